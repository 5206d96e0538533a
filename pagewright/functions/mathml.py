"""Presentation MathML to TeX, and plain text to TeX.

Plain Python over ElementTree, free of Spark. Each conversion counts what it repaired or
lost. Null, or what does not parse, gives null.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache
from xml.etree import ElementTree

# TeX of letter-like characters, by name where TeX and Unicode agree, and else as listed.
_LETTERS = "alpha beta gamma delta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega"
LETTERS = {unicodedata.lookup(f"GREEK {'CAPITAL' if n[0].isupper() else 'SMALL'} LETTER {n.upper().replace('LAMBDA', 'LAMDA')}"): f"\\{n}" for n in _LETTERS.split()} | {
    "ε": r"\varepsilon",
    "ς": r"\varsigma",
    "φ": r"\varphi",
    "ϐ": r"\beta",
    "ϑ": r"\vartheta",
    "ϕ": r"\phi",
    "ϖ": r"\varpi",
    "ϵ": r"\epsilon",
    "ℏ": r"\hbar",
    "ℓ": r"\ell",
    "ℕ": r"\mathbb{N}",
    "℘": r"\wp",
    "ℚ": r"\mathbb{Q}",
    "ℛ": r"\Re",
    "ℝ": r"\mathbb{R}",
    "ℤ": r"\mathbb{Z}",
    "ℱ": r"\mathcal{F}",
    "ℵ": r"\aleph",
    "∅": r"\emptyset",
    "∝": r"\propto",
    "∠": r"\angle",
    "∥": r"\|",
    "≃": r"\simeq",
    "≅": r"\cong",
    "⊥": r"\perp",
}
# TeX of operators and spaces, in order of code points.
OPERATORS = {
    "*": r"\ast",
    "\u00a0": " ",
    "¬": r"\neg",
    "°": r"^{\circ}",
    "±": r"\pm",
    "²": "^{2}",
    "³": "^{3}",
    "¹": "^{1}",
    "×": r"\times",
    "÷": r"\div",
    "˜": r"\sim",
    "\u2003": r"\quad",
    "\u2009": r"\,",
    "\u200a": r"\,",
    "\u200b": "",
    "\u200d": "",
    "‖": r"\Vert",
    "‗": "_",
    "…": r"\cdots",
    "′": "'",
    "″": "''",
    "\u2060": "",
    "\u2061": "",
    "\u2062": "",
    "\u2063": "",
    "\u2064": "+",
    "←": r"\leftarrow",
    "→": r"\to",
    "⇒": r"\Rightarrow",
    "∀": r"\forall",
    "∂": r"\partial",
    "∃": r"\exists",
    "∇": r"\nabla",
    "∈": r"\in",
    "∉": r"\notin",
    "∋": r"\ni",
    "∏": r"\prod",
    "∑": r"\sum",
    "−": "-",
    "∗": "*",
    "∘": r"\circ",
    "∙": r"\cdot",
    "∞": r"\infty",
    "∧": r"\wedge",
    "∨": r"\vee",
    "∩": r"\cap",
    "∪": r"\cup",
    "∫": r"\int",
    "∼": r"\sim",
    "≈": r"\approx",
    "≠": r"\neq",
    "≡": r"\equiv",
    "≤": r"\leq",
    "≥": r"\geq",
    "⊂": r"\subset",
    "⊃": r"\supset",
    "⊆": r"\subseteq",
    "⊇": r"\supseteq",
    "⊕": r"\oplus",
    "⊗": r"\otimes",
    "⋀": r"\bigwedge",
    "⋁": r"\bigvee",
    "⋂": r"\bigcap",
    "⋃": r"\bigcup",
    "⋅": r"\cdot",
    "⋮": r"\vdots",
    "⋯": r"\cdots",
    "⋱": r"\ddots",
    "\u2329": r"\langle",
    "\u232a": r"\rangle",
    "⟨": r"\langle",
    "⟩": r"\rangle",
    "\u3008": r"\langle",
    "\u3009": r"\rangle",
}
# Names set as functions, operators with limits, accents.
FUNCTIONS = frozenset("arg cos deg det dim exp inf ker lim ln log max min sin sup tan".split())
LIMITS = frozenset(rf"\{n}" for n in "bigcap bigcup iint inf int lim liminf limsup max min prod sum sup".split())
ACCENTS = {"^": "hat", "¯": "bar", "ˉ": "bar", "-": "bar", "~": "tilde", "˜": "tilde", "→": "overrightarrow", "←": "overleftarrow", ".": "dot", "¨": "ddot"}

LOST_MAX = 12


@lru_cache(1)
def known_commands() -> frozenset[str]:
    """Names of all commands that the tables give."""
    commands = [*LETTERS.values(), *OPERATORS.values(), *(f"\\{f}" for f in FUNCTIONS)]
    return frozenset(c[1:] for c in commands if re.fullmatch(r"\\[A-Za-z]+", c))


class Stats:
    """What conversions repaired and lost."""

    def __init__(self):
        self.counts: Counter[str] = Counter()
        self.sets: dict[str, set[str]] = {"unknown_tags": set(), "lost_text": set(), "lost_math": set()}

    def lose(self, kind: str, char: str) -> str:
        self.sets[kind].add(f"U+{ord(char):04X}")
        return "?"

    def row(self) -> dict:
        counts = {k: self.counts[k] for k in ("unclosed_fences", "short_fractions", "matrices", "folded")}
        return counts | {k: sorted(v)[:LOST_MAX] for k, v in self.sets.items()}


def _folded(char: str) -> str:
    return unicodedata.normalize("NFKD", char)


def text_to_tex(text: str, stats: Stats) -> str:
    """Characters of plain text in math mode: by the tables, else by what they fold to."""
    out = []
    for ch in text:
        tex = LETTERS.get(ch, OPERATORS.get(ch))
        if tex is None and ch < "\x80":
            tex = ch
        if tex is None:
            fold = _folded(ch)
            tex = LETTERS.get(fold)
        if tex is None:
            plain = "".join(c for c in fold if c < "\x80")
            if plain and re.fullmatch("[A-Za-z0-9+=-]+", plain):
                stats.counts["folded"] += 1
                tex = plain if len(plain) == 1 else rf"\mathrm{{{plain}}}"
        out.append(stats.lose("lost_text", ch) if tex is None else tex)
    return "".join(out)


def _identifier_char(ch: str, stats: Stats) -> tuple[str, bool]:
    """TeX of one character, and whether a variant may still change it."""
    if ch in LETTERS:
        return LETTERS[ch], True
    if ch in OPERATORS:
        return OPERATORS[ch], False
    fold = _folded(ch)
    for candidate in (fold, ch):
        if candidate in LETTERS:
            return LETTERS[candidate], True
        if len(candidate) == 1 and candidate < "\x80" and candidate.isalnum():
            return candidate, True
    return stats.lose("lost_math", ch), False


def _varied(tex: str, variant: str) -> str:
    command, single = tex.startswith("\\"), len(tex) == 1
    if variant == "bold":
        return rf"\boldsymbol{{{tex}}}" if command else rf"\mathbf{{{tex}}}"
    if command or variant == "double-struck" and tex.islower():
        return tex
    font = {"normal": "mathrm", "sans-serif": "mathsf", "monospace": "mathsf"}.get(variant) or (single and {"script": "mathcal", "double-struck": "mathbb", "fraktur": "mathfrak"}.get(variant))
    return rf"\{font}{{{tex}}}" if font else tex


def identifier(text: str, variant: str, stats: Stats) -> str:
    name = text.replace("\u00a0", "").strip()
    if len(name) < 2:
        if not name:
            return ""
        tex, may_vary = _identifier_char(name, stats)
        return _varied(tex, variant) if may_vary else tex
    word = "".join(c for c in name if c < "\x80" or c in LETTERS)
    if word in FUNCTIONS:
        return f"\\{word}"
    if word.isascii() and word.isalpha():
        return rf"\{'mathrm' if variant == 'normal' else 'mathit'}{{{word}}}"
    return text_to_tex(name, stats)


def end_scripts(tex: str) -> set[str]:
    """The kinds of scripts that stand at the very end of ``tex``, outside of any group."""
    found: set[str] = set()
    end = len(tex)
    while end:
        begin = end - 1
        if tex[begin] == "}":
            depth = 1
            while begin and depth:
                begin -= 1
                depth += (tex[begin] == "}") - (tex[begin] == "{")
        elif tex[begin] in "{^_":
            break
        if begin < 1 or tex[begin - 1] not in "^_":
            break
        found.add(tex[begin - 1])
        end = begin - 1
    return found


def concat(parts) -> str:
    """Siblings together; an empty atom where a script would meet one of its kind."""
    out = ""
    for part in parts:
        if out and part[:1] in ("^", "_") and part[0] in end_scripts(out):
            out += "{}"
        out += part
    return out


_ESCAPES = {"\\": r"\textbackslash\{\}", "{": r"\{", "}": r"\}", "_": r"\_", "%": r"\%", "&": r"\&", "#": r"\#"}


def _tag(el) -> str:
    return el.tag.rpartition("}")[2] if isinstance(el.tag, str) else ""


def _elements(el) -> list:
    return [c for c in el if isinstance(c.tag, str)]


class Converter:
    """One element to TeX; a method for each kind of element."""

    def __init__(self, stats: Stats):
        self.stats = stats

    def tex(self, el) -> str:
        method = getattr(self, f"on_{_tag(el)}", None)
        if method is None:
            self.stats.sets["unknown_tags"].add(_tag(el))
            return self.all(el)
        return method(el)

    def all(self, el) -> str:
        return concat(map(self.tex, _elements(el)))

    def kids(self, el, n: int) -> list[str]:
        found = [self.tex(c) for c in _elements(el)[:n]]
        return found + [""] * (n - len(found))

    on_mrow = on_mstyle = on_mpadded = on_mphantom = all

    def on_semantics(self, el):
        return concat(self.tex(c) for c in [c for c in _elements(el) if _tag(c) != "annotation"][:1])

    def on_annotation(self, el):
        return ""

    def on_mi(self, el):
        return identifier(el.text or "", el.get("mathvariant", "").strip(), self.stats)

    def on_mn(self, el):
        return text_to_tex((el.text or "").strip(), self.stats)

    def on_mo(self, el):
        sign = (el.text or "").strip()
        if sign in ("{", "}"):
            return r"\left\{" if sign == "{" else r"\right\}"
        if sign in ("(", "[", ")", "]") and el.get("stretchy") == "true":
            return (r"\left" if sign in "([" else r"\right") + sign
        return OPERATORS.get(sign) if sign in OPERATORS else text_to_tex(sign, self.stats)

    def on_mtext(self, el):
        text = "".join(el.itertext())
        # a backslash's own braces are escaped like any others
        return rf"\text{{{''.join(_ESCAPES.get(c, c) for c in text)}}}"

    def on_mspace(self, el):
        found = re.fullmatch(r"\s*([+-]?[0-9.]+)em\s*", el.get("width", ""))
        try:
            width = float(found[1]) if found else 0.0
        except ValueError:
            width = 0.0
        return r"\quad" if width >= 1 else r"\;" if width >= 0.2 else r"\,"

    def on_mfrac(self, el):
        if len(_elements(el)) < 2:
            self.stats.counts["short_fractions"] += 1
            return self.all(el)
        return r"\frac{%s}{%s}" % tuple(self.kids(el, 2))

    def on_msqrt(self, el):
        return rf"\sqrt{{{self.all(el)}}}"

    def on_mroot(self, el):
        if len(_elements(el)) < 2:
            return self.on_msqrt(el)
        base, degree = self.kids(el, 2)
        return rf"\sqrt[{degree}]{{{base}}}"

    def _with_scripts(self, el, sub: bool, sup: bool):
        base, *scripts = self.kids(el, 1 + sub + sup)
        marks = [m for m, there in (("_", sub), ("^", sup)) if there]
        if not base:
            # a prescript: what there is of the last kind floats left
            return f"{marks[-1]}{{{scripts[-1]}}}"
        single = len(base) == 1 or re.fullmatch(r"\\[A-Za-z]+", base)
        if not single and not base.startswith(("\\left", "(", "[")):
            base = f"{{{base}}}"
        taken = end_scripts(base)
        base += "{}" * sum(1 for m, s in zip(marks, scripts) if s and m in taken)
        return base + "".join(f"{m}{{{s}}}" for m, s in zip(marks, scripts))

    def on_msub(self, el):
        return self._with_scripts(el, True, False)

    def on_msup(self, el):
        return self._with_scripts(el, False, True)

    def on_msubsup(self, el):
        return self._with_scripts(el, True, True)

    def _with_limits(self, el, under: bool, over: bool):
        base, *rest = self.kids(el, 1 + under + over)
        low, high = (rest[0] if under else None), (rest[-1] if over else None)
        if base in LIMITS:
            return base + "".join(f"{m}{{{s}}}" for m, s in (("_", low), ("^", high)) if s is not None)
        if low is None and high in ACCENTS:
            return rf"\{ACCENTS[high]}{{{base}}}"
        if low is not None:
            base = rf"\underset{{{low}}}{{{base}}}"
        return base if high is None else rf"\overset{{{high}}}{{{base}}}"

    def on_munder(self, el):
        return self._with_limits(el, True, False)

    def on_mover(self, el):
        return self._with_limits(el, False, True)

    def on_munderover(self, el):
        return self._with_limits(el, True, True)

    def on_mtable(self, el):
        self.stats.counts["matrices"] += 1
        rows = [r for r in _elements(el) if _tag(r) in ("mtr", "mlabeledtr")]
        body = r" \\ ".join(" & ".join(self.all(c) for c in _elements(r) if _tag(c) == "mtd") for r in rows)
        return rf"\begin{{matrix}} {body} \end{{matrix}}"

    def on_mfenced(self, el):
        inner = f" {el.get('separators', ',')} ".join(map(self.tex, _elements(el)))
        return el.get("open", "(") + inner + el.get("close", ")")


def element_to_tex(el, stats: Stats) -> str:
    """A formula element to TeX without dollar signs. Every ``\\left`` counts as a fence, those of arrows too."""
    from .latex import split_commands

    converter = Converter(stats)
    tex = split_commands(converter.all(el) if _tag(el) == "math" else converter.tex(el))
    missing = max(tex.count("\\left") - tex.count("\\right"), 0)
    stats.counts["unclosed_fences"] += missing
    return (tex + " \\right." * missing).strip()


def convert(xml: str) -> dict | None:
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return None
    stats = Stats()
    return {"tex": element_to_tex(root, stats)} | stats.row()


_FUSIONS = ((re.compile(r"\*\$([^$]*\\[^$]*)\$\*"), r"$\1$"), (re.compile(r"\$([^$]*)\$\$([_^]\{[^$]*\})\$"), r"$\1\2$"), (re.compile(r"\$([^$]+)\$\$([^$]+)\$"), r"$\1\2$"))


def fuse(text: str) -> str:
    """Math runs that stand together as one, until nothing changes."""
    before = None
    while text != before:
        before = text
        for pattern, to in _FUSIONS:
            text = pattern.sub(to, text)
    return text

"""Scholarly articles in JATS XML as Markdown: sections, citations, formulas, figures, tables, references.

Plain Python over ElementTree, free of Spark. ``convert`` raises on what is no article or has unbalanced dollar signs;
``convert_or_error`` returns the reason as data, so that one bad article never fails a job.
"""

from __future__ import annotations

import re
from xml.etree import ElementTree

from . import mathml

OPEN, CLOSE = "\ue000", "\ue001"
_PLACE = re.compile(f"{OPEN}([0-9]+){CLOSE}")
_CAPTION_PREFIX = re.compile(r"^(?:fig(?:ure)?|table)\.?\s*\w+\.?\s*", re.I)
_SILENT = frozenset(("title", "caption", "label", "object-id", "supplementary-material", "media"))
ALT_CHARS, ALT_LEAST = 160, 130


class ArticleError(ValueError):
    """What cannot be converted faithfully."""


def without_doctype(xml: str) -> str:
    """``xml`` without its document type declaration, whose quotes and internal subset may hold angle brackets."""
    start = xml.find("<!DOCTYPE")
    if start < 0:
        return xml
    quote, depth = "", 0
    for i in range(start + 9, len(xml)):
        c = xml[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[]":
            depth = max(depth + (1 if c == "[" else -1), 0)
        elif c == ">" and not depth:
            return xml[:start] + xml[i + 1 :]
    return xml


def collapse(text: str) -> str:
    return " ".join(text.split())


def tag(el) -> str:
    return el.tag.rpartition("}")[2] if isinstance(el.tag, str) else ""


def elements(el) -> list:
    return [c for c in el if isinstance(c.tag, str)]


def child(el, name: str):
    return next((c for c in elements(el) if tag(c) == name), None)


def inside(el, name: str) -> list:
    return [c for c in el.iter() if tag(c) == name]


def whole_text(el) -> str:
    return "".join(el.itertext())


def prose(text: str) -> str:
    """A text run with its white space as spaces; dollar signs escaped, bars made slashes."""
    spaced = re.sub(r"\s", " ", text)
    return spaced.replace("$", "\\$").replace("|", "/").replace("[ [`ref", "[[`ref")


def equation(tex: str, label: str) -> str:
    tex, label = tex.strip(), label.strip()
    if not tex:
        return ""
    number = label[1:-1] if len(label.encode()) > 2 and label[0] == "(" and label[-1] == ")" else label
    return f"$${tex} \\tag{{{number}}}$$" if number else f"$${tex}$$"


def check_dollars(text: str, what: str) -> str:
    if text.count("$") % 2:
        raise ArticleError(f"unbalanced `$` in {what}: {text[:120]}")
    return text


def short_alt(label: str, caption: str) -> str:
    """Label and caption as alternative text: no brackets, cut near a word's end, never inside a formula."""
    alt = ": ".join(t for t in (label, caption) if t).replace("[", "").replace("]", "")
    if len(alt) > ALT_CHARS:
        cut = alt[:ALT_CHARS]
        space = cut.rfind(" ")
        # how far back a space may be is told in bytes
        alt = cut[:space] if space >= 0 and len(cut[:space].encode()) >= ALT_LEAST else cut
    signs = [m.start() for m in re.finditer(r"(?<!\\)\$", alt)]
    return alt[: signs[-1]].rstrip() if len(signs) % 2 else alt


class Article:
    """State of one conversion: citation keys, displayed formulas that wait for their paragraph, counts."""

    def __init__(self, root):
        if tag(root) != "article":
            raise ArticleError("not a JATS article")
        self.root, self.stats = root, mathml.Stats()
        self.displays: list[tuple[str, str]] = []
        self.n_formulas = self.n_figures = self.n_tables = 0
        self.back = next(iter(inside(root, "back")), None)
        self.refs = [] if self.back is None else inside(self.back, "ref")
        self.keys = {r.get("id"): f"ref{n:02d}" for n, r in enumerate(self.refs, 1) if r.get("id") is not None}
        self.out: list[str] = []

    # ------------------------------------------------------------------------------------------ inline

    def formula(self, el) -> str:
        math = next(iter(inside(el, "math")), None)
        math = next(iter(elements(el)), None) if math is None else math
        return "" if math is None else mathml.element_to_tex(math, self.stats)

    def script(self, el, mark: str) -> str:
        text = collapse(whole_text(el))
        return text if "$" in text else f"${mark}{{{mathml.text_to_tex(text, self.stats)}}}$"

    def inline(self, el) -> str:
        kind = tag(el)
        if kind == "xref" and el.get("ref-type") == "bibr":
            return "".join(f" [`{self.keys[r]}`]" for r in el.get("rid", "").split() if r in self.keys)
        if kind in ("sup", "sub"):
            return self.script(el, "^" if kind == "sup" else "_")
        if kind in ("italic", "i", "bold", "b"):
            stars = "*" if kind[0] == "i" else "**"
            return f"{stars}{collapse(whole_text(el))}{stars}"
        if kind in ("ext-link", "uri", "email"):
            return collapse(whole_text(el))
        if kind == "inline-formula":
            tex = self.formula(el)
            self.n_formulas += bool(tex)
            return f"${tex}$" if tex else ""
        if kind == "disp-formula":
            tex, label = self.formula(el), child(el, "label")
            self.n_formulas += bool(tex)
            self.displays.append((tex, "" if label is None else collapse(whole_text(label))))
            return f"{OPEN}{len(self.displays) - 1}{CLOSE}"
        return self.rich(el)

    def rich(self, el) -> str:
        parts = [prose(el.text or "")]
        for c in el:
            if isinstance(c.tag, str):
                parts.append(self.inline(c))
            parts.append(prose(c.tail or ""))
        return collapse("".join(parts))

    def display(self, number: str) -> tuple[str, str]:
        return self.displays[int(number)] if int(number) < len(self.displays) else ("", "")

    def displays_inline(self, text: str) -> str:
        """Displayed formulas where none can stand, as inline ones."""

        def one(found):
            tex = self.display(found[1])[0].strip()
            return f"${tex}$" if tex else ""

        return _PLACE.sub(one, text)

    def rich_child(self, el, name: str) -> str:
        found = child(el, name)
        return "" if found is None else self.displays_inline(mathml.fuse(self.rich(found)))

    # ------------------------------------------------------------------------------------------ blocks

    def paragraph(self, text: str) -> None:
        """Text with its formulas fused, parted at displayed formulas."""
        parts = _PLACE.split(mathml.fuse(text))
        for i, part in enumerate(parts):
            if i % 2:
                self.out += filter(None, [equation(*self.display(part))])
            elif part.strip():
                self.out.append(check_dollars(part.strip(), "paragraph"))

    def rich_paragraph(self, el, before: str = "") -> None:
        text = self.rich(el)
        if text:
            self.paragraph(before + text)

    def captioned(self, el) -> tuple[str, str]:
        label, caption = self.rich_child(el, "label"), child(el, "caption")
        return label, "" if caption is None else _CAPTION_PREFIX.sub("", self.rich(caption))

    def figure(self, el) -> None:
        self.n_figures += 1
        label, caption = self.captioned(el)
        graphic = next(iter(inside(el, "graphic")), None)
        links = [] if graphic is None else [v for k, v in graphic.attrib.items() if k.rpartition("}")[2] == "href"]
        if links and links[0]:
            self.out.append(f"![{short_alt(label, caption)}]({links[0]})")
        else:
            self.out.append(f"**{label or 'Figure'}.** {caption} (figure image not in JATS).")

    def cell(self, el) -> str:
        text = self.displays_inline(self.rich(el).replace("|", " / "))
        return f"{{}} {text}" if text.lstrip().startswith("[") else text

    def table(self, el) -> None:
        label, caption = self.captioned(el)
        body = next(iter(inside(el, "table")), None)
        rows = [] if body is None else [[self.cell(c) for c in elements(tr) if tag(c) in ("td", "th")] for tr in inside(body, "tr")]
        rows = [r for r in rows if r]
        if not rows:
            return
        self.n_tables += 1
        width = max(map(len, rows))
        if label or caption:
            self.out += [f"**{label or 'Table'}.** {caption}", ""]
        lines = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in rows]
        self.out += [lines[0], f"|{'|'.join(['---'] * width)}|", *lines[1:]]

    def section(self, el, depth: int) -> None:
        title = self.rich_child(el, "title") or "Section"
        self.out.append(f"{'#' * (depth + 2)} {title}\n" if depth < 2 else f"**{title}.**\n")
        for c in elements(el):
            self.block(c, depth + 1)

    def block(self, el, depth: int) -> None:
        kind = tag(el)
        if kind in _SILENT:
            return
        if kind == "sec":
            self.section(el, depth)
        elif kind == "fig":
            self.figure(el)
        elif kind == "table-wrap":
            self.table(el)
        elif kind == "list":
            for item in inside(el, "list-item"):
                self.rich_paragraph(item, "- ")
        elif kind == "boxed-text":
            for p in inside(el, "p"):
                self.rich_paragraph(p)
        elif kind == "disp-formula":
            tex, label = self.formula(el), child(el, "label")
            if tex:
                self.n_formulas += 1
                self.out.append(equation(tex, "" if label is None else collapse(whole_text(label))))
        else:
            self.rich_paragraph(el)

    # ------------------------------------------------------------------------------------------ parts

    def convert(self) -> dict:
        front = next(iter(inside(self.root, "front")), None)
        meta = None if front is None else child(front, "article-meta")
        group = None if meta is None else child(meta, "title-group")
        heading = None if group is None else child(group, "article-title")
        title = "" if heading is None else check_dollars(mathml.fuse(self.rich(heading)).strip(), "title")
        self.out.append(f"# {title}\n")
        abstract = None if meta is None else child(meta, "abstract")
        if abstract is not None:
            self.out.append("## Abstract\n")
            for p in elements(abstract):
                if tag(p) == "p":
                    self.rich_paragraph(p)
        body = next(iter(inside(self.root, "body")), None)
        for c in [] if body is None else elements(body):
            if tag(c) == "sec":
                self.section(c, 0)
            else:
                self.block(c, 1)
        self.acknowledgements()
        self.references()
        text = "\n".join(b if b.endswith("\n") else b + "\n" for b in self.out)
        return {"markdown": text, "title": title, "n_formulas": self.n_formulas, "n_figures": self.n_figures, "n_tables": self.n_tables}

    def acknowledgements(self) -> None:
        ack = None if self.back is None else child(self.back, "ack")
        texts = [] if ack is None else [t for t in map(self.rich, inside(ack, "p")) if t]
        if texts:
            self.out.append("## Acknowledgements\n")
            for t in texts:
                self.paragraph(t)

    def references(self) -> None:
        named = [r for r in self.refs if r.get("id") is not None]
        if named:
            self.out.append("## References\n")
            self.out += [f"- [`{self.keys[r.get('id')]}`] {collapse(whole_text(r))}" for r in named]


def convert(xml: str) -> dict:
    try:
        root = ElementTree.fromstring(without_doctype(xml))
    except ElementTree.ParseError as error:
        raise ArticleError(f"XML parse: {error}") from error
    return Article(root).convert()


def convert_or_error(xml: str) -> dict:
    try:
        return convert(xml) | {"error": None}
    except ArticleError as error:
        return dict.fromkeys(("markdown", "title", "n_formulas", "n_figures", "n_tables")) | {"error": str(error)}

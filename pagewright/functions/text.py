"""Text rules of scholarly Markdown as Catalyst expressions: headings, titles, captions, TeX checks, page signals.

Everything here takes and returns columns, so plans that use it stay in the JVM. Lengths called "bytes" count UTF-8
bytes. White space is Unicode white space. A null text gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a page's glyphs, labels and captions are judged by.
MATH_FONTS = ("cmmi", "cmsy", "cmex", "msam", "msbm", "math", "symbol", "mathjax", "stix", "xits", "asana", "euclid")
MATH_RANGES = ((0x0370, 0x03FF), (0x2200, 0x22FF), (0x2A00, 0x2AFF), (0x27C0, 0x27EF), (0x2980, 0x29FF), (0x1D400, 0x1D7FF))
MONO_FONTS = ("mono", "courier", "consol", "menlo", "inconsolata", "sourcecode", "dejavu sans mono", "fixed", "terminal")
MATH_LABELS = ("equation", "display_formula", "inline_formula", "isolate_formula", "formula")
CAPTION_LABELS = ("caption", "footnote", "figure_title", "table_title")
CAPTION_WORDS = ("figure", "fig", "table", "abb", "plate")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "tif", "tiff", "svg", "avif", "heic", "heif")
DOCUMENT_EXTENSIONS = ("pdf", "docx", "xlsx", "pptx", "doc", "xls", "ppt")
TEXT_EXTENSIONS = ("txt", "md", "markdown", "rst", "text")
PAGE_BREAK = "\n\n---\n\n"

#: A token that reads as a floating-point number, with the words for infinity and not-a-number.
NUMBER = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"


def let(value, body) -> Column:
    """``body(value)`` with the value computed once, however often and in whatever lambda the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: All characters of the Unicode property White_Space.
WHITE = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def trim(c) -> Column:
    return F.btrim(c, F.lit(WHITE))


def collapse(c) -> Column:
    """Runs of white space as one space each, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c) -> Column:
    return F.filter(F.split(c, r"(?U)\s+", -1), lambda w: w != "")


def count_of(c, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def contains_any(c, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out


# ---------------------------------------------------------------------------------------------- page signals


def is_math_char(ch) -> Column:
    return F.rlike(ch, F.lit("[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in MATH_RANGES) + "]"))


def is_math_font(font) -> Column:
    return F.rlike(F.lower(font), F.lit("|".join(MATH_FONTS)))


def is_mono_font(font) -> Column:
    return F.rlike(F.lower(font), F.lit("|".join(MONO_FONTS)))


def is_math_glyph(ch, font) -> Column:
    return is_math_font(font) | is_math_char(ch)


def needs_models(n_math, n_chars, n_images, mode="auto", use_models: bool = True, math_chars: int = 30, min_text: int = 50) -> Column:
    """Whether a page goes to the expensive route; ``mode`` is a word or a column of words."""
    if not use_models:
        return F.lit(False)
    mode = F.lit(mode) if isinstance(mode, str) else mode
    mathy = (n_math > math_chars) & ((n_chars == 0) | (n_math / n_chars > 0.02))
    scanned = (n_chars < min_text) & (n_images > 0)
    return F.when(mode == "never", False).when(mode == "always", True).otherwise(mathy | scanned)


# ---------------------------------------------------------------------------------------------- labels


def claim_priority(label) -> Column:
    """0 math, 1 table, 2 caption, 3 text, 9 for what owns no text; captions are told apart first."""
    low = F.lower(label)
    return (
        F.when(contains_any(low, CAPTION_LABELS), 2)
        .when(F.contains(low, F.lit("table")), 1)
        .when(contains_any(low, MATH_LABELS), 0)
        .when(contains_any(low, ("figure", "image", "chart", "seal")), 9)
        .otherwise(3)
    )


def is_figure(label) -> Column:
    return contains_any(F.lower(label), ("figure", "image"))


# ---------------------------------------------------------------------------------------------- headings and titles


def section_prefix(bare) -> Column:
    """``struct(level, rest, risky)`` of a numbered heading, null without a prefix. ``bare`` is trimmed."""
    number = r"^([0-9]+(?:\.[0-9]+)*)\.?[ \t]([\s\S]*)$"
    roman = r"^(?:XII|XI|IX|VIII|VII|VI|IV|X|V|III|II|I)\. ([\s\S]*)$"
    letter = r"^[A-Z]\. ([\s\S]*)$"
    num = F.regexp_extract(bare, number, 1)
    parts = F.size(F.split(num, r"\.", -1))
    level = F.when(parts == 1, 2).when(parts == 2, 3).otherwise(4)

    def found(level, pattern, group, risky):
        rest = trim(F.regexp_extract(bare, pattern, group))
        return F.when(rest != "", F.struct(level.cast("int").alias("level"), rest.alias("rest"), risky.alias("risky")))

    return (
        F.when(F.rlike(bare, F.lit(number)) & ~F.rlike(num, F.lit("^0+$")), found(level, number, 2, parts == 1))
        .when(F.rlike(bare, F.lit(roman)), found(F.lit(2), roman, 1, F.lit(True)))
        .when(F.rlike(bare, F.lit(letter)), found(F.lit(3), letter, 1, F.lit(False)))
    )


def has_number(c, strip: str = "") -> Column:
    """Whether a word reads as a number, after ``strip`` characters are cut from its end."""
    return F.exists(words(c), lambda w: F.rlike(F.rtrim(w, F.lit(strip)) if strip else w, F.lit(NUMBER)))


def is_short_title(rest) -> Column:
    return (
        ~F.rlike(rest, F.lit(r"[.,;:]$|[,=]"))
        & ~has_number(rest)
        & F.rlike(rest, F.lit(r"(?U)^\s*\p{Lu}"))
        & (F.size(words(rest)) <= 8)
    )


def is_plausible_heading(rest) -> Column:
    letters, upper = count_of(rest, "[A-Za-z]"), count_of(rest, "[A-Z]")
    return (
        (rest != "")
        & (F.octet_length(rest) <= 100)
        & ~F.rlike(rest, F.lit(r"[.,;!]$|="))
        & (F.size(words(rest)) <= 14)
        & ~has_number(rest)
        & (letters >= 3)
        & (upper * 10 >= letters * 7)
    )


def is_bold_dominant(line) -> Column:
    """At least 60 % of what is not white space stands between pairs of double stars."""
    parts = F.split(line, r"\*\*", -1)
    inside = F.array_join(F.filter(parts, lambda _, i: i % 2 == 1), "")
    bold, total = (F.length(F.regexp_replace(c, r"(?U)\s", "")) for c in (inside, F.replace(line, F.lit("**"), F.lit(""))))
    return (F.size(parts) >= 3) & (total > 0) & (bold * 10 >= total * 6)


#: What the first characters of a line must be before the dearer rules look at it.
_MAY_HEAD = r"^(?:\*\*|[0-9]|[A-Z]\.|[IVX]+\.|\s)"


def heading_line(line) -> Column:
    """The heading that a trimmed line becomes, or null."""

    def heading(prefix):
        rest = prefix["rest"]
        ok = is_plausible_heading(rest) | is_bold_dominant(line) | (~prefix["risky"] & is_short_title(rest))
        return F.when(prefix.isNotNull() & ok, F.concat(F.repeat(F.lit("#"), prefix["level"]), F.lit(" "), rest))

    no = F.rlike(line, F.lit(r"^[#|>\-!]|^\* |^\*$")) | ~F.rlike(line, F.lit(_MAY_HEAD))
    bare = trim(F.replace(line, F.lit("**"), F.lit("")))
    return F.when(~no, let(bare, lambda b: let(section_prefix(b), heading)))


#: A line that opens or closes a fence; only line feeds end lines.
_FENCE = r"(?mdU)^[^\S\n]*```[^\n]*$"


def promote_headings(md) -> Column:
    """Headings promoted line by line, but not inside fences: every other stretch between fence lines is code."""

    def stretch(part, i):
        lines = F.transform(F.split(part, "\n", -1), lambda line: F.coalesce(heading_line(trim(line)), line))
        return F.when(i % 2 == 0, F.array_join(lines, "\n")).otherwise(part)

    def fenced(open_lines):
        # the lines that begin and end fences stand between the stretches
        return F.array_join(F.transform(F.split(md, _FENCE, -1), lambda p, i: F.concat(stretch(p, i), F.coalesce(F.get(open_lines, i), F.lit("")))), "")

    return F.when(F.contains(md, F.lit("```")), let(F.regexp_extract_all(md, F.lit(_FENCE), F.lit(0)), fenced)).otherwise(stretch(md, F.lit(0)))


def is_title(t) -> Column:
    return (
        ~F.rlike(t, F.lit(r"^[*•\x{2217}\x{2212}\-]|[=+@]|\)\("))
        & (count_of(t, ",") < 2)
        & ~has_number(t, ",")
        & (F.octet_length(t) <= 120)
        & (F.size(words(t)) <= 25)
    )


def title_place(md) -> Column:
    """``struct(line, title)``: the line number (from 1) of the document's title and its text; null without one."""
    row = lambda n, t: F.struct(n.cast("int").alias("line"), t.alias("title"))

    def opening(trimmed, first):
        t = F.get(trimmed, (first - 1).cast("int"))
        ok = (first > 0) & ~F.startswith(t, F.lit("#")) & is_title(t) & ~F.rlike(t, F.lit("[.,;]$"))
        return F.when(ok, row(first, t))

    def later(trimmed):
        page_end = F.array_position(trimmed, "---")
        page = F.when(page_end > 0, F.slice(trimmed, 1, (page_end - 1).cast("int"))).otherwise(trimmed)
        headed = F.transform(page, lambda t: F.when(F.rlike(t, F.lit("^##")), trim(F.regexp_extract(t, r"^#+([\s\S]*)$", 1))))
        places = F.transform(headed, lambda h, i: F.when(h.isNotNull() & is_title(h), row(i + 1, h)))
        return F.get(F.array_compact(places), F.lit(0))

    def find(trimmed):
        first = F.array_position(F.transform(trimmed, lambda t: (t != "") & (t != "---")), True)
        return F.coalesce(let(first, lambda n: opening(trimmed, n)), later(trimmed))

    return let(F.transform(F.split(md, "\n", -1), trim), find)


def promote_title(md) -> Column:
    """The document's title as its one first-level heading."""

    return let(title_place(md), lambda place: with_title(md, place))


def with_title(md, place) -> Column:
    """``md`` with the title at ``place`` (``title_place``) promoted."""
    lines = F.transform(F.split(md, "\n", -1), lambda line, i: F.when(i + 1 == place["line"], F.concat(F.lit("# "), place["title"])).otherwise(line))
    return F.when(place.isNull(), md).otherwise(F.array_join(lines, "\n"))


# ---------------------------------------------------------------------------------------------- captions and blocks


def caption_alt(text, max_bytes: int = 120) -> Column:
    """A caption as alternative text of an image, cut at a word; null for what is no caption."""
    parts = words(text)
    first = F.lower(F.rtrim(F.get(parts, F.lit(0)), F.lit(".:")))
    ok = first.isin(*CAPTION_WORDS) & F.rlike(F.get(parts, F.lit(1)), F.lit("[0-9A-Za-z]"))

    def add(acc, w):
        full = F.octet_length(acc["out"]) + F.octet_length(w) + 1 > max_bytes
        longer = F.when(acc["out"] == "", w).otherwise(F.concat(acc["out"], F.lit(" "), w))
        out = F.when(acc["done"], acc["out"]).when(full, F.concat(acc["out"], F.lit("…"))).otherwise(longer)
        return F.struct(out.alias("out"), (acc["done"] | full).alias("done"))

    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("done"))
    return F.when(F.coalesce(ok, F.lit(False)), F.translate(F.aggregate(parts, start, add)["out"], "[]", ""))


def caption_block(label, text) -> Column:
    """Text of a caption region as a block of its own; null if it is none or blank."""
    return F.when(contains_any(F.lower(label), CAPTION_LABELS) & (trim(text) != ""), text)


def text_block(label, text) -> Column:
    """Text of a region, as a second-level heading if the label says title; null if blank."""
    head = F.when(F.contains(F.lower(label), F.lit("title")), F.concat(F.lit("## "), text)).otherwise(text)
    return F.when(trim(text) != "", head)


def is_display_latex(tex) -> Column:
    """Whether recognized TeX reads as a displayed equation: structure, no prose, no word more than four times."""
    low = F.lower(tex)
    # five equal words stand together once the words are sorted
    often = let(F.array_sort(words(low)), lambda ws: F.exists(F.sequence(F.lit(0), F.greatest(F.size(ws) - 5, F.lit(0))), lambda i: F.coalesce(F.get(ws, i) == F.get(ws, i + 4), F.lit(False))))
    return (
        ~contains_any(low, ("\\mbox{", "\\text{", " the ", " with ", " and "))
        & ~often
        & contains_any(low, ("=", "+", "^", "_", "\\frac", "\\sum", "\\int", "\\sqrt"))
    )


def wrap_math(tex, height, width, line_height, inline_max_width: float = 220.0) -> Column:
    """Displayed if tall or wide, else inline."""
    display = (height > 1.6 * line_height) | (width > inline_max_width)
    return F.when(display, F.concat(F.lit("$$\n"), tex, F.lit("\n$$"))).otherwise(F.concat(F.lit("$"), tex, F.lit("$")))


def token_budget(width, height) -> Column:
    """Decoding steps that a crop may take, by its area."""
    return F.least(F.greatest(width * height / 40, F.lit(64.0)), F.lit(512.0)).cast("int")


def emit_equation(tex, label) -> Column:
    """``$$tex \\tag{n}$$``; parentheses of the label go, a blank formula gives nothing."""
    t, lab = trim(tex), trim(label)
    num = F.when((F.octet_length(lab) > 2) & F.rlike(lab, F.lit(r"^\([\s\S]*\)$")), F.substr(lab, F.lit(2), F.length(lab) - 2)).otherwise(lab)
    tag = F.when(num == "", "").otherwise(F.concat(F.lit(" \\tag{"), num, F.lit("}")))
    return F.when(t == "", "").otherwise(F.concat(F.lit("$$"), t, tag, F.lit("$$")))


def close_fences(tex) -> Column:
    """``struct(latex, closed)``: a ``\\right.`` for every ``\\left`` that lacks one; longer commands do not count."""
    fences = lambda side: count_of(tex, rf"\\{side}") - count_of(tex, rf"\\{side}[a-zA-Z]")
    missing = F.greatest(fences("left") - fences("right"), F.lit(0)).cast("int")
    return F.struct(F.concat(tex, F.repeat(F.lit(" \\right."), missing)).alias("latex"), missing.alias("closed"))


def normalize_tex(tex) -> Column:
    """For comparing formulas: no sizing commands, single spaces, none inside brackets."""
    bare = F.replace(F.replace(tex, F.lit("\\left"), F.lit("")), F.lit("\\right"), F.lit(""))
    single = F.regexp_replace(bare, r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(single, r"([(\[{]) ", "$1"), r" ([)\]}])", "$1"))


def similarity(a, b) -> Column:
    """1 minus the edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return 1 - F.levenshtein(a, b) / longest


def unbalanced_dollars(text) -> Column:
    return count_of(text, r"\$") % 2 != 0


def prose_guard(text) -> Column:
    """Dollar signs escaped, bars made slashes, the bracket before a citation closed up."""
    out = F.replace(F.replace(text, F.lit("$"), F.lit("\\$")), F.lit("|"), F.lit("/"))
    return F.replace(out, F.lit("[ [`ref"), F.lit("[[`ref"))


def caption_without_prefix(text) -> Column:
    return F.regexp_replace(text, r"(?iU)^(?:fig(?:ure)?|table)\.?\s*\w+\.?\s*", "")


def gfm_escape(text) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def html_escape(text) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


# ---------------------------------------------------------------------------------------------- names and paths


def extension(path) -> Column:
    """Lower-cased extension of the last path segment; none for names that only begin with a dot."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def stem(path) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def route_of_extension(ext) -> Column:
    return (
        F.when(ext == "pdf", "pdf").when(ext.isin(*DOCUMENT_EXTENSIONS), "office").when(ext.isin("xml", "jats"), "jats").otherwise("text")
    )


def is_supported(ext) -> Column:
    return ext.isin(*DOCUMENT_EXTENSIONS, *TEXT_EXTENSIONS)


def is_image(ext) -> Column:
    return ext.isin(*IMAGE_EXTENSIONS)


def slug(name) -> Column:
    return F.lower(F.replace(name, F.lit(" "), F.lit("_")))


def sheet_file_name(name) -> Column:
    """A sheet's name as a part of a file name: letters, digits, hyphens and underscores."""
    clean = F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}\p{M}\-_]", "_"), F.lit("_"))
    return F.when(clean == "", "sheet").otherwise(clean)


def token_set(text) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0)), F.lower))


def jaccard(a, b) -> Column:
    """Of two distinct arrays; null if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union)


def gate_fires(n_words, agreement, min_words: int = 30, min_agreement: float = 0.35) -> Column:
    """A substantial text layer that agrees with what is rendered on too few words; unknown agreement never fires."""
    return F.coalesce((n_words >= min_words) & (agreement < min_agreement), F.lit(False))

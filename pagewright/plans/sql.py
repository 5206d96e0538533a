"""Pieces of SQL for the other engine: the text rules once more, written for it alone."""

from __future__ import annotations

NUMBER = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"
MATH = r"[\x{370}-\x{3FF}\x{2200}-\x{22FF}\x{2A00}-\x{2AFF}\x{27C0}-\x{27EF}\x{2980}-\x{29FF}\x{1D400}-\x{1D7FF}]"
DECIMAL, ROMAN, LETTER = r"^([0-9]+(?:\.[0-9]+)*)\.?[ \t]([\s\S]*)$", r"^(?:XII|XI|IX|VIII|VII|VI|IV|X|V|III|II|I)\. ([\s\S]*)$", r"^[A-Z]\. ([\s\S]*)$"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def occurrences(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def has_number(x: str, strip: str = "") -> str:
    w = f"rtrim(w, '{strip}')" if strip else "w"
    return f"len(list_filter({words(x)}, lambda w: regexp_matches({w}, '{NUMBER}'))) > 0"


def is_short_title(x: str) -> str:
    return rf"(NOT regexp_matches({x}, '[.,;:]$|[,=]') AND NOT {has_number(x)} AND regexp_matches({x}, '^\s*\p{{Lu}}') AND len({words(x)}) <= 8)"


def is_plausible_heading(x: str) -> str:
    letters, upper = occurrences(x, "[A-Za-z]"), occurrences(x, "[A-Z]")
    return f"({x} <> '' AND strlen({x}) <= 100 AND NOT regexp_matches({x}, '[.,;!]$|=') AND len({words(x)}) <= 14 AND NOT {has_number(x)} AND {letters} >= 3 AND {upper} * 10 >= {letters} * 7)"


def is_bold_dominant(x: str) -> str:
    inside = f"array_to_string(list_filter(string_split({x}, '**'), lambda s, i: i % 2 = 0), '')"
    bold, total = (rf"length(regexp_replace({c}, '\s', '', 'g'))" for c in (inside, f"replace({x}, '**', '')"))
    return f"(len(string_split({x}, '**')) >= 3 AND {total} > 0 AND {bold} * 10 >= {total} * 6)"


def is_title(x: str) -> str:
    return rf"(NOT regexp_matches({x}, '^[*•\x{{2217}}\x{{2212}}\-]|[=+@]|\)\(') AND {occurrences(x, ',')} < 2 AND NOT {has_number(x, ',')} AND strlen({x}) <= 120 AND len({words(x)}) <= 25)"


#: Documents as outlines: a sentence a line, numbered by turns in the ways that headings are.
PREFIXES = ("", "1. ", "2.3 ", "IV. ", "B. ", "**3.1.4** ", "0 ", "## ")
OUTLINES = rf"""
outlines AS (SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(text, '[.!?]\s', chr(10), 'g'), chr(10)),
  lambda l, i: (['{"','".join(PREFIXES)}'])[((i - 1) % {len(PREFIXES)} + 1)::INT] || l), chr(10)) AS md FROM documents WHERE text IS NOT NULL),
md_lines AS (SELECT doc_id, i, l, {trim("l")} AS t FROM outlines, unnest(string_split(md, chr(10))) WITH ORDINALITY AS u(l, i)),
bare AS (SELECT *, {trim("replace(t, '**', '')")} AS b FROM md_lines),
kinds AS (SELECT *, CASE WHEN regexp_matches(b, '{DECIMAL}') AND NOT regexp_matches(regexp_extract(b, '{DECIMAL}', 1), '^0+$') THEN 1
  WHEN regexp_matches(b, '{ROMAN}') THEN 2 WHEN regexp_matches(b, '{LETTER}') THEN 3 END AS kind FROM bare),
prefixed AS (SELECT *, {trim(f"CASE kind WHEN 1 THEN regexp_extract(b, '{DECIMAL}', 2) WHEN 2 THEN regexp_extract(b, '{ROMAN}', 1) WHEN 3 THEN regexp_extract(b, '{LETTER}', 1) END")} AS rest,
  CASE kind WHEN 1 THEN least(len(string_split(regexp_extract(b, '{DECIMAL}', 1), '.')) + 1, 4) WHEN 2 THEN 2 WHEN 3 THEN 3 END AS level,
  kind = 2 OR (kind = 1 AND NOT contains(regexp_extract(b, '{DECIMAL}', 1), '.')) AS risky FROM kinds),
headed AS (SELECT *, CASE WHEN rest <> '' AND NOT regexp_matches(t, '^[#|>\-!]|^\* |^\*$')
  AND ({is_plausible_heading("rest")} OR {is_bold_dominant("t")} OR (NOT risky AND {is_short_title("rest")})) THEN repeat('#', level::INT) || ' ' || rest END AS heading FROM prefixed),
promoted AS (SELECT doc_id, i, coalesce(heading, l) AS l, {trim("coalesce(heading, l)")} AS t FROM headed),
first_line AS (SELECT doc_id, min(i) AS i FROM promoted WHERE t <> '' AND t <> '---' GROUP BY doc_id),
opening AS (SELECT doc_id, i, t AS title FROM promoted JOIN first_line USING (doc_id, i) WHERE NOT starts_with(t, '#') AND {is_title("t")} AND NOT regexp_matches(t, '[.,;]$')),
page_end AS (SELECT doc_id, min(i) AS e FROM promoted WHERE t = '---' GROUP BY doc_id),
second AS (SELECT doc_id, min(i) AS i, arg_min({trim("regexp_extract(t, '^#+(.*)$', 1)")}, i) AS title FROM promoted LEFT JOIN page_end USING (doc_id)
  WHERE (e IS NULL OR i < e) AND starts_with(t, '##') AND {is_title(trim("regexp_extract(t, '^#+(.*)$', 1)"))} GROUP BY doc_id),
titles AS (SELECT * FROM opening UNION ALL SELECT * FROM second WHERE doc_id NOT IN (SELECT doc_id FROM opening)),
titled AS (SELECT p.doc_id, p.i, CASE WHEN p.i = titles.i THEN '# ' || title ELSE l END AS l FROM promoted p LEFT JOIN titles USING (doc_id))
"""

#: Glyphs of plain text on a grid: lines of 96, pages of 50 lines.
GLYPHS = rf"""
wrapped AS (SELECT doc_id, k - 1 AS r, s FROM (SELECT doc_id, flatten(list_transform(string_split(text, chr(10)), lambda l:
  list_transform(range(greatest(ceil(length(l) / 96.0), 1)::BIGINT), lambda j: substring(l, j * 96 + 1, 96)))) AS a FROM documents WHERE text IS NOT NULL), unnest(a) WITH ORDINALITY AS u(s, k)),
glyphs AS (SELECT doc_id, CAST(r // 50 AS INT) AS page_no, CAST((r % 50) * 96 + i - 1 AS INT) AS glyph_no, ch, 50.0::DOUBLE + 8 * (i - 1) AS x, 700.0::DOUBLE - 14 * (r % 50) AS y, 7.0::DOUBLE AS w, 11.0::DOUBLE AS h,
  CASE WHEN regexp_matches(s, '^(    |\t)') THEN 'CourierNew' WHEN regexp_matches(ch, '{MATH}') THEN 'CMMI10' ELSE 'Times-Roman' END AS font
  FROM wrapped, unnest(string_split(s, '')) WITH ORDINALITY AS u(ch, i) WHERE ch <> '')
"""


def xyxy_iou(a: str, b: str) -> str:
    inter = shared(a, b)
    return f"(CASE WHEN {inter} > 0 AND {area(a)} + {area(b)} - {inter} > 0 THEN {inter} / ({area(a)} + {area(b)} - {inter}) ELSE 0.0 END)"


def area(a: str) -> str:
    return f"(greatest({a}x1 - {a}x0, 0.0) * greatest({a}y1 - {a}y0, 0.0))"


def shared(a: str, b: str) -> str:
    return f"(greatest(least({a}x1, {b}x1) - greatest({a}x0, {b}x0), 0.0) * greatest(least({a}y1, {b}y1) - greatest({a}y0, {b}y0), 0.0))"

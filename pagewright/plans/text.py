"""Plans over texts: outlines, titles, captions, frontmatter, names, formulas, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import text as T
from ..operators import assets as A
from ..operators import scoring as S
from . import sql as Q
from .inputs import outlines
from .registry import query, table


@query(f"""WITH {Q.OUTLINES},
docs AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS md, count(*) AS n_lines FROM titled GROUP BY doc_id),
heads AS (SELECT doc_id, count(*) AS n_headings FROM headed WHERE heading IS NOT NULL GROUP BY doc_id)
SELECT doc_id, n_lines::INT AS n_lines, coalesce(n_headings, 0)::INT AS n_headings, title, strlen(md)::INT AS md_bytes, 'img_' || substring(sha256('doc ' || doc_id || '|1|' || md), 1, 16) AS asset_id, sha256(md) AS md_sha256
FROM docs LEFT JOIN heads USING (doc_id) LEFT JOIN titles USING (doc_id)""")
def flagship_convert_documents(spark, d):
    """Every document as Markdown: headings and title promoted, with its counts, id and digest."""
    docs = outlines(spark, d).withColumn("promoted", T.promote_headings("md"))
    docs = docs.withColumn("title", T.title_place(F.col("promoted"))["title"]).withColumn("done", T.promote_title(F.col("promoted")))
    lines = F.split("promoted", "\n", -1)
    n_headings = F.size(F.filter(F.arrays_zip(lines.alias("a"), F.split("md", "\n", -1).alias("b")), lambda z: z["a"] != z["b"]))
    stem = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    return docs.select(
        "doc_id", F.size(lines).alias("n_lines"), n_headings.alias("n_headings"), "title", F.octet_length("done").alias("md_bytes"), A.asset_id(stem, F.lit(1), F.col("done").cast("binary")).alias("asset_id"), F.sha2("done", 256).alias("md_sha256")
    )


@query(f"WITH {Q.OUTLINES} SELECT doc_id, (i - 1)::INT AS line_no, heading FROM headed WHERE heading IS NOT NULL")
def heading_promotion(spark, d):
    """Lines of every outline that become headings."""
    rows = outlines(spark, d).select("doc_id", F.posexplode(F.split("md", "\n", -1)).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", T.heading_line(T.trim("line")).alias("heading")).where("heading is not null")


@query(f"WITH {Q.OUTLINES} SELECT doc_id, (i - 1)::INT AS line_no, level::INT AS level, rest, risky FROM prefixed WHERE rest <> ''")
def section_prefix_split(spark, d):
    """Level, remainder and list risk of every line with a section prefix."""
    rows = outlines(spark, d).select("doc_id", F.posexplode(F.split("md", "\n", -1)).alias("line_no", "line"))
    bare = T.trim(F.replace(T.trim("line"), F.lit("**"), F.lit("")))
    return rows.select("doc_id", "line_no", T.section_prefix(bare).alias("p")).where("p is not null").select("doc_id", "line_no", "p.*")


@query(f"WITH {Q.OUTLINES}, places AS (SELECT doc_id, i AS place, title FROM titles) SELECT doc_id, place::INT AS line_no, title, sha256(string_agg(l, chr(10) ORDER BY titled.i)) AS md_sha256 FROM titled JOIN places USING (doc_id) GROUP BY doc_id, place, title")
def title_promotion(spark, d):
    """Line and text of each document's title, and the text with it promoted."""
    # unfolded, so that headings are promoted and the place is found once, and not again by the filter
    docs = outlines(spark, d).select("doc_id", F.inline(F.array(F.struct(T.promote_headings("md").alias("md")))))
    docs = docs.select("doc_id", "md", F.inline(F.array(F.struct(T.title_place(F.col("md")).alias("p"))))).where("p is not null")
    return docs.select("doc_id", F.col("p.line").alias("line_no"), F.col("p.title").alias("title"), F.sha2(T.with_title(F.col("md"), F.col("p")), 256).alias("md_sha256"))


_FENCED = "concat_ws(chr(10), 'Intro', '```', '1. Not A Heading', '```', md, '   ```py', 'A. Code', '```', 'A. Plain Heading')"


@query(f"""WITH {Q.OUTLINES}, body AS (SELECT doc_id, string_agg(coalesce(heading, l), chr(10) ORDER BY i) AS md FROM headed GROUP BY doc_id)
SELECT doc_id, sha256({_FENCED.replace("'A. Plain Heading'", "'### Plain Heading'")}) AS md_sha256 FROM body""")
def fenced_heading_promotion(spark, d):
    """Headings promoted around code fences, never inside them."""
    docs = outlines(spark, d)
    return docs.select("doc_id", F.sha2(T.promote_headings(F.expr(_FENCED.replace("chr(10)", "char(10)"))), 256).alias("md_sha256"))


_CAPTIONS = ("Figure 3:", "Fig. S1", "table 2.", "Abb.", "Plate [4]", "Photo 5", "figure -", "FIG 7")
_CAPTION_SQL = rf"""
s AS (SELECT doc_id, i, (['{"','".join(_CAPTIONS)}'])[(i % {len(_CAPTIONS)} + 1)::INT] || ' ' || l AS c FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), unnest(a) WITH ORDINALITY AS u(l, i)),
w AS (SELECT *, {Q.words("c")} AS ws FROM s),
ok AS (SELECT * FROM w WHERE rtrim(lower(ws[1]), '.:') IN ('figure', 'fig', 'table', 'abb', 'plate') AND regexp_matches(ws[2], '[0-9A-Za-z]')),
sizes AS (SELECT doc_id, i, x, k, len(ws) AS n, sum(strlen(x)) OVER (PARTITION BY doc_id, i ORDER BY k) + CASE WHEN k = 1 THEN 1 ELSE k - 1 END AS upto FROM ok, unnest(ws) WITH ORDINALITY AS u(x, k)),
fit AS (SELECT doc_id, i, n, count(*) AS m, string_agg(x, ' ' ORDER BY k) AS t FROM sizes WHERE upto <= 120 GROUP BY doc_id, i, n)"""


@query(f"WITH {_CAPTION_SQL} SELECT doc_id, (i - 1)::INT AS line_no, translate(CASE WHEN m < n THEN t || '…' ELSE t END, '[]', '') AS alt FROM fit")
def caption_alt(spark, d):
    """Alternative texts from every line, captioned in eight ways."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    head = F.get(F.array(*map(F.lit, _CAPTIONS)), (F.col("line_no") + 1) % len(_CAPTIONS))
    return rows.select("doc_id", "line_no", T.caption_alt(F.concat(head, F.lit(" "), F.col("line"))).alias("alt")).where("alt is not null")


def _headed(spark, d):
    """Documents with a block of frontmatter that has a comment, a repeated key, a list and a line without a colon."""
    c, nl = F.col, F.lit("\n")
    ident = c("doc_id").cast("string")
    parts = ["---", nl, 'title: "Doc ', ident, '"', nl, "# note: no", nl, "lang : ", c("lang"), nl, "tags: [", c("source"), ', "b", , ', c("source"), "]", nl, "title: 'T ", ident, "'", nl, "plain", nl, "topic: a:b", nl, "---", nl, nl, c("text")]
    content = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.concat(F.lit("/in/Some Doc "), ident, F.lit(".md")).alias("path"), content.alias("content"))


@query("""SELECT doc_id, unnest([{'k': 'lang', 'v': lang}, {'k': 'tags', 'v': '[' || source || ', "b", , ' || source || ']'}, {'k': 'title', 'v': 'T ' || doc_id}, {'k': 'topic', 'v': 'a:b'}], recursive := true), strlen(text)::INT + 1 AS body_bytes
FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL""")
def frontmatter_parse(spark, d):
    """Keys and values of every document's frontmatter, and what is left as its body."""
    rows = _headed(spark, d).where("content is not null").select("doc_id", D.frontmatter(F.col("content")).alias("fm"))
    return rows.select("doc_id", F.octet_length("fm.body").alias("body_bytes"), F.explode(F.arrays_zip(F.col("fm.keys").alias("k"), F.col("fm.values").alias("v"))).alias("e")).select("doc_id", "e.k", "e.v", "body_bytes")


@query("""SELECT doc_id, 'some_doc_' || doc_id AS id, 'T ' || doc_id AS title, 'Explicit' AS description, 'document' AS doc_type, 'x,' || source || CASE WHEN source = 'b' THEN '' ELSE ',b' END AS tags, strlen(text)::INT + 1 AS body_bytes,
  sha256('---' || chr(10) || 'title: "T ' || doc_id || '"' || chr(10) || 'type: document' || chr(10) || 'tags: [x, ' || source || ', b]' || chr(10) || 'description: "Explicit"' || chr(10) || 'lang: ' || lang || chr(10) || 'topic: a:b' || chr(10) || '---' || chr(10) || chr(10) || chr(10) || text) AS md_sha256
FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL""")
def okf_markdown(spark, d):
    """Documents normalized from frontmatter and file name, and written back."""
    rows = _headed(spark, d).where("content is not null").select("doc_id", "path", D.frontmatter(F.col("content")).alias("fm"))
    rows = rows.select("doc_id", D.document(F.col("fm"), F.col("path"), description=F.lit("Explicit"), extra_tags=F.array(F.lit("x"))).alias("doc"))
    return rows.select("doc_id", "doc.id", "doc.title", "doc.description", "doc.doc_type", F.array_join("doc.tags", ",").alias("tags"), F.octet_length("doc.body").alias("body_bytes"), F.sha2(D.to_markdown(F.col("doc")), 256).alias("md_sha256"))


@query("""SELECT doc_id, 'thought_' || substring(lower(replace('On ' || lang, ' ', '_')), 1, 30) || '_20240102030405_abc123' AS id, 'Thought: On ' || lang AS title,
  sha256(concat_ws(chr(10), '---', 'title: "Thought: On ' || lang || '"', 'type: thought', 'thought_type: reasoning', 'topic: On ' || lang, 'tags: [thought, reasoning, On ' || lang || ']', 'created: 2024-01-02T03:04:05+00:00', '---', '', text)) AS body_sha256
FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL""")
def thought_wrap(spark, d):
    """Every text wrapped as reasoning about its language."""
    docs = table(spark, d, "documents").where("text is not null and lang is not null")
    topic = F.concat(F.lit("On "), F.col("lang"))
    rows = docs.select("doc_id", D.wrapped_thought(F.col("text"), topic, F.expr("timestamp_ntz'2024-01-02 03:04:05'"), "abc123").alias("t"))
    return rows.select("doc_id", "t.id", "t.title", F.sha2("t.body", 256).alias("body_sha256"))


@query("SELECT doc_id, 'src_x_' || doc_id || '_ß' AS slug, 'img_' || substring(sha256('Src X ' || doc_id || '|2|' || text), 1, 16) AS asset_id FROM documents WHERE text IS NOT NULL")
def slug_and_asset_id(spark, d):
    """Slugs, and content-addressed ids of each text as the second image of its document."""
    stem = F.concat(F.lit("Src X "), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.slug(F.concat(stem, F.lit(" ß"))).alias("slug"), A.asset_id(stem, F.lit(2), F.col("text").cast("binary")).alias("asset_id"))


_EXTS = ("pdf", "DOCX", "xlsx", "ppt", "xml", "jats", "txt", "Md", "png", "heic", "exe", "tar.gz")


@query(f"""WITH p AS (SELECT lower(string_split((['{"','".join(_EXTS)}'])[(doc_id % {len(_EXTS)} + 1)::INT], '.')[-1]) AS ext FROM documents)
SELECT ext, CASE WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('docx', 'xlsx', 'pptx', 'doc', 'xls', 'ppt') THEN 'office' WHEN ext IN ('xml', 'jats') THEN 'jats' ELSE 'text' END AS route,
  ext IN ('pdf', 'docx', 'xlsx', 'pptx', 'doc', 'xls', 'ppt', 'txt', 'md', 'markdown', 'rst', 'text') AS supported, ext IN ('png', 'jpg', 'jpeg', 'gif', 'webp', 'bmp', 'tif', 'tiff', 'svg', 'avif', 'heic', 'heif') AS image, count(*) AS n FROM p GROUP BY ALL""")
def ext_dispatch(spark, d):
    """Routes of file names of twelve kinds."""
    name = F.concat(F.lit("/a.b/c"), F.col("doc_id").cast("string"), F.lit("."), F.get(F.array(*map(F.lit, _EXTS)), (F.col("doc_id") % len(_EXTS)).cast("int")))
    rows = table(spark, d, "documents").select(T.extension(name).alias("ext"))
    return rows.groupBy("ext").agg(F.count(F.lit(1)).alias("n")).select("ext", T.route_of_extension(F.col("ext")).alias("route"), T.is_supported(F.col("ext")).alias("supported"), T.is_image(F.col("ext")).alias("image"), "n")


@query(r"""SELECT p_partkey, CASE WHEN s = '' THEN 'sheet' ELSE s END AS file_name FROM (SELECT p_partkey, trim(regexp_replace(CASE WHEN p_partkey % 50 = 0 THEN '::' ELSE p_name || ' (é/' || p_brand || ')_' END, '[^\p{L}\p{N}\p{M}\-_]', '_', 'g'), '_') AS s FROM part)""")
def sheet_name_sanitize(spark, d):
    """Sheet names as parts of file names."""
    name = F.when(F.col("p_partkey") % 50 == 0, F.lit("::")).otherwise(F.concat(F.col("p_name"), F.lit(" (é/"), F.col("p_brand"), F.lit(")_")))
    return table(spark, d, "part").select("p_partkey", T.sheet_file_name(name).alias("file_name"))


@query(f"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/$', '') || '/f' || page_id || '.' || (['{"','".join(_EXTS)}'])[(page_id % {len(_EXTS)} + 1)::INT] AS path FROM pages)
SELECT page_id, path, row_number() OVER (ORDER BY encode(path), page_id)::INT AS place FROM p WHERE lower(string_split(path, '.')[-1]) IN ('pdf', 'docx', 'xlsx', 'ppt', 'txt', 'md')""")
def directory_scan(spark, d):
    """Supported documents among paths from URLs, in order of path; a loose image is no document."""
    ext = F.get(F.array(*map(F.lit, _EXTS)), (F.col("page_id") % len(_EXTS)).cast("int"))
    path = F.concat(F.regexp_replace(F.regexp_extract("url", "://([^?#]*)", 1), "/$", ""), F.lit("/f"), F.col("page_id").cast("string"), F.lit("."), ext)
    from ..sources.files import numbered, supported

    return numbered(supported(table(spark, d, "pages").select("page_id", path.alias("path"))), ["path", "page_id"], "place")


_TEX = r"concat('\left( ', a, '^{\left[', b, ' \right) ', case when doc_id % 3 = 0 then '\leftarrow \rightarrow ' else '\right] ' end, case when doc_id % 5 = 0 then '\left' else '' end)"


@query(rf"""WITH w AS (SELECT doc_id, {Q.words('text')}[1] AS a, {Q.words('text')}[2] AS b FROM documents), t AS (SELECT doc_id, {_TEX} AS tex FROM w WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT doc_id, tex || repeat(' \right.', closed) AS latex, closed FROM (SELECT *, greatest(({Q.occurrences('tex', r'\\left')} - {Q.occurrences('tex', r'\\left[a-zA-Z]')}) - ({Q.occurrences('tex', r'\\right')} - {Q.occurrences('tex', r'\\right[a-zA-Z]')}), 0)::INT AS closed FROM t)""")
def fence_repair(spark, d):
    """Formulas with fences left open."""
    rows = table(spark, d, "documents").select("doc_id", T.words("text").alias("w")).select("doc_id", F.get("w", F.lit(0)).alias("a"), F.get("w", F.lit(1)).alias("b")).where("a is not null and b is not null")
    left, right = F.lit("\\left"), F.lit("\\right")
    tex = F.concat(left, F.lit("( "), "a", F.lit("^{"), left, F.lit("["), "b", F.lit(" "), right, F.lit(") "), F.when(F.col("doc_id") % 3 == 0, F.lit("\\leftarrow \\rightarrow ")).otherwise(F.lit("\\right] ")), F.when(F.col("doc_id") % 5 == 0, left).otherwise(F.lit("")))
    return rows.select("doc_id", T.close_fences(tex).alias("r")).select("doc_id", "r.*")


@query(r"""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity * 5 AS w, l_quantity AS h, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE '(' || l_linenumber || ')' END AS lab, 'x_{' || l_partkey || '}' AS tex FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN h > 1.6 * 12.0 OR w > 220 THEN '$$' || chr(10) || tex || chr(10) || '$$' ELSE '$' || tex || '$' END AS wrapped,
  '$$' || tex || CASE WHEN lab = '' THEN '' ELSE ' \tag{' || l_linenumber || '}' END || '$$' AS equation, floor(least(greatest(w * h / 40, 64), 512))::INT AS budget, w >= 40 AND (h > 1.6 * 12.0 OR w > 220) AND h <= 36.0 AS refinable FROM p""")
def equation_wrap(spark, d):
    """Formulas wrapped by the size of their boxes, tagged, and budgeted."""
    c = F.col
    w, h = c("l_quantity") * 5, c("l_quantity")
    tex = F.concat(F.lit("x_{"), c("l_partkey").cast("string"), F.lit("}"))
    label = F.when(c("l_linenumber") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("("), c("l_linenumber").cast("string"), F.lit(")")))
    from ..functions.geometry import is_refinable

    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.wrap_math(tex, h, w, F.lit(12.0)).alias("wrapped"), T.emit_equation(tex, label).alias("equation"), T.token_budget(w, h).alias("budget"), is_refinable(w, h, F.lit(12.0)).alias("refinable"))


@query(r"""WITH t AS (SELECT item_id, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') AS text FROM benchmark), b AS (SELECT item_id, text, lead(text) OVER (ORDER BY item_id) AS other FROM t)
SELECT item_id, levenshtein(text, other)::INT AS distance, 1 - levenshtein(text, other) / greatest(length(text), length(other), 1)::DOUBLE AS similarity FROM b WHERE other IS NOT NULL""")
def edit_similarity(spark, d):
    """Neighbouring benchmark items by edit distance, on ASCII, as the engines count other letters unlike."""
    b = table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", r"[^\x00-\x7F]", "_").alias("text"))
    # each item meets the next by number: an equi-join, not a window over all rows
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    return pairs.select("item_id", F.levenshtein("text", "other").alias("distance"), T.similarity(F.col("text"), F.col("other")).alias("similarity"))


_TOKENS = r"list_distinct(list_transform(regexp_extract_all({}, '[\p{{L}}\p{{N}}\p{{M}}]+'), lambda t: lower(t)))"


@query(f"""WITH b AS (SELECT item_id, {_TOKENS.format('text')} AS s FROM benchmark), t AS (SELECT doc_id, {_TOKENS.format('text')} AS s FROM documents WHERE text IS NOT NULL),
c AS (SELECT item_id, doc_id, count(*) AS n FROM (SELECT item_id, unnest(s) AS w FROM b) JOIN (SELECT doc_id, unnest(s) AS w FROM t) USING (w) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, n::INT AS n_shared, n / (len(b.s) + len(t.s) - n)::DOUBLE AS jaccard FROM c JOIN b USING (item_id) JOIN t USING (doc_id) WHERE n / (len(b.s) + len(t.s) - n)::DOUBLE >= 0.2""")
def token_jaccard(spark, d):
    """Documents that share at least a fifth of their tokens with a benchmark item, joined on tokens of the item."""
    from ..operators.scoring import alike_pairs

    items = table(spark, d, "benchmark").select("item_id", T.token_set(F.col("text")).alias("s"))
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", T.token_set(F.col("text")).alias("s"))
    return alike_pairs(docs, "doc_id", items, "item_id", 0.2)


_SEEN_SQL = r"CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN regexp_replace(text, '[aeiou]', '', 'g') WHEN 2 THEN '' ELSE regexp_replace(text, '[a-m]+', 'zz', 'g') END"
_GATE_SQL = rf"""g AS (SELECT doc_id, source, len({Q.words('text')})::INT AS n_words, {_TOKENS.format('text')} AS a, {_TOKENS.format(_SEEN_SQL)} AS b, {Q.occurrences('text', '[A-Z]')} AS spans FROM documents WHERE text IS NOT NULL),
j AS (SELECT *, len(list_intersect(a, b)) AS shared FROM g),
f AS (SELECT *, CASE WHEN len(a) + len(b) - shared > 0 THEN shared / (len(a) + len(b) - shared)::DOUBLE END AS agreement FROM j),
gated AS (SELECT *, coalesce(n_words >= 30 AND agreement < 0.35, false) AS fires FROM f)"""


def _gated(spark, d):
    text = F.col("text")
    seen = F.when(F.col("doc_id") % 4 == 0, text).when(F.col("doc_id") % 4 == 1, F.regexp_replace(text, "[aeiou]", "")).when(F.col("doc_id") % 4 == 2, F.lit("")).otherwise(F.regexp_replace(text, "[a-m]+", "zz"))
    pages = table(spark, d, "documents").where("text is not null").select("doc_id", "source", text.alias("layer_text"), seen.alias("seen_text"), T.count_of(text, "[A-Z]").alias("n_math_spans"))
    return S.gate(pages)


@query(f"WITH {_GATE_SQL} SELECT doc_id, n_words, agreement, fires FROM gated")
def render_gate(spark, d):
    """Texts against damaged copies of themselves: agreement, and whether the page falls back."""
    return _gated(spark, d).select("doc_id", "n_words", "agreement", "fires")


@query(f"""WITH {_GATE_SQL} SELECT source, count(*) AS pages_checked, count_if(fires)::BIGINT AS pages_fired, coalesce(sum(spans) FILTER (fires), 0)::BIGINT AS spans_suppressed,
  CASE WHEN count_if(fires) > 0 THEN count_if(fires)::BIGINT || ' of ' || count(*) || ' pages fell back' END AS line FROM gated GROUP BY source""")
def gate_counters(spark, d):
    """Counts of the gate for each source."""
    return S.gate_counters(_gated(spark, d), ["source"])


def _spans(spark, d, side):
    """Sentences as displayed formulas, in papers by document; the found side drops, changes and adds some."""
    rows = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("paper"), F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    line = F.regexp_replace("line", r"[$]", "")
    if side == "found":
        line = F.when(F.col("k") % 3 == 1, F.concat(F.lit("\\left("), line, F.lit("\\right)"))).when(F.col("k") % 3 == 2, F.concat(line, F.lit(" x"))).otherwise(F.regexp_replace(line, " ", "  "))
    else:
        line = F.when(F.col("k") % 3 == 1, F.concat(F.lit("("), line, F.lit(")"))).otherwise(line)
    tag = F.when(F.col("k") % 2 == 0, F.concat(F.lit(" \\tag{"), F.col("k").cast("string"), F.lit("}"))).otherwise(F.lit(""))
    span = F.concat(F.lit("$$"), F.when(F.col("k") % 4 == 0, "\n").otherwise(""), line, tag, F.when(F.col("k") % 4 == 0, "\n").otherwise(""), F.lit("$$"))
    parts = rows.select("paper", "k", span.alias("s"))
    if side == "found":
        parts = parts.where((F.col("paper") % 5 != 0) | (F.col("k") != 0)).unionByName(rows.where("k = 0 and paper % 7 = 0").select("paper", F.lit(1_000_000).alias("k"), F.lit("$$extra$$").alias("s")))
    from ..operators.ordered import joined

    return parts.groupBy("paper").agg(joined("s", ["k"], "\n\ntext\n\n").alias("md"))


def _side_sql(side: str) -> str:
    line = r"regexp_replace(l, '[$]', '', 'g')"
    found = rf"CASE k % 3 WHEN 1 THEN '\left(' || {line} || '\right)' WHEN 2 THEN {line} || ' x' ELSE replace({line}, ' ', '  ') END"
    wanted = rf"CASE k % 3 WHEN 1 THEN '(' || {line} || ')' ELSE {line} END"
    raw = f"SELECT doc_id AS paper, k - 1 AS k, l FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(l, k)"
    tex = found if side == "found" else wanted
    rows = f"SELECT paper, k, {Q.trim('(' + tex + ')')} AS tex, CASE WHEN k % 2 = 0 THEN k::VARCHAR END AS tag FROM ({raw})"
    if side == "found":
        rows = f"SELECT * FROM ({rows}) WHERE paper % 5 <> 0 OR k <> 0 UNION ALL SELECT doc_id, 1000000, 'extra', NULL FROM documents WHERE text IS NOT NULL AND doc_id % 7 = 0"
    # a tag without a formula before it is the formula
    rows = rf"SELECT paper, k, CASE WHEN tex = '' AND tag IS NOT NULL THEN '\tag{{' || tag || '}}' ELSE tex END AS tex, CASE WHEN tex <> '' THEN tag END AS tag FROM ({rows})"
    return f"SELECT paper, row_number() OVER (PARTITION BY paper ORDER BY k) - 1 AS ord, tex, tag FROM ({rows}) WHERE tex <> ''"


def _normal_sql(x: str) -> str:
    bare = rf"regexp_replace(replace(replace({x}, '\left', ''), '\right', ''), '\s+', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({bare}, '([(\[{{]) ', '\1', 'g'), ' ([)\]}}])', '\1', 'g'))"


_PAIRS_SQL = f"""f AS ({_side_sql('found')}), e AS ({_side_sql('expected')}),
p AS (SELECT coalesce(f.paper, e.paper) AS paper, CASE WHEN f.tex IS NULL THEN 'missing' WHEN e.tex IS NULL THEN 'spurious' WHEN {_normal_sql('f.tex')} = {_normal_sql('e.tex')} THEN 'exact' ELSE 'mismatch' END AS kind
  FROM f FULL JOIN e ON f.paper = e.paper AND f.ord = e.ord)"""


@query(f"""WITH {_PAIRS_SQL} SELECT paper, count_if(kind IN ('exact', 'mismatch', 'missing'))::BIGINT AS n_expected, count_if(kind IN ('exact', 'mismatch', 'spurious'))::BIGINT AS n_found,
  count_if(kind = 'exact')::BIGINT AS exact, count_if(kind = 'missing')::BIGINT AS missing, count_if(kind = 'spurious')::BIGINT AS spurious,
  CASE WHEN count_if(kind IN ('exact', 'mismatch', 'missing')) > 0 THEN count_if(kind = 'exact') / count_if(kind IN ('exact', 'mismatch', 'missing'))::DOUBLE END AS rate FROM p GROUP BY ROLLUP (paper)""")
def bench_scoring(spark, d):
    """Displayed formulas of two sides extracted, paired and scored, with a row for all papers."""
    found, expected = (S.display_spans(_spans(spark, d, side)) for side in ("found", "expected"))
    return S.scores(S.paired(found, expected))


@query(rf"""WITH t AS (SELECT doc_id, i, lower(l || CASE i % 4 WHEN 0 THEN ' = x^2' WHEN 1 THEN '' WHEN 2 THEN ' \frac a a a a a' ELSE ' \text{{b}} +' END) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), unnest(a) WITH ORDINALITY AS u(l, i)),
w AS (SELECT *, {Q.words('l')} AS ws FROM t)
SELECT doc_id, (i - 1)::INT AS line_no FROM w WHERE NOT (contains(l, '\mbox{{') OR contains(l, '\text{{') OR contains(l, ' the ') OR contains(l, ' with ') OR contains(l, ' and '))
  AND coalesce(list_max(map_values(list_histogram(ws))), 0) <= 4 AND regexp_matches(l, '[=+^_]|\\frac|\\sum|\\int|\\sqrt')""")
def display_latex_gate(spark, d):
    """Lines that would pass as displayed equations."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    k = (F.col("line_no") + 1) % 4
    tail = F.when(k == 0, " = x^2").when(k == 1, "").when(k == 2, " \\frac a a a a a").otherwise(" \\text{b} +")
    return rows.where(T.is_display_latex(F.concat(F.col("line"), tail))).select("doc_id", "line_no")


@query(r"""SELECT doc_id, sha256(replace(replace(replace(text || ' $5 [ [`ref01`]', '$', '\$'), '|', '/'), '[ [`ref', '[[`ref')) AS guarded, len(regexp_extract_all(text || ' $5', '\$')) % 2 <> 0 AS unbalanced, trim(regexp_replace(text, '\s+', ' ', 'g')) AS collapsed,
  regexp_replace('Fig. 7. ' || text, '(?i)^(fig(ure)?|table)\.?\s*\w+\.?\s*', '') AS caption FROM documents WHERE text IS NOT NULL""")
def prose_rules(spark, d):
    """Guards of prose: dollars, bars, white space, caption prefixes."""
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(T.prose_guard(F.concat(t, F.lit(" $5 [ [`ref01`]"))), 256).alias("guarded"), T.unbalanced_dollars(F.concat(t, F.lit(" $5"))).alias("unbalanced"), T.collapse("text").alias("collapsed"), T.caption_without_prefix(F.concat(F.lit("Fig. 7. "), t)).alias("caption"))

"""Plans over tables: cells and words, linked captions, decoded lines, source tables, sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as TB
from ..operators import decode as DE
from ..sources import office as O
from . import sql as Q
from .inputs import BOXES_SQL, boxes
from .registry import query, table

KEYS = ["doc_id", "page_no"]
_CELLS_SQL = f"""{BOXES_SQL}, orders_of AS (SELECT DISTINCT doc_id, page_no FROM boxes),
cells AS (SELECT doc_id, page_no, k::INT AS cell_no, 100.0 * (k % 4) AS x0, 120.0 * (k // 4) AS y0, 100.0 * (k % 4) + 110 AS x1, 120.0 * (k // 4) + 130 AS y1 FROM orders_of, range(16) AS t(k))"""


def _lines_and_cells(spark, d):
    lines = boxes(spark, d)
    k = F.col("cell_no")
    cells = lines.select(*KEYS).distinct().withColumn("cell_no", F.explode(F.sequence(F.lit(0), F.lit(15))))
    x, y = 100.0 * (k % 4), 120.0 * F.floor(k / 4)
    return lines, cells.select(*KEYS, "cell_no", x.alias("x0"), y.alias("y0"), (x + 110).alias("x1"), (y + 130).alias("y1"))


def _distance(a, b):
    first, second = f"abs({b}x0 - {a}x0) + abs({b}y0 - {a}y0)", f"abs({b}x1 - {a}x1) + abs({b}y1 - {a}y1)"
    return f"({first} + {second} + least({first}, {second}))"


@query(f"""WITH {_CELLS_SQL}, r AS (SELECT l.doc_id, l.page_no, l.no, c.cell_no, row_number() OVER (PARTITION BY l.doc_id, l.page_no, l.no ORDER BY 1 - {Q.xyxy_iou('l.', 'c.')}, {_distance('l.', 'c.')}, c.cell_no) AS k
FROM boxes l JOIN cells c USING (doc_id, page_no) WHERE {Q.xyxy_iou('l.', 'c.')} > 1e-8) SELECT doc_id, page_no, no, cell_no FROM r WHERE k = 1""")
def ocr_cell_match(spark, d):
    """Each line's best table cell."""
    lines, cells = _lines_and_cells(spark, d)
    return DE.match_cells(lines, cells, KEYS).select(*KEYS, "no", "cell_no")


_SLOTS_SQL = f"""{_CELLS_SQL}, s AS (SELECT l.doc_id, l.page_no, l.no, c.cell_no, {Q.shared('l.', 'c.')} / {Q.area('l.')} AS share FROM boxes l JOIN cells c USING (doc_id, page_no)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, no ORDER BY share DESC, cell_no) AS k FROM s)"""


@query(f"WITH {_SLOTS_SQL} SELECT doc_id, page_no, no, cell_no, share FROM k WHERE share >= 0.25")
def word_cell_slotting(spark, d):
    """Words in all cells that hold a quarter of them or more."""
    lines, cells = _lines_and_cells(spark, d)
    return DE.slot_words(lines, cells, KEYS, threshold=0.25, unique=False).select(*KEYS, "no", "cell_no", "share")


@query(f"WITH {_SLOTS_SQL} SELECT doc_id, page_no, round((avg(share) + min(share)) / 2, 9) AS confidence FROM k WHERE k = 1 GROUP BY ALL")
def slot_confidence(spark, d):
    """How well each table's words fall into its cells."""
    lines, cells = _lines_and_cells(spark, d)
    return DE.slot_confidence(lines, cells, KEYS).withColumn("confidence", F.round("confidence", 9))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: round(v::DOUBLE, 4)) AS v FROM embeddings),
o AS (SELECT vec_id, i::INT AS idx, CASE i % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'table caption' WHEN 2 THEN 'table footer rotated' ELSE 'table row' END AS label, CASE WHEN i = 5 THEN ' ' ELSE 'part ' || i END AS text, v[i + 1] AS y0 FROM e, range(8) AS t(i)),
p AS (SELECT vec_id, i::INT AS i, j::INT AS j, 1 / (1 + exp(v[i * 8 + j + 1] * 10 - v[j * 8 + i + 1] * 3)) AS p FROM e, range(8) AS t(i), range(8) AS u(j)),
b AS (SELECT a.vec_id, a.i, a.j, (a.p + c.p) / 2 AS s FROM p a JOIN p c ON a.vec_id = c.vec_id AND a.i = c.j AND a.j = c.i)
SELECT b.vec_id, b.i AS table_no, CASE WHEN o.label LIKE 'table caption%' THEN 'caption' ELSE 'footer' END AS kind, string_agg(trim(o.text), ' ' ORDER BY o.y0, o.idx) AS text, count(*) AS n_parts
FROM b JOIN o ON o.vec_id = b.vec_id AND o.idx = b.j JOIN o t ON t.vec_id = b.vec_id AND t.idx = b.i
WHERE t.label = 'table' AND (o.label LIKE 'table caption%' OR o.label LIKE 'table footer%') AND trim(o.text) <> '' AND s >= 0.5 GROUP BY ALL""")
def edge_linked_text(spark, d):
    """Captions and footers linked to tables by the edge logits of each vector."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.round(v.cast("double"), 4)).alias("v"))
    i, j = F.col("i"), F.col("j")
    of = lambda k: F.get("v", k.cast("int"))
    objects = e.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7)))).select("vec_id", i.alias("idx"), F.get(F.array(*map(F.lit, ("table", "table caption", "table footer rotated", "table row"))), i % 4).alias("label"), F.when(i == 5, " ").otherwise(F.concat(F.lit("part "), i.cast("string"))).alias("text"), of(i).alias("y0"))
    edges = e.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(7)))).select("vec_id", "i", "j", (of(i * 8 + j) * 10).alias("l0"), (of(j * 8 + i) * 3).alias("l1"))
    return DE.linked_text(edges, objects, ["vec_id"]).select("vec_id", "table_no", "kind", "text", "n_parts")


_CHARS = ("", "a", "b", " ", "c", "  ", "d")


@query(f"""WITH s AS (SELECT vec_id AS line_id, t, list_slice(embedding, t * 8 + 1, t * 8 + 8) AS l FROM embeddings, range(8) AS r(t)),
b AS (SELECT line_id, t, list_position(l, list_max(l)) - 1 AS k, list_max(l) AS v FROM s),
e AS (SELECT *, lag(k) OVER (PARTITION BY line_id ORDER BY t) AS p FROM b),
o AS (SELECT line_id, trim(regexp_replace(string_agg((['{"','".join(_CHARS)}'])[(k + 1)::INT], '' ORDER BY t), ' {{2,}}', ' ', 'g')) AS text, round(avg(v::DOUBLE), 6) AS confidence FROM e WHERE (p IS NULL OR p <> k) AND k < {len(_CHARS)} GROUP BY line_id)
SELECT * FROM o WHERE text <> ''""")
def ctc_decode(spark, d):
    """Vectors as eight steps of eight class scores, decoded with a charset of seven."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("line_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("t"))
    steps = e.select("line_id", "t", F.slice("embedding", F.col("t") * 8 + 1, 8).alias("logits"))
    return DE.ctc_decode(steps, list(_CHARS)).withColumn("confidence", F.round("confidence", 6))


# ---------------------------------------------------------------------------------------------- source tables

_GRID_SQL = rf"""
all_words AS (SELECT doc_id, {Q.words('text')} AS ws, (doc_id % 4 + 1)::INT AS nc FROM documents WHERE text IS NOT NULL),
cells AS (SELECT doc_id, nc, (i - 1) // nc AS r, (i - 1) % nc AS c, CASE WHEN i % 7 = 0 OR doc_id % 10 = 9 THEN ' ' ELSE w || CASE WHEN i % 5 = 0 THEN '|<&' ELSE '' END END AS t, CASE WHEN doc_id % 6 = 0 AND i = 2 THEN 2 ELSE 1 END AS cs FROM all_words, unnest(ws) WITH ORDINALITY AS u(w, i)),
flags AS (SELECT DISTINCT doc_id, nc, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE -1 END AS head, doc_id % 5 = 0 AS has_header FROM cells),
tall AS (SELECT doc_id, max(r) AS last, count(*) AS n FROM cells GROUP BY doc_id)"""


def _source_tables(spark, d):
    """Every text's words as a table of one to four columns: doc_id, rows, has_header, col_count."""
    nc = (F.col("doc_id") % 4 + 1).cast("int")
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", nc.alias("nc"), T_words("text").alias("ws")).where("size(ws) > 0")
    doc, nc = F.col("doc_id"), F.col("nc")
    head = F.when(doc % 3 == 0, 1).otherwise(-1)

    def cell(w, k):
        i = k + 1
        t = F.when((i % 7 == 0) | (doc % 10 == 9), " ").otherwise(F.concat(w, F.when(i % 5 == 0, "|<&").otherwise("")))
        return F.struct(t.alias("text"), F.when((doc % 6 == 0) & (i == 2), 2).otherwise(1).alias("colspan"), F.lit(1).alias("rowspan"))

    # a table is cut from its text's words inside the row: nothing is shuffled
    def row(r):
        return F.struct((r == head).alias("is_header"), F.transform(F.slice("ws", r * nc + 1, nc), lambda w, k: cell(w, r * nc + k)).alias("cells"))

    built = F.transform(F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / nc).cast("int")), row)
    # unfolded, so that the rows are built once however often they are used
    return docs.select("doc_id", F.inline(F.array(F.struct(built.alias("rows"), (doc % 5 == 0).alias("has_header"), nc.alias("col_count")))))


def T_words(c):
    from ..functions.text import words

    return words(c)


@query(rf"""WITH {_GRID_SQL}, f AS (SELECT doc_id, nc, r, count(*) AS n, count_if({Q.trim('t')} <> '') AS filled FROM cells GROUP BY ALL)
SELECT doc_id, count(*) >= 2 AND nc >= 2 AND bool_and(filled * 5 >= n * 3) AS plausible FROM f GROUP BY doc_id, nc""")
def table_plausibility(spark, d):
    """Which of the tables are filled well enough."""
    return _source_tables(spark, d).select("doc_id", TB.is_plausible("rows", F.col("col_count")).alias("plausible"))


def _html_rows_sql(tag: str) -> str:
    return f"""'<tr>' || chr(10) || string_agg('<{tag}' || CASE WHEN cs > 1 THEN ' colspan="' || cs || '"' ELSE '' END || '>' || replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</{tag}>' || chr(10), '' ORDER BY c) || '</tr>' || chr(10)"""


@query(rf"""WITH {_GRID_SQL},
full_cells AS (SELECT doc_id, nc, r, c, replace({Q.trim('t')}, '|', '\|') AS g FROM cells UNION ALL SELECT doc_id, nc, last, c, '' FROM (SELECT doc_id, nc, last, n, unnest(range(n - last * nc, nc)) AS c FROM tall JOIN flags USING (doc_id))),
pipes AS (SELECT doc_id, nc, r, '| ' || string_agg(g, ' | ' ORDER BY c) || ' |' AS p FROM full_cells GROUP BY doc_id, nc, r),
gfm AS (SELECT doc_id, max(p) FILTER (r = greatest(least(head, last), 0) AND (head < 0 OR head <= last) OR (head > last AND r = 0)) AS hp, last, '| ' || array_to_string(list_transform(range(nc), lambda x: '---'), ' | ') || ' |' AS rule,
  string_agg(p, chr(10) ORDER BY r) FILTER (r <> CASE WHEN head <= last THEN greatest(head, 0) ELSE 0 END) AS body FROM pipes JOIN flags USING (doc_id, nc) JOIN tall USING (doc_id) GROUP BY doc_id, nc, last),
th AS (SELECT doc_id, r, {_html_rows_sql('th')} AS h FROM cells GROUP BY doc_id, r), td AS (SELECT doc_id, r, {_html_rows_sql('td')} AS h FROM cells GROUP BY doc_id, r),
spans AS (SELECT doc_id, max(cs) AS cs, bool_or({Q.trim('t')} <> '') AS has_text FROM cells GROUP BY doc_id),
placed AS (SELECT flags.*, last, CASE WHEN head >= 0 AND head <= last THEN head ELSE -1 END AS h FROM flags JOIN tall USING (doc_id)),
heads AS (SELECT placed.doc_id, th.h FROM placed JOIN th ON th.doc_id = placed.doc_id AND th.r = greatest(placed.h, 0)), bodies AS (SELECT placed.doc_id, string_agg(td.h, '' ORDER BY td.r) AS h FROM placed JOIN td ON td.doc_id = placed.doc_id AND td.r <> placed.h GROUP BY placed.doc_id),
html AS (SELECT placed.doc_id, '<table>' || chr(10) || CASE WHEN has_header OR placed.h >= 0 THEN '<thead>' || chr(10) || heads.h || '</thead>' || chr(10) ELSE '' END || '<tbody>' || chr(10) || coalesce(bodies.h, '') || '</tbody>' || chr(10) || '</table>' AS h FROM placed JOIN heads USING (doc_id) LEFT JOIN bodies USING (doc_id))
SELECT doc_id, sha256(CASE WHEN cs > 1 THEN html.h ELSE hp || chr(10) || rule || chr(10) || coalesce(body || chr(10), '') END) AS md_sha256 FROM gfm JOIN html USING (doc_id) JOIN spans USING (doc_id) WHERE has_text""")
def source_table_markdown(spark, d):
    """The tables as pipe tables or HTML; those without text have none."""
    rows = _source_tables(spark, d)
    return rows.select("doc_id", F.sha2(TB.source_table_markdown("rows", F.col("has_header"), F.col("col_count")), 256).alias("md_sha256")).where("md_sha256 is not null")


# ---------------------------------------------------------------------------------------------- sheets


def _sheets(spark, d):
    """Events as cells of one sheet a user: a row for each day, a column for each type, the last value of a day."""
    types = F.array(*map(F.lit, ("click", "view", "purchase", "signup", "error", "search")))
    e = table(spark, d, "events").select(F.col("user_id").alias("sheet"), F.datediff("ts", F.lit("2024-01-01")).alias("row_no"), (F.array_position(types, F.col("event_type")) - 1).cast("int").alias("col_no"), "event_id", "value", "event_type").where("col_no >= 0")
    last = e.groupBy("sheet", "row_no", "col_no").agg(F.max_by("value", "event_id").alias("v"), F.max("event_id").alias("id"))
    null = F.lit(None).cast("string")
    text = F.when(F.col("id") % 11 == 0, "").otherwise(F.concat(F.col("v").cast("decimal(18,2)").cast("string"), F.when(F.col("id") % 4 == 0, ',"x"').otherwise("")))
    value = F.when(F.col("id") % 11 == 0, null).otherwise(TB.number_value(F.floor(F.col("v")).cast("double")))
    formula = F.when(F.col("id") % 13 == 0, F.concat(F.lit("=A"), F.col("row_no").cast("string")))
    cells = last.select("sheet", "row_no", "col_no", text.alias("text"), value.alias("value"), F.when(F.col("id") % 11 != 0, formula).alias("formula"))
    return O.sheet_cells(cells, ["sheet"])


_SHEETS_SQL = """
e AS (SELECT user_id AS sheet, date_diff('day', DATE '2024-01-01', ts::DATE) AS r, list_position(['click', 'view', 'purchase', 'signup', 'error', 'search'], event_type) - 1 AS c, event_id, value FROM events),
last AS (SELECT sheet, r, c, arg_max(value, event_id) AS v, max(event_id) AS id FROM e WHERE c >= 0 GROUP BY ALL),
cell AS (SELECT sheet, r, c, CASE WHEN id % 11 = 0 THEN '' ELSE v::DECIMAL(18,2)::VARCHAR || CASE WHEN id % 4 = 0 THEN ',"x"' ELSE '' END END AS t, CASE WHEN id % 11 <> 0 THEN floor(v)::BIGINT::VARCHAR END AS val, CASE WHEN id % 13 = 0 AND id % 11 <> 0 THEN '=A' || r END AS f FROM last),
ends AS (SELECT sheet, max(r) FILTER (t <> '' OR val IS NOT NULL) AS last_row FROM cell GROUP BY sheet),
wide AS (SELECT cell.sheet, max(c) + 1 AS w, any_value(last_row) AS last_row FROM cell JOIN ends USING (sheet) WHERE r <= last_row GROUP BY cell.sheet),
grid AS (SELECT g.sheet, g.r, g.c, coalesce(t, '') AS t, val, f, w FROM (SELECT sheet, w, r, unnest(range(w)) AS c FROM (SELECT sheet, w, unnest(range(last_row + 1)) AS r FROM wide)) g LEFT JOIN cell USING (sheet, r, c)),
kept AS (SELECT sheet, r FROM grid GROUP BY sheet, r HAVING bool_or(t <> '' OR val IS NOT NULL)),
full_rows AS (SELECT sheet, r, any_value(w) AS w, '|' || string_agg(' ' || t || ' |', '' ORDER BY c) || chr(10) AS md, string_agg(CASE WHEN regexp_matches(t, '[",]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END, ',' ORDER BY c) AS csv, count(*) AS n FROM grid JOIN kept USING (sheet, r) GROUP BY sheet, r)"""


@query(f"""WITH {_SHEETS_SQL}, first AS (SELECT sheet, min(r) AS r FROM full_rows GROUP BY sheet)
SELECT sheet, sha256('## User ' || sheet || chr(10) || chr(10) || max(md) FILTER (full_rows.r = first.r) || '|' || repeat(' --- |', any_value(w)::INT) || chr(10) || coalesce(string_agg(md, '' ORDER BY full_rows.r) FILTER (full_rows.r > first.r), '') || chr(10)) AS md_sha256,
  any_value(w)::INT AS n_columns, count(*)::INT AS n_rows, sha256(string_agg(CASE WHEN n = 1 AND csv = '' THEN '""' ELSE csv END || chr(10), '' ORDER BY full_rows.r)) AS csv_sha256 FROM full_rows JOIN first USING (sheet) GROUP BY sheet""")
def sheet_grid(spark, d):
    """Sheets from sparse cells, as Markdown and CSV."""
    grids = _sheets(spark, d)
    name = F.concat(F.lit("User "), F.col("sheet").cast("string"))
    return grids.select("sheet", F.sha2(TB.sheet_markdown(name, F.col("grid")), 256).alias("md_sha256"), F.size(F.get("grid", F.lit(0))).alias("n_columns"), F.size(TB.content_rows(F.col("grid"))).alias("n_rows"), F.sha2(TB.sheet_csv(F.col("grid")), 256).alias("csv_sha256")).where("n_rows > 0")


@query(f"""WITH {_SHEETS_SQL}, js AS (SELECT sheet, r, '[' || string_agg('{{"text":' || to_json(t) || ',"value":' || coalesce(val, 'null') || CASE WHEN f IS NULL THEN '' ELSE ',"formula":' || to_json(f) END || '}}', ',' ORDER BY c) || ']' AS j FROM grid GROUP BY sheet, r),
first AS (SELECT sheet, min(r) AS r FROM kept GROUP BY sheet), heads AS (SELECT sheet, '[' || string_agg(to_json(t), ',' ORDER BY c) || ']' AS h FROM grid JOIN first USING (sheet, r) GROUP BY sheet)
SELECT sheet, sha256('{{"name":"' || sheet || '","headers":' || any_value(h) || ',"rows":[' || string_agg(j, ',' ORDER BY r) || ']}}') AS json_sha256 FROM js JOIN heads USING (sheet) GROUP BY sheet""")
def sheet_json(spark, d):
    """Sheets as typed JSON."""
    return _sheets(spark, d).where(F.size("grid") > 0).select("sheet", F.sha2(TB.sheet_json(F.col("sheet").cast("string"), F.col("grid")), 256).alias("json_sha256"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN l_quantity WHEN 2 THEN l_discount WHEN 3 THEN 'nan'::DOUBLE WHEN 4 THEN 'inf'::DOUBLE WHEN 5 THEN l_quantity * 1e15 ELSE -l_tax * 100 END AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN isfinite(x) THEN CASE WHEN x = floor(x) AND abs(x) < 9e15 THEN 'int' ELSE 'float' END ELSE 'null' END AS kind, CASE WHEN isfinite(x) AND x = floor(x) AND abs(x) < 9e15 THEN x::BIGINT::VARCHAR END AS whole FROM v""")
def typed_cells_json(spark, d):
    """Numbers as JSON values: whole, fractional, or null if not finite."""
    c, n = F.col, F.col("l_linenumber")
    x = F.when(n == 1, c("l_quantity")).when(n == 2, c("l_discount")).when(n == 3, F.lit(float("nan"))).when(n == 4, F.lit(float("inf"))).when(n == 5, c("l_quantity") * 1e15).otherwise(-c("l_tax") * 100)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", TB.number_value(x).alias("v"))
    whole = F.rlike("v", F.lit("^-?[0-9]+$"))
    return rows.select("l_orderkey", "l_linenumber", F.when(c("v").isNull(), "null").when(whole, "int").otherwise("float").alias("kind"), F.when(whole, c("v")).alias("whole"))

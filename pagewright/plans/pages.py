"""Plans over pages: glyph frames, routes, lines, words, regions and what belongs to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import glyphs as GL
from ..operators import ordered as OR
from ..operators import ownership as OW
from ..operators import paged as PG
from ..operators import suppress as SU
from . import sql as Q
from .inputs import BOXES_SQL, REGIONS_SQL, boxes, regions
from .registry import query, table

IS_MATH = f"(regexp_matches(lower(font), 'cmmi|cmsy|cmex|msam|msbm|math|symbol|mathjax|stix|xits|asana|euclid') OR regexp_matches(ch, '{Q.MATH}'))"
#: Glyphs top-down, and the line (from 0, top first) of each.
LINED_SQL = f"{Q.GLYPHS}, lined AS (SELECT doc_id, page_no, glyph_no, ch, x, 792.0 - y - h AS y, w, h, font, (dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY 792.0 - y - h) - 1)::INT AS line_no FROM glyphs)"


def _pages(spark, d):
    return PG.pages_of_text(table(spark, d, "documents").select("doc_id", "text"))


@query(f"WITH {Q.GLYPHS} SELECT doc_id, page_no, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, sum(unicode(ch))::BIGINT AS codes FROM glyphs GROUP BY ALL")
def glyph_frame(spark, d):
    """Glyphs of every text: counts, bounds and a checksum of each page."""
    sums = PG.page_sums(_pages(spark, d)).groupBy(*GL.PAGE)
    return sums.agg(F.sum("n_chars").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("codes").alias("codes"))


@query(f"WITH {Q.GLYPHS} SELECT doc_id, page_no, count_if({IS_MATH})::BIGINT AS n_math, count(*) AS n_chars FROM glyphs GROUP BY ALL")
def math_signal(spark, d):
    """Mathematical and all glyphs of each page."""
    return PG.page_sums(_pages(spark, d)).groupBy(*GL.PAGE).agg(F.sum("n_math").alias("n_math"), F.sum("n_chars").alias("n_chars"))


_MODES = ("auto", "auto", "never", "always", "surgical")


@query(f"""WITH {Q.GLYPHS}, s AS (SELECT doc_id, page_no, count_if({IS_MATH} OR (doc_id % 9 = 0 AND ch = 'e')) AS n_math, count(*) AS n_chars, doc_id % 3 AS n_images, (['{"','".join(_MODES)}'])[(doc_id % {len(_MODES)} + 1)::INT] AS mode FROM glyphs GROUP BY ALL)
SELECT doc_id, page_no, mode, CASE mode WHEN 'never' THEN 'fast' WHEN 'surgical' THEN 'surgical' WHEN 'always' THEN 'full' ELSE CASE WHEN (n_math > 30 AND n_math / n_chars::DOUBLE > 0.02) OR (n_chars < 50 AND n_images > 0) THEN 'full' ELSE 'fast' END END AS route FROM s""")
def page_routing(spark, d):
    """The route of each page under four modes."""
    from ..operators.pages import route

    flagged = F.col("n_math") + F.when(F.col("doc_id") % 9 == 0, F.col("n_counted")).otherwise(0)
    pages = PG.page_sums(_pages(spark, d), counted="e").groupBy(*GL.PAGE).agg(F.sum(flagged).alias("n_math"), F.sum("n_chars").alias("n_chars"))
    mode = F.get(F.array(*map(F.lit, _MODES)), (F.col("doc_id") % len(_MODES)).cast("int"))
    return pages.select(*GL.PAGE, mode.alias("mode"), route(F.col("n_math"), F.col("n_chars"), F.col("doc_id") % 3, mode).alias("route"))


@query("""WITH r AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, l_quantity AS median FROM r WHERE k = n // 2 + 1""")
def upper_median_height(spark, d):
    """Upper medians of groups of any size."""
    return OR.upper_median_by(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "median")


@query(f"""WITH {LINED_SQL}, inked AS (SELECT *, coalesce(x - lag(x + w) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY x, glyph_no) > w * 0.25, false) AS gap FROM lined WHERE NOT regexp_matches(ch, '^\\s$')),
words AS (SELECT *, sum(gap::INT) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY x, glyph_no) AS word_no FROM inked)
SELECT doc_id, page_no, line_no, count(DISTINCT word_no)::INT AS n_words, min(x) AS x0, max(x + w) AS x1, max(y + h) AS y1 FROM words GROUP BY ALL""")
def word_segmentation(spark, d):
    """Words and bounds of every line."""
    return PG.word_rows(_pages(spark, d), GL.PAGE_HEIGHT).groupBy(*GL.LINE).agg(F.count(F.lit(1)).cast("int").alias("n_words"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query(f"""WITH {LINED_SQL}, l AS (SELECT doc_id, page_no, line_no, {Q.trim("string_agg(ch, '' ORDER BY x, glyph_no)")} AS text FROM lined GROUP BY ALL)
SELECT doc_id, page_no, count(*)::INT AS n_lines, sha256(string_agg(text, chr(10) ORDER BY line_no)) AS text_sha256 FROM l WHERE text <> '' GROUP BY ALL""")
def cluster_lines(spark, d):
    """Visual lines of every page and their text in visual order."""
    texts = PG.line_rows(_pages(spark, d), GL.PAGE_HEIGHT)
    return texts.groupBy(*GL.PAGE).agg(F.count(F.lit(1)).cast("int").alias("n_lines"), F.sha2(OR.joined("text", ["line_no"], "\n"), 256).alias("text_sha256"))


_CODE_FONT = "CASE WHEN glyph_no // 96 % 3 = 0 AND doc_id % 2 = 0 THEN 'Courier New' ELSE font END"


@query(f"""WITH {Q.GLYPHS}, m AS (SELECT doc_id, page_no, (y * 10)::INT AS band, {Q.trim("string_agg(ch, '' ORDER BY glyph_no)")} AS code FROM glyphs WHERE regexp_matches(lower({_CODE_FONT}), 'mono|courier|consol|menlo|inconsolata|sourcecode|dejavu sans mono|fixed|terminal') GROUP BY ALL)
SELECT doc_id, page_no, count(*) AS n_blocks, sha256(string_agg('```' || chr(10) || code || chr(10) || '```', chr(10) || chr(10) ORDER BY band)) AS code_sha256 FROM m WHERE strlen(code) > 4 GROUP BY ALL""")
def code_block_runs(spark, d):
    """Fences around runs of fixed-width glyphs, every third line of every other document."""
    styled = lambda g: (g.no // 96 % 3 == 0) & (g.key("doc_id") % 2 == 0)
    return GL.fenced_runs(PG.code_runs(PG.gathered(_pages(spark, d)), styled)).select(*GL.PAGE, "n_blocks", F.sha2("code", 256).alias("code_sha256"))


# ---------------------------------------------------------------------------------------------- ownership

PRIORITY = """CASE WHEN label LIKE '%caption%' OR label LIKE '%footnote%' OR label LIKE '%figure_title%' OR label LIKE '%table_title%' THEN 2 WHEN label LIKE '%table%' THEN 1
  WHEN label LIKE '%equation%' OR label LIKE '%formula%' THEN 0 WHEN label LIKE '%figure%' OR label LIKE '%image%' OR label LIKE '%chart%' OR label LIKE '%seal%' THEN 9 ELSE 3 END"""
OWNED_SQL = f"""{LINED_SQL}, {REGIONS_SQL},
ranked AS (SELECT *, {PRIORITY} AS priority, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY {PRIORITY}, y0, x0, region_no) - 1 AS claim_rank FROM regions),
hits AS (SELECT g.doc_id, g.page_no, g.line_no, g.glyph_no, r.region_no, r.claim_rank, (least(r.x1, x + w) - greatest(r.x0, x)) * (least(r.y1, y + h) - greatest(r.y0, y)) AS a FROM lined g JOIN ranked r ON g.doc_id = r.doc_id AND g.page_no = r.page_no
  AND least(r.x1, x + w) > greatest(r.x0, x) AND least(r.y1, y + h) > greatest(r.y0, y) WHERE priority <> 9),
owner AS (SELECT doc_id, page_no, line_no, glyph_no, arg_min(region_no, (-a, claim_rank)) AS owner FROM hits GROUP BY ALL),
owned AS (SELECT lined.*, owner FROM lined LEFT JOIN owner USING (doc_id, page_no, line_no, glyph_no))"""


def _owned(spark, d):
    pages = _pages(spark, d)
    boxes_of = regions(pages)
    return PG.owned_runs(PG.with_regions(pages, boxes_of), height=GL.PAGE_HEIGHT), boxes_of


@query(f"WITH {OWNED_SQL} SELECT doc_id, page_no, owner, count(*) AS n, sum(glyph_no)::BIGINT AS glyphs FROM owned GROUP BY ALL")
def glyph_region_ownership(spark, d):
    """How many glyphs, and which, each region owns; those without an owner come with a null."""
    owned, _ = _owned(spark, d)
    return owned.groupBy(*GL.PAGE, "owner").agg(F.sum("n").alias("n"), F.sum("glyphs").alias("glyphs"))


@query(f"""WITH {OWNED_SQL}, t AS (SELECT o.doc_id, o.page_no, line_no, owner AS region_no, count(*) AS n, any_value(claim_rank) AS claim_rank FROM owned o JOIN ranked r ON o.doc_id = r.doc_id AND o.page_no = r.page_no AND o.owner = r.region_no GROUP BY ALL)
SELECT doc_id, page_no, line_no, arg_min(region_no, (-n, claim_rank)) AS region_no, max(n) AS n_glyphs FROM t GROUP BY ALL""")
def line_majority_owner(spark, d):
    """The region of each line."""
    return OW.line_owners(_owned(spark, d)[0])


@query(f"""WITH {OWNED_SQL}, l AS (SELECT doc_id, page_no, line_no, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM owned WHERE owner IS NULL GROUP BY ALL),
near AS (SELECT l.doc_id, l.page_no, l.line_no, arg_min(region_no, (greatest(r.y0 - (l.y0 + l.y1) / 2, (l.y0 + l.y1) / 2 - r.y1, 0), region_no)) AS region_no FROM l JOIN ranked r ON l.doc_id = r.doc_id AND l.page_no = r.page_no
  AND (l.x0 + l.x1) / 2 BETWEEN r.x0 - 8 AND r.x1 + 8 AND (l.y0 + l.y1) / 2 BETWEEN r.y0 - 8 AND r.y1 + 8 WHERE priority <> 9 GROUP BY ALL)
SELECT l.doc_id, l.page_no, l.line_no, region_no FROM l LEFT JOIN near USING (doc_id, page_no, line_no)""")
def seam_homeless(spark, d):
    """Lines of unowned glyphs with the padded region that adopts them, or none."""
    owned, boxes_of = _owned(spark, d)
    # dealt by page once, for the lines and for their regions
    runs = owned.where("owner is null").repartition(*GL.PAGE)
    lines = runs.groupBy(*GL.LINE).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return OW.seams(lines, boxes_of).select(*GL.LINE, "region_no")


_TWO_SQL = f"{BOXES_SQL}, a AS (SELECT * FROM boxes WHERE flag = 'R'), b AS (SELECT * FROM boxes WHERE flag <> 'R')"


def _two(spark, d):
    rows = boxes(spark, d)
    return rows.where("flag = 'R'"), rows.where("flag <> 'R'")


@query(f"""WITH {_TWO_SQL}, c AS (SELECT a.doc_id, a.page_no, a.no, b.no AS img_no, {Q.shared('a.', 'b.')} / {Q.area('b.')} AS cover FROM a JOIN b USING (doc_id, page_no)),
best AS (SELECT doc_id, page_no, no, arg_min(img_no, (-cover, img_no)) AS img_no, max(cover) AS cover FROM c WHERE cover >= 0.6 GROUP BY ALL) SELECT a.doc_id, a.page_no, a.no, img_no, cover FROM a LEFT JOIN best USING (doc_id, page_no, no)""")
def figure_asset_match(spark, d):
    """The raster that each figure region covers best."""
    a, b = _two(spark, d)
    return OW.embedded_match(a, b.withColumnRenamed("no", "img_no")).select(*GL.PAGE, "no", "img_no", "cover")


_GAP = """CASE WHEN b.y0 < a.y1 AND a.y0 < b.y1 THEN CASE WHEN greatest(b.x0 - a.x1, a.x0 - b.x1, 0) <= 66 AND greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) >= 0.5 * least(a.y1 - a.y0, b.y1 - b.y0) THEN greatest(b.x0 - a.x1, a.x0 - b.x1, 0) END
  WHEN least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.3 * least(a.x1 - a.x0, b.x1 - b.x0) THEN CASE WHEN b.y0 >= a.y1 THEN b.y0 - a.y1 ELSE a.y0 - b.y1 END END"""


@query(f"""WITH {_TWO_SQL}, c AS (SELECT a.doc_id, a.page_no, a.no, b.no AS caption_no, {_GAP} AS gap FROM a JOIN b USING (doc_id, page_no)),
best AS (SELECT doc_id, page_no, no, arg_min(caption_no, (gap, caption_no)) AS caption_no, min(gap) AS gap FROM c WHERE gap <= 33 GROUP BY ALL)
SELECT a.doc_id, a.page_no, a.no, caption_no, gap, CASE WHEN caption_no % 3 <> 0 THEN 'Figure ' || caption_no END AS caption FROM a LEFT JOIN best USING (doc_id, page_no, no)""")
def nearest_caption(spark, d):
    """The caption of each figure, below, above or beside it; a blank one is none."""
    a, b = _two(spark, d)
    text = F.when(F.col("no") % 3 != 0, F.concat(F.lit("Figure "), F.col("no").cast("string"))).otherwise(" ")
    captions = b.withColumn("label", F.lit("figure_caption")).withColumn("text", text).withColumnRenamed("no", "region_no")
    return OW.nearest_captions(a, captions, 33.0).select(*GL.PAGE, "no", "caption_no", "gap", "caption")


_IOU = Q.xyxy_iou("a.", "b.")
_PART_IOU, _PART_COVER = Q.xyxy_iou("p.", "b."), f"{Q.shared('p.', 'b.')} / {Q.area('b.')}"


@query(f"""WITH {_TWO_SQL}, ab AS (SELECT a.doc_id, a.page_no, a.no, b.no AS region_no, {_IOU} AS iou, a AS t, b AS r FROM a JOIN b USING (doc_id, page_no)),
m AS (SELECT doc_id, page_no, no, region_no, iou, {{'x0': t.x0, 'y0': t.y1, 'x1': t.x1, 'y1': t.y1 + 60}} AS p, r AS b FROM ab),
h AS (SELECT doc_id, page_no, no, region_no, iou FROM m WHERE greatest(iou, {_PART_IOU}) > 0.2 OR {_PART_COVER} > 0.2),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, no ORDER BY iou DESC, region_no) = 1 AS anchor FROM h)
SELECT doc_id, page_no, no AS table_no, region_no, anchor FROM k UNION ALL SELECT doc_id, page_no, no, NULL, false FROM a WHERE (doc_id, page_no, no) NOT IN (SELECT (doc_id, page_no, no) FROM h)""")
def table_claims(spark, d):
    """Regions that page tables suppress, their anchors, and tables without any."""
    a, b = _two(spark, d)
    part = F.struct(F.col("x0"), F.col("y1").alias("y0"), F.col("x1"), (F.col("y1") + 60).alias("y1"))
    return OW.table_claims(a.withColumn("parts", F.array(part)).withColumnRenamed("no", "table_no"), b.withColumnRenamed("no", "region_no"), 0.2)


@query(f"""WITH {_TWO_SQL}, c AS (SELECT a.doc_id, a.page_no, a.no, min(b.no) AS region_no FROM a JOIN b ON a.doc_id = b.doc_id AND a.page_no = b.page_no
  AND (a.x0 + a.x1) / 2 BETWEEN b.x0 - 6 AND b.x1 + 6 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 - 6 AND b.y1 + 6 GROUP BY ALL) SELECT a.doc_id, a.page_no, a.no, region_no FROM a LEFT JOIN c USING (doc_id, page_no, no)""")
def math_box_claims(spark, d):
    """The first region that consumes each math box."""
    a, b = _two(spark, d)
    return OW.first_claims(a, b.withColumnRenamed("no", "region_no")).select(*GL.PAGE, "no", "region_no")


def _fold_sql(order: str, blocked: str) -> str:
    """Kept boxes of each page by an ordered fold: a recursion that carries the kept ones."""
    return f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY {order}) AS k FROM boxes),
kept(doc_id, page_no, k, ks) AS (SELECT doc_id, page_no, 0::BIGINT, []::STRUCT(no INT, flag VARCHAR, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] FROM (SELECT DISTINCT doc_id, page_no FROM boxes)
  UNION ALL SELECT o.doc_id, o.page_no, o.k, CASE WHEN len(list_filter(ks, lambda s: {blocked})) > 0 THEN ks ELSE list_append(ks, {{'no': o.no, 'flag': o.flag, 'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1}}) END
  FROM kept JOIN ordered o ON o.doc_id = kept.doc_id AND o.page_no = kept.page_no AND o.k = kept.k + 1),
last AS (SELECT doc_id, page_no, arg_max(ks, k) AS ks FROM kept GROUP BY ALL)
SELECT doc_id, page_no, unnest(list_transform(ks, lambda s: s.no)) AS no FROM last"""


@query(f"WITH RECURSIVE {BOXES_SQL}, {_fold_sql('score DESC, no', 's.flag = o.flag AND ' + Q.xyxy_iou('s.', 'o.') + ' > 0.1')}")
def nms_regions(spark, d):
    """Detections that survive within their class."""
    rows = boxes(spark, d).withColumnRenamed("no", "object_no").withColumnRenamed("flag", "label")
    return SU.suppress_detections(rows, 0.1).select(*GL.PAGE, F.col("object_no").alias("no"))


@query(f"WITH RECURSIVE {BOXES_SQL}, {_fold_sql('no', 's.flag <> ' + chr(39) + 'A' + chr(39) + ' AND o.flag <> ' + chr(39) + 'A' + chr(39) + ' AND ' + Q.xyxy_iou('s.', 'o.') + ' >= 0.1')}")
def figure_dedup(spark, d):
    """Regions without figures drawn twice."""
    label = F.when(F.col("flag") == "A", "text").otherwise("Figure")
    rows = boxes(spark, d).withColumn("label", label).withColumnRenamed("no", "region_no")
    return SU.dedup_figures(rows, 0.1).select(*GL.PAGE, F.col("region_no").alias("no"))


@query(f"WITH RECURSIVE {BOXES_SQL}, {_fold_sql('no', Q.shared('s.', 'o.') + ' / greatest((o.x1 - o.x0) * (o.y1 - o.y0), 1e-6) > 0.25')}")
def recognition_claims(spark, d):
    """Regions that are recognized, each area once."""
    return SU.claim_recognition(boxes(spark, d).withColumnRenamed("no", "region_no")).select(*GL.PAGE, F.col("region_no").alias("no"))


@query(f"""WITH {BOXES_SQL}, m AS (SELECT doc_id, no, x0, y0, x1, y1, row_number() OVER () AS r FROM boxes)
SELECT doc_id, no, {Q.area('')} AS area, 792 - y0 - (y1 - y0) AS flipped, trunc(greatest((x0 - 4) * 25 / 6, 0))::BIGINT AS crop_left, trunc(greatest((y1 + 4) * 25 / 6, 0))::BIGINT AS crop_bottom, 500 - y1 AS turned_x0, round(1 / (1 + exp((x0 - y0) / 100)), 9) AS edge_p,
  (y1 - y0) <= 0.25 * 792 AND (x1 - x0) * (y1 - y0) <= 0.15 * 612 * 792 AS plausible, least(640 / (x1 - x0), 640 / (y1 - y0)) AS ratio FROM m""")
def box_geometry(spark, d):
    """Areas, flips, crops, turns, probabilities and plausibility of single boxes."""
    b = G.box()
    crop = G.crop_pixels(b, F.lit(300.0), 4.0)
    rows = boxes(spark, d)
    return rows.select(
        "doc_id", "no", G.area(b).alias("area"), G.flip(b.y0, b.height, F.lit(792.0)).alias("flipped"), crop["left"].alias("crop_left"), crop["bottom"].alias("crop_bottom"), G.clockwise(b, F.lit(500.0)).x0.alias("turned_x0"),
        F.round(G.edge_probability(b.x0 / 100, b.y0 / 100), 9).alias("edge_p"), G.is_plausible_formula(b, F.lit(612.0), F.lit(792.0)).alias("plausible"), G.letterbox(b.width, b.height, 640)["ratio"].alias("ratio"),
    )


#: Runs of math glyphs of a line that stand no further apart than two and a half heights; on these pages lines with math
#: are too far apart to stack, and runs to be one display.
@query(f"""WITH {Q.GLYPHS}, m AS (SELECT *, 792.0 - y - h AS top, glyph_no // 96 AS row_no FROM glyphs WHERE (glyph_no // 96 % 5 = 0 AND glyph_no % 96 % 40 < 24) OR regexp_matches(ch, '{Q.MATH}')),
b AS (SELECT *, coalesce(x - lag(x + w) OVER (PARTITION BY doc_id, page_no, row_no ORDER BY x) > 27.5, true)::INT AS brk FROM m),
r AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page_no, row_no ORDER BY x) AS run FROM b),
c AS (SELECT doc_id, page_no, min(x) AS x0, min(top) AS y0, max(x + w) AS x1, max(top + h) AS y1 FROM r GROUP BY doc_id, page_no, row_no, run HAVING count(*) >= 5)
SELECT doc_id, page_no, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0) - 1)::INT AS cluster_no, 1 AS n_members, x0, y0, x1, y1 FROM c""")
def math_clusters(spark, d):
    """Formula clusters of pages whose every fifth line is set in a math font."""
    styled = lambda g: (g.no // 96 % 5 == 0) & (g.no % 96 % 40 < 24)
    return PG.math_clusters(PG.gathered(_pages(spark, d)), height=GL.PAGE_HEIGHT, styled=styled)


@query(f"""WITH {OWNED_SQL}, broken AS (SELECT *, coalesce(x - lag(x + w) OVER (PARTITION BY doc_id, page_no, line_no, owner IS NULL ORDER BY x) > 14, false)::INT AS brk FROM owned),
parts AS (SELECT * REPLACE (line_no * 1000 + sum(brk) OVER (PARTITION BY doc_id, page_no, line_no, owner IS NULL ORDER BY x) AS line_no) FROM broken),
t AS (SELECT o.doc_id, o.page_no, line_no, owner AS region_no, count(*) AS n, any_value(claim_rank) AS claim_rank FROM parts o JOIN ranked r ON o.doc_id = r.doc_id AND o.page_no = r.page_no AND o.owner = r.region_no GROUP BY ALL),
win AS (SELECT doc_id, page_no, line_no, arg_min(region_no, (-n, claim_rank)) AS region_no FROM t GROUP BY ALL),
texts AS (SELECT doc_id, page_no, line_no, min(y) AS y0, {Q.trim("string_agg(ch, '' ORDER BY x, glyph_no)")} AS text FROM parts WHERE owner IS NOT NULL GROUP BY ALL),
bodies AS (SELECT doc_id, page_no, region_no, string_agg(text, chr(10) ORDER BY y0, line_no) AS text FROM texts JOIN win USING (doc_id, page_no, line_no) WHERE text <> '' GROUP BY ALL),
blocks AS (SELECT r.doc_id, r.page_no, row_number() OVER (PARTITION BY r.doc_id, r.page_no ORDER BY r.y0, r.x0, r.region_no) AS k, CASE WHEN priority = 2 THEN coalesce(text, CASE WHEN label LIKE '%table%' THEN '[table: ' || label || ']' END) WHEN label LIKE '%table%' THEN coalesce(text, '[table: ' || label || ']') WHEN priority = 0 THEN text WHEN priority = 9 THEN NULL WHEN label LIKE '%title%' THEN '## ' || text ELSE text END AS b
  FROM ranked r LEFT JOIN bodies t ON r.doc_id = t.doc_id AND r.page_no = t.page_no AND r.region_no = t.region_no),
free AS (SELECT doc_id, page_no, line_no, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, {Q.trim("string_agg(ch, '' ORDER BY x, glyph_no)")} AS text FROM parts WHERE owner IS NULL GROUP BY ALL),
home AS (SELECT DISTINCT l.doc_id, l.page_no, l.line_no FROM free l JOIN ranked r ON l.doc_id = r.doc_id AND l.page_no = r.page_no AND (l.x0 + l.x1) / 2 BETWEEN r.x0 - 8 AND r.x1 + 8 AND (l.y0 + l.y1) / 2 BETWEEN r.y0 - 8 AND r.y1 + 8 WHERE priority <> 9),
every AS (SELECT doc_id, page_no, k, b FROM blocks WHERE b IS NOT NULL UNION ALL SELECT doc_id, page_no, 1000 + line_no, text FROM free ANTI JOIN home USING (doc_id, page_no, line_no) WHERE text <> ''),
page_md AS (SELECT doc_id, page_no, string_agg(b, chr(10) || chr(10) ORDER BY k) AS md FROM every GROUP BY ALL)
SELECT doc_id, count(*)::INT AS n_pages, sha256(string_agg(md, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_no)) AS md_sha256 FROM page_md GROUP BY doc_id""")
def page_assembly(spark, d):
    """Whole pages from glyphs and regions, joined to documents: ownership, blocks by kind, homeless lines."""
    from ..operators.pages import documents_of, structured_pages

    pages = _pages(spark, d)
    docs = documents_of(structured_pages(pages, regions(pages), height=GL.PAGE_HEIGHT))
    return docs.select("doc_id", "n_pages", F.sha2("md", 256).alias("md_sha256"))


@query(r"""SELECT doc_id, sha256(regexp_replace(text, '^(\s*)\S+\s+\S+', '\1$$' || chr(10) || 'x' || chr(10) || '$$') || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '$lost$' ELSE '' END) AS md_sha256 FROM documents WHERE regexp_matches(text, '^\s*\S+\s+\S')""")
def surgical_splice(spark, d):
    """A formula in the place of each text's first two words, and for half of them one whose place is not found."""
    from ..operators.pages import splice_formulas

    docs = table(spark, d, "documents").where(F.rlike("text", F.lit(r"(?U)^\s*\S+\s+\S")))
    pages = docs.select("doc_id", F.lit(0).alias("page_no"), F.col("text").alias("md"))
    ws = T.words("text")
    first = docs.select("doc_id", F.lit(0).alias("page_no"), F.lit(0).alias("ord"), F.concat(F.get(ws, F.lit(0)), F.lit("  \n"), F.get(ws, F.lit(1))).alias("needle"), F.lit("$$\nx\n$$").alias("block"))
    lost = docs.where("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("page_no"), F.lit(1).alias("ord"), F.lit("no \u2603 where").alias("needle"), F.lit("$lost$").alias("block"))
    return splice_formulas(pages, first.unionByName(lost)).select("doc_id", F.sha2("md", 256).alias("md_sha256"))


def _hit(needle: str, cursor: str) -> str:
    return f"({cursor} + instr(substring(plain, {cursor} + 1), {needle}))"


@query(f"""WITH {LINED_SQL}, t AS (SELECT doc_id, page_no, line_no, min(y) AS y0, {Q.trim("string_agg(ch, '' ORDER BY x, glyph_no)")} AS text FROM lined GROUP BY ALL),
c AS (SELECT *, array_to_string({Q.words('text')}, ' ') AS flat, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS n FROM t WHERE text <> ''),
p AS (SELECT *, coalesce(sum(length(flat) + 1) OVER (PARTITION BY doc_id, page_no ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS begins FROM c),
pages AS (SELECT doc_id, page_no, string_agg(flat, ' ' ORDER BY n) AS plain, min(n) FILTER (y0 >= 129.5) AS a1, list(flat ORDER BY n) AS flats, list(y0 ORDER BY n) AS tops, list(begins ORDER BY n) AS starts FROM p GROUP BY ALL),
two AS (SELECT *, list_filter(range(1, len(flats) + 1), lambda i: tops[i] >= 189.5 AND i > a1)[1] AS a2 FROM pages),
h AS (SELECT *, {_hit('flats[a1]', '0')} AS hit FROM two), g AS (SELECT *, {_hit('flats[a2]', '(hit - 1 + length(flats[a1]))')} AS hit2 FROM h),
j AS (SELECT doc_id, page_no, len(list_filter(starts, lambda s: s <= hit)) AS j, len(list_filter(starts, lambda s: s <= hit2)) AS j2 FROM g),
m AS (SELECT c.doc_id, c.page_no, string_agg(CASE WHEN n = j THEN chr(10) || chr(10) || '![](p' || c.page_no || '/img0.png)' || chr(10) || chr(10) ELSE '' END || CASE WHEN n = j2 THEN chr(10) || chr(10) || '![](p' || c.page_no || '/img1.png)' || chr(10) || chr(10) ELSE '' END || text, chr(10) ORDER BY n) AS md
  FROM c LEFT JOIN j ON c.doc_id = j.doc_id AND c.page_no = j.page_no GROUP BY ALL)
SELECT doc_id, page_no, len(regexp_extract_all(md, '!\\['))::INT AS n_links, sha256(md) AS md_sha256 FROM m""")
def image_interleave(spark, d):
    """Two images on each page of text, linked before the lines that follow them."""
    from ..operators.pages import place_page_images

    lines = PG.line_rows(_pages(spark, d), GL.PAGE_HEIGHT)
    pages = lines.groupBy(*GL.PAGE).agg(OR.joined("text", ["line_no"], "\n").alias("md"))
    k = F.col("img_no")
    rasters = pages.select(*GL.PAGE, F.explode(F.sequence(F.lit(0), F.lit(1))).alias("img_no")).select(*GL.PAGE, F.lit(50.0).alias("x0"), (100.0 + 60 * k).alias("y0"), F.lit(90.0).alias("x1"), (130.0 + 60 * k).alias("y1"), F.format_string("p%d/img%d.png", "page_no", k).alias("src"))
    placed = place_page_images(pages, lines, rasters)
    return placed.select(*GL.PAGE, T.count_of(F.col("md"), r"!\[").alias("n_links"), F.sha2("md", 256).alias("md_sha256"))

"""Inputs of plans: whole driver tables in the shapes that the operators take, made by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import glyphs as GL
from .registry import table
from .sql import PREFIXES


def outlines(spark, d: str) -> DataFrame:
    """doc_id, md: every text with a sentence a line, numbered by turns in the ways that headings are."""
    lines = F.split(F.regexp_replace("text", r"[.!?](?U)\s", "\n"), "\n", -1)
    prefix = lambda i: F.get(F.array(*map(F.lit, PREFIXES)), i % len(PREFIXES))
    md = F.array_join(F.transform(lines, lambda line, i: F.concat(prefix(i), line)), "\n")
    return table(spark, d, "documents").where("text is not null").select("doc_id", md.alias("md"))


LABELS = ("text", "formula", "table", "figure_title", "image", "footnote", "paragraph_title", "table_caption")
#: Regions of a page (pixels at scale 1, top-down): columns that overlap in the middle, six a page.
REGIONS_SQL = f"""
pages_of AS (SELECT DISTINCT doc_id, page_no FROM glyphs),
regions AS (SELECT doc_id, page_no, CAST(k AS INT) AS region_no, 40.0 + 260 * (k % 2) AS x0, 60.0 + 130 * (k // 2) + 7 * (doc_id % 5) AS y0,
  340.0 + 420 * (k % 2) AS x1, 210.0 + 130 * (k // 2) + 7 * (doc_id % 5) AS y1, (['{"','".join(LABELS)}'])[((doc_id + page_no + k) % {len(LABELS)} + 1)::INT] AS label
  FROM pages_of, range(6) AS t(k))
"""


def regions(pages: DataFrame) -> DataFrame:
    """Six regions for each (doc_id, page_no)."""
    k, shift = F.col("k"), 7.0 * (F.col("doc_id") % 5)
    row, side = F.floor(k / 2), k % 2
    label = F.get(F.array(*map(F.lit, LABELS)), ((F.col("doc_id") + F.col("page_no") + k) % len(LABELS)).cast("int"))
    rows = pages.select(*GL.PAGE).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return rows.select(
        *GL.PAGE, k.cast("int").alias("region_no"), (40.0 + 260 * side).alias("x0"), (60.0 + 130 * row + shift).alias("y0"), (340.0 + 420 * side).alias("x1"), (210.0 + 130 * row + shift).alias("y1"), label.alias("label")
    )


#: Boxes of two kinds on pages, from order lines: whole numbers, so that both engines measure them alike. Lines are
#: numbered anew within their order, as their own numbers repeat.
BOX_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
BOXES_SQL = f"""
boxes AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 AS INT) AS page_no, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(BOX_ORDER)}) AS INT) AS no, CAST(l_partkey % 400 AS DOUBLE) AS x0, CAST(l_suppkey % 90 * 5 AS DOUBLE) AS y0,
  CAST(l_partkey % 400 + 20 + l_quantity * 4 AS DOUBLE) AS x1, CAST(l_suppkey % 90 * 5 + 30 + l_quantity AS DOUBLE) AS y1, l_returnflag AS flag, CAST(l_quantity AS DOUBLE) AS score FROM lineitem)
"""


def boxes(spark, d: str) -> DataFrame:
    c = F.col
    no = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*BOX_ORDER))
    return table(spark, d, "lineitem").select(
        c("l_orderkey").alias("doc_id"), (c("l_linenumber") % 2).cast("int").alias("page_no"), no.alias("no"), (c("l_partkey") % 400).cast("double").alias("x0"), (c("l_suppkey") % 90 * 5).cast("double").alias("y0"),
        (c("l_partkey") % 400 + 20 + c("l_quantity") * 4).cast("double").alias("x1"), (c("l_suppkey") % 90 * 5 + 30 + c("l_quantity")).cast("double").alias("y1"), c("l_returnflag").alias("flag"), c("l_quantity").cast("double").alias("score"),
    )

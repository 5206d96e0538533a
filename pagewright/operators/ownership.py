"""Which region a glyph, line, raster, caption or table belongs to: theta joins with an argmax.

Regions of a page are gathered to one array and joined by page, so a glyph meets its page's regions inside its row: the
plan has one equi-join by page and no row for each pair. A region frame has ``doc_id, page_no, region_no, x0, y0, x1,
y1, label`` in render pixels; glyphs are in top-down points and are scaled by ``scale``.

Nulls: rows with a null page key match nothing; a region with a null label is text. Equal regions go by region_no.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from .glyphs import LINE, PAGE
from .ordered import best_of, joined

TIE, SEAM_PAD, OWNS_NOTHING = 1e-6, 8.0, 9


def reading_order(regions: DataFrame) -> DataFrame:
    """``region_no`` renumbered from 0 by (top, left)."""
    by = Window.partitionBy(*PAGE).orderBy("y0", "x0", "region_no")
    return regions.withColumn("region_no", (F.row_number().over(by) - 1).cast("int"))


def claim_ranks(regions: DataFrame) -> DataFrame:
    """Adds ``priority`` and ``claim_rank``: how early a region claims among those of its page."""
    rows = regions.withColumn("priority", T.claim_priority(F.coalesce("label", F.lit(""))))
    by = Window.partitionBy(*PAGE).orderBy("priority", "y0", "x0", "region_no")
    return rows.withColumn("claim_rank", (F.row_number().over(by) - 1).cast("int"))


def by_page(regions: DataFrame, *columns: str) -> DataFrame:
    """One row a page: ``regions``, an array of structs in order of region_no. A page's regions are few."""
    items = F.array_sort(F.collect_list(F.struct(F.col("region_no").alias("no"), *columns)))
    return regions.groupBy(*PAGE).agg(items.alias("regions"))


def _owner(regions, glyph: G.Box) -> Column:
    """The region of the largest overlap; near-equal overlaps go to the earlier claim. A fold, as ties are not transitive."""

    rated = F.transform(
        F.filter(regions, lambda r: r["priority"] != OWNS_NOTHING),
        lambda r: F.struct(G.shared(G.of_struct(r), glyph).alias("a"), r["claim_rank"].alias("rank"), r["no"].alias("no")),
    )

    def take(best, r):
        near = (F.abs(r["a"] - best["a"]) <= best["a"] * TIE) & (r["rank"] < best["rank"])
        return F.when(best["no"].isNull() | (r["a"] > best["a"]) | near, r).otherwise(best)

    start = F.struct(F.lit(0.0).alias("a"), F.lit(0).alias("rank"), F.lit(None).cast("int").alias("no"))
    return F.aggregate(F.filter(rated, lambda r: r["a"] > 0), start, take)["no"]


def glyph_owners(glyphs: DataFrame, regions: DataFrame, scale: float = 1.0) -> DataFrame:
    """``glyphs`` with ``owner``, the region_no of the region that owns each, or null."""
    pages = by_page(claim_ranks(regions), "x0", "y0", "x1", "y1", "priority", "claim_rank")
    g = G.xywh(F.col("x"), F.col("y"), F.col("w"), F.col("h")).times(scale)
    return glyphs.join(pages, PAGE, "left").withColumn("owner", _owner(F.col("regions"), g)).drop("regions")


def line_owners(runs: DataFrame) -> DataFrame:
    """For each line of owned runs (``paged.owned_runs``) the region that owns most of it; ties go to the earlier claim.

    Runs are dealt by page once; a line's runs and its owners are counted there.
    """
    tally = runs.where("owner is not null").repartition(*PAGE).groupBy(*LINE, F.col("owner").alias("region_no")).agg(F.sum("n").alias("n"), F.min("claim_rank").alias("claim_rank"))
    best = tally.groupBy(*LINE).agg(F.min(F.struct((-F.col("n")).alias("m"), "claim_rank", "region_no")).alias("b"))
    return best.select(*LINE, F.col("b.region_no").alias("region_no"), (-F.col("b.m")).alias("n_glyphs"))


def seams(lines: DataFrame, regions: DataFrame, scale: float = 1.0) -> DataFrame:
    """Lines of unowned glyphs (bounds in points) with ``region_no`` of the nearest padded region, null if homeless."""
    pages = by_page(regions.withColumn("priority", T.claim_priority(F.coalesce("label", F.lit("")))), "x0", "y0", "x1", "y1", "priority")
    cx, cy = (c * scale for c in G.center(G.box()))

    def distance(r):
        b = G.of_struct(r)
        d = F.greatest(b.y0 - cy, cy - b.y1, F.lit(0.0))
        inside = (r["priority"] != OWNS_NOTHING) & G.contains_point(b.padded(SEAM_PAD * scale), cx, cy)
        return F.when(inside, F.struct(d.alias("d"), r["no"].alias("no")))

    near = F.array_min(F.transform("regions", distance))
    return lines.join(pages, PAGE, "left").withColumn("region_no", near["no"]).drop("regions")


def embedded_match(figures: DataFrame, rasters: DataFrame, min_cover: float = 0.6) -> DataFrame:
    """``figures`` with ``img_no`` and ``cover`` of the raster that each covers best, if by ``min_cover``."""
    bounds = F.struct(F.col("img_no").alias("no"), "x0", "y0", "x1", "y1")
    pages = rasters.where("x0 is not null").groupBy(*PAGE).agg(F.array_sort(F.collect_list(bounds)).alias("rasters"))

    def cover(r):
        c = G.covered(G.of_struct(r), G.box())
        return F.when(c >= min_cover, F.struct((-c).alias("c"), r["no"].alias("no")))

    best = F.array_min(F.transform("rasters", cover))
    return figures.join(pages, PAGE, "left").withColumn("img_no", best["no"]).withColumn("cover", -best["c"]).drop("rasters")


def nearest_captions(figures: DataFrame, captions: DataFrame, max_gap: float) -> DataFrame:
    """``figures`` with ``caption_no``, ``gap`` and ``caption`` of the nearest caption region; ties go to the first."""
    items = F.struct(F.col("region_no").alias("no"), "x0", "y0", "x1", "y1", "text")
    pages = captions.where(F.contains(F.lower("label"), F.lit("caption"))).groupBy(*PAGE).agg(F.array_sort(F.collect_list(items)).alias("caps"))

    def near(c):
        gap = G.caption_gap(G.box(), G.of_struct(c), F.lit(max_gap))
        return F.when(gap.isNotNull(), F.struct(gap.alias("gap"), c["no"].alias("no"), c["text"].alias("text")))

    best = F.array_min(F.transform("caps", near))
    caption = F.when(T.trim(best["text"]) != "", best["text"])
    return figures.join(pages, PAGE, "left").withColumn("caption_no", best["no"]).withColumn("gap", best["gap"]).withColumn("caption", caption).drop("caps")


def first_claims(boxes: DataFrame, regions: DataFrame, margin: float = 6.0) -> DataFrame:
    """Math boxes with ``region_no``: the first region, in order, whose margin holds the box's centre, consumes it."""
    pages = by_page(regions, "x0", "y0", "x1", "y1")
    cx, cy = G.center(G.box())
    inside = F.filter("regions", lambda r: G.contains_point(G.of_struct(r).padded(margin), cx, cy))
    return boxes.join(pages, PAGE, "left").withColumn("region_no", F.get(inside, F.lit(0))["no"]).drop("regions")


def table_claims(tables: DataFrame, regions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Claims of page tables on layout regions: one row for each (table, region) suppressed, with ``anchor``.

    ``tables``: doc_id, page_no, table_no, bounds and ``parts`` (array of bounds of linked captions and footers). A
    region is suppressed if a claim box's IoU with it, or a part's cover of it, is above the threshold. Tables without
    any such region come with a null region_no and go to the page's end.
    """
    pages = by_page(regions, "x0", "y0", "x1", "y1")
    rows = tables.join(pages, PAGE, "left").select(*PAGE, "table_no", "x0", "y0", "x1", "y1", "parts", F.explode_outer("regions").alias("r"))
    region, table = G.of_struct(F.col("r")), G.box()
    parts = lambda f: F.coalesce(F.array_max(F.transform("parts", f)), F.lit(0.0))
    by_iou = F.greatest(G.iou(table, region), parts(lambda p: G.iou(G.of_struct(p), region)))
    by_cover = parts(lambda p: G.covered(region, G.of_struct(p)))
    rows = rows.withColumn("hit", F.coalesce((by_iou > threshold) | (by_cover > threshold), F.lit(False))).withColumn("anchor_iou", G.iou(table, region))
    hits = rows.where("hit").select(*PAGE, "table_no", F.col("r.no").alias("region_no"), "anchor_iou")
    first = F.row_number().over(Window.partitionBy(*PAGE, "table_no").orderBy(F.desc("anchor_iou"), "region_no"))
    anchored = hits.withColumn("anchor", first == 1).drop("anchor_iou")
    trailing = tables.select(*PAGE, "table_no").join(hits, [*PAGE, "table_no"], "left_anti")
    return anchored.unionByName(trailing.select("*", F.lit(None).cast("int").alias("region_no"), F.lit(False).alias("anchor")))


def region_texts(lines: DataFrame) -> DataFrame:
    """Text of each region: its lines (bounds, text, ``region_no``) from top to bottom."""
    return lines.groupBy(*PAGE, "region_no").agg(joined("text", ["y0", "line_no"], "\n").alias("text"))


__all__ = ["best_of", "by_page", "claim_ranks", "embedded_match", "first_claims", "glyph_owners", "line_owners", "nearest_captions", "reading_order", "region_texts", "seams", "table_claims"]

"""Pages and documents put together: routes, blocks by kind of region, fallbacks, page breaks.

The routes are split before any recognizer is planned, so a page costs what its route costs. Recognized results come as
frames (see ``models``); where there are none a page degrades to its text layer.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import splice as SP
from ..functions import text as T
from ..session import ship
from . import glyphs as GL
from . import ownership as OW
from . import paged as PG
from .ordered import joined

#: Ordinals of what follows a page's regions: lines that no region adopts, then tables without a region.
HOMELESS, TRAILING = 1_000_000, 2_000_000


def route(n_math, n_chars, n_images, mode, use_models: bool = True, math_chars: int = 30, min_text: int = 50) -> Column:
    """``fast``, ``surgical`` or ``full``."""
    heavy = T.needs_models(n_math, n_chars, n_images, mode, use_models, math_chars, min_text)
    mode = F.lit(mode) if isinstance(mode, str) else mode
    surgical = (mode == "surgical") & F.lit(use_models)
    return F.when(surgical, "surgical").when(heavy, "full").otherwise("fast")


def fast_text(page_md, text) -> Column:
    """A page's own Markdown, else its text layer."""
    return F.coalesce(page_md, text, F.lit(""))


def with_fallback(full_md, fast_md) -> Column:
    """What the dear route gave, unless that is blank or failed."""
    return F.when(T.trim(full_md) != "", full_md).otherwise(fast_md)


def block(label, text, structured=None, recognized=None, picture=None) -> Column:
    """Markdown of one region by its label, null for none.

    Captions are text wherever they have any. Tables: structured, else their text, else recognized, else a note that
    there is a table. Formulas: recognized, else their text. Figures: their picture. Other regions: text, else what was
    recognized, with a heading mark for titles.
    """
    null = F.lit(None).cast("string")
    of = lambda c: null if c is None else c
    low = F.lower(F.coalesce(label, F.lit("")))
    has_text = F.when(T.trim(text) != "", text)
    table = F.coalesce(of(structured), has_text, of(recognized), F.concat(F.lit("[table: "), label, F.lit("]")))
    return (
        F.when(T.caption_block(low, text).isNotNull(), text)
        .when(F.contains(low, F.lit("table")), table)
        .when(T.contains_any(low, T.MATH_LABELS), F.coalesce(of(recognized), has_text))
        .when(T.is_figure(low), of(picture))
        .otherwise(T.text_block(low, F.coalesce(has_text, of(recognized))))
    )


def region_blocks(regions: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, page_no, ord, md of all regions in reading order. ``texts``: region_no, text.

    ``regions`` may have ``structured``, ``recognized``, ``picture`` (Markdown) and ``suppressed``.
    """
    ordered = OW.reading_order(regions.withColumn("__own", F.col("region_no")))
    rows = ordered.join(texts.withColumnRenamed("region_no", "__own"), [*GL.PAGE, "__own"], "left")
    extra = {c: F.col(c) for c in ("structured", "recognized", "picture") if c in regions.columns}
    rows = rows.where(~F.col("suppressed")) if "suppressed" in regions.columns else rows
    return rows.select(*GL.PAGE, F.col("region_no").alias("ord"), block(F.col("label"), F.col("text"), **extra).alias("md")).where("md is not null")


def structured_pages(pages: DataFrame, regions: DataFrame, scale: float = 1.0, tables: DataFrame | None = None, height: float | None = None) -> DataFrame:
    """doc_id, page_no, md of pages (rows with ``glyphs``) from layout regions. ``height``: flip to top-down.

    Lines are clustered once among owned and once among unowned glyphs, in one pass; lines that a padded region adopts
    are not repeated, the homeless follow the regions. ``tables`` (doc_id, page_no, table_no, md) go to the end.
    """
    lines = PG.region_lines(PG.with_regions(pages, regions), scale, height)
    return assembled(lines, regions, OW.region_texts(lines.where("not free")), tables, scale)


def assembled(lines: DataFrame, regions: DataFrame, texts: DataFrame, tables: DataFrame | None = None, scale: float = 1.0) -> DataFrame:
    """doc_id, page_no, md from lines with their regions, the regions with what is known of them, and their texts."""
    homeless = OW.seams(lines.where("free").drop("region_no"), regions, scale).where("region_no is null").select(*GL.PAGE, (F.col("line_no") + HOMELESS).alias("ord"), F.col("text").alias("md"))
    blocks = region_blocks(regions, texts).unionByName(homeless)
    if tables is not None:
        blocks = blocks.unionByName(tables.select(*GL.PAGE, (F.col("table_no") + TRAILING).alias("ord"), "md"))
    return blocks.groupBy(*GL.PAGE).agg(joined("md", ["ord"], "\n\n").alias("md")).where(T.trim("md") != "")


def documents_of(pages: DataFrame, promote: bool = False) -> DataFrame:
    """Pages as documents: doc_id, n_pages, md; headings and title promoted if asked for."""
    md = T.promote_headings("md") if promote else F.col("md")
    docs = pages.withColumn("md", md).groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_pages"), joined("md", ["page_no"], T.PAGE_BREAK).alias("md"))
    return docs.withColumn("md", T.promote_title(F.col("md"))) if promote else docs


def figure_links(figures: DataFrame, rasters: DataFrame, captions: DataFrame, max_gap: float, min_area: float = 100.0) -> DataFrame:
    """Figure regions with ``picture``: a link to the raster that they cover, with the nearest caption as its text.

    ``rasters`` has ``src``; small ones are decoration and match nothing. Figures without a raster keep a null picture
    for a crop to fill in.
    """
    matched = OW.embedded_match(figures, rasters)
    sized = rasters.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= min_area).select(*GL.PAGE, "img_no", "src")
    rows = OW.nearest_captions(matched, captions, max_gap).join(sized, [*GL.PAGE, "img_no"], "left")
    alt = F.coalesce(T.caption_alt(F.col("caption")), F.lit(""))
    return rows.withColumn("picture", F.when(F.col("src").isNotNull(), F.concat(F.lit("!["), alt, F.lit("]("), F.col("src"), F.lit(")"))))


def gate_pages(full: DataFrame, fast: DataFrame, gated: DataFrame) -> DataFrame:
    """Full pages but where the render gate fires: those fall back to the fast text with the salvaged formulas."""
    rows = fast.select(*GL.PAGE, F.col("md").alias("fast_md")).join(full.select(*GL.PAGE, F.col("md").alias("full_md")), GL.PAGE, "left").join(gated.select(*GL.PAGE, "fires", "salvaged"), GL.PAGE, "left")
    fallen = F.concat(F.col("fast_md"), F.array_join(F.transform(F.coalesce("salvaged", F.array().cast("array<string>")), lambda s: F.concat(F.lit("\n\n"), s)), ""))
    return rows.select(*GL.PAGE, F.when(F.coalesce("fires", F.lit(False)), fallen).otherwise(with_fallback(F.col("full_md"), F.col("fast_md"))).alias("md"))


def place_page_images(pages: DataFrame, lines: DataFrame, rasters: DataFrame, min_area: float = 100.0) -> DataFrame:
    """Fast pages (doc_id, page_no, md) with links to placed images before the text that follows them on the page.

    ``lines``: bounds and text of visual lines; ``rasters``: bounds and ``src``. Decoration and images that the text
    references are left out; those that find no line stay for the gallery. A page's lines and images are gathered to
    arrays; what finds their places keeps a cursor, so it is a function of the page.
    """
    ship(pages.sparkSession)
    by_line = lines.groupBy(*GL.PAGE).agg(F.collect_list(F.struct("y0", "y1", "text")).alias("lines"))
    sized = rasters.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= min_area)
    by_image = sized.groupBy(*GL.PAGE).agg(F.array_sort(F.collect_list(F.struct("y0", "y1", "src"))).alias("images"))

    @F.pandas_udf("string")
    def place(texts: pd.Series, lines: pd.Series, images: pd.Series) -> pd.Series:
        row = lambda r, last: (r["y0"], r["y1"], r[last])
        return pd.Series([SP.place_images(t, [row(x, "text") for x in ls], [row(x, "src") for x in ims]) for t, ls, ims in zip(texts, lines, images)])

    rows = pages.join(by_image, GL.PAGE, "left").join(by_line, GL.PAGE, "left")
    fresh = F.filter("images", lambda i: ~F.contains("md", F.concat(F.lit("("), i["src"], F.lit(")"))))
    rows = rows.withColumn("images", fresh)
    wanted = (F.size(F.coalesce("images", F.array().cast(rows.schema["images"].dataType))) > 0) & F.col("lines").isNotNull() & F.col("md").isNotNull()
    placed, others = rows.where(wanted), rows.where(~F.coalesce(wanted, F.lit(False)))
    return placed.withColumn("md", place("md", "lines", "images")).unionByName(others).drop("lines", "images")


def splice_formulas(pages: DataFrame, formulas: DataFrame) -> DataFrame:
    """Pages (doc_id, page_no, md) with recognized formulas in the places of their text: ``formulas`` has ``ord``,
    ``needle`` and ``block``. A needle is found despite reflow; a block whose needle is not found follows at the end."""
    ship(pages.sparkSession)
    by_page = formulas.groupBy(*GL.PAGE).agg(F.array_sort(F.collect_list(F.struct("ord", "needle", "block"))).alias("found"))

    @F.pandas_udf("string")
    def put(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([SP.splice(t, [(f["needle"] or "", f["block"] or "") for f in fs]) for t, fs in zip(texts, found)])

    rows = pages.join(by_page, GL.PAGE, "left")
    wanted = F.col("found").isNotNull() & F.col("md").isNotNull()
    return rows.where(wanted).withColumn("md", put("md", "found")).unionByName(rows.where(~wanted)).drop("found")

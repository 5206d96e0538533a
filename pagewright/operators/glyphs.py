"""Glyph frames: pages of positioned characters, their signals, words, lines, code runs and math boxes.

A glyph frame has ``doc_id, page_no, glyph_no, ch, x, y, w, h, font``. Everything that needs order works on one page
at a time; pages made from plain text have ``LINES`` lines of at most ``COLUMNS`` characters, so a page is bounded
however long its document is. Null texts have no glyphs. Repeated documents keep their own pages if their doc_id
differs; rows with equal doc_id share pages, as their glyphs are told apart by nothing else.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ordered import joined, upper_median

LINES, COLUMNS = 50, 96
PAGE_HEIGHT, TOP, LINE_STEP = 792.0, 700.0, 14.0
PAGE = ["doc_id", "page_no"]
LINE = [*PAGE, "line_no"]


def text_lines(docs: DataFrame, lines: int = LINES, columns: int = COLUMNS) -> DataFrame:
    """doc_id, page_no, row_no (in the page), line: a text's lines, wrapped and dealt to pages."""
    wrapped = F.flatten(F.transform(F.split("text", "\n", -1), lambda line: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(line) / columns) - 1, F.lit(0)).cast("int")), lambda k: F.substr(line, k * columns + 1, F.lit(columns)))))
    rows = docs.where("text is not null").select("doc_id", F.posexplode(wrapped).alias("at", "line"))
    return rows.select("doc_id", F.floor(F.col("at") / lines).cast("int").alias("page_no"), (F.col("at") % lines).alias("row_no"), "line")


def from_text(docs: DataFrame, lines: int = LINES, columns: int = COLUMNS) -> DataFrame:
    """Glyphs of plain text on a fixed grid: bottom-up points, 8 apart, 7 wide, 11 high.

    Characters in a mathematical range get a math font; lines that are indented get a fixed-width one.
    """
    rows = text_lines(docs, lines, columns)
    glyphs = rows.select("doc_id", "page_no", "row_no", F.rlike("line", F.lit("^(    |\t)")).alias("code"), F.posexplode(F.split("line", "", -1)).alias("i", "ch"))
    font = F.when(F.col("code"), "CourierNew").when(T.is_math_char(F.col("ch")), "CMMI10").otherwise("Times-Roman")
    return glyphs.where("ch <> ''").select(
        "doc_id", "page_no", (F.col("row_no") * columns + F.col("i")).cast("int").alias("glyph_no"), "ch",
        (F.lit(50.0) + 8 * F.col("i")).alias("x"), (F.lit(TOP) - LINE_STEP * F.col("row_no")).alias("y"), F.lit(7.0).alias("w"), F.lit(11.0).alias("h"), font.alias("font"),
    )


def top_down(glyphs: DataFrame, page_height: float = PAGE_HEIGHT) -> DataFrame:
    return glyphs.withColumn("y", F.lit(page_height) - F.col("y") - F.col("h"))


def page_signals(glyphs: DataFrame) -> DataFrame:
    """n_math, n_chars of each page."""
    return glyphs.groupBy(*PAGE).agg(F.count_if(T.is_math_glyph(F.col("ch"), F.col("font"))).alias("n_math"), F.count(F.lit(1)).alias("n_chars"))


def line_height(glyphs: DataFrame, page_height: float = PAGE_HEIGHT) -> DataFrame:
    """The upper median of the positive glyph heights of each page, else a fiftieth of the page."""
    return glyphs.groupBy(*PAGE).agg(F.coalesce(upper_median(F.when(F.col("h") > 0, F.col("h"))), F.lit(page_height / 50)).alias("line_height"))


def assign_lines(glyphs: DataFrame) -> DataFrame:
    """Adds ``line_no``: visual lines of each page. One shuffle by page; see ``paged`` for pages that are rows already.

    Glyphs in order of (centre height, left edge) begin a line where they leave the band of the line's first glyph,
    which a comparison with the last glyph could not tell; and where the gap to the last glyph is a column gutter. A
    gutter does not move the band.
    """
    from . import paged as PG

    return PG.lined_glyphs(PG.paged(glyphs)).select(*[F.col(f"`{c}`") for c in glyphs.columns], "line_no")


def page_text(lines: DataFrame) -> DataFrame:
    """Visual order of each page, line by line, from rows of lines."""
    return lines.groupBy(*PAGE).agg(joined("text", ["line_no"], "\n").alias("text"))


def code_blocks(glyphs: DataFrame) -> DataFrame:
    """Fenced runs of fixed-width glyphs, one for each height of a page in ascending height; short runs are no code."""
    mono = glyphs.where(T.is_mono_font(F.col("font"))).withColumn("band", (F.col("y") * 10).cast("int"))
    return fenced_runs(mono.groupBy(*PAGE, "band").agg(joined("ch", ["glyph_no"], "").alias("code")))


def fenced_runs(runs: DataFrame) -> DataFrame:
    """Code and number of blocks of each page from its runs: ``band`` and ``code``."""
    fenced = runs.where(F.octet_length(T.trim("code")) > 4).withColumn("code", F.concat(F.lit("```\n"), T.trim("code"), F.lit("\n```")))
    return fenced.groupBy(*PAGE).agg(joined("code", ["band"], "\n\n").alias("code"), F.count(F.lit(1)).alias("n_blocks"))


# ---------------------------------------------------------------------------------------------- math boxes


def _grow(a, b):
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def math_boxes(boxes: list[tuple[float, float, float, float]], min_chars: int, hgap_times: float, vgap_times: float):
    """Boxes of formulas from the boxes of one page's math glyphs: bands, runs in a band, then runs that stack.

    Absorbing changes a box, so stacking is repeated until nothing is absorbed; each absorbs into the first that fits.
    """
    if not boxes:
        return []
    heights = sorted(y1 - y0 for _, y0, _, y1 in boxes)
    height = max(heights[len(heights) // 2], 10.0)
    hgap, vgap = hgap_times * height, vgap_times * height
    bands: list[list] = []
    for b in sorted(boxes, key=lambda b: (b[1] + b[3]) / 2):
        if bands and abs((b[1] + b[3]) / 2 - (bands[-1][0][1] + bands[-1][0][3]) / 2) <= 0.8 * height:
            bands[-1].append(b)
        else:
            bands.append([b])

    def absorb(items, fits):
        out: list[list] = []
        for b, n in items:
            home = next((o for o in out if fits(o[0], b)), None)
            if home is None:
                out.append([b, n])
            else:
                home[0], home[1] = _grow(home[0], b), home[1] + n
        return out

    def beside(u, b):
        return b[0] <= u[2] + hgap and b[2] >= u[0] - hgap

    def stacked(u, b):
        return beside(u, b) and max(b[1] - u[3], u[1] - b[3], 0.0) <= vgap

    runs = [r for band in bands for r in absorb([(b, 1) for b in sorted(band, key=lambda b: b[0])], beside)]
    runs.sort(key=lambda r: (r[0][1], r[0][0]))
    while len(merged := absorb(runs, stacked)) < len(runs):
        runs = merged
    return [b for b, n in merged if n >= min_chars]


def cluster_boxes(boxes, cx, cy, line_height: float):
    """Math boxes that are one displayed formula: next to or under the cluster before, with no glyph (of centres ``cx``,
    ``cy``) between."""
    out: list[tuple[tuple, list]] = []

    def empty(x0, y0, x1, y1):
        return not ((x0 < cx) & (cx < x1) & (y0 <= cy) & (cy <= y1)).any()

    for b in boxes:
        if out:
            c, members = out[-1]
            hgap, vgap = b[0] - c[2], b[1] - c[3]
            row = abs((b[1] + b[3]) / 2 - (c[1] + c[3]) / 2) <= 0.5 * line_height and 0 <= hgap <= 3 * line_height
            left, right = max(c[0], b[0]), min(c[2], b[2])
            stack = right > left and 0 <= vgap <= line_height
            if row and empty(c[2], min(b[1], c[1]), b[0], max(c[3], b[3])) or stack and empty(left, c[3], right, b[1]):
                out[-1] = (_grow(c, b), [*members, b])
                continue
        out.append((b, [b]))
    return out


def clusters_of_page(x, y, w, h, math, min_chars: int, hgap: float, vgap: float):
    """Clusters of the formula boxes of one page, from arrays of its glyphs' measures and whether each is mathematical."""
    of = np.flatnonzero(math)
    boxes = math_boxes(list(zip(x[of].tolist(), y[of].tolist(), (x[of] + w[of]).tolist(), (y[of] + h[of]).tolist())), min_chars, hgap, vgap)
    if not boxes:
        return []
    tall = np.sort(h[h > 0])
    height = float(tall[len(tall) // 2]) if len(tall) else PAGE_HEIGHT / 50
    return cluster_boxes(boxes, (x + (x + w)) / 2, (y + (y + h)) / 2, height)


CLUSTERS = "doc_id long, page_no int, cluster_no int, n_members int, x0 double, y0 double, x1 double, y1 double"


def math_clusters(glyphs: DataFrame, min_chars: int = 5, hgap: float = 2.5, vgap: float = 0.9) -> DataFrame:
    """Clusters of formula boxes of each page; the gaps of the surgical route are 1.5 and 1.5."""

    def find(page: pd.DataFrame) -> pd.DataFrame:
        found = clusters_of_page(*(page[c].to_numpy(float) for c in ("x", "y", "w", "h")), page["math"].to_numpy(bool), min_chars, hgap, vgap)
        keys = (page["doc_id"].iloc[0], page["page_no"].iloc[0])
        return pd.DataFrame([(*keys, k, len(m), *map(float, c)) for k, (c, m) in enumerate(found)], columns=[c.split()[0] for c in CLUSTERS.split(", ")])

    flagged = glyphs.withColumn("math", T.is_math_glyph(F.col("ch"), F.col("font")))
    mathy = flagged.where("math").select(*PAGE).distinct()
    return flagged.join(mathy, PAGE, "left_semi").select(*PAGE, "x", "y", "w", "h", "math").groupBy(*PAGE).applyInPandas(find, CLUSTERS)

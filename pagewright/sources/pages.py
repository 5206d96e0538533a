"""Page sources: pre-extracted pages of documents as a data source, and tables in an area of a page.

``PageSource`` reads files of one JSON object a page (the shape of ``FIELDS``), a partition for each file, so any
extractor that can write lines of JSON plugs in; ``register`` makes it ``spark.read.format("pagewright_pages")``.
"""

from __future__ import annotations

import fnmatch
import glob
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import geometry as G
from ..session import local_path, open_input, ship

FIELDS = "doc_id long, page_no int, page_md string, n_images int, width double, height double, glyphs array<struct<ch:string,x:double,y:double,w:double,h:double,font:string>>"
_GLYPH = (("ch", str), ("x", float), ("y", float), ("w", float), ("h", float), ("font", str))


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


def matching(path: str) -> list[str]:
    """The files that a path with wildcards names, in order; a path without is itself. Other stores than plain files are
    listed by pyarrow's file systems."""
    if not any(c in path for c in "*?["):
        return [path]
    if path.startswith("file:") or "://" not in path:
        return sorted(glob.glob(local_path(path), recursive=True))
    from pyarrow import fs

    folder = path[: path.rindex("/", 0, min(path.index(c) for c in "*?[" if c in path))]
    store, base = fs.FileSystem.from_uri(folder)
    prefix = folder[: len(folder) - len(base)]
    found = (f"{prefix}{f.path}" for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file)
    return sorted(p for p in found if fnmatch.fnmatchcase(p, path))


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]

    def partitions(self):
        return [FilePartition(p) for path in self.paths for p in matching(path)]

    def read(self, partition):
        with open_input(partition.path) as file:
            for line in io.TextIOWrapper(file, encoding="utf-8"):
                if not line.strip():
                    continue
                page = json.loads(line)
                glyphs = [tuple(kind(g[name]) for name, kind in _GLYPH) for g in page.get("glyphs", ())]
                yield (page["doc_id"], page["page_no"], page.get("page_md"), page.get("n_images", 0), float(page.get("width", 612)), float(page.get("height", 792)), glyphs)


class PageSource(DataSource):
    @classmethod
    def name(cls):
        return "pagewright_pages"

    def schema(self):
        return FIELDS

    def reader(self, schema):
        return PageReader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(PageSource)


def glyphs_of(pages: DataFrame) -> DataFrame:
    """The glyph frame of pages."""
    rows = pages.select("doc_id", "page_no", F.posexplode("glyphs").alias("glyph_no", "g"))
    return rows.select("doc_id", "page_no", "glyph_no", "g.ch", "g.x", "g.y", "g.w", "g.h", "g.font")


def tables_in(tables: DataFrame, areas: DataFrame) -> DataFrame:
    """Source tables (doc_id, page_no, table_no, bounds) that meet areas (doc_id, page_no, area_no, bounds) of a page."""
    boxes = [F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")]
    rows = tables.join(areas.select("doc_id", "page_no", "area_no", *boxes), ["doc_id", "page_no"])
    area = G.Box(*(F.col(f"a_{c}") for c in ("x0", "y0", "x1", "y1")))
    inter = G.intersection(G.box(), area)
    return rows.where((inter.x1 > inter.x0) & (inter.y1 > inter.y0)).drop("a_x0", "a_y0", "a_x1", "a_y1")

"""Conversion and ingestion of files and folders as frames, and what is written of them.

``Converter`` holds settings and recognizers. Every file is a row; a file that fails is a row with an ``error``.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .errors import ArticleFailed, OfficeError, SourceError, UnsupportedFormat
from .functions import text as T
from .functions import udfs
from .models import Registry
from .operators import arms as AR
from .operators import assets as A
from .operators import glyphs as GL
from .operators import paged as PG
from .operators import pages as P
from .session import local_path, open_output, ship, written
from .sources import files as FI
from .sources import office as OF

RESULT = ["path", "md", "n_pages", "error"]
_ERRORS = {"office": OfficeError, "jats": ArticleFailed, "text": UnsupportedFormat, "pdf": UnsupportedFormat}


class Converter:
    """Documents to Markdown by their extension: office packages, scholarly XML, text, and pages of a page source."""

    def __init__(self, spark: SparkSession, config: Config | None = None, models: Registry | None = None):
        self.spark, self.config, self.models = spark, config or Config(), models or Registry()

    def describe(self) -> dict:
        """Settings, plan of passes and which recognizers there are."""
        return {"config": self.config.to_dict(), "plan": self.config.runtime_plan(False), "models": self.models.status()}

    def convert_files(self, files: DataFrame) -> DataFrame:
        """path, md, n_pages, error of files with path and content. Page formats need a page source: see
        ``convert_pages``."""
        routes = FI.by_route(files)
        text = FI.read_text(routes["text"]).select("path", F.col("text").alias("md"), "error")
        office = OF.convert_office(routes["office"]).select("path", F.col("markdown").alias("md"), "error")
        article = routes["jats"].select("path", udfs.jats_to_markdown(F.decode("content", "UTF-8")).alias("r")).select("path", F.col("r.markdown").alias("md"), "r.error")
        paged = routes["pdf"].select("path", F.lit(None).cast("string").alias("md"), F.lit("pages of this format come from a page source").alias("error"))
        return text.unionByName(office).unionByName(article).unionByName(paged).select("path", "md", F.lit(0).alias("n_pages"), "error")

    def convert_pages(self, pages: DataFrame, glyphs: DataFrame, regions: DataFrame | None = None, images: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
        """doc_id, n_pages, md from pre-extracted pages (doc_id, page_no, page_md, n_images) and glyphs (bottom-up).

        ``regions``: layout regions in render pixels, else those of the layout recognizer if there is one; ``images``:
        placed images (img_no, bounds in points from the top, src); ``tables``: tables of the source (table_no, bounds,
        md). Pages go by their route: ``full`` ones are put together from their regions, ``surgical`` ones get formulas
        into their own text, and all others, and those that come out blank, keep their own text.
        """
        c = self.config
        whole = PG.paged(glyphs)
        signals = pages.join(GL.page_signals(glyphs), GL.PAGE, "left").fillna(0, ["n_math", "n_chars"])
        way = P.route(F.col("n_math"), F.col("n_chars"), F.coalesce("n_images", F.lit(0)), c.routing_mode, c.use_onnx, c.math_char_threshold, c.scanned_text_threshold)
        routed = signals.withColumn("route", way)
        lines = PG.line_rows(whole, GL.PAGE_HEIGHT)
        own = F.col("text") if c.preserve_layout else P.fast_text(F.col("page_md"), F.col("text"))
        fast = routed.join(GL.page_text(lines), GL.PAGE, "left").select(*GL.PAGE, "route", F.coalesce("text", F.lit("")).alias("layer_text"), F.coalesce(own, F.lit("")).alias("md"))
        of_route = lambda df, route: df.join(routed.where(F.col("route") == route).select(*GL.PAGE), GL.PAGE, "left_semi")
        parts = [fast.where("route = 'fast'").select(*GL.PAGE, "md")]
        if images is not None and c.extract_images:
            parts = [P.place_page_images(parts[0], lines, images, c.min_figure_area_pts).select(*GL.PAGE, "md")]
        text = fast.where("route = 'surgical'").select(*GL.PAGE, "md")
        parts.append(AR.surgical(of_route(whole, "surgical"), GL.top_down(of_route(glyphs, "surgical")), text, self.models, c).select(*GL.PAGE, "md") if self.models.status()["formula"] else text)
        parts.append(self._full(of_route(whole, "full"), of_route(pages, "full"), fast.where("route = 'full'"), regions, images, tables))
        done = reduce(DataFrame.unionByName, parts)
        done = done.withColumn("md", T.promote_headings(F.col("md"))) if c.promote_headings else done
        if c.detect_code_blocks:
            done = done.join(GL.code_blocks(glyphs), GL.PAGE, "left").select(*GL.PAGE, F.concat_ws("\n\n", "md", "code").alias("md"))
        docs = P.documents_of(done)
        if images is not None and c.extract_images and c.append_unreferenced_images:
            placed = images.select("doc_id", F.concat(F.lpad(F.col("page_no").cast("string"), 9, "0"), F.lit(":"), F.lpad(F.col("img_no").cast("string"), 9, "0")).alias("img_no"), "src", (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))
            docs = A.with_gallery(docs, placed, c.min_figure_area_pts).drop("n_gallery")
        return docs.withColumn("md", T.promote_title(F.col("md"))) if c.promote_title else docs

    def _full(self, whole: DataFrame, pages: DataFrame, fast: DataFrame, regions: DataFrame | None, images: DataFrame | None, tables: DataFrame | None) -> DataFrame:
        """doc_id, page_no, md of the pages of the dear route: their regions, gated, else their own text."""
        c = self.config
        if regions is None and self.models.status()["layout"]:
            regions = AR.detected(pages, self.models, c)
        if regions is None:
            return fast.select(*GL.PAGE, "md")
        regions = regions.join(pages.select(*GL.PAGE), GL.PAGE, "left_semi")
        full = AR.full_pages(whole, regions, self.models, c, images, tables)
        if not (c.render_gate_enabled and self.models.status()["ocr"]):
            both = fast.join(full.withColumnRenamed("md", "full_md"), GL.PAGE, "left")
            return both.select(*GL.PAGE, P.with_fallback(F.col("full_md"), F.col("md")).alias("md"))
        full = written(full, "full-pages")
        checked = AR.gated(fast.join(full.withColumnRenamed("md", "full_md"), GL.PAGE).select(*GL.PAGE, "layer_text", "full_md"), self.models, c)
        return P.gate_pages(full, fast.select(*GL.PAGE, "md"), checked)

    def recognize_formula(self, crops: DataFrame) -> DataFrame:
        """``crops`` (a ``crop`` column) with ``latex``, sanitized if the settings say so; a recognizer must be there."""
        rows = self.models.run("formula", crops, "crop", None, required=True)
        return rows.withColumn("latex", udfs.sanitize_latex(F.col("latex"))["latex"]) if self.config.sanitize_ocr else rows

    def ingest(self, files: DataFrame, out_dir: str, lint: Callable | None = None) -> DataFrame:
        """Converted documents with their images staged: path, md_path, md, n_images, n_pages, data_files, error.

        ``lint``: a function of a Markdown column to ``struct(fixed, content)``; its content is taken if it says so.
        The links name assets that ``ingest_with_assets`` also returns.
        """
        return self.ingest_with_assets(files, out_dir, lint)[0]

    def ingest_with_assets(self, files: DataFrame, out_dir: str, lint: Callable | None = None) -> tuple[DataFrame, DataFrame]:
        """``ingest``, and the files that go with its documents: path, data (see ``write_files``).

        Those are images that links were moved to, under the asset store, pictures of office packages, and the sheets
        and the whole of workbooks.
        """
        docs = self.convert_files(files).withColumn("stem", T.stem(F.col("path")))
        good = docs.where("error is null").select(F.col("path").alias("doc_id"), "md", "stem")
        store = f"{out_dir}/{A.STORE}"
        extra = []
        if self.config.extract_images:
            office = FI.by_route(files)["office"]
            shown = OF.office_pictures(office).select(F.col("path").alias("doc_id"), F.posexplode("pictures").alias("at", "p")).select("doc_id", (F.col("at") + 1).alias("img_no"), "p.alt", "p.ext", "p.data")
            folder = f"{self.config.image_output_dir}/office"
            good, named = A.paired_pictures(good, shown, folder)
            extra.append(named.select(F.concat(F.lit(f"{out_dir}/"), "path").alias("path"), "data"))
        parent = F.regexp_replace(F.col("doc_id"), "/[^/]*$", "")
        good = good.select("doc_id", "md", "stem", F.lit(store).alias("image_dir"), parent.alias("source_dir"), F.lit(out_dir).alias("out_dir"))
        images = files.where(T.is_image(T.extension(F.col("path")))).select("path", F.col("content").alias("data"))
        staged, kept = A.stage_images(good, images)
        extra.append(kept.select(F.concat(F.lit(f"{store}/"), "asset_id", F.lit("."), "ext").alias("path"), "data"))
        siblings = self.workbook_siblings(files)
        extra.append(siblings.select(F.concat(F.lit(f"{out_dir}/"), "name").alias("path"), F.col("content").cast("binary").alias("data")))
        names = siblings.groupBy("path").agg(F.array_sort(F.collect_list("name")).alias("data_files"))
        rows = staged.select(F.col("doc_id").alias("path"), F.col("md").alias("staged"), F.col("n_changed").alias("n_images"))
        out = docs.join(rows, "path", "left").join(names, "path", "left").withColumn("md", F.coalesce("staged", "md"))
        if lint is not None:
            linted = lint(F.col("md"))
            out = out.withColumn("md", F.when(linted["fixed"], linted["content"]).otherwise(F.col("md")))
        none = F.array().cast("array<string>")
        out = out.select("path", F.concat(F.lit(f"{out_dir}/"), "stem", F.lit(".md")).alias("md_path"), "md", F.coalesce("n_images", F.lit(0)).alias("n_images"), "n_pages", F.coalesce("data_files", none).alias("data_files"), "error")
        return out, reduce(DataFrame.unionByName, extra)

    def workbook_siblings(self, files: DataFrame) -> DataFrame:
        """path, name, content: a CSV for each sheet with content and a JSON of the whole for each workbook."""
        books = files.where(T.extension(F.col("path")) == "xlsx").select("path", OF.rectangular_sheets(OF.read_workbook(F.col("content"))["sheets"]).alias("sheets")).where("sheets is not null")
        from .functions import tables as TB

        sheets = books.select("path", F.explode("sheets").alias("s")).select("path", F.concat(T.stem(F.col("path")), F.lit("."), T.sheet_file_name(F.col("s.name")), F.lit(".csv")).alias("name"), TB.sheet_csv(F.col("s.grid")).alias("content"))
        whole = books.select("path", F.concat(T.stem(F.col("path")), F.lit(".json")).alias("name"), OF.workbook_json(F.col("sheets")).alias("content"))
        return sheets.where("content is not null").unionByName(whole)

    def convert_directory(self, folder: str, out_dir: str, lint: Callable | None = None) -> DataFrame:
        """Every supported document below a folder, ingested; failures stay as rows with their error."""
        return self.ingest(self._with_images(folder), out_dir, lint)

    def _with_images(self, folder: str) -> DataFrame:
        files = FI.scan(self.spark, folder)
        ext = T.extension(F.col("path"))
        return files.where(T.is_supported(ext) | ext.isin("xml", "jats") | T.is_image(ext))

    def convert(self, path: str) -> str:
        """One file's Markdown, or the error of its kind."""
        try:
            found = self.convert_files(FI.scan(self.spark, path, recursive=False)).first()
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                raise SourceError(f"not found: {path}") from error
            raise
        if found["error"] is not None:
            route = self.spark.range(1).select(T.route_of_extension(T.extension(F.lit(path)))).first()[0]
            raise _ERRORS[route](found["error"])
        return found["md"]


def write_files(files: DataFrame) -> DataFrame:
    """Each ``data`` as a file at ``path``, by the tasks, in any store that pyarrow reaches; returns path, n_bytes.

    Names are made of contents or given once, so a task that runs again writes the same bytes to the same name. Plain
    files are written beside their names and moved.
    """
    ship(files.sparkSession)

    def write(frames):
        for frame in frames:
            for path, data in zip(frame["path"], frame["data"]):
                beside = f"{path}.{os.getpid()}.part" if path.startswith("file:") or "://" not in path else path
                with open_output(beside) as file:
                    file.write(data)
                if beside != path:
                    os.replace(local_path(beside), local_path(path))
            yield frame[["path"]].assign(n_bytes=[len(d) for d in frame["data"]])

    return files.select("path", F.col("data").cast("binary").alias("data")).mapInPandas(write, "path string, n_bytes long")


def write_markdown(docs: DataFrame) -> DataFrame:
    """Each document's Markdown as a file at ``md_path``; returns md_path, n_bytes of what was written."""
    files = docs.where("error is null").select(F.col("md_path").alias("path"), F.encode("md", "UTF-8").alias("data"))
    return write_files(files).withColumnRenamed("path", "md_path")

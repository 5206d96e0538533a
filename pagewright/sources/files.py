"""Scans of files and folders: which are documents, by what route they go, their text or bytes.

Files come through Spark's binary source, so any store that Spark reads will do. Every failure is a row's ``error``, not
an exception. Spark's scan leaves out files of no bytes, so an empty file gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written

SNIFF_BYTES, MAX_CONTROL_SHARE = 1024, 0.3


def scan(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, content (bytes), n_bytes, modified of every file; the bytes are only read if a plan uses them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).select("path", "content", F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"))


def supported(files: DataFrame) -> DataFrame:
    """Documents among files; loose images are assets, not documents."""
    ext = T.extension(F.col("path"))
    return files.where(T.is_supported(ext) & ~T.is_image(ext))


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with places from 1 in a total order, without a global window: ranges are numbered by themselves and moved
    on by what the ranges before them hold. The dealt rows are written, so that both passes see the same ranges."""
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("__part").count()
    # one row for each partition: the only window over all rows is over these
    starts = counts.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.join(F.broadcast(starts), "__part").withColumn(out, (inside + F.col("__start")).cast("int")).drop("__part", "__start")


def is_binary(content) -> Column:
    """Whether the first bytes look like no text: a zero byte, or too many control bytes and no valid UTF-8."""
    head = F.substring(content, 1, SNIFF_BYTES)
    codes = F.regexp_count(F.hex(head), F.lit("(?:..)"))
    # control bytes but tab, line feed, form feed, carriage return, backspace and escape
    control = F.size(F.filter(F.regexp_extract_all(F.hex(head), F.lit("(..)"), F.lit(1)), lambda b: F.rlike(b, F.lit("^(?:0[0-7BEF]|1[0-9ACDEF]|7F)$"))))
    return F.rlike(F.hex(head), F.lit("^(?:..)*00")) | ((codes > 0) & (control > codes * MAX_CONTROL_SHARE))


def read_text(files: DataFrame) -> DataFrame:
    """Adds ``text`` and ``error``: strict UTF-8 of files that are no binaries."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    error = F.when(is_binary(F.col("content")), F.lit("binary file, not text")).when(~valid, F.lit("not valid UTF-8"))
    rows = files.withColumn("error", error)
    return rows.withColumn("text", F.when(F.col("error").isNull(), F.col("content").cast("string"))).drop("content")


def read_text_leniently(files: DataFrame) -> DataFrame:
    """Adds ``text``: bytes that are no UTF-8 are left out."""
    made = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    return files.withColumn("text", made).drop("content")


def by_route(files: DataFrame) -> dict[str, DataFrame]:
    """One frame for each route, split before any parser is planned."""
    rows = files.withColumn("route", T.route_of_extension(T.extension(F.col("path"))))
    return {route: rows.where(F.col("route") == route).drop("route") for route in ("pdf", "office", "jats", "text")}


def load_documents(files: DataFrame, **explicit) -> DataFrame:
    """Markdown files as normalized documents: path, doc, error."""
    from ..functions import documents as D

    rows = read_text(files)
    return rows.select("path", F.when(F.col("text").isNotNull(), D.document(D.frontmatter(F.col("text")), F.col("path"), **explicit)).alias("doc"), "error")

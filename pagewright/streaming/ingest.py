"""Ingestion of a folder as a stream: new files become documents once, restarts take up where they stopped.

The file source keeps which files it has seen in the checkpoint; results are appended to a Parquet table, and asset ids
are made from contents, so a batch that runs again writes the same ids. Progress is told by a listener, and a running
query is stopped between batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions import text as T
from ..pipeline import Converter


def plain_path(path) -> Column:
    """A path without its scheme and authority, so that one folder compares alike however it is written."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")


def read_folder(spark: SparkSession, folder: str, files_per_batch: int = 1000, without: tuple[str, ...] = ()) -> DataFrame:
    """path, content, n_bytes, modified of supported files below a folder, as a stream. What lies below a folder of
    ``without``, as the stream's own output may, is left out."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    ext = T.extension(F.col("path"))
    wanted = T.is_supported(ext) | ext.isin("xml", "jats")
    for other in without:
        wanted = wanted & ~F.startswith(plain_path(F.col("path")), F.concat(F.rtrim(plain_path(F.lit(other)), F.lit("/")), F.lit("/")))
    return stream.where(wanted).select("path", "content", F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"))


def ingest_folder(converter: Converter, folder: str, table: str, checkpoint: str, files_per_batch: int = 1000, on_batch: Callable[[int, int], None] | None = None, once: bool = True) -> StreamingQuery:
    """Start a query that converts new files and appends them to ``table``, each batch under its own partition.

    A batch that is run again after a failure replaces its partition, so its rows are there once. ``on_batch`` gets
    the batch's number and how many documents it wrote; a batch of files that are not supported writes nothing and tells
    nothing. The table and the checkpoint may lie in the folder: they are not read. ``once``: take what is there and end.
    """

    def write(batch: DataFrame, number: int) -> None:
        counted = Observation(f"batch-{number}")
        docs = converter.convert_files(batch).withColumn("batch", F.lit(number)).observe(counted, F.count(F.lit(1)).alias("n"))
        docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)
        if on_batch is not None and counted.get["n"]:
            on_batch(number, counted.get["n"])

    writer = read_folder(converter.spark, folder, files_per_batch, (table, checkpoint)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


class Progress(StreamingQueryListener):
    """Tells a function the batch and its rows; a false answer stops the query after that batch."""

    def __init__(self, spark: SparkSession, tell: Callable[[int, int], bool | None]):
        self.spark, self.tell = spark, tell

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        if self.tell(event.progress.batchId, event.progress.numInputRows) is False:
            query = self.spark.streams.get(str(event.progress.id))
            if query is not None:
                query.stop()

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

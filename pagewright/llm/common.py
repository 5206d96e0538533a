"""Shared plumbing of the training-data operators: tables in the shared folder, code shipping, column packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import local_path, open_input, open_output, shared_dir, ship, temporary
from ..session import written as materialize

__all__ = ["local_path", "materialize", "open_input", "open_output", "shared_dir", "ship", "temporary"]

#: ASCII white space of every word rule here, as Python's ``bytes.split()`` has it.
WS = " \t\n\x0b\x0c\r"
#: Bytes of texts that a worker takes together.
PART_BYTES = 6 << 20
#: Bytes of an Arrow batch where Spark's own limit holds. Executor and worker hold a batch in and one out each, for every core.
BATCH_BYTES = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def pack(df: DataFrame, **keep) -> DataFrame:
    """The whole row as struct ``__row`` beside computed columns, so that no name of the caller's can clash with ours."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *[c.alias(k) for k, c in keep.items()])


def unpack(df: DataFrame) -> DataFrame:
    return df.select("__row.*")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by ``BATCH_BYTES``, unless a limit other than Spark's own was set."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, f"{64 << 20}b"):
        spark.conf.set(name, f"{BATCH_BYTES}b")


def field(batch, name_or_place):
    """A column of the caller's row in an Arrow batch of packed rows, so that no value is sent twice."""
    return batch.column(0).field(name_or_place)


def give_back() -> None:
    """Return what a worker has freed to the system: idle workers stay, and others need the memory."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def text_parts(texts, at_once: int = PART_BYTES):
    """Slices ``(first, texts)`` of an array of texts with ``at_once`` bytes at most, or of one longer text."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once, "right")))
        yield at, texts.slice(at, end - at)
        at = end


def ascii_lower(text):
    """Lower-case A to Z only; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def ascii_words(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), WS, " " * 6), " ", -1), "")


def bounded(df: DataFrame, max_rows: int) -> bool:
    """Whether a table has at most ``max_rows`` rows, told without counting beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


def most_frequent(counts: DataFrame, limit: int) -> dict[str, int]:
    """Of ``key, c`` the most frequent: all from some count on, ``limit`` at most.

    That count comes from a histogram, so that no partition sends rows that do not stay.
    """
    bucket = F.floor(F.log2("c") * 8)
    sizes = sorted(((r["b"], r["n"]) for r in counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, held = None, 0
    for b, n in sizes:
        held += n
        if held > limit:
            break
        least = b
    if least is None:
        return {}
    return {r["key"]: r["c"] for r in counts.where(bucket >= least).select("key", "c").collect()}


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

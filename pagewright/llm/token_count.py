"""Token counts by a two-tier lookup: a broadcast table of frequent pre-token lengths, then worker caches.

A text is cut into units and those into pre-tokens (see ``units``), which the tokenizer never joins. The first tier is a
table of the lengths of the pre-tokens in the ``table_rows`` most frequent units at most, counted over all documents:
each task counts its own and tells the ``TOLD`` most frequent, so what is summed is bounded and no pre-token of a text
is shuffled. A pre-token that the table lacks is encoded by the library once and kept in the worker's bounded cache.
Neither tier changes a count, whatever it holds: they only save work.

A file of another kind than byte-level BPE gives no units; its library counts whole texts.

Nulls: a null text counts as empty (0 bytes, 0 tokens), a null identifier stays null. Repeated rows are counted each.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, units
from .arrays import Ragged

TABLE_ROWS, TOLD = 1 << 16, 1 << 14


def counter(path: str):
    """From a list of strings to the number of tokens of each, by the library that the file is for."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: np.fromiter(map(len, model.encode(texts, num_threads=1)), np.int64, len(texts))
    library = units.library(path)
    return lambda texts: library.encode_pieces(texts).lengths


def lengths(path: str, first: tuple[list[str], np.ndarray] | None = None) -> units.Pieces:
    """Pieces whose value is their number of tokens; those of ``first`` are known."""
    number = counter(path)
    split = units.split_letters if units.cuts_apart(path) else units.whole_units

    def values(pieces: list[str]) -> Ragged:
        return Ragged(number(pieces).astype(np.int32), np.ones(len(pieces), np.int64))

    known = first and (pa.array(first[0], pa.string()), Ragged(first[1].astype(np.int32), np.ones(len(first[0]), np.int64)))
    return units.Pieces(split, values, first=known)


def frequent_units(texts: DataFrame, table_rows: int, told: int = TOLD) -> list[str]:
    """Units that are frequent over all of a column ``text``."""

    def count(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for _, part in common.text_parts(batch.column(0)):
                coded = units.units_of(part, True)[0].dictionary_encode()
                times = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary))
                if len(times) > told:
                    often = np.argpartition(-times, told)[:told]
                    often = often[times[often] > 1]
                else:
                    often = np.arange(len(times))
                short = np.asarray(pc.utf8_length(coded.dictionary))[often] <= units.Pieces.LONGEST
                often = often[short]
                seen.update(dict(zip(coded.dictionary.take(pa.array(often)).to_pylist(), times[often].tolist())))
                if len(seen) > 8 * told:
                    seen = Counter(dict(seen.most_common(2 * told)))
        top = seen.most_common(told)
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], names=["key", "c"])
        common.give_back()

    counts = texts.select("text").mapInArrow(count, "key string, c long").groupBy("key").agg(F.sum("c").alias("c"))
    return list(common.most_frequent(common.materialize(counts, "frequent-units"), table_rows))


def token_counts(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "n_tokens", table_rows: int = TABLE_ROWS) -> DataFrame:
    """``docs`` with the number of tokens of every whole text in ``out_col``, which replaces a column of that name."""
    spark = docs.sparkSession
    common.ship(spark)
    apart, table = units.cuts_apart(path), None
    if apart:
        pieces = sorted(set(units.split_letters(frequent_units(docs.select(F.col(f"`{text_col}`").alias("text")), table_rows))[0]))
        table = pieces, counter(path)(pieces)
    sent = spark.sparkContext.broadcast(table)
    at = docs.columns.index(text_col)

    def count(batches):
        known = lengths(path, sent.value)
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for first, part in common.text_parts(common.field(batch, at)):
                found = known.encode(part, apart)
                total = np.concatenate([[0], np.cumsum(found.flat, dtype=np.int64)])
                ends = np.cumsum(found.lengths)
                out[first : first + len(part)] = total[ends] - total[ends - found.lengths]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["__row", "__n"])
        del known
        common.give_back()

    rows = common.pack(docs)
    schema = rows.select("__row", F.lit(0).cast("long").alias("__n")).schema
    return rows.mapInArrow(count, schema).select(*[F.col(f"__row.`{c}`") for c in docs.columns if c != out_col], F.col("__n").alias(out_col))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents`` by byte_bpe_50k.json: doc_id, n_bytes, n_tokens, over_limit."""
    import public_tokenizers

    docs = spark.read.parquet(common.table_path(sf_dir, "documents"))
    texts = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = token_counts(texts, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))

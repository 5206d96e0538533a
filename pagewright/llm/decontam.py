"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

Benchmark items are cut into windows of ``size`` consecutive words (shorter items are one window). A window is looked
for through its shingles of up to ``SHINGLE`` words: containment is exact, so all of a window's shingles must occur and
one necessary prefix token, its rarest shingle over the whole corpus, is enough to join on. A match of the prefix
token at word p of a document fixes where the window would begin (positional bound) and that it must end inside the
document (length bound); the words there are then compared one by one.

The index of windows is broadcast in blocks of at most ``BLOCK_WORDS`` benchmark words. Each further block is one more
pass over the documents that carries the hits along, and what it found is written before the next begins, so one block's
index at a time is in a worker whatever the size of the benchmark. Windows that share a prefix token, its place and
their length are one set, so a token's occurrence costs a lookup for each place and length. No document word is ever
shuffled; the corpus counts of shingles are summed per task first.

Nulls: a null text has no words and is never hit; a null item text gives no window; windows of an item with a null
identifier hit words but the identifier is listed nowhere. Repeated items count once, repeated documents each.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIZE, SHINGLE, BLOCK_WORDS = 13, 3, 2_000_000
#: Bytes of words are ASCII digits and letters (lower-cased) and everything beyond ASCII; all others separate words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def shingles_of(window: tuple[bytes, ...], n: int = SHINGLE) -> list[bytes]:
    n = min(n, len(window))
    return [b" ".join(window[i : i + n]) for i in range(len(window) - n + 1)]


def lengths(shingles) -> list[int]:
    return sorted({s.count(b" ") + 1 for s in shingles})


def document_shingles(words: list[bytes], n: int):
    return words if n == 1 else list(map(b" ".join, zip(*[words[i:] for i in range(n)])))


def blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, block_words: int):
    """Windows of the benchmark with their item ids as strings, in blocks of bounded size, streamed to the driver."""
    block: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    held = 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        for window in windows_of(words_of(text), size):
            block[window].update([] if item is None else [item])
            held += len(window)
            if held >= block_words:
                yield dict(block)
                block, held = defaultdict(set), 0
    if block:
        yield dict(block)


def shingle_counts(docs: DataFrame, text_col: str, wanted) -> dict[bytes, int]:
    """In how many documents each benchmark shingle of one block occurs, over the whole corpus."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(frozenset(wanted))

    def count(batches):
        found, wants = Counter(), sent.value
        sizes = lengths(wants)
        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                for n in sizes:
                    found.update(wants.intersection(document_shingles(words, n)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["s", "n"])

    rows = docs.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(count, "s binary, n long")
    return {bytes(s): n for s, n in rows.groupBy("s").agg(F.sum("n").alias("n")).collect()}


def make_index(block: dict, counts: dict[bytes, int]) -> dict[bytes, dict[tuple[int, int], dict]]:
    """From the necessary prefix token of each window to windows with their item ids, by (offset of it, window length)."""
    index: dict[bytes, dict] = {}
    for window, items in block.items():
        tokens = shingles_of(window)
        at = min(range(len(tokens)), key=lambda i: (counts.get(tokens[i], 0), tokens[i], i))
        if counts.get(tokens[at], 0):  # a shingle that occurs nowhere: the window occurs nowhere
            index.setdefault(tokens[at], {}).setdefault((at, len(window)), {})[window] = tuple(sorted(items))
    return index


def find_hits(words: list[bytes], index: dict, sizes: list[int], spans: list, items: set) -> None:
    """Adds the spans [from, to) of words inside occurrences of windows, and the items they are of."""
    total = len(words)
    for n in sizes:
        tokens = document_shingles(words, n)
        if index.keys().isdisjoint(tokens):
            continue
        for p, token in enumerate(tokens):
            for (offset, size), windows in index.get(token, {}).items():
                start = p - offset
                if start >= 0 and start + size <= total:
                    of = windows.get(tuple(words[start : start + size]))
                    if of is not None:
                        spans.append((start, start + size))
                        items.update(of)


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = SIZE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` packed as ``__row`` with ``n_words``, ``spans`` (merged word spans that are hit), ``items`` (sorted) and
    ``rest``, the text without the hit words where there are any.

    One pass of corpus counts and one of matching for each block of the benchmark; hits of earlier blocks are merged.
    """
    spark = docs.sparkSession
    common.ship(spark)
    at = docs.columns.index(text_col)
    rows = common.pack(docs, n_words=F.lit(0).cast("long"), spans=F.expr("cast(array() as array<struct<a:int,b:int>>)"), items=F.expr("cast(array() as array<string>)"), rest=F.lit(None).cast("string"))
    sent = None
    for block in blocks(benchmark, item_col, item_text, size, block_words):
        if sent is not None:
            rows = common.materialize(rows, "block-hits")
            sent.unpersist()
        index = make_index(block, shingle_counts(docs, text_col, {s for w in block for s in shingles_of(w)}))
        sent = spark.sparkContext.broadcast(index)
        rows = match_block(rows, sent, at)
    return rows if sent is not None else match_block(rows, spark.sparkContext.broadcast({}), at)


def match_block(rows: DataFrame, sent, at: int) -> DataFrame:
    """One pass: hits of the block's windows in column ``at`` of the packed rows, merged with those found before."""

    def match(batches):
        index = sent.value
        sizes = lengths(index)
        for batch in batches:
            counts, all_spans, all_items, rests = [], [], [], []
            for text, spans, items in zip(common.field(batch, at), batch.column(2), batch.column(3)):
                text = text.as_py()
                words = words_of(text)
                spans, items = [(s["a"], s["b"]) for s in spans.as_py()], set(items.as_py())
                find_hits(words, index, sizes, spans, items)
                spans = merged(spans)
                counts.append(len(words))
                all_spans.append([{"a": a, "b": b} for a, b in spans])
                all_items.append(sorted(items))
                rests.append(excise(text, spans) if spans else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(all_spans, SPANS), pa.array(all_items, pa.list_(pa.string())), pa.array(rests, pa.string())], names=["__row", "n_words", "spans", "items", "rest"])

    return rows.mapInArrow(match, rows.schema)


def n_hit(spans="spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["b"] - s["a"]).cast("long"))


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def excise(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, and without what stands between those words."""
    data = text.encode()
    plain, at, places = data.translate(WORD_BYTES), 0, []
    for word in plain.split():
        at = plain.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without contaminated documents; from the others the hit words are cut out. Same columns."""
    rows = contamination(docs, benchmark, text_col).withColumn("n_hit", n_hit()).where(~is_contaminated())
    hit = F.col("rest").isNotNull()
    changed = {text_col: F.when(hit, F.col("rest")).otherwise(F.col(f"__row.`{text_col}`"))}
    if chars_col in docs.columns:
        changed[chars_col] = F.when(hit, F.length("rest").cast(docs.schema[chars_col].dataType)).otherwise(F.col(f"__row.`{chars_col}`"))
    return rows.select(*[changed.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document against all 13-word windows: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = spark.read.parquet(common.table_path(sf_dir, "documents")).select("doc_id", "text")
    benchmark = spark.read.parquet(common.table_path(sf_dir, "benchmark"))
    rows = contamination(docs, benchmark).withColumn("n_hit", n_hit())
    return rows.select(
        F.col("__row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS g
  FROM item_words, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
doc_words AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
grams AS (
  SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM doc_words, sizes, unnest(generate_series(1, len(w) - n + 1)) AS t(i) WHERE len(w) >= n),
hits AS (SELECT r, i, n, item_id FROM grams JOIN windows USING (n, g)),
words_hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(generate_series(i, i + n - 1)) AS t(p) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN words_hit USING (r) LEFT JOIN items USING (r)
"""

"""SimHash near-duplicates with Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into segments of 22, 21 and 21 bits. Up to four differing bits leave two of the three
segments with two or fewer between them (pigeonhole), so every link shows in one of the three pairs of segments with
at most two errors in each. A segment is padded to 23 bits and extended by a parity bit; its keys are the indices of
all codewords of the extended Golay code (24, 12, 8) within distance four: one if it lies within two of a codeword,
else exactly six, whose differences partition the 24 places. Two words that differ in one or two data bits are at
distance two after extension and always share a key. A pair of segments has the products of their keys, 28 on average.

Equal fingerprints are one node from the start, so groups of copies of any size give one row. Nodes that meet under a
key are compared by XOR and bit count; of the links found under a key only a spanning forest is kept, which has the
same components. A key with more than ``BLOCK`` nodes is dealt out as pairs of blocks, so that no task holds or
compares an unbounded group. Components are found by star steps; nothing of them comes to the driver.

Nulls: a null text has no words; a text without words has fingerprint zero and is linked like any other. A null
identifier takes no part in the minimum; a component of null identifiers only has a null component_id. Repeated rows
are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, nearcopies
from .components import components
from .golay import golay_codewords, segment_keys

WIDTH, SEED, MAX_BITS, BLOCK, MAX_DROPPED = 4, 42, 4, 2048, 2_000_000
SEGMENTS = ((42, 22), (21, 21), (0, 21))


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of all fuzzy keys of an array of fingerprints."""
    found = [segment_keys((prints >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64)) for low, bits in SEGMENTS]
    rows, keys = [], []
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, b = found[i][:, :, None], found[j][:, None, :]
        good = (a >= 0) & (b >= 0)
        keys.append(((k << 24) + (a << 12) + b)[good])
        rows.append(np.nonzero(good)[0])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), seed)
    hashes = np.array([digest(s, seed) for s in map(b" ".join, zip(*[words[i:] for i in range(width)]))], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """``docs`` packed as ``__row`` beside ``fp``, the fingerprint as a signed long."""
    common.ship(docs.sparkSession)

    def scan(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), width, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["__row", "fp"])

    rows = common.pack(docs, __text=F.col(f"`{text_col}`"))
    return rows.mapInArrow(scan, rows.select("__row", F.lit(0).cast("long").alias("fp")).schema)


def key_rows(nodes: DataFrame) -> DataFrame:
    """``(key, fp)`` for all fuzzy keys of distinct fingerprints."""

    def make(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(prints), 4096):
                part = prints[at : at + 4096]
                rows, keys = fuzzy_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(part[rows].view(np.int64))], names=["key", "fp"])

    return nodes.mapInArrow(make, "key int, fp long")


def forest(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among fingerprints (unsigned), as index pairs."""
    links, left = [], np.arange(len(prints))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            close = np.bitwise_count(prints[left] ^ prints[node]) <= max_bits
            if close.any():
                links += [(node, other) for other in left[close]]
                queue += left[close].tolist()
                left = left[~close]
    return links


def short_forests(runs: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many runs of equal length, one a row, without those that two links to an earlier place imply.

    A link (i, j) goes if some k before both is linked to both: the ends stay connected by links that begin earlier.
    """
    close = np.triu(np.bitwise_count(runs[:, :, None] ^ runs[:, None, :]) <= max_bits, 1).astype(np.float32)
    row, i, j = np.nonzero((close > 0) & (close.transpose(0, 2, 1) @ close == 0))
    return runs[row, i], runs[row, j]


def runs_to_links(keys: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows with equal keys that have the components of all; rows come sorted by key."""
    a, b = [], []
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    for size in range(2, 33):
        of = starts[sizes == size]
        step = max(1, (1 << 19) // (size * size))
        for at in range(0, len(of), step):
            x, y = short_forests(prints[of[at : at + step, None] + np.arange(size)], max_bits)
            a.append(x)
            b.append(y)
    for start, size in zip(starts[sizes > 32], sizes[sizes > 32]):
        run = prints[start : start + size]
        links = forest(run, max_bits)
        if links:
            x, y = zip(*links)
            a.append(run[list(x)])
            b.append(run[list(y)])
    return np.concatenate(a) if a else np.empty(0, np.uint64), np.concatenate(b) if b else np.empty(0, np.uint64)


def link_runs(rows: DataFrame, keys: list[str], max_bits: int) -> DataFrame:
    """Links under equal keys. A run has ``BLOCK`` rows twice at most, so what a task holds beyond a batch is bounded."""

    def scan(batches):
        kept, told = None, set()
        for batch in batches:
            parts = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(keys))]
            key = np.stack([*parts, batch.column(len(keys)).to_numpy(zero_copy_only=False)])
            key = key if kept is None else np.concatenate([kept, key], axis=1)
            if not key.shape[1]:
                continue
            last = int(np.argmax((key[:-1] == key[:-1, -1:]).all(0)))
            key, kept = key[:, :last], key[:, last:]
            yield from emit(key, told)
        if kept is not None:
            yield from emit(kept, told)

    def emit(key, told):
        if key.shape[1] < 2:
            return
        change = np.concatenate([[0], np.cumsum((key[:-1, 1:] != key[:-1, :-1]).any(0))])
        a, b = runs_to_links(change, np.ascontiguousarray(key[-1]).view(np.uint64), max_bits)
        if len(a):
            # the same link under many keys of one task is told once; a full memory of them is dropped
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            if len(told) > 500_000:
                told.clear()
            fresh = [p for p in map(tuple, pairs.tolist()) if p not in told]
            told.update(fresh)
            out = np.array(fresh, np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, 0]).view(np.int64)), pa.array(np.ascontiguousarray(out[:, 1]).view(np.int64))], names=["a", "b"])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "fp").select(*keys, "fp")
    return dealt.mapInArrow(scan, "a long, b long").distinct()


def heavy_keys(keyed: DataFrame, block: int) -> DataFrame:
    """``key, count`` of keys with more than ``block`` rows.

    Such a key has more than its share of ``block`` in some partition (pigeonhole), so only keys that have are counted
    exactly; where partitions are so many that a share is below one, all are.
    """
    share = block // max(1, keyed.rdd.getNumPartitions())

    def often(batches):
        parts = [batch.column(0).to_numpy(zero_copy_only=False) for batch in batches]
        keys, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.int32), np.empty(0, int))
        yield pa.RecordBatch.from_arrays([pa.array(keys[counts > share])], names=["key"])

    rows = keyed.select("key")
    if share > 1:
        candidates = common.materialize(rows.mapInArrow(often, "key int").distinct(), "often-keys")
        rows = rows.join(F.broadcast(candidates) if common.bounded(candidates, 200_000) else candidates, "key", "left_semi")
    return rows.groupBy("key").count().where(F.col("count") > block)


def find_links(nodes: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """A set of verified links between distinct fingerprints that has the components of all links.

    Keys with more than ``block`` nodes (counted over all nodes) are split: the nodes of such a key are hashed to
    blocks and each pair of blocks is a group of its own. How many keys are that large is bounded by the number of
    key rows over ``block``; the table of them is joined, not broadcast, unless it is small.
    """
    if max_bits > 4:
        raise ValueError("three segments with two errors each carry at most four differing bits")
    keyed = common.materialize(key_rows(nodes), "fuzzy-keys")
    heavy = common.materialize(heavy_keys(keyed, block).select("key", F.ceil(F.col("count") / block).cast("int").alias("n")), "heavy-keys")
    plain, split = keyed, None
    if not heavy.isEmpty():
        heavy = F.broadcast(heavy) if common.bounded(heavy, 200_000) else heavy
        plain = keyed.join(heavy.select("key"), "key", "left_anti")
        own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
        split = keyed.join(heavy, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        split = split.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    links = link_runs(plain, ["key"], max_bits)
    return links if split is None else links.unionByName(link_runs(split, ["key", "x", "y"], max_bits))


def print_groups(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp``, ``root`` for each fingerprint of ``rows`` that is linked to another; those that miss are their own root."""
    nodes = common.materialize(rows.select("fp").distinct(), "nodes")
    groups = components(find_links(nodes, max_bits)).select(F.col("node").alias("fp"), "root")
    return common.materialize(groups, "groups")


def op10_simhash_golay(spark, sf_dir: str) -> DataFrame:
    """Every document with its class: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    docs = spark.read.parquet(common.table_path(sf_dir, "documents")).select("doc_id", "text")
    rows = common.materialize(with_fingerprint(docs).select(F.col("__row.doc_id").alias("doc_id"), "fp"), "fingerprints")
    groups = print_groups(rows)
    smallest = rows.groupBy("fp").agg(F.min("doc_id").alias("m"))
    linked = smallest.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = linked.groupBy("root").agg(F.min("m").alias("component_id"))
    ids = common.materialize(linked.select("fp", "root").join(roots, "root").select("fp", "component_id"), "component-ids")
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest identifier (nulls last).

    Groups are those of ``nearcopies``: SimHash fingerprints of five-word shingles meet under Golay keys and are verified
    at similarity 0.8. Four words, 64 bits and the limit of four bits are the query's only.
    """
    rows = common.materialize(nearcopies.with_sketch(docs, text_col).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    groups = nearcopies.node_groups(rows, text_col)
    best = F.min(F.struct(F.col(f"__row.`{id_col}`").isNull().alias("n"), F.col(f"__row.`{id_col}`").alias("i"), F.col("rid").alias("r"))).alias("best")
    per_node = rows.groupBy("node").agg(best)
    linked = per_node.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keep = linked.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.r").alias("rid"))
    # what goes is told by number and broadcast up to a bound, so that no text is shuffled; beyond it the join merges
    drop = common.materialize(rows.select("rid").join(keep, "rid", "left_anti"), "dropped")
    drop = F.broadcast(drop) if common.bounded(drop, MAX_DROPPED) else drop
    return common.unpack(rows.join(drop, "rid", "left_anti"))

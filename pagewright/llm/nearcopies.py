"""Near copies by SimHash with Golay-code fuzzy hashing: texts whose sets of five-word shingles have a Jaccard similarity
of 0.8 or more are linked.

At that similarity the fingerprints differ in some 15 % of their bits, 6 to 13 of 64, which the three segments of the op10
query do not reach. So a fingerprint has ``TABLES`` times one first segment and ``RESTS`` others of 23 bits, and 128 bits of
their own to compare. A segment's keys are the codewords of the extended Golay code (24, 12, 8) within four of it; texts
meet that share a key of a table's first segment and of one of its others. Two segments share a key with probability 0.62
at 0.8 (simulated on sets of 18 to 297 shingles), so a pair meets with 1 - (1 - 0.62 * (1 - 0.38**4))**10, which is 0.9999.
Of those that meet, pairs with more than ``NEAR`` bits apart are dropped, of the 64 and 4 * 23 that a row has (at 0.8 the
expectation is 23).

Rows are dealt by table and key of the first segment only, 53 a text; the other segments' keys are made in the task. Nodes
go by the number of a row with their text, which rows near each other share but for its end and so take little in a shuffle.

Texts of equal word sequences are one node from the start. A bucket tells a spanning forest of its candidates, the most
alike fingerprints first, without those that share an earlier key of the same first segment: their bucket has connected them.
Their components are groups whose texts are moved once, and
compared inside one task: each node with all candidates that it is not connected to yet, by the shingles of both. A link is
told where it connects, so what leaves a task follows the nodes and not the pairs. Groups with more than ``BLOCK`` nodes or
``BLOCK_BYTES`` of texts are first gone through by their forest alone, verified on the texts; only those that it leaves apart
are dealt out as pairs of blocks. So are buckets with more than ``BUCKET`` nodes.

Words are lower-cased A to Z and separated by ASCII white space. A text of fewer than five words is one shingle; texts
without words, and null texts, are one node that is like no other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, golay
from .components import components

WIDTH, SEED, TABLES, RESTS, SEGMENT, BUCKET, BLOCK, BLOCK_BYTES, MAX_SENT = 5, 42, 10, 4, 23, 65536, 2048, 16 << 20, 2_000_000
#: Bytes of a fingerprint that are compared; the segments follow them.
HASHES = 16
#: Bits that candidates may have apart: of a bucket's rows, and of ``HASHES`` bytes (19 expected at 0.8).
NEAR, MOST = 45, 38
WORDS = -(-(8 * HASHES + (1 + RESTS) * TABLES * SEGMENT) // 64)
SMALL_RUN, PLAIN_RUN = 64, 1024
ADD = np.random.default_rng(SEED).integers(0, 1 << 63, WORDS, np.uint64)
TIMES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def shingles(words: list[bytes]) -> set[bytes]:
    if len(words) < WIDTH:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*[words[i:] for i in range(WIDTH)])))


def alike(a: str | None, b: str | None) -> bool:
    """Whether the shingle sets have a Jaccard similarity of 0.8 or more, in whole numbers."""
    x, y = (shingles((t or "").encode().lower().split()) for t in (a, b))
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    both = len(x & y)
    return 5 * both >= 4 * (len(x) + len(y) - both) > 0


def wide_print(hashes: np.ndarray) -> bytes:
    """The SimHash of some shingles: a bit is 1 if set in over half of what each hash is spread to."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 1020):
        spread = (hashes[at : at + 1020, None] + ADD) * TIMES[0]
        spread = (spread ^ spread >> np.uint64(32)) * TIMES[1]
        bits = np.unpackbits((spread ^ spread >> np.uint64(29)).view(np.uint8), axis=1)
        for k in range(0, len(bits), 255):
            ones += bits[k : k + 255].sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def sketch(text: str | None) -> tuple[int, bytes | None]:
    """The node (a hash of all words) and the fingerprint; none without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    node = int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)).astype(np.int64))
    found = shingles(words)
    digest = xxhash.xxh64_intdigest
    return node, wide_print(np.fromiter((digest(s, SEED) for s in found), np.uint64, len(found))) if found else None


def with_sketch(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` packed as ``__row`` beside ``node`` and ``print``."""
    common.ship(docs.sparkSession)
    place = docs.columns.index(text_col)

    def scan(batches):
        for batch in batches:
            found = [sketch(t.as_py()) for t in common.field(batch, place)]
            nodes, prints = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(prints, pa.binary())], names=["__row", "node", "print"])

    rows = common.pack(docs)
    return rows.mapInArrow(scan, rows.select("__row", F.lit(0).cast("long").alias("node"), F.lit(None).cast("binary").alias("print")).schema)


def places(prints: np.ndarray) -> np.ndarray:
    """The values of the segments, by row, table and place (first, then the others), of fingerprints as rows of bytes."""
    bits = np.unpackbits(prints[:, HASHES:], axis=1, count=(1 + RESTS) * TABLES * SEGMENT)
    return (bits.reshape(-1, TABLES, 1 + RESTS, SEGMENT) @ (1 << np.arange(SEGMENT))).astype(np.int64)


def segments(prints: np.ndarray) -> np.ndarray:
    """By row the pairs of segments that meet if both share a key: a table's first with each of its others."""
    values = places(prints)
    return np.stack(np.broadcast_arrays(values[:, :, :1], values[:, :, 1:]), -1).reshape(len(prints), TABLES * RESTS, 2)


def first_keys(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of fingerprints: themselves as rows of bytes, then row, key (table and codeword) and the table's segments."""
    prints = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 8 * WORDS)
    values = places(prints)
    words = golay.segment_keys(values[:, :, 0].ravel()).reshape(-1, TABLES, 6)
    row, table, place = np.nonzero(words >= 0)
    return prints, row, (table << 12) + words[row, table, place], values[row, table]


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """``key, r0, r1, node, sig`` of nodes with a fingerprint: a row for each codeword near the first segment. The other
    segments are packed by two with half of the first above them, and eight bytes are there to compare."""

    def make(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                prints, row, key, of = first_keys(part.column(1))
                r0, r1 = ((of[:, 0] & 4095, of[:, 0] >> 12)[k] << 2 * SEGMENT | of[:, 2 * k + 1] << SEGMENT | of[:, 2 * k + 2] for k in (0, 1))
                ids, sig = part.column(0).to_numpy(), np.ascontiguousarray(prints[:, :8]).view(np.int64)[:, 0]
                arrays = [key.astype(np.int32), r0, r1, ids[row], sig[row]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["key", "r0", "r1", "node", "sig"])

    return nodes.where("print is not null").select("node", "print").mapInArrow(make, "key int, r0 long, r1 long, node long, sig long")


def bucket_sizes(nodes: DataFrame) -> DataFrame:
    """``key, c``: the rows of each bucket, counted where they are made."""

    def count(batches):
        sizes = np.zeros(TABLES << 12, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sizes += np.bincount(first_keys(batch.column(0).slice(at, 512))[2], minlength=len(sizes))
        keys = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(sizes[keys])], names=["key", "c"])

    return nodes.where("print is not null").select("print").mapInArrow(count, "key int, c long").groupBy("key").agg(F.sum("c").alias("c"))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints as rows of bytes or whole numbers."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def candidates(sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one run: a spanning forest of its candidates that prefers the most alike fingerprints; in a run of
    more than ``PLAIN_RUN`` any spanning forest."""
    a, b = [], []
    if len(sigs) > PLAIN_RUN:
        left = np.arange(len(sigs))
        while len(left) > 1:
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                node = queue.pop()
                close = apart(sigs[left], sigs[node]) <= NEAR
                a += [node] * int(close.sum())
                b += left[close].tolist()
                queue += left[close].tolist()
                left = left[~close]
        return np.array(a, np.int64), np.array(b, np.int64)
    left = np.arange(1, len(sigs))
    least, link = apart(sigs[left], sigs[0]), np.zeros(len(left), np.int64)
    while len(left):
        k = int(least.argmin())
        new = int(left[k])
        if least[k] <= NEAR:
            a.append(int(link[k]))
            b.append(new)
        left, least, link = np.delete(left, k), np.delete(least, k), np.delete(link, k)
        now = apart(sigs[left], sigs[new])
        less = now < least
        least[less], link[less] = now[less], new
    return np.array(a, np.int64), np.array(b, np.int64)


def bucket_forest(bucket: np.ndarray, rest: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows in whole buckets: in each a spanning forest of those that share a key of one of the other
    segments (columns of ``rest``) and have at most ``NEAR`` bits apart, the most alike first."""
    a, b, seen = [np.empty(0, np.int64)], [np.empty(0, np.int64)], set()
    for values in rest.reshape(len(rest), -1).T:
        words = golay.segment_keys(values)
        row, place = np.nonzero(words >= 0)
        entry = (bucket[row] << 12) + words[row, place]
        order = np.argsort(entry, kind="stable")
        entry, row = entry[order], row[order]
        starts = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
        sizes = np.diff(np.append(starts, len(entry)))
        small = np.repeat((sizes > 1) & (sizes <= SMALL_RUN), sizes)
        of, at = entry[small], row[small]
        for k in range(1, SMALL_RUN):
            same = np.flatnonzero(of[k:] == of[: len(of) - k]) if k < len(of) else of[:0]
            if not len(same):
                break
            x, y = at[same], at[same + k]
            near = apart(sigs[x], sigs[y]) <= NEAR
            a.append(x[near])
            b.append(y[near])
        for start, size in zip(starts[sizes > SMALL_RUN], sizes[sizes > SMALL_RUN]):
            run = row[start : start + size]
            if (mark := run.tobytes()) not in seen:  # near copies often share all their keys
                seen.add(mark)
                x, y = candidates(sigs[run])
                a.append(run[x])
                b.append(run[y])
    x, y = np.concatenate(a), np.concatenate(b)
    if not len(x):
        return x, y
    x, y = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
    order = np.argsort(apart(sigs[x], sigs[y]), kind="stable")
    root, kept = {}, []
    for k, i, j in zip(order.tolist(), x[order].tolist(), y[order].tolist()):
        while (up := root.get(i, i)) != i:
            root[i] = i = root.get(up, up)
        while (up := root.get(j, j)) != j:
            root[j] = j = root.get(up, up)
        if i != j:
            root[i] = j
            kept.append(k)
    return x[kept], y[kept]


def met_before(a: np.ndarray, b: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Whether first segments share a codeword before ``word``. Such candidates are connected in that word's bucket, by links
    that it tells or that have met before it, so the one of ``word`` need not tell them."""
    x, y = (np.where(k < word[:, None], k, -1) for k in map(golay.segment_keys, (a, b)))
    return ((x[:, :, None] == y[:, None, :]) & (x[:, :, None] >= 0)).any((1, 2))


def connect(nodes: np.ndarray, labels: np.ndarray, sigs: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Links of one run that connect its labels as all links would: every pair of two labels is compared, most alike
    fingerprints first, unless what is connected before makes it needless. ``flat``: sorted shingles, ``sizes`` of each."""
    _, own = np.unique(labels, return_inverse=True)
    root, ends, links = own.copy(), np.cumsum(sizes), []
    largest = np.bincount(own).argmax()
    for i in np.flatnonzero(own != largest).tolist():
        other = np.flatnonzero((root != root[i]) & (5 * np.minimum(sizes, sizes[i]) >= 4 * np.maximum(sizes, sizes[i])))
        bits = apart(sigs[other], sigs[i])
        other = other[np.argsort(bits, kind="stable")][: int((bits <= MOST).sum())]
        mine = flat[ends[i] - sizes[i] : ends[i]]
        at = 0
        while at < len(other):
            part = other[at : at + 64]
            at += 64
            part = part[root[part] != root[i]]
            if not len(part):
                continue
            theirs = np.concatenate([flat[ends[j] - sizes[j] : ends[j]] for j in part])
            place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            both = np.add.reduceat((mine[place] == theirs).astype(np.int64), np.cumsum(sizes[part]) - sizes[part])
            for j in part[5 * both >= 4 * (sizes[i] + sizes[part] - both)].tolist():
                if root[j] != root[i]:
                    links.append((int(nodes[i]), int(nodes[j])))
                    root[root == root[j]] = root[i]
    return links


def run_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Forests of candidates under equal keys, from ``keys.., r0, r1, node, sig``; a bucket has ``BUCKET`` rows twice at most."""
    wide = len(keys)

    def emit(rows, told):
        bucket = np.concatenate([[0], np.cumsum((rows[:wide, 1:] != rows[:wide, :-1]).any(0))])
        r0, r1, node, sig = rows[wide:]
        first = r0 >> 2 * SEGMENT | r1 >> 2 * SEGMENT << 12
        r0, r1 = (r & (1 << 2 * SEGMENT) - 1 for r in (r0, r1))
        rest = np.stack([r0 >> SEGMENT, r0 & (1 << SEGMENT) - 1, r1 >> SEGMENT, r1 & (1 << SEGMENT) - 1], 1)
        x, y = bucket_forest(bucket, rest, np.stack([r0, r1, sig], 1).view(np.uint64))
        new = ~met_before(first[x], first[y], rows[0, x] & 4095)
        x, y = node[x[new]], node[y[new]]
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        if len(told) > 200_000:
            told.clear()
        fresh = [p for p in map(tuple, pairs.tolist()) if p not in told]
        told.update(fresh)
        out = np.array(fresh, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, 0])), pa.array(np.ascontiguousarray(out[:, 1]))], names=["a", "b"])

    def scan(batches):
        kept, told = None, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(wide + 4)])
            rows = rows if kept is None else np.concatenate([kept, rows], 1)
            last = int(np.argmax((rows[:wide] == rows[:wide, -1:]).all(0)))
            if last:
                yield from emit(rows[:, :last], told)
            kept = rows[:, last:]
        if kept is not None:
            yield from emit(kept, told)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "r0", "r1", "node", "sig")
    return dealt.mapInArrow(scan, "a long, b long").distinct()


def hashes_of(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    import xxhash

    found = shingles((text or "").encode().lower().split())
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in found), np.uint64, len(found)))


def run_links(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Labels that verified links under equal keys connect as all links would, from ``keys.., label, sig, words``: a text,
    or the hashes of its shingles."""

    def settle(run):
        if len(run) < 2 or len({r[0] for r in run}) < 2:
            return []
        labels, sigs = np.array([r[0] for r in run]), np.frombuffer(b"".join(r[1] for r in run), np.uint8).reshape(-1, HASHES)
        found = [np.frombuffer(r[2], "<u8") if isinstance(r[2], bytes) else hashes_of(r[2]) for r in run]
        return connect(labels, labels, sigs, np.concatenate(found), np.array(list(map(len, found))))

    def scan(batches):
        last, run, found = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(keys) + 3))):
                if row[: len(keys)] != last:
                    found += settle(run)
                    last, run = row[: len(keys)], []
                run.append(row[len(keys) :])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
                found = []
        found = settle(run)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "label", "sig", "words")
    return dealt.mapInArrow(scan, "a long, b long").distinct()


def by_blocks(keyed: DataFrame, blocks: DataFrame, find) -> DataFrame:
    """``find(rows, keys)`` under each ``key``; where ``blocks`` has an ``n`` of more than 1, by pairs of so many blocks."""
    heavy = common.materialize(blocks.select("key", F.col("n").cast("int").alias("n")).where("n > 1"), "heavy-buckets")
    if heavy.isEmpty():
        return find(keyed, ["key"])
    heavy = F.broadcast(heavy) if common.bounded(heavy, 200_000) else heavy
    plain = find(keyed.join(heavy.select("key"), "key", "left_anti"), ["key"])
    own = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    split = keyed.join(heavy, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    split = split.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("own", "other", "n")
    return plain.unionByName(find(split, ["key", "x", "y"])).distinct()


def shingles_of(texts: DataFrame) -> DataFrame:
    """``key, node, label, sig, words`` with the text in ``words`` replaced by the hashes of its shingles."""

    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                data = [hashes_of(t.as_py()).astype("<u8").tobytes() for t in part.column(4)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(data, pa.binary())], names=["key", "node", "label", "sig", "words"])

    return texts.select("key", "node", "label", "sig", "words").mapInArrow(scan, "key long, node long, label long, sig binary, words binary")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose texts are alike."""
    ends = [texts.select(F.col("node").alias(end), F.col("words").alias(t)) for end, t in (("a", "x"), ("b", "y"))]
    both = pairs.join(ends[0], "a").join(ends[1], "b")

    def compare(batches):
        for batch in batches:
            good = pa.array([alike(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return common.materialize(both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "verified")


def large_links(pairs: DataFrame, texts: DataFrame, large: DataFrame) -> DataFrame:
    """Links of the groups of ``large``: of their forests, then, where those leave a group apart, of all its candidates."""
    texts = common.materialize(texts.join(F.broadcast(large.select("key")) if common.bounded(large, MAX_SENT) else large.select("key"), "key"), "texts-of-large")
    good = verified(pairs, texts)
    root = common.materialize(components(good).select("node", F.col("root").alias("label")), "labels")
    texts = texts.join(root, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = texts.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    apart = common.materialize(apart.join(large, "key"), "apart")
    if apart.isEmpty():
        return good
    few = apart.select("key")
    whole = common.materialize(shingles_of(texts.join(F.broadcast(few) if common.bounded(few, MAX_SENT) else few, "key")), "texts-again")
    return good.unionByName(by_blocks(whole, apart, run_links))


def node_groups(rows: DataFrame, text_col: str = "text", block: int = BLOCK, block_bytes: int = BLOCK_BYTES, bucket: int = BUCKET) -> DataFrame:
    """``node``, ``root`` of nodes linked to others, from written rows with ``__row, node, print, rid``."""
    every = common.materialize(rows.groupBy("node").agg(F.min("rid").alias("rid"), F.first("print").alias("print")), "nodes")
    nodes = every.select(F.col("rid").alias("node"), "print")
    sizes = bucket_sizes(nodes).select("key", F.ceil(F.col("c") / bucket).alias("n"))
    pairs = common.materialize(by_blocks(bucket_rows(nodes), sizes, run_pairs), "candidates")
    met = common.materialize(components(pairs).select("node", F.col("root").alias("key")), "met")
    few = F.broadcast(met) if common.bounded(met, MAX_SENT) else met
    texts = rows.select(F.col("rid").alias("node"), F.substring("print", 1, HASHES).alias("sig"), F.col(f"__row.`{text_col}`").alias("words"))
    texts = common.materialize(texts.join(few, "node").select("key", "node", F.col("node").alias("label"), "sig", "words"), "texts")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum(F.octet_length("words")) / block_bytes)).cast("int")
    large = common.materialize(texts.groupBy("key").agg(blocks.alias("n")).where("n > 1"), "large-groups")
    if large.isEmpty():
        links = run_links(texts, ["key"])
    else:
        some = F.broadcast(large) if common.bounded(large, MAX_SENT) else large
        theirs = met.join(some.select("key"), "key", "left_semi").select(F.col("node").alias("a"))
        theirs = F.broadcast(theirs) if common.bounded(theirs, MAX_SENT) else theirs
        links = run_links(texts.join(some.select("key"), "key", "left_anti"), ["key"])
        links = links.unionByName(large_links(pairs.join(theirs, "a", "left_semi"), texts.drop("label"), large))
    linked = common.materialize(components(links).select(F.col("node").alias("rid"), "root"), "groups")
    few = F.broadcast(linked) if common.bounded(linked, MAX_SENT) else linked
    named = common.materialize(every.select("node", "rid").join(few, "rid"), "named-groups")
    return named.select("node", "root").join(named.select(F.col("rid").alias("root"), F.col("node").alias("top")), "root").select("node", F.col("top").alias("root"))

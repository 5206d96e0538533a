"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A block of pre-tokens is one linked list of parts, with a stop between pre-tokens. Pairs that have a merge rank wait
in a bucket per rank that holds list positions; a two-level bitmap tells by find-first-set which bucket is next, and
entries whose pair has changed meanwhile are skipped as stale. Ranks only rise where no merged token has a lower rank
than its parts, so all positions of a bucket, over all pre-tokens of the block, are merged together: from left to
right where they overlap. A small bucket is merged one position at a time, a large one by array operations. A table
where ranks may fall is merged one pre-token at a time. A pre-token of n bytes takes O(n log n) steps however long it is.

Texts are cut into units that the public pattern never matches across (see ``units``), and each distinct pre-token of a
part of a batch is merged once. With another pattern a whole text is one unit.

Nulls: a null text encodes like an empty one (no ids). Repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, units
from .arrays import IntTable, Ragged

#: Positions of a bucket from which on array operations pay; bytes of pre-tokens in a block.
MANY, BLOCK_BYTES = 20, 1 << 21
BIT = [1 << i for i in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class RankQueue:
    """Buckets of list positions per rank, and which ranks have any as a bitmap of two levels.

    ``low`` has words of 256 bits, a bit a rank; bit i of ``top`` tells whether ``low[i]`` has any. The next rank is
    the first set bit of the first word that has one. A bucket is a list of positions and of arrays of them.
    """

    def __init__(self, size: int):
        self.low, self.top = [0] * ((size >> 8) + 1), 0
        self.buckets: dict[int, list] = {}

    def push(self, rank: int, entry) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [entry]
            w = rank >> 8
            self.low[w] |= BIT[rank & 255]
            self.top |= 1 << w
        else:
            bucket.append(entry)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Positions with their ranks; each pair of them is pushed once."""
        key = np.sort(ranks.astype(np.int64) << 32 | positions)
        key = key[np.append(True, key[1:] != key[:-1])]
        ranks, positions = key >> 32, (key & 0xFFFFFFFF).astype(np.int32)
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()]
        push, heads = self.push, ranks[starts].tolist()
        for rank, a, b in zip(heads, starts, [*starts[1:], len(positions)]):
            push(rank, positions[a:b] if b - a > 1 else int(positions[a]))

    def pop(self) -> tuple[int, list]:
        """The lowest rank that has a bucket, and that bucket; there must be one."""
        w = (self.top & -self.top).bit_length() - 1
        word = self.low[w]
        first = word & -word
        self.low[w] = word ^ first
        if word == first:
            self.top ^= 1 << w
        rank = (w << 8) + first.bit_length() - 1
        return rank, self.buckets.pop(rank)


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The pair that makes ``token`` of its bytes, if merges by rank do so with ranks that rise to its own."""
    parts, low, at = [bytes([b]) for b in token], -1, 0
    while len(parts) > 1:
        found = [ranks.get(a + b, -1) for a, b in zip(parts, parts[1:])]
        rank = min((r for r in found if r >= 0), default=-1)
        if rank < low or rank < 0:
            return None
        low, at = rank, found.index(rank)
        pair = parts[at : at + 2]
        parts[at : at + 2] = [pair[0] + pair[1]]
    return (ranks[pair[0]], ranks[pair[1]]) if low == ranks[token] else None


def merge_table(ranks: dict[bytes, int]) -> np.ndarray | None:
    """For a table whose ranks only rise: rows ``left, right, merged``, one for each merge that can happen.

    Boundaries of a pair that is about to be merged were there from the start, so its bytes have been merged as they
    are by themselves. If every token is so made by merges of rising ranks, it is always made of the same last pair, and
    no merge brings up a pair of a lower rank. Else there is no such table.
    """
    rows = []
    for token, rank in ranks.items():
        if len(token) > 1:
            pair = last_pair(token, ranks)
            if pair is None:
                return None
            rows.append((*pair, rank))
    return np.array(rows, np.int64).reshape(-1, 3).T


_tables: dict[str, np.ndarray | None] = {}


def table_of(path: str) -> np.ndarray | None:
    """The merge table of a file, made once on the driver; it is as large as the file's."""
    if path not in _tables:
        _tables[path] = merge_table(load_ranks(path))
    return _tables[path]


class Merger:
    """Merges pre-tokens by a table of ranks; a token's id is its rank. ``table``: that of ``merge_table``."""

    def __init__(self, ranks: dict[bytes, int], table: np.ndarray | None):
        self.ranks, size = ranks, max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.rising = table is not None
        self.pairs = IntTable(table[0] << 32 | table[1], table[2].astype(np.int32)) if self.rising else None
        self.queue = RankQueue(size)

    def encode(self, pieces: list[bytes]) -> Ragged:
        """The ids of each pre-token."""
        lists, at = [Ragged(np.empty(0, np.int32), np.empty(0, np.int64))], 0
        while at < len(pieces):
            size, end = 0, at
            while end < len(pieces) and (end == at or size + len(pieces[end]) <= BLOCK_BYTES) and (self.rising or end == at):
                size += len(pieces[end])
                end += 1
            lists.append(self.block(pieces[at:end]))
            at = end
        return Ragged(np.concatenate([x.flat for x in lists]), np.concatenate([x.lengths for x in lists]))

    def block(self, pieces: list[bytes]) -> Ragged:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = b"".join(pieces)
        n = len(data)
        starts = np.cumsum(lengths) - lengths
        ids = self.byte[np.frombuffer(data, np.uint8)]
        # part i spans data[i:end[i]], the next part starts at end[i]; waiting[i] is the rank of the pair from i or -1
        end, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        stop = np.zeros(n + 1, bool)
        stop[starts[lengths > 0]] = stop[n] = True
        before[:-1][stop[:-1]] = -1
        # a pre-token that is a token itself is not merged at all
        token = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int32, len(pieces))
        token[lengths == 0] = -1
        waiting = np.full(n, -1, np.int32)
        to_merge = np.repeat(token < 0, lengths)
        if n > 1:
            open_pairs = np.flatnonzero(~stop[1:n] & to_merge[:-1])
            if self.rising:
                waiting[open_pairs] = self.pairs.get(ids[open_pairs].astype(np.int64) << 32 | ids[open_pairs + 1])
            else:
                waiting[open_pairs] = [self.ranks.get(data[i : i + 2], -1) for i in open_pairs.tolist()]
        dead = ~to_merge
        if to_merge.any():
            self.run(data, ids, end, before, waiting, stop, dead)
        whole = np.flatnonzero(token >= 0)
        ids[starts[whole]] = token[whole]
        dead[starts[whole]] = False
        left = np.flatnonzero(~dead)
        counts = np.zeros(len(pieces), np.int64)
        full = np.flatnonzero(lengths)
        bounds = np.append(np.searchsorted(left, starts[full]), len(left))
        counts[full] = np.diff(bounds)
        return Ragged(ids[left], counts)

    def run(self, data: bytes, ids, end, before, waiting, stop, dead) -> None:
        """Merges until no pair has a rank. The queue is empty before and after."""
        queue, buckets = self.queue, self.queue.buckets
        first = np.flatnonzero(waiting >= 0)
        if len(first):
            queue.push_all(waiting[first], first)
        one = [memoryview(x) for x in (ids, end, before, waiting, stop, dead)]
        try:
            while queue.top:
                rank, bucket = queue.pop()
                if len(bucket) == 1 and type(bucket[0]) is int:
                    self.merge_few(rank, bucket, data, *one)
                elif self.rising and (len(bucket) >= MANY or sum(1 if type(x) is int else len(x) for x in bucket) >= MANY):
                    places = np.concatenate([np.array([x for x in bucket if type(x) is int], np.int32), *[x for x in bucket if type(x) is not int]])
                    self.merge_many(rank, places, ids, end, before, waiting, stop, dead)
                else:
                    places = sorted(y for x in bucket for y in ([x] if type(x) is int else x.tolist()))
                    self.merge_few(rank, places, data, *one)
        finally:
            buckets.clear()

    def merge_few(self, rank: int, places: list[int], data: bytes, ids, end, before, waiting, stop, dead) -> None:
        rank_of, push = self.ranks.get, self.queue.push
        for count, i in enumerate(places):
            if waiting[i] != rank:
                continue
            j = end[i]
            k = end[i] = end[j]
            ids[i] = rank
            dead[j] = True
            waiting[j] = -1
            low = rank
            if stop[k]:
                waiting[i] = -1
            else:
                before[k] = i
                new = waiting[i] = rank_of(data[i : end[k]], -1)
                if new >= 0:
                    push(new, i)
                    low = min(low, new)
            h = before[i]
            if h >= 0:
                new = rank_of(data[h:k], -1)
                if new != waiting[h]:
                    waiting[h] = new
                    if new >= 0:
                        push(new, h)
                        low = min(low, new)
            if low < rank:  # a lower rank goes first; what is left of this bucket waits
                if count + 1 < len(places):
                    push(rank, np.array(places[count + 1 :], np.int32))
                return

    def merge_many(self, rank: int, places, ids, end, before, waiting, stop, dead) -> None:
        i = places[waiting[places] == rank]
        if not len(i):
            return
        i.sort()
        j = end[i]
        over = np.flatnonzero(i[1:] == j[:-1])
        if len(over):  # of pairs that overlap in a row every second goes
            new_row = np.ones(len(i), bool)
            new_row[over + 1] = False
            count = np.arange(len(i))
            keep = (count - np.maximum.accumulate(np.where(new_row, count, 0))) & 1 == 0
            i, j = i[keep], j[keep]
        k = end[j]
        ids[i] = rank
        end[i] = k
        dead[j] = True
        waiting[j] = -1
        waiting[i] = -1
        right = ~stop[k]
        i_right, k = i[right], k[right]
        before[k] = i_right
        left = before[i]
        i_left = i[left >= 0]
        left = left[left >= 0]
        begin = np.concatenate([i_right, left])
        new = self.pairs.get(np.concatenate([ids[i_right], ids[left]]).astype(np.int64) << 32 | np.concatenate([ids[k], ids[i_left]]))
        waiting[begin] = new
        there = new >= 0
        if there.any():
            self.queue.push_all(new[there], begin[there])


class Codec:
    """Encoding and decoding of texts by ranks and a pre-token pattern; special strings are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], table: np.ndarray | None, pattern: str, limit: int = 300_000):
        import public_tokenizers
        import regex

        size = max(ranks.values()) + 1
        self.merger, self.find = Merger(ranks, table), regex.compile(pattern).findall
        by_id: list[bytes] = [b""] * size
        for token, i in ranks.items():
            by_id[i] = token
        self.tokens = pa.array(by_id, pa.binary())
        self.decimals = pa.array([b" %d" % i for i in range(size)], pa.binary())
        self.cut = pattern == public_tokenizers.PATTERN
        self.pieces = units.Pieces(self.split, lambda found: self.merger.encode([p.encode() for p in found]), limit)

    def split(self, coded: list[str]) -> tuple[list[str], np.ndarray]:
        found = list(map(self.find, map(units.raw, coded)))
        return list(chain.from_iterable(found)), np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, texts: pa.Array) -> Ragged:
        """Ids of every text."""
        return self.pieces.encode(texts, self.cut)

    def decode(self, lists: Ragged) -> list[bytes]:
        """The bytes that each list of ids stands for."""
        return strings(self.tokens, lists)


def strings(table: pa.Array, lists: Ragged) -> list[bytes]:
    """For each list of numbers their strings in ``table`` put together."""
    found = table.take(pa.array(lists.flat))
    if not len(found):
        return [b""] * len(lists.lengths)
    data, ends = found.buffers()[2].to_pybytes(), np.frombuffer(found.buffers()[1], np.int32)[: len(found) + 1]
    bounds = ends[np.concatenate([[0], np.cumsum(lists.lengths)])].tolist()
    return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every whole text, and ``token_ids`` if asked for.

    Columns of these names in ``docs`` are replaced. The ids are decoded again and the digest is of those bytes.
    """
    common.ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    table = docs.sparkSession.sparkContext.broadcast(table_of(ranks_path))

    def encode(batches):
        codec = Codec(load_ranks(ranks_path), table.value, pattern)
        sha = hashlib.sha256
        for batch in batches:
            for first, texts in common.text_parts(common.field(batch, at)):
                lists = codec.encode(texts)
                ids_sha = [sha(x[1:]).hexdigest() for x in strings(codec.decimals, lists)]
                decoded_sha = [sha(x).hexdigest() for x in codec.decode(lists)]
                columns = [batch.column(0).slice(first, len(texts)), pa.array(lists.lengths), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(lists.lengths)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(lists.flat)))
                yield pa.RecordBatch.from_arrays(columns, names=["__row", *names])
        del codec
        common.give_back()

    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * with_ids
    rows = common.pack(docs)
    empty = {"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit(""), "token_ids": F.array(F.lit(0))}
    schema = rows.select("__row", *[empty[n].alias(n) for n in names]).schema
    return rows.mapInArrow(encode, schema).select(*[F.col(f"__row.`{c}`") for c in docs.columns if c not in names], *names)


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    docs = spark.read.parquet(common.table_path(sf_dir, "documents"))
    out = bpe_encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

"""Token output as sorted string tables: documents keyed by identifier in prefix-compressed blocks.

A shard file is: data blocks, block index, Bloom filter, footer. A block holds entries ``shared length, rest length,
value length, rest of key, value`` (variable-length integers) in key order, compressed with Zstandard and closed by
its CRC-32. The index has the last key, offset and length of each block; a lookup asks the Bloom filter, searches the
index by bisection and decodes one block. Keys order null identifiers first, then integers ascending, or strings by
their bytes.

Documents are encoded where they are read, and their compressed ids dealt out by ranges of identifiers whose cuts come
from a sample of identifiers; an identifier that fills more than a range is spread over several by a hash of the text.
Tasks sort theirs and write shards under a name of their own attempt, and only the manifest rows that Spark commits
name the files that count. A lost executor therefore leaves orphans, never gaps.

Nulls: a null identifier is a key of its own, a null text encodes like an empty one (just the end id). Repeated rows
and equal identifiers are kept, next to each other, ordered by a hash of their texts. An empty table gives no shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, units

MAGIC = b"PWSST001"
FOOTER = struct.Struct("<QQQQQQB7x8s")
MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long, n_bytes long"
BLOCK_BYTES, SHARD_BYTES = 1 << 16, 256 << 20
BLOOM_BITS, BLOOM_HASHES, PER_PART = 10, 7, 100


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def key_of(doc_id: int | str | None) -> bytes:
    if isinstance(doc_id, str):
        return b"\2" + doc_id.encode()
    return b"\0" * 9 if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | str | None:
    if key[0] == 2:
        return key[1:].decode()
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63)


def bloom_places(keys: list[bytes], m: int) -> np.ndarray:
    import xxhash

    a = np.fromiter((xxhash.xxh64_intdigest(k, 1) for k in keys), np.uint64, len(keys))
    b = np.fromiter((xxhash.xxh64_intdigest(k, 2) | 1 for k in keys), np.uint64, len(keys))
    with np.errstate(over="ignore"):
        return (a[:, None] + b[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(m)


class Writer:
    """One shard; entries come in key order."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.pack = out, width, zstandard.ZstdCompressor(level=1).compress
        self.at = self.n_docs = self.n_tokens = self.size = 0
        self.last = b""
        self.block: list[bytes] = []
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            if key == self.last:
                shared = len(key)
            else:
                while shared < len(self.last) and key[shared] == self.last[shared]:
                    shared += 1
        else:
            self.size = 0
        self.block += (varint(shared), varint(len(key) - shared), varint(len(value)), key[shared:], value)
        self.size += len(value) + 12
        if key != self.last or not self.keys:
            self.keys.append(key)
        self.last = key
        self.n_docs += 1
        self.n_tokens += len(value) // self.width
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.pack(b"".join(self.block))
            data += zlib.crc32(data).to_bytes(4, "little")
            self.out.write(data)
            self.index.append((self.last, self.at, len(data)))
            self.at += len(data)
            self.block = []

    def close(self) -> int:
        self.flush()
        index = b"".join(varint(len(k)) + k + varint(at) + varint(n) for k, at, n in self.index)
        m = max(64, BLOOM_BITS * len(self.keys) + 7 & ~7)
        bits = np.zeros(m, np.uint8)
        bits[bloom_places(self.keys, m).astype(np.int64).ravel()] = 1
        bloom = np.packbits(bits, bitorder="little").tobytes()
        foot = FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.n_docs, self.n_tokens, self.width, MAGIC)
        self.out.write(index + bloom + foot)
        self.out.close()
        return self.at + len(index) + len(bloom) + len(foot)


class Reader:
    """Lookup and scan of one shard; holds the index and the filter, and one block at a time."""

    def __init__(self, file):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        file.seek(0, 2)
        end = file.tell()
        file.seek(end - FOOTER.size)
        i_at, i_len, b_at, b_len, self.n_docs, self.n_tokens, self.width, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        file.seek(i_at)
        data, at = file.read(i_len), 0
        self.bloom, self.blocks = np.frombuffer(file.read(b_len), np.uint8), []
        while at < len(data):
            n, at = read_varint(data, at)
            key, at = data[at : at + n], at + n
            off, at = read_varint(data, at)
            size, at = read_varint(data, at)
            self.blocks.append((key, off, size))

    def block(self, i: int):
        _, off, size = self.blocks[i]
        self.file.seek(off)
        data = self.file.read(size)
        if zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
            raise ValueError("a block is damaged")
        data, at, key = self.unpack(data[:-4]), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n]
            at += n

    def scan(self):
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def may_have(self, key: bytes) -> bool:
        places = bloom_places([key], len(self.bloom) * 8)[0]
        return all(self.bloom[int(p) >> 3] >> (int(p) & 7) & 1 for p in places)

    def get(self, doc_id: int | str | None) -> list[np.ndarray]:
        """The ids of every document of this identifier, without a scan of other blocks than its own."""
        key, found = key_of(doc_id), []
        if not self.may_have(key):
            return found
        for i in range(bisect_left([k for k, _, _ in self.blocks], key), len(self.blocks)):
            for k, value in self.block(i):
                if k > key:
                    return found
                if k == key:
                    found.append(np.frombuffer(value, f"<u{self.width}").astype("<u4"))
        return found


def id_width(tokenizer_path: str, end_id: int) -> int:
    return 2 if max(units.library_tokenizer(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def range_bounds(docs: DataFrame, id_col: str, parts: int) -> list[bytes]:
    """Keys that cut the identifiers into ``parts`` ranges of about equal rows, from a sample of identifiers.

    The sample has ``PER_PART`` identifiers a part, so it follows the number of tasks and not that of rows. It only
    places the cuts; no result depends on it.
    """
    ids = docs.select(F.col(f"`{id_col}`").alias("i"))
    n, wanted = ids.count(), PER_PART * parts
    if n > 2 * wanted:
        ids = ids.sample(min(1.0, 1.2 * wanted / n), 42)
    keys = sorted(key_of(r["i"]) for r in ids.collect())
    return [keys[len(keys) * k // parts] for k in range(1, parts)] if keys else []


def encoder(tokenizer_path: str, end_id: int, width: int, bounds):
    """From ``doc_id, text, hash`` to ``part, key, hash, ids`` (compressed), whatever the order of rows."""

    def encode(batches):
        import zstandard

        library, cuts, pack = units.library(tokenizer_path), bounds.value, zstandard.ZstdCompressor(level=1).compress
        end = end_id.to_bytes(width, "little")
        for batch in batches:
            keys, hashes = list(map(key_of, batch.column(0).to_pylist())), batch.column(2).to_pylist()
            for first, texts in common.text_parts(batch.column(1), 2 * common.PART_BYTES):
                lists = library.encode(texts)
                data, ends = lists.flat.astype(f"<u{width}").tobytes(), np.cumsum(lists.lengths) * width
                starts = ends - lists.lengths * width
                ids = [pack(data[a:b] + end) for a, b in zip(starts.tolist(), ends.tolist())]
                here, of = keys[first : first + len(texts)], hashes[first : first + len(texts)]
                # an identifier that fills whole ranges is spread over them by hash, in order
                low = [bisect_left(cuts, k) for k in here]
                high = [bisect_right(cuts, k) for k in here]
                part = [a + ((h + (1 << 63)) * (b - a + 1) >> 64) if b > a else a for a, b, h in zip(low, high, of)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(here, pa.binary()), pa.array(of, pa.int64()), pa.array(ids, pa.binary())], names=["part", "key", "hash", "ids"])
        common.give_back()

    return encode


def shard_writer(folder: str, width: int, shard_bytes: int):
    def write(batches):
        import zstandard
        from pyspark import TaskContext

        part, unpack = TaskContext.get().partitionId(), zstandard.ZstdDecompressor().decompress
        rows, out, path = [], None, ""

        def close():
            n = out.close()
            rows.append((part, len(rows), path, out.n_docs, out.n_tokens, n))

        for batch in batches:
            for key, ids in zip(batch.column(0), batch.column(1)):
                if out is None:
                    path = f"{folder}/shard-{part:06d}-{len(rows):04d}-{uuid.uuid4().hex}.sst"
                    out = Writer(common.open_output(path), width)
                out.add(key.as_py(), unpack(ids.as_py()))
                if out.at >= shard_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "seq", "path", "n_docs", "n_tokens", "n_bytes"), r)) for r in rows], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    return write


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, folder: str | None = None, parts: int | None = None) -> DataFrame:
    """Encode every document and write the shards; returns the manifest (one row a shard), already committed."""
    spark = docs.sparkSession
    common.ship(spark)
    folder = folder or common.temporary(spark, "sst")
    parts, width = parts or common.shuffle_parts(spark), id_width(tokenizer_path, end_id)
    bounds = spark.sparkContext.broadcast(range_bounds(docs, id_col, parts))
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    coded = rows.mapInArrow(encoder(tokenizer_path, end_id, width, bounds), "part int, key binary, hash long, ids binary")
    dealt = coded.repartitionById(parts, F.col("part")).sortWithinPartitions("key", "hash").select("key", "ids")
    return common.materialize(dealt.mapInArrow(shard_writer(folder, width, shard_bytes), MANIFEST), "manifest")


def read_shards(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Documents of all shards: doc_id, start (ids before it), ids (binary, little-endian unsigned 32-bit).

    The manifest has a row for each shard of up to ``SHARD_BYTES``; its running sum is made on the driver.
    """
    spark = manifest.sparkSession
    common.ship(spark)
    shards = manifest.orderBy("part", "seq").select("path", "n_tokens").collect()
    starts = [0, *accumulate(s.n_tokens for s in shards)]
    plan = spark.sparkContext.parallelize([(s.path, b) for s, b in zip(shards, starts)], max(1, len(shards)))
    schema = pa.schema([("doc_id", pa.string() if id_type == "string" else pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with common.open_input(row["path"]) as file:
                    reader, start = Reader(file), row["base"]
                    for i in range(len(reader.blocks)):
                        out = []
                        for key, value in reader.block(i):
                            out.append({"doc_id": id_of(key), "start": start, "ids": np.frombuffer(value, f"<u{reader.width}").astype("<u4").tobytes()})
                            start += len(value) // reader.width
                        yield pa.RecordBatch.from_pylist(out, schema)

    return spark.createDataFrame(plan, "path string, base long").mapInArrow(read, f"doc_id {id_type}, start long, ids binary")


def op3_token_sstable(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents`` as shards of byte-level ids with end id 2, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    docs = spark.read.parquet(common.table_path(sf_dir, "documents"))
    back = read_shards(write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), 2))
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))

"""Language-model scores by subword lattice likelihood, beside a smoothed word unigram.

Training documents (crc32 of the identifier's text mod 10 is not 0) give counts of words, natively. An existing
vocabulary gives the pieces and their first scores; its scores are ranks, taken as weights 1 / (rank + 1). Under these
the distinct words, weighted by their counts, give expected counts of pieces over all segmentations by forward and
backward sums, which are the next scores; ``ROUNDS`` times. The probability of a text sums over all its segmentations
into pieces by a forward recursion in log space, times the probability of the end. White space between words counts
as one space. The pieces are those of the vocabulary whatever the corpus; the word counts grow with it.

The counts of words are never broadcast whole: the most frequent are, down to a count below which they would be more
than ``HEAD_WORDS`` (found from a histogram of counts, so that no partition sends more). The words of a document that
are not among them go through a join by word, after being counted per document. A word of more than ``KEY_BYTES``
bytes stands in that table and join as its SHA-256, so that long words may be frequent ones too. A hot word is in the
head; what is left is no hot key but by ties, which adaptive execution splits. Documents are numbered for the sums, so
equal or null identifiers do not mix.

Nulls: a null text is empty: one token, the end. A null identifier is in training (its remainder is null, not 0) and
not held out. An empty training set gives N = V = 0; scores then come from smoothing alone. Repeated rows count each.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, lattice

HEAD_WORDS, KEY_BYTES, ROUNDS, CACHE_WORDS = 100_000, 64, 2, 150_000


def held_out(id_col, of: int, rest: int):
    """crc32 of the identifier as text, mod ``of``, is ``rest``; false for a null identifier."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % of == rest, F.lit(False))


def piece_scores(counts: DataFrame, n_docs: int, vocabulary: str, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Log probabilities of all pieces, and of the end, from word counts; at most the vocabulary's size comes back."""
    p = lattice.pieces(vocabulary)
    lp, end = p.own_scores(), 0.0
    for _ in range(rounds):
        n = lattice.expected_counts(counts, vocabulary, lp)
        weights = np.where(p.usable, n + lattice.SMOOTH, 0.0)
        total = weights.sum() + n_docs + lattice.SMOOTH
        with np.errstate(divide="ignore"):
            lp, end = np.log(weights / total), math.log((n_docs + lattice.SMOOTH) / total)
    return lp, end


def keys_of(words: pa.Array) -> pa.Array:
    """What words stand as in the join: the long ones as a space, which is in no word, and their SHA-256."""
    long = np.flatnonzero(np.asarray(pc.binary_length(words)) > KEY_BYTES)
    if not len(long):
        return words
    out = words.to_pylist()
    for i in long.tolist():
        out[i] = " " + hashlib.sha256(out[i].encode()).hexdigest()
    return pa.array(out, pa.string())


def rare_of(words: lattice.Words, missing: np.ndarray) -> tuple[np.ndarray, pa.StructArray]:
    """Of each text the missing words with their counts: how many there are, and all of them as structs."""
    places = np.flatnonzero(missing[words.index])
    text = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))[places]
    pairs, times = np.unique(text * len(words.distinct) + words.index[places], return_counts=True)
    text, word = np.divmod(pairs, max(1, len(words.distinct)))
    keys = keys_of(words.distinct.take(pa.array(word)))
    return np.bincount(text, minlength=len(words.bounds) - 1), pa.StructArray.from_arrays([keys, pa.array(times.astype(np.int64))], ["w", "k"])


def word_key():
    """The same of a column ``word``."""
    return F.when(F.octet_length("word") <= KEY_BYTES, F.col("word")).otherwise(F.concat(F.lit(" "), F.sha2("word", 256)))


def score_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of marginal probability)."""
    spark = docs.sparkSession
    common.ship(spark)
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), held_out(doc_id, 10, 0).alias("held_out"))
    counts = common.materialize(lattice.word_counts(rows.where("not held_out")).select("word", "c", word_key().alias("key")), "word-counts")
    n_docs = rows.where("not held_out").count()
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = words + n_docs, distinct + (n_docs > 0)
    norm = n + 0.1 * (v + 1)
    end_base = math.log10((n_docs + 0.1) / norm)
    lp, end_lp = piece_scores(counts, n_docs, vocabulary, rounds)
    head = common.most_frequent(counts, head_words)
    sent = spark.sparkContext.broadcast((list(head), np.array([math.log10((c + 0.1) / norm) for c in head.values()]), lp[:, None]))

    def scan(batches):
        """For each document its sums over frequent words, its lattice score, and its rare words."""
        head, base, lp = sent.value
        marginals = lattice.Marginals(lattice.pieces(vocabulary), lp, CACHE_WORDS)
        frequent = pa.array(head, pa.string())
        base = np.append(base, 0.0)
        for batch in batches:
            parts = []
            for _, part in common.text_parts(batch.column(0)):
                words = lattice.Words(part)
                place = pc.index_in(keys_of(words.distinct), value_set=frequent)
                missing = np.asarray(pc.is_null(place))
                values = np.stack([marginals.of(words.distinct)[:, 0], base[np.asarray(pc.fill_null(place, len(head)))], ~missing], 1)
                sums = words.sums(values)
                parts.append((np.diff(words.bounds) + 1, sums, *rare_of(words, missing)))
            n_tokens = np.concatenate([p[0] for p in parts])
            sums = np.concatenate([p[1] for p in parts])
            lengths = np.concatenate([p[2] for p in parts])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.concat_arrays([p[3] for p in parts]))
            del parts
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(n_tokens), pa.array(sums[:, 2].astype(np.int64) + (n_docs > 0)), pa.array(sums[:, 1] + end_base), pa.array((sums[:, 0] + end_lp) / math.log(10)), lists],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
            )
        del marginals
        common.give_back()

    kind = rows.schema["doc_id"].dataType.simpleString()
    scanned = rows.select("text", "doc_id", "held_out").mapInArrow(scan, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<w:string,k:long>>")
    scanned = common.materialize(scanned.withColumn("rid", F.monotonically_increasing_id()), "scored")
    rare = scanned.select("rid", F.explode("rare").alias("r")).select("rid", F.col("r.w").alias("key"), F.col("r.k").alias("k"))
    looked = rare.join(counts.select("key", "c").hint("shuffle_merge"), "key", "left").groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k"))).alias("more"),
        F.sum(F.col("k") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / norm)).alias("base"),
    )
    return scanned.drop("rare").join(looked.hint("shuffle_merge"), "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), "score",
    )


def op4_lattice_score(spark, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all whole texts of ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(common.table_path(sf_dir, "documents"))
    return score_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))

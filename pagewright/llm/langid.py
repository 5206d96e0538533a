"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has its own probabilities of the vocabulary's pieces, learned from labelled training documents by
segmenting the distinct words of each task once. A text's probability under a language is the product over its words
of the sum over all segmentations (forward algorithm, all languages at once), times the language's prior. Training
may be bounded: of at most ``MAX_TRAIN_DOCS`` labelled documents that are used, a rare language gives all it has and
the frequent ones an equal share, drawn by a hash of identifier and text; this is the documented bound for fitting
the classifier. Predictions cover every whole text.

A posterior compares the learned languages only, so a text of no learned language has one of nearly 1 too. ``strange``
does not: it is the text's log probability per character over that of the training texts of its language, about 1 for
texts like them and larger the less likely a text is.

Nulls: a null text, or one without a letter, is ``und`` with score 0. Documents with a null language are not learned
from. Without any training document all predictions are ``und``. Ties go to the smaller language name.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, lattice
from .lm import held_out

MAX_TRAIN_DOCS, UNKNOWN, MIN_SCORE, MAX_STRANGE = 200_000, "und", 0.5, 2.5
#: Words kept in a worker's table, and bytes of that table.
TABLE_WORDS, TABLE_BYTES = 250_000, 32 << 20
DRAWS = 1_000_000


class Model(NamedTuple):
    langs: list[str]
    lp: np.ndarray  # log probabilities, pieces by languages
    prior: np.ndarray
    per_char: np.ndarray  # log probability of a character in training


def share_of(counts: dict[str, int], limit: int) -> dict[str, float]:
    """The share of each class that is drawn: the rare ones whole, the others down to one common number."""
    left, level = limit, None
    ranked = sorted(counts.values())
    for k, n in enumerate(ranked):
        if n * (len(ranked) - k) > left:
            level = left / (len(ranked) - k)
            break
        left -= n
    return {c: 1.0 if level is None or n <= level else level / n for c, n in counts.items()}


def fit(train: DataFrame, vocabulary: str, max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """The model from ``text``, ``lang`` and ``draw`` (a hash).

    What comes to the driver is one row a language, and at most the vocabulary's size for each.
    """
    train = train.where("lang is not null and text is not null")
    totals = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = share_of(totals, max_docs)
    drawn = F.lit(False)
    for share in sorted(set(shares.values())):
        of = [lang for lang, s in shares.items() if s == share]
        drawn = drawn | (F.col("lang").isin(of) & (F.col("draw") < int(DRAWS * share)))
    if any(s < 1 for s in shares.values()):
        train = train.where(drawn)
    langs = sorted(totals)
    p = lattice.pieces(vocabulary)
    counts = np.zeros((p.size, len(langs)))
    place = {lang: k for k, lang in enumerate(langs)}
    for r in lattice.piece_counts(train, vocabulary, "lang").collect():
        counts[r["piece"], place[r["lang"]]] = r["n"]
    weights = np.where(p.usable[:, None], counts + lattice.SMOOTH, 0.0)
    if not langs:
        return Model([], weights, np.empty(0), np.empty(0))
    with np.errstate(divide="ignore"):
        lp = np.log(weights / weights.sum(0))
    lengths = np.ones(p.size)
    for piece, k in p.number.items():
        lengths[k] = len(piece.lstrip(lattice.MARK))
    per_char = (counts * np.where(p.usable[:, None], lp, 0)).sum(0) / np.maximum((counts * lengths[:, None]).sum(0), 1)
    n = sum(totals.values())
    return Model(langs, lp, np.log(np.array([totals[x] / n for x in langs])), per_char)


def with_language(docs: DataFrame, model: Model, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` packed as ``__row`` with ``lang_pred``, ``score`` and ``strange``; the model is languages by pieces, so bounded."""
    common.ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))
    at = docs.columns.index(text_col)
    text = F.col(f"`{text_col}`")
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = common.pack(docs, letters=letters, chars=F.length(F.translate(text, common.WS, "")))

    def scan(batches):
        model = Model(*sent.value)
        marginals = lattice.Marginals(lattice.pieces(vocabulary), model.lp, max(1000, min(TABLE_WORDS, TABLE_BYTES // (8 * max(1, len(model.langs))))))
        names = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            n, known = batch.num_rows, len(model.langs)
            totals = np.zeros((n, max(1, known)))
            for first, part in common.text_parts(common.field(batch, at)) if known else ():
                words = lattice.Words(part)
                totals[first : first + len(part)] = words.sums(marginals.of(words.distinct))
            chars = np.array(batch.column(2).fill_null(0), np.float64)
            good = np.array(batch.column(1), bool) & (known > 0)
            best = np.full(n, known)
            score, strange = np.zeros(n), np.zeros(n)
            if known:
                both = totals + model.prior
                best = np.where(good, both.argmax(1), known)
                top = both.max(1)
                score = np.where(good, 1 / np.exp(np.minimum(both - top[:, None], 0)).sum(1), 0.0)
                rate = totals.max(1) / np.maximum(chars, 1) / np.append(model.per_char, -1.0)[best]
                strange = np.where(good, rate, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(strange)], names=["__row", "lang_pred", "score", "strange"])
        del marginals
        common.give_back()

    return rows.mapInArrow(scan, rows.select("__row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("strange")).schema)


def training(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    draw = F.pmod(F.xxhash64(doc_id, text, F.lit(7)), F.lit(DRAWS))
    return docs.where(~held_out(doc_id, 4, 2)).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), text.alias("text"), draw.alias("draw"))


def keep_identified(docs: DataFrame, vocabulary: str, min_score: float = MIN_SCORE, max_strange: float = MAX_STRANGE) -> DataFrame:
    """``docs`` without those of no language, of a posterior below ``min_score``, or stranger than ``max_strange``."""
    model = fit(training(docs), vocabulary)
    found = with_language(docs, model, vocabulary)
    return common.unpack(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score) & (F.col("strange") <= max_strange)))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``: doc_id, held_out, lang_pred, score."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(common.table_path(sf_dir, "documents"))
    model = fit(training(docs), vocabulary)
    out = with_language(docs.select("doc_id", "text"), model, vocabulary)
    return out.select(F.col("__row.doc_id").alias("doc_id"), held_out(F.col("__row.doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")

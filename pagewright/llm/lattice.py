"""Subword lattices over a fixed public vocabulary: all segmentations of words into pieces, weighted and summed.

A word stands as the vocabulary writes it, with the space mark before it; no piece but a leading one contains the
mark, so the lattices of a text's words are independent and the marginal probability of a text is the product of
those of its words. A character that is no piece falls back to the pieces of its bytes, as in the vocabulary itself.

Many words are taken at once. They stand as the columns of a matrix of characters, right-aligned, and a trie held in
hash arrays is walked from all places together; an arc ends ``d`` rows below the one it begins in, so for each row and
``d`` a word has one arc at most and the recursions are sums of whole rows in log space.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .arrays import IntTable

MARK = "▁"
SMOOTH = 0.1
#: No character; bits of a character in a trie key; places of a matrix that are walked together; characters of a word
#: that expectations are taken over together (longer words count in stretches of it).
NONE, CHAR_BITS, PLACES, STRETCH = (1 << 21) - 1, 21, 1 << 16, 1024
#: Bytes of a word that is kept for the next part of a batch.
KEPT_BYTES = 64


class Trie:
    """Children by ``node << CHAR_BITS | character``, and the piece of each node or -1."""

    def __init__(self, number: dict[str, int]):
        children: dict[int, int] = {}
        piece = [-1]
        for text, p in number.items():
            node = 0
            for c in map(ord, text):
                k = node << CHAR_BITS | c
                node = children.get(k, 0)
                if not node:
                    node = children[k] = len(piece)
                    piece.append(-1)
            piece[node] = p
        self.piece = np.array(piece, np.int32)
        self.children = IntTable(np.array(list(children), np.int64), np.array(list(children.values()), np.int32))

    def child(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child of each node by its character, -1 where there is none."""
        return self.children.get(node.astype(np.int64) << CHAR_BITS | char)


class Pieces:
    """The pieces of a sentencepiece file: number by piece, the numbers of the byte pieces, and the trie of all."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.number = {p: i for i in plain if MARK not in (p := model.id_to_piece(i)).lstrip(MARK)}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.number))
        self.usable = np.zeros(n, bool)
        self.usable[list(self.number.values())] = True
        self.usable[self.byte] = True
        self.trie = Trie(self.number)

    def own_scores(self) -> np.ndarray:
        """Log probabilities from the file's scores. They are ranks, so a piece of the r-th best score weighs 1 / (r + 1).

        Byte pieces, whose scores are no ranks, come last.
        """
        ids = list(self.number.values())
        best = sorted(ids, key=lambda i: (-self.model.get_score(i), i))
        weight = np.zeros(self.size)
        weight[best] = 1 / (1 + np.arange(len(best)))
        weight[self.byte] = 1 / (1 + len(best))
        with np.errstate(divide="ignore"):
            return np.log(weight / weight.sum())

    def segment(self, words: list[str]) -> list[list[int]]:
        """The vocabulary's own segmentation of each word, in numbers of pieces."""
        return self.model.encode(words, num_threads=1)

    def log_marginals(self, words: pa.Array, lp: np.ndarray) -> np.ndarray:
        """Natural logs of the sums over all segmentations: words by models; ``lp`` is pieces by models."""
        out = np.empty((len(words), lp.shape[1]))
        for at, lattice in lattices(self, *characters(words), lp.shape[1]):
            out[at] = lattice.forward(lp)
        return out

    def expected_counts(self, words: pa.Array, weights: np.ndarray, lp: np.ndarray) -> np.ndarray:
        """Expected occurrences of each piece over all segmentations, each word counted ``weights`` times (one model)."""
        flat, starts, lengths, marked = *characters(words), np.ones(len(words), bool)
        long = np.flatnonzero(lengths > STRETCH)
        if len(long):
            more = [(starts[i] + k, min(STRETCH, lengths[i] - k), i) for i in long for k in range(STRETCH, lengths[i], STRETCH)]
            starts, lengths = np.append(starts, [a for a, _, _ in more]), np.append(np.minimum(lengths, STRETCH), [n for _, n, _ in more])
            weights, marked = np.append(weights, weights[[i for _, _, i in more]]), np.append(marked, np.zeros(len(more), bool))
        total = np.zeros(self.size)
        for at, lattice in lattices(self, flat, starts, lengths, marked=marked):
            lattice.add_expected(lp, weights[at], total)
        return total


def characters(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All characters of many words as numbers, and where each word's begin and how many they are."""
    lengths = np.asarray(pc.utf8_length(words)).astype(np.int64)
    text = "".join(words.to_pylist()) if words.offset else words.buffers()[2].to_pybytes()[: pc.sum(pc.binary_length(words)).as_py() or 0].decode() if len(words) else ""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), np.cumsum(lengths) - lengths, lengths


def lattices(pieces: Pieces, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, models: int = 1, marked: np.ndarray | None = None):
    """``(indices, lattice)`` of words of about equal length; the words of one lattice fill ``PLACES`` at most.

    With more than four models it is fewer places, as each has a number for each model. Words that are not ``marked``
    are later stretches and get no space mark.
    """
    places = PLACES // max(1, models // 4)
    order = np.argsort(lengths, kind="stable")
    ranked, at = lengths[order], 0
    while at < len(order):
        longest = max(1, int(ranked[at]))
        longest += longest // 8 if longest > 24 else 0
        end = min(int(np.searchsorted(ranked, longest, "right")), at + max(1, places // longest))
        of = order[at:end]
        yield of, Lattice(pieces, flat, starts[of], lengths[of], None if marked is None else marked[of])
        at = end


class Lattice:
    """Words as the columns of a matrix of characters; node ``(row, word)`` is what stands before that character."""

    def __init__(self, pieces: Pieces, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, marked: np.ndarray | None = None):
        self.pieces, self.width = pieces, len(lengths)
        longest = int(lengths.max(initial=0))
        self.rows = rows = longest + 1
        marks = np.ones(self.width, bool) if marked is None else marked
        self.begin = rows - lengths - marks
        self.chars = np.full((rows, self.width), NONE, np.int64)
        at = np.arange(longest)[:, None] - longest + (starts + lengths)
        if int(lengths.min(initial=0)) == longest:
            self.chars[1:] = flat[at]
        else:
            there = np.arange(longest)[:, None] >= longest - lengths
            self.chars[1:][there] = flat[at[there]]
        self.chars[self.begin[marks], np.flatnonzero(marks)] = ord(MARK)
        self.fallback: dict[int, int] = {}

    def arcs(self, first: int, last: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(begin row, end row, words, pieces)`` of arcs that begin in rows first..last; bytes of a character as one.

        A character that is no piece gets a number after those of the pieces, kept in ``fallback``.
        """
        trie, width = self.pieces.trie, self.width
        place = np.flatnonzero(self.chars[first:last].ravel() != NONE) + first * width
        flat, node, size, deep, out = self.chars.ravel(), np.zeros(len(place), np.int32), self.chars.size, 0, []
        while len(place):
            at = place + deep * width
            inside = at < size
            if not inside.all():
                place, node, at = place[inside], node[inside], at[inside]
            child = trie.child(node, flat[at])
            found = trie.piece[child]
            found[child < 0] = -1
            if not deep:
                none = np.flatnonzero(found < 0)
                if len(none):
                    chars = flat[place[none]]
                    for c in np.unique(chars).tolist():
                        self.fallback.setdefault(c, self.pieces.size + len(self.fallback))
                    found[none] = [self.fallback[c] for c in chars.tolist()]
            deep += 1
            has = np.flatnonzero(found >= 0)
            if len(has):
                row, word = np.divmod(place[has], width)
                piece = found[has]
                cuts = np.flatnonzero(row[1:] != row[:-1]) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(row)]):
                    out.append((int(row[a]), int(row[a]) + deep, word[a:b], piece[a:b]))
            alive = child >= 0
            place, node = place[alive], child[alive]
        return out

    def extended(self, lp: np.ndarray) -> np.ndarray:
        """``lp`` with a row for each character of ``fallback``: the sum of its bytes' rows."""
        if not self.fallback:
            return lp
        more = [lp[[self.pieces.byte[b] for b in chr(c).encode()]].sum(0) for c in self.fallback]
        return np.concatenate([lp, more])

    def forward(self, lp: np.ndarray) -> np.ndarray:
        """Log marginals, words by models. Rows are walked in stretches, so that a long word's arcs are never all held."""
        step = max(1, PLACES // max(1, self.width))
        ending: dict[int, list] = {}
        alpha = {0: self.start(0, lp.shape[1])}
        for first in range(0, self.rows, step):
            last = min(self.rows, first + step)
            for begin, end, word, piece in self.arcs(first, last):
                ending.setdefault(end, []).append((begin, word, piece))
            scores = self.extended(lp)
            for j in range(first + 1, last + 1):
                terms = [(word, alpha[begin][word] + scores[piece]) for begin, word, piece in ending.pop(j, ())]
                alpha[j] = log_sum(terms, self.start(j, lp.shape[1]))
                alpha.pop(j - self.pieces.longest, None)
        return alpha[self.rows]

    def start(self, row: int, models: int) -> np.ndarray:
        """Log probability 0 for the words that begin in ``row``, none for the others."""
        return np.where(self.begin == row, 0.0, -np.inf)[:, None].repeat(models, 1)

    def add_expected(self, lp: np.ndarray, weights: np.ndarray, total: np.ndarray) -> None:
        """Adds expected counts of pieces by forward and backward sums; ``lp`` is of one model."""
        arcs = self.arcs(0, self.rows)
        by_end: dict[int, list] = {}
        by_begin: dict[int, list] = {}
        for arc in arcs:
            by_end.setdefault(arc[1], []).append(arc)
            by_begin.setdefault(arc[0], []).append(arc)
        scores = self.extended(lp[:, None])
        alpha, beta = [self.start(0, 1)], {self.rows: np.zeros((self.width, 1))}
        for j in range(1, self.rows + 1):
            alpha.append(log_sum([(word, alpha[begin][word] + scores[piece]) for begin, _, word, piece in by_end.get(j, ())], self.start(j, 1)))
        for i in range(self.rows - 1, -1, -1):
            beta[i] = log_sum([(word, beta[end][word] + scores[piece]) for _, end, word, piece in by_begin.get(i, ())], np.full((self.width, 1), -np.inf))
        sums, whole = np.zeros(len(scores)), alpha[self.rows]
        for begin, end, word, piece in arcs:
            share = np.exp(alpha[begin][word] + scores[piece] + beta[end][word] - whole[word])[:, 0]
            sums += np.bincount(piece, share * weights[word], len(scores))
        total += sums[: len(total)]
        for c, k in self.fallback.items():
            for b in chr(c).encode():
                total[self.pieces.byte[b]] += sums[k]


def log_sum(terms: list[tuple[np.ndarray, np.ndarray]], empty: np.ndarray) -> np.ndarray:
    """Rows of the log of the summed exponentials of ``(rows, values)``; rows without a term stay as in ``empty``."""
    if not terms:
        return empty
    width = len(empty)
    top = np.full(empty.shape, -np.inf)
    for word, value in terms:
        if len(word) == width:
            np.maximum(top, value, out=top)
        else:
            top[word] = np.maximum(top[word], value)
    total, none = np.zeros(empty.shape), np.isneginf(top)
    top[none] = 0.0
    for word, value in terms:
        if len(word) == width:
            total += np.exp(value - top)
        else:
            total[word] += np.exp(value - top[word])
    with np.errstate(divide="ignore"):
        return np.where(none, empty, top + np.log(total))


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


class Words:
    """The words of some texts after lower-casing A to Z: ``distinct``, for each word its number there, and each text's range."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
        coded = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py()).dictionary_encode()
        bounds = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
        self.distinct, self.index = coded.dictionary, np.asarray(coded.indices)
        none = pc.index(self.distinct, pa.scalar("", self.distinct.type)).as_py()
        if none >= 0:  # what stands before leading white space
            real = self.index != none
            bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
            self.index = self.index[real]
            self.index[self.index > none] -= 1
            self.distinct = pa.concat_arrays([self.distinct.slice(0, none), self.distinct.slice(none + 1)])
        self.bounds = bounds

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum of its words' rows of ``values``."""
        out = np.zeros((len(self.bounds) - 1, *values.shape[1:]))
        full = np.flatnonzero(self.bounds[1:] > self.bounds[:-1])
        if len(full):
            out[full] = np.add.reduceat(values[self.index], self.bounds[full], axis=0)
        return out


class Marginals:
    """Log marginals of words, kept for the next part as long as their words are ``limit`` at most."""

    def __init__(self, pieces: Pieces, lp: np.ndarray, limit: int):
        self.pieces, self.lp, self.limit = pieces, lp, limit
        self.words, self.values = pa.array([], pa.string()), np.empty((0, lp.shape[1]))

    def of(self, words: pa.Array) -> np.ndarray:
        known = pc.index_in(words, value_set=self.words)
        missing = np.asarray(pc.is_null(known))
        out = np.empty((len(words), self.lp.shape[1]))
        out[~missing] = self.values[np.asarray(known.drop_null())]
        new = words.filter(pa.array(missing))
        out[missing] = values = self.pieces.log_marginals(new, self.lp)
        short = np.asarray(pc.binary_length(new)) <= KEPT_BYTES
        if len(self.words) + len(new) > self.limit:
            self.words, self.values = pa.array([], pa.string()), np.empty((0, self.lp.shape[1]))
        if int(short.sum()) <= self.limit:
            self.words = pa.concat_arrays([self.words, new.filter(pa.array(short))])
            self.values = np.concatenate([self.values, values[short]])
        return out


def piece_counts(texts: DataFrame, path: str, by: str) -> DataFrame:
    """From ``by, text`` to ``by, piece, n``: how often each piece of the vocabulary's own segmentation occurs.

    Words are counted and segmented inside the task, in parts of bounded bytes, so no word is shuffled: what is, is at
    most the size of the piece vocabulary for each task and value of ``by``.
    """

    def count(batches):
        p = pieces(path)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            keys = batch.column(0)
            for key in pc.unique(keys).to_pylist():
                for _, part in common.text_parts(batch.column(1).filter(pc.equal(keys, key))):
                    words = Words(part)
                    found = p.segment(words.distinct.to_pylist())
                    lengths = np.fromiter(map(len, found), np.int64, len(found))
                    flat = np.fromiter(chain.from_iterable(found), np.int64, int(lengths.sum()))
                    weights = np.repeat(np.bincount(words.index, minlength=len(found)), lengths)
                    sums[key] = sums.get(key, 0) + np.bincount(flat, weights, p.size)
        for key, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=[by, "piece", "n"])
        common.give_back()

    return texts.select(by, "text").mapInArrow(count, f"`{by}` string, piece int, n long").groupBy(by, "piece").agg(F.sum("n").alias("n"))


def expected_counts(counts: DataFrame, path: str, lp: np.ndarray) -> np.ndarray:
    """Expected occurrences of pieces from ``word, c`` (counts over a corpus); one number a piece comes back."""
    sent = counts.sparkSession.sparkContext.broadcast(lp)

    def count(batches):
        p, total = pieces(path), np.zeros(len(sent.value))
        for batch in batches:
            weights = np.asarray(batch.column(1)).astype(np.float64)
            for at, words in common.text_parts(batch.column(0), 1 << 20):
                total += p.expected_counts(words, weights[at : at + len(words)], sent.value)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["piece", "n"])
        common.give_back()

    out = np.zeros(len(lp))
    for row in counts.select("word", "c").mapInArrow(count, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        out[row["piece"]] = row["n"]
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c`` over a column ``text``: words after lower-casing A to Z, counted per task before the shuffle."""
    words = texts.select(F.explode(common.ascii_words(common.ascii_lower(F.col("text")))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("c"))

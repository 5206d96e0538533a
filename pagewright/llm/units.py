"""Cutting texts where a byte-level pre-tokenizer can never match across, and what each distinct piece encodes to.

The public pattern lets only white-space runs and one leading space touch white space. A cut before a single space or
line feed, between two characters that are none, therefore never splits a match, nor does one before any space whose
left neighbour is not white space. Units are cut so, coded as numbers of distinct ones, split into pieces once each,
and the distinct pieces encoded once each; what a text encodes to is then put together by numbers.
"""

from __future__ import annotations

import os
import re
import string
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrays import Ragged

#: White space as either the tokenizers' or Python's patterns may see it; only ever makes units longer.
_SPACE_PAIR = re.compile(r"\s ")
#: Texts that are not cut at every single space and line feed: those with white space in a row or of other kinds.
_UNUSUAL = "[ \n\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　][ \n]|[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]"
#: A unit that starts with this stands as it is; others have lost a leading space, but for those that start with "\n".
RAW = "\x1f"
#: Marks that the pattern always parts from letters before them.
MARKS = string.punctuation
#: Letters below this are letters in every version of the standard that a library may follow.
SURE = "\u0530"
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: Characters that stand for bytes in a byte-level vocabulary: those that show for themselves, the rest from 256 on.
BYTE_CHARS = {b: chr(b) if b in _SHOWN else chr(256 + sum(c not in _SHOWN for c in range(b))) for b in range(256)}
SPACE = BYTE_CHARS[32]


def cut(text: str) -> list[str]:
    """Units of any text: cut before each space whose left neighbour is not white space."""
    parts = text.split(" ")
    units = [parts[0]]
    for part in parts[1:]:
        if units[-1][-1:].isspace() or not units[-1]:
            units[-1] += " " + part
        else:
            units.append(" " + part)
    return units


def units_of(texts: pa.Array, apart: bool) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts, in the form of ``RAW``, and the number of each text's; whole texts if not ``apart``."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not apart:
        return pc.binary_join_element_wise(pa.scalar(RAW), texts, ""), np.ones(len(texts), np.int64)
    odd = np.asarray(pc.match_substring_regex(texts, _UNUSUAL))
    plain = pc.if_else(pa.array(odd), "", texts)
    lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(RAW), pc.replace_substring(plain, "\n", " \n"), ""), " ")
    counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    units = lists.flatten()
    if odd.any():
        places = np.flatnonzero(odd)
        ends = np.cumsum(counts)
        parts, last = [], 0
        for i, text in zip(places.tolist(), texts.filter(pa.array(odd)).to_pylist()):
            found = [RAW + u for u in cut(text)]
            at = int(ends[i])
            parts += [units.slice(last, at - 1 - last), pa.array(found, pa.string())]
            counts[i], last = len(found), at
        units = pa.concat_arrays([*parts, units.slice(last)])
    return units, counts


def raw(unit: str) -> str:
    return unit[1:] if unit[:1] == RAW else unit if unit[:1] == "\n" else " " + unit


class Pieces:
    """What texts encode to, by their pieces; those of ``limit`` distinct pieces are kept for the next texts.

    ``split`` takes units to all their pieces and the number of each unit's; ``encode`` takes pieces to their ids.
    Pieces of ``first`` are known from the start and never forgotten.
    Pieces of more than ``LONGEST`` characters are never kept, so memory is bounded on any input.
    """

    LONGEST = 64

    def __init__(self, split, encode, limit: int = 300_000, first: tuple[pa.Array, Ragged] | None = None):
        self.split, self.encode_pieces, self.limit = split, encode, limit
        self.first = first or (pa.array([], pa.string()), Ragged(np.empty(0, np.int32), np.empty(0, np.int64)))
        self.forget()

    def forget(self) -> None:
        self.known, self.ids = self.first

    def distinct(self, texts: pa.Array, apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Numbers of units of each text, each unit's number, numbers of pieces of each, each piece's number, pieces."""
        units, counts = units_of(texts, apart)
        coded = units.dictionary_encode()
        pieces, sizes = self.split(coded.dictionary.to_pylist())
        found = pa.array(pieces, pa.string()).dictionary_encode()
        return counts, np.asarray(coded.indices), sizes, np.asarray(found.indices), found.dictionary

    def of_pieces(self, pieces: pa.Array) -> Ragged:
        """The ids of distinct pieces."""
        place = pc.index_in(pieces, value_set=self.known)
        missing = np.asarray(pc.is_null(place))
        new = pieces.filter(pa.array(missing))
        values = self.encode_pieces(new.to_pylist())
        index = np.empty(len(pieces), np.int64)
        index[~missing] = np.asarray(place.drop_null())
        index[missing] = len(self.known) + np.arange(len(new))
        both = self.ids + values
        out = both.take(index)
        short = np.asarray(pc.utf8_length(new)) <= self.LONGEST
        if len(self.known) + int(short.sum()) > self.limit:
            self.forget()
        if short.any() and len(self.known) + int(short.sum()) <= self.limit:
            self.known = pa.concat_arrays([self.known, new.filter(pa.array(short))])
            self.ids = self.ids + values.take(np.flatnonzero(short))
        return out

    def encode(self, texts: pa.Array, apart: bool) -> Ragged:
        """The ids of every text."""
        counts, unit, sizes, piece, pieces = self.distinct(texts, apart)
        return self.of_pieces(pieces).take(piece).joined(sizes).take(unit).joined(counts)


def library_tokenizer(path: str):
    """A tokenizer of the tokenizers library on one thread, as it is loaded."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def cuts_apart(path: str) -> bool:
    """Whether units may be encoded by themselves: only with the byte-level pre-tokenizer and no normalizer."""
    if path.endswith(".model"):
        return False
    import json

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
    plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) or not re.search(r"[^\w]", t["content"]) or not re.search(r"\w", t["content"]) for t in added)
    return spec.get("normalizer") is None and spec.get("post_processor") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and bool(pre.get("use_regex")) and plain


def split_letters(units: list[str]) -> tuple[list[str], np.ndarray]:
    """Units as pieces: a line feed, letters with their space, and the marks after them; any other unit as it is."""
    pieces: list[str] = []
    add, sizes = pieces.append, np.ones(len(units), np.int64)
    for k, unit in enumerate(units):
        if unit.isalpha() and unit.isascii():
            add(" " + unit)
            continue
        first = unit[:1]
        if first == "\n":
            head, rest = "", unit[1:]
        elif first == RAW:
            head = " " if unit[1:2] == " " else ""
            rest = unit[1 + len(head) :]
        else:
            head, rest = " ", unit
        core = rest.rstrip(MARKS)
        if core.isalpha() and (core.isascii() or max(core) < SURE):
            if first == "\n":
                add("\n")
            add(head + core)
            if len(core) < len(rest):
                add(rest[len(core) :])
            sizes[k] = (first == "\n") + 1 + (len(core) < len(rest))
        else:
            add(raw(unit))
    return pieces, sizes


def whole_units(units: list[str]) -> tuple[list[str], np.ndarray]:
    return list(map(raw, units)), np.ones(len(units), np.int64)


class Library:
    """Texts to ids by the tokenizers library, which encodes each distinct piece; whole texts where it must."""

    def __init__(self, path: str, limit: int = 300_000):
        self.tokenizer, self.apart = library_tokenizer(path), cuts_apart(path)
        self.pieces = Pieces(split_letters if self.apart else whole_units, self.encode_pieces, limit)

    def encode_pieces(self, pieces: list[str]) -> Ragged:
        """Letters, with or without a space, are one match of the pattern and go straight to the library's model."""
        tokenize, found, others = self.tokenizer.model.tokenize, [], []
        for k, piece in enumerate(pieces):
            letters = piece[1:] if piece[:1] == " " else piece
            if letters.isascii():
                if letters.isalpha() and self.apart:
                    found.append([x.id for x in tokenize(letters if letters is piece else SPACE + letters)])
                    continue
            elif self.apart and letters.isalpha() and max(letters) < SURE:
                found.append([x.id for x in tokenize(piece.encode().decode("latin-1").translate(BYTE_CHARS))])
                continue
            others.append(k)
            found.append(())
        if others:
            for k, encoding in zip(others, self.tokenizer.encode_batch_fast([pieces[k] for k in others], add_special_tokens=False)):
                found[k] = encoding.ids
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return Ragged(np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum())), lengths)

    def encode(self, texts: pa.Array) -> Ragged:
        return self.pieces.encode(texts, self.apart)


_libraries: dict[str, Library] = {}


def library(path: str) -> Library:
    """One for each file in a worker, over all its tasks; what it keeps is bounded."""
    if path not in _libraries:
        _libraries[path] = Library(path)
    return _libraries[path]

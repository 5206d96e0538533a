"""Each operator against a brute-force version, on small tables with nulls, ties, repeats, empty and long texts."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pagewright.llm import bpe, common, components, decontam, langid, lattice, lm, nearcopies, quality, queries, simhash, sstable, token_count, units, urlfilter, warc

VOCAB = P.path("piece_bpe_32k.model")
FR, EN = "le chat noir dort sur la table et la nuit tombe", "the black cat sleeps on the table and night falls"


def texts():
    rng = random.Random(5)
    vocab = [a + b for a in ("th", "an", "é", "re", "12", "ß") for b in ("e", "ing", ".", "ou", ",", "x")]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    long = prose(4000)
    copy = prose(120)
    near = copy.split()
    near[60] = "changed"
    return [
        None, "", " \n\t ", "A", "one two", copy, copy, " ".join(near), long, "ab" * 3000, "line one is here\nline one is here\n\nother",
        "a <|endoftext|> b", "  two  spaces \n x", "a b c d e f g h " * 8, prose(30) + " " + EN, FR + " " + FR, EN + "; " + EN, "###$$$ %%% &&&", "日本 語 x", prose(60), prose(61),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, [None, "en", "fr"][i % 3], None if i % 5 == 0 else f"s{i % 2}", len(t or ""), "x", i) for i, t in enumerate(texts())]
    rows.append(rows[5])  # a repeated row
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, fp int")
    return frame.repartition(3)


@pytest.fixture(scope="module")
def sf(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    docs.drop("n_tokens", "fp").write.parquet(f"{at}/documents.parquet")
    marks = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"
    spark.createDataFrame([(7, marks), (10, "the black cat"), (10, "the black cat"), (None, "night falls"), (4, None), (5, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    big = "x" * 1500
    pages = [(1, "http://a.com/en/1", big), (2, "https://B.example.com/en/7?q=1", big), (None, None, big), (4, "no scheme", "small"), (5, "http://x.org/es/", "small"), (6, "ftp://u.net/de/9#f", None), (6, "ftp://u.net/de/9#f", None), (2, "http://evilcom/en/", big)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark", "pages"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    return at


def documents(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def key(row):
    return [(x is not None, x) for x in row]


def same(found, expected):
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, expected), key=key)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ws_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_op1(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    expected = []
    for page, _, html in pages:
        data = (html or "").encode()
        group = [p for p, _, h in pages if (h or "").encode() == data and p is not None]
        first = max(group) if len(data) >= 1000 and sum((h or "").encode() == data for _, _, h in pages) > 1 and group else None
        refers = first if first is not None and (page is None or page < first) else None
        expected.append((page, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    same(queries.QUERIES["op1_warc_roundtrip"](spark, sf).collect(), expected)


def test_warc_reads_selected_ranges(spark, sf):
    index = warc.write_archives(spark.read.parquet(f"{sf}/pages.parquet"), archive_bytes=600)
    assert index.select("file").distinct().count() > 1
    reads = warc.read_records(index, task_bytes=200)
    assert reads.rdd.getNumPartitions() == index.count() == reads.count() > 4  # more bytes than that many tasks hold
    one = warc.read_records(index.where("url like '%x.org%'")).collect()
    assert [(r.page_id, bytes(r.payload)) for r in one] == [(5, b"small")]
    assert list(warc.ranges([("a", 0, 5), ("a", 5, 5), ("a", 20, 1), ("b", 0, 2)], 100)) == [("a", 0, 10, [(0, 5), (5, 5)]), ("a", 20, 1, [(20, 1)]), ("b", 0, 2, [(0, 2)])]


def test_warc_headers(spark, tmp_path):
    """An archive opens with its own record; a revisit tells the record, target and date of its response."""
    big, odd = "y" * 1200, "http://a.org/\x01 \n é"
    pages = spark.createDataFrame([(1, "http://a.org/1", big), (2, odd, big), (3, odd, "z")], "page_id long, url string, html string").coalesce(1)
    index = warc.write_archives(pages, f"file://{tmp_path}/w")
    assert {(r.page_id, r.url, r.refers_to) for r in warc.read_records(index).collect()} == {(1, "http://a.org/1", 2), (2, odd, None), (3, odd, None)}
    entries = sorted((r.file, r.offset, r.length) for r in index.collect())
    with common.open_input(entries[0][0]) as file:
        data = file.read()
    heads = [warc.parse_record(zlib.decompress(data[a : a + n], 31))[0] for _, a, n in entries]
    of = {h["x-page-id"]: h for h in heads}
    assert of["1"]["warc-refers-to"] == of["2"]["warc-record-id"] and of["1"]["warc-refers-to-target-uri"] == of["2"]["warc-target-uri"] and of["1"]["warc-refers-to-date"] == of["2"]["warc-date"]
    assert b"WARC-Type: warcinfo" in zlib.decompressobj(31).decompress(data) and entries[0][1] > 0


def features(text):
    words, seen, dup = ws_words(text), set(), 0
    for line in (text or "").split("\n"):
        if ws_words(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_op2(spark, sf):
    out = queries.QUERIES["op2_host_quality"](spark, sf).collect()
    same([tuple(r)[:7] for r in out], [(d, *features(t)) for d, t in documents(spark, sf)])
    assert all(not (r.kept and r.base_failed) for r in out)


def test_host_verdicts(spark):
    good = " ".join(f"word{i}" for i in range(40))
    odd = " ".join(f"w#{i}#" for i in range(40))
    rows = [(i, good, "clean") for i in range(60)] + [(100, odd, "clean")] + [(200 + i, "x", "spam") for i in range(60)] + [(300, good, "spam"), (400, good, None)]
    kept = {r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert kept == {*range(60), 100, 400}  # the odd one is forgiven on a clean host; a good one goes with its host


def test_op3(spark, sf):
    tokenizer = units.library_tokenizer(P.path("byte_bpe_50k.json"))
    rows = sorted(((d, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in documents(spark, sf)), key=lambda r: (r[0] is not None, r[0] or 0))
    out = queries.QUERIES["op3_token_sstable"](spark, sf).collect()
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in out], [(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in rows])
    at = 0
    starts = {}
    for d, ids in rows:
        starts.setdefault(d, set()).add(at)
        at += len(ids)
    assert all(r.start in starts[r.doc_id] for r in out) and len({r.start for r in out}) == len(out)


def test_sstable_lookup(tmp_path):
    with open(tmp_path / "s", "wb") as file:
        writer = sstable.Writer(file, 2)
        rows = [(None, [1]), (-5, [2, 3]), (0, []), *((i, [i % 60000] * 40) for i in range(3, 9000, 3)), (8997, [7])]
        for d, ids in rows:
            writer.add(sstable.key_of(d), np.array(ids, "<u2").tobytes())
        writer.close()
    with open(tmp_path / "s", "rb") as file:
        reader = sstable.Reader(file)
        assert len(reader.blocks) > 2 and reader.n_docs == len(rows)
        assert [(sstable.id_of(k), len(v) // 2) for k, v in reader.scan()] == [(d, len(i)) for d, i in rows]
        assert [x.tolist() for x in reader.get(-5)] == [[2, 3]] and reader.get(4) == [] and reader.get(None)[0].tolist() == [1]
        assert [len(x) for x in reader.get(8997)] == [40, 1]


def test_op4(spark, sf):
    docs = documents(spark, sf)
    tokens = lambda t: ws_words(lower(t)) + [None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    count = Counter(w for d, t in docs if not held(d) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    out = lm.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), VOCAB, head_words=5).collect()
    expected = [(d, held(d), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for d, t in docs]
    same([(*tuple(r)[:5], round(r.base_score, 6)) for r in out], expected)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def segmentations(p, word):
    """All ways to write a word, as lists of piece numbers; a character that is no piece goes as its bytes."""
    if not word:
        yield []
    for k in range(1, min(len(word), p.longest) + 1):
        head = [p.number[word[:k]]] if word[:k] in p.number else [p.byte[b] for b in word[0].encode()] if k == 1 else None
        if head is not None:
            yield from (head + rest for rest in segmentations(p, word[k:]))


def test_lattice_against_all_segmentations():
    p = lattice.pieces(VOCAB)
    rng = random.Random(1)
    lp = np.array([-rng.random() * 9 - 1 for _ in range(p.size)])
    words = ["the", "thereon", "ß🙂x", "a", "thing.", "the", "▁x", "internatio"]
    counts = np.array([2, 1, 3, 1, 1, 5, 1, 2], float)
    both = p.log_marginals(pa.array(words), np.stack([lp, lp - 1], 1))
    expected = np.zeros(p.size)
    for word, n, found in zip(words, counts, both):
        ways = list(segmentations(p, lattice.MARK + word))
        weights = np.exp([sum(lp[i] for i in way) for way in ways])
        assert math.isclose(found[0], math.log(weights.sum()), rel_tol=1e-9)
        assert math.isclose(found[1], math.log(sum(math.exp(sum(lp[i] - 1 for i in way)) for way in ways)), rel_tol=1e-9)
        for way, weight in zip(ways, weights / weights.sum()):
            for i in way:
                expected[i] += n * weight
    assert np.allclose(p.expected_counts(pa.array(words), counts, lp), expected, rtol=1e-9)


def test_lattice_of_long_words():
    """One model or many, one word or a stretch of many, mixed lengths: the same sums."""
    p = lattice.pieces(VOCAB)
    rng = np.random.default_rng(2)
    lp = np.log(rng.dirichlet(np.ones(p.size), 9).T)
    words = ["ab" * 3000, "x" * 40, "日本語" * 30, "thing" * 9, "a"] + ["word" * k for k in range(1, 30)]
    whole = p.log_marginals(pa.array(words), lp)
    for i, word in enumerate(words):
        a = [np.zeros(9)]
        text = lattice.MARK + word
        for j in range(1, len(text) + 1):
            terms = [a[i] + (lp[p.number[text[i:j]]] if text[i:j] in p.number else sum(lp[p.byte[b]] for b in text[i].encode())) for i in range(max(0, j - p.longest), j) if text[i:j] in p.number or i == j - 1]
            a.append(np.logaddexp.reduce(terms))
        assert np.allclose(whole[i], a[-1], rtol=1e-9)
    assert np.allclose(p.log_marginals(pa.array(words), lp[:, :1])[:, 0], whole[:, 0], rtol=1e-12)
    counts = p.expected_counts(pa.array(words), np.ones(len(words)), lp[:, 0])
    lengths = {k: len(piece) for piece, k in p.number.items()}
    assert math.isclose(sum(counts[k] * n for k, n in lengths.items()), sum(len(w) + 1 for w in words), rel_tol=1e-6)


def test_words_of_texts():
    cases = [" a  b\n", None, "", " ", "A b\x0bc\x0cd\re\x1cf É", "\u3000x y"]
    words = lattice.Words(pa.array(["skipped", *cases]).slice(1))
    found = [[words.distinct[i].as_py() for i in words.index[a:b].tolist()] for a, b in zip(words.bounds, words.bounds[1:])]
    assert found == [ws_words(lower(t)) for t in cases]
    assert [len(x) for _, x in common.text_parts(pa.array(["aaaa", "b", None, "c" * 9, "d"]), 5)] == [3, 1, 1]


def test_lattice_score_of_documents(spark, sf):
    """The whole score from the parts that its docstring names."""
    docs = documents(spark, sf)
    p = lattice.pieces(VOCAB)
    train = [ws_words(lower(t)) for d, t in docs if not (d is not None and zlib.crc32(str(d).encode()) % 10 == 0)]
    seen = Counter(w for words in train for w in words)
    lp = p.own_scores()
    for _ in range(2):
        n = p.expected_counts(pa.array(list(seen), pa.string()), np.array(list(seen.values()), float), lp)
        weights = np.where(p.usable, n + 0.1, 0)
        total = weights.sum() + len(train) + 0.1
        with np.errstate(divide="ignore"):
            lp = np.log(weights / total)
    value = lambda t: p.log_marginals(pa.array(ws_words(lower(t)), pa.string()), lp[:, None]).sum()
    expected = [(d, round((value(t) + math.log((len(train) + 0.1) / total)) / math.log(10), 5)) for d, t in docs]
    same([(r.doc_id, round(r.score, 5)) for r in queries.QUERIES["op4_lattice_score"](spark, sf).collect()], expected)


def test_scores_of_frequent_long_words(spark):
    """Words longer than the join's keys, frequent and rare, known and not, against counts."""
    long, rare = "=" * 300, "x" * 80
    rows = [(i, f"{long} a b{i} {long}" + (f" {rare}" if i == 3 else "")) for i in range(40)]
    count = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in t.split() + [None])
    n, v = sum(count.values()), len(count)
    docs = spark.createDataFrame(rows, "`doc.id` long, `te.xt` string")
    for head in (0, 1, 2, 1000):
        out = lm.score_documents(docs, VOCAB, id_col="doc.id", text_col="te.xt", head_words=head).collect()
        expected = [(i, sum(count[w] > 0 for w in t.split() + [None]), round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t.split() + [None]), 6)) for i, t in rows]
        same([(r.doc_id, r.n_known, round(r.base_score, 6)) for r in out], expected)


def test_op5(spark, sf, docs):
    tokenizer = units.library_tokenizer(P.path("byte_bpe_50k.json"))
    count = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    same(queries.QUERIES["op5_token_counts"](spark, sf).collect(), [(d, len((t or "").encode()), count(t), count(t) > 512) for d, t in documents(spark, sf)])
    import sentencepiece

    words = units.library_tokenizer(P.path("word_bpe_49k.json"))
    model = sentencepiece.SentencePieceProcessor(model_file=VOCAB)
    for file, number in (("word_bpe_49k.json", lambda t: len(words.encode(t, add_special_tokens=False).ids)), ("piece_bpe_32k.model", lambda t: len(model.encode(t)))):
        out = token_count.token_counts(docs, P.path(file), table_rows=3)
        same([(r.text, r.n_tokens) for r in out.collect()], [(r.text, number(r.text or "")) for r in docs.collect()])
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp", "n_tokens"]


PARTS = [" ", "  ", "\n", "a", "the", "é", "1", ".", "'s", "\t", "\xa0", "\u3000", "\x1c", "\x1f", "日本", "<|endoftext|>", "\r\n", "🙂", "\u0301", "\x00", "x" * 70, "word", "aaaa", " foo", "\n\n", "ΑΒΓ", "'", "'t", "\x85", "\u2028"]


@pytest.mark.parametrize("limit", [3, 50, 300_000])
def test_units_never_change_ids(limit):
    """Random texts of awkward parts through both encoders, with caches that overflow, against the libraries."""
    import tiktoken

    rng, library = random.Random(2), units.Library(P.path("byte_bpe_50k.json"), limit)
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, bpe.table_of(P.path("byte_bpe_50k.tiktoken")), P.PATTERN, limit)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + [None, ""]
    for at in range(0, len(texts), 100):
        part = pa.array(texts[at : at + 100], pa.string())
        for lists, encode in ((library.encode(part), lambda t: library.tokenizer.encode(t, add_special_tokens=False).ids), (codec.encode(part), public.encode_ordinary)):
            ends = np.cumsum(lists.lengths)
            assert [lists.flat[b - n : b].tolist() for b, n in zip(ends, lists.lengths)] == [encode(t or "") for t in part.to_pylist()]


def test_shards_of_string_and_hot_identifiers(spark):
    rows = [(f"k{'x' * (i % 5)}{i % 40}", f"text number {i} " * (1 + i % 7)) for i in range(300)] + [("hot", f"t{i}") for i in range(400)] + [(None, "n")]
    docs = spark.createDataFrame(rows, "`doc.id` string, `te.xt` string").repartition(4)
    manifest = sstable.write_shards(docs, P.path("byte_bpe_50k.json"), 2, id_col="doc.id", text_col="te.xt", shard_bytes=600, parts=7)
    assert manifest.select("part").distinct().count() > 4
    back = sstable.read_shards(manifest, "string").orderBy("start").collect()
    tokenizer = units.library_tokenizer(P.path("byte_bpe_50k.json"))
    found = [(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in back]
    same(found, [(d, tuple(tokenizer.encode(t, add_special_tokens=False).ids + [2])) for d, t in rows])
    assert [d for d, _ in found] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))


def test_op6_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()
    langs = {r.doc_id: r.lang for r in docs}
    out = [r for r in queries.QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").collect() if r.held_out and r.lang_pred != "und"]
    assert len(out) > 200 and np.mean([langs[r.doc_id] == r.lang_pred for r in out]) > 0.97


def languages(docs):
    """language, score and strangeness of (doc_id, text, lang) rows by plain recursion over segmentations."""
    p = lattice.pieces(VOCAB)
    lengths = {k: len(piece.lstrip(lattice.MARK)) for piece, k in p.number.items()}
    train = [(t, lang) for d, t, lang in docs if not held_out(d) and t is not None and lang is not None]
    langs, lp, rate = sorted({lang for _, lang in train}), {}, {}
    for lang in langs:
        n = np.where(p.usable, 0.1, 0.0)
        ids = [i for t, of in train if of == lang for word in p.segment(ws_words(lower(t))) for i in word]
        np.add.at(n, ids, 1)
        with np.errstate(divide="ignore"):
            lp[lang] = np.log(n / n.sum())
        rate[lang] = sum(lp[lang][i] for i in ids if p.usable[i]) / max(1, sum(lengths.get(i, 1) for i in ids))
    out = []
    for d, t, _ in docs:
        if not any(map(str.isalpha, t or "")) or not langs:
            out.append((d, held_out(d), "und", 0.0, 0.0))
            continue
        words = pa.array(ws_words(lower(t)), pa.string())
        plain = np.array([p.log_marginals(words, lp[lang][:, None]).sum() for lang in langs])
        total = plain + [math.log(sum(of == lang for _, of in train) / len(train)) for lang in langs]
        k = int(total.argmax())
        out.append((d, held_out(d), langs[k], round(1 / math.fsum(np.exp(total - total[k])), 6), plain.max() / sum(map(len, ws_words(t))) / rate[langs[k]]))
    return out


def held_out(d):
    return d is not None and zlib.crc32(str(d).encode()) % 4 == 2


def test_op6(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    found = queries.QUERIES["op6_language_id"](spark, sf).collect()
    same([(r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in found], [r[:4] for r in languages(docs)])


def test_language_sample_keeps_rare_ones():
    assert langid.share_of({"a": 900, "b": 90, "c": 10}, 200) == {"a": 100 / 900, "b": 1.0, "c": 1.0}
    assert langid.share_of({"a": 3}, 5) == {"a": 1.0} and langid.share_of({}, 5) == {}


def test_strange_texts_go(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(EN.split()) for _ in range(30)), "en") for i in range(80)] + [(100 + i, " ".join(rng.choice(FR.split()) for _ in range(30)), "fr") for i in range(80)]
    rows += [(500, "Съешь же ещё этих мягких французских булок да выпей чаю", None)]
    kept = {r.doc_id for r in langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), VOCAB).collect()}
    assert kept == {r[0] for r in rows} - {500}


def test_op7(spark, sf, docs):
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = [(d, len(i := library.encode_ordinary(t or "")), sha(" ".join(map(str, i)).encode()), sha((t or "").encode())) for d, t in documents(spark, sf)]
    same(queries.QUERIES["op7_byte_bpe"](spark, sf).collect(), expected)
    out = bpe.bpe_encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect()
    assert all(r.token_ids == library.encode_ordinary(r.text or "") for r in out)


@pytest.mark.parametrize("many,rising", [(1, True), (3, True), (20, True), (20, False)])
def test_bpe_merge_on_random_bytes(monkeypatch, many, rising):
    import tiktoken

    rng = random.Random(3)
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["a" * 5000, "ab" * 2000, "aab" * 999, *("".join(rng.choice("aethion.,é ") for _ in range(rng.randint(0, 300))) for _ in range(300))]
    monkeypatch.setattr(bpe, "MANY", many)
    codec = bpe.Codec(ranks, bpe.table_of(P.path("byte_bpe_50k.tiktoken")) if rising else None, P.PATTERN)
    lists = codec.encode(pa.array(texts))
    ends = np.cumsum(lists.lengths)
    assert [lists.flat[b - n : b].tolist() for b, n in zip(ends, lists.lengths)] == list(map(library.encode_ordinary, texts))
    assert codec.decode(lists) == [t.encode() for t in texts]
    assert not codec.merger.queue.buckets and not any(codec.merger.queue.low) and not codec.merger.queue.top


def test_ranks_that_fall():
    """A table where a merge brings up a lower rank: no table of rising merges, and the order of single steps."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 400, b"abc": 300, b"abcd": 500, b"da": 450}
    assert bpe.merge_table(ranks) is None
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    pieces = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 40))) for _ in range(400)]
    lists = bpe.Merger(ranks, None).encode([p.encode() for p in pieces])
    ends = np.cumsum(lists.lengths)
    assert [lists.flat[b - n : b].tolist() for b, n in zip(ends, lists.lengths)] == [library.encode_ordinary(p) for p in pieces]


def test_op8(spark, sf):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    expected = []
    for d, t in documents(spark, sf):
        w, hit, of = words(t), set(), set()
        for item, text in items:
            b = words(text)
            n = min(13, len(b))
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    of |= {str(item)} if item is not None else set()
        expected.append((d, len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    same(queries.QUERIES["op8_decontamination"](spark, sf).collect(), expected)
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = [tuple(r)[1:] for r in decontam.contamination(docs, bench).select("__row.doc_id", "n_words", "spans", "items").collect()]
    many = [tuple(r)[1:] for r in decontam.contamination(docs, bench, block_words=3).select("__row.doc_id", "n_words", "spans", "items").collect()]
    assert sorted(map(str, one)) == sorted(map(str, many)) and len(list(decontam.blocks(bench, "item_id", "text", 13, 3))) > 2


def test_excise():
    assert decontam.excise("One, two THREE four é five.", [(1, 3)]) == "One,  four é five."
    assert decontam.excise("a b", [(0, 2)]) == ""


def test_op9(spark, sf):
    def rule(host, path):
        fits = [(len(h) + len(p), h + p, k) for k, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    expected = []
    for page, url in pages:
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        expected.append((page, lower(host), path, *rule(lower(host), path)))
    out = queries.QUERIES["op9_url_rules"](spark, sf).collect()
    same([(r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in out], expected)
    assert {r.verdict for r in out} <= {"allow", "block"}


def test_fp_rules_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"http://{rng.choice(['a', 'b'])}.{rng.choice(['spam', 'fine'])}.com/{rng.choice(['x', 'y'])}/{i}?k=1",) for i in range(120)]
    rows = [(u, "spam" in u and "/x/" in u) for (u,) in rows]
    labels = spark.createDataFrame(rows, "url string, blocked boolean")
    urls = spark.createDataFrame([(u,) for u, _ in rows] + [("http://new.spam.com/x/9",), ("http://q.fine.com/x/",), (None,)], "url string")
    out = urlfilter.judge(urls, rules=(), labels=labels, min_confidence=0.9)
    for r in out.select("__row.url", "verdict").collect():
        assert (r.verdict == "block") == bool(r.url and "spam" in r.url and "/x/" in r.url)


def url_tokens(url):
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    path, query = re.match(r"([^?#]*)\??([^#]*)", rest[len(host) :]).groups()
    labels = lower(host).split(".")
    found = {"h:" + ".".join(labels[i:]) for i in range(len(labels))} if host else set()
    found |= {f"p{i}:{x}" for i, x in enumerate(x for x in re.sub("[0-9]+", "#", path).split("/") if x)}
    return found | {"q:" + q.split("=")[0] for q in query.split("&") if q}


def test_op9_verdicts_against_all_combinations(spark, tmp_path):
    """Every verdict from every combination of tokens, counted one by one; other folders of a domain stay allowed."""
    rng = random.Random(11)
    hosts = ["a.example.com", "example.com", "b.org", "c.b.org", "x.de", "evil.net"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'de'])}/{rng.randrange(90)}" + rng.choice(["", "?q=1", "?q=1&r=2"]) for _ in range(400)] + [None, "none", "http://only.org"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    out = queries.QUERIES["op9_url_rules"](spark, str(tmp_path)).collect()
    ruled = {r.page_id: r.verdict for r in out if r.rule}
    baskets = [(url_tokens(u), ruled.get(i) == "block") for i, u in enumerate(urls)]
    n, b = Counter(), Counter()
    for found, blocked in baskets:
        for k in range(1, len(found) + 1):
            for c in itertools.combinations(sorted(found), k):
                n[c] += 1
                b[c] += blocked
    total = sum(bool(found) or blocked for found, blocked in baskets)
    rules = [set(c) for c in n if b[c] >= max(1, 0.01 * total) and b[c] >= 0.85 * n[c]]
    assert rules
    for r in out:
        if not r.rule:
            assert (r.verdict == "block") == any(rule <= url_tokens(urls[r.page_id]) for rule in rules)
    assert all(r.verdict == "allow" for r in out if r.host.endswith("b.org") and not r.path.startswith("/es/"))


def print_of(text):
    w = ws_words(lower(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints):
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    return root


def test_op10(spark, sf):
    docs = documents(spark, sf)
    prints = [print_of(t) for _, t in docs]
    root = groups(prints)
    ids = {r: min((d for (d, _), x in zip(docs, root) if x == r and d is not None), default=None) for r in set(root)}
    same(queries.QUERIES["op10_simhash_golay"](spark, sf).collect(), [(d, f"{p:016x}", ids[r]) for (d, _), p, r in zip(docs, prints, root)])


def test_golay_keys_meet():
    rng = random.Random(6)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        rows, keys = simhash.fuzzy_keys(np.array([a, b], np.uint64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])
    words = simhash.golay_codewords()
    assert min(int(x).bit_count() for x in words[1:]) == 8


@pytest.mark.parametrize("block", [5, 40, 2048])
def test_links_of_dense_groups(spark, block):
    """Blocks of heavy keys lose no component, however small they are."""
    rng, prints = random.Random(7), set()
    for centre in [rng.getrandbits(64) for _ in range(8)]:
        chain = centre
        for _ in range(60):
            chain ^= 1 << rng.randrange(64) if rng.random() < 0.7 else 0
            prints.add(chain ^ (1 << rng.randrange(64)))
    prints = sorted(prints)
    nodes = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    found = components.components(simhash.find_links(nodes, block=block)).collect()
    root = {r.node: r.root for r in found}
    brute = groups(prints)
    mine = [root.get(int(np.uint64(p).view(np.int64)), int(np.uint64(p).view(np.int64))) for p in prints]
    assert len(set(zip(mine, brute))) == len(set(mine)) == len(set(brute))


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2200)] + [(3, 3), (None, 4)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a int, b int")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert out == {x: find(x) for x in root}


def host_verdicts(rows):
    """Which of (text, host) rows the quality rules keep."""
    def excess(text):
        n, chars, symbols, dup, _, failed = features(text)
        lines = sum(bool(ws_words(x)) for x in (text or "").split("\n"))
        over = lambda a, b: a / b if b else 0.0
        return failed, max(over(3 * n, chars), over(chars, 12 * n), over(10 * symbols, n), over(10 * dup, 3 * lines))

    judged = [(*excess(t), h) for t, h in rows]
    n, f = Counter(h for *_, h in judged), Counter(h for failed, e, h in judged if failed or e > 1)
    total, mean = len(judged), sum(f.values()) / max(1, len(judged))
    spread = total - sum(x * x for x in n.values()) / max(1, total) - (len(n) - 1)
    strength = 1e6
    if 0 < mean < 1 and spread > 0:
        scatter = sum(n[h] * (f[h] / n[h] - mean) ** 2 for h in n) / (mean * (1 - mean))
        strength = 1 / min(max((scatter - (len(n) - 1)) / spread, 1e-6), 0.5) - 1
    rate = {h: (f[h] + mean * strength) / (n[h] + strength) for h in n}
    return [not failed and rate[h] < (1 + mean) / 2 and e <= (max(1.0, 2 * mean / rate[h]) if rate[h] else 1.0) for failed, e, h in judged]


def without_benchmark(rows, items):
    """Rows that stay after decontamination, their hit words cut out."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    grams = {tuple(b[i : i + min(13, len(b))]) for b in map(words, items) for i in range(len(b) - min(13, len(b)) + 1) if b}
    out = []
    for r in rows:
        w, hit = words(r["text"]), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
        if hit and 20 * len(hit) >= len(w):
            continue
        text = r["text"]
        if hit:
            runs = [k for k in sorted(hit) if k - 1 not in hit]
            text = decontam.excise(text, [(k, next(j for j in range(k, len(w) + 1) if j not in hit)) for k in runs])
        out.append({**r, "text": text, "n_chars": len(text) if hit else r["n_chars"]})
    return out


def test_pipeline(spark, sf):
    """Every stage's rows in full against brute force on what its predecessor kept."""
    import corpus_pipeline
    import tiktoken

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9000 + i, " ".join(f"{EN} number{i}{k}" for k in range(4)), "en", "s9", 1) for i in range(6)], docs.schema)
    docs = docs.unionByName(extra)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns = docs.columns
    rowset = lambda rows: [tuple(r[c] for c in columns) for r in rows]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        after = stage(spark, docs, sf)
        docs = common.materialize(after, "t")
        rows = [r.asDict() for r in docs.collect()]
        assert before
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            same(rowset(rows), rowset(r for r, kept in zip(before, host_verdicts([(r["text"], r["source"]) for r in before])) if kept))
        if k == 1:
            found = languages([(r["doc_id"], r["text"], r["lang"]) for r in before])
            same(rowset(rows), rowset(r for r, (_, _, lang, score, strange) in zip(before, found) if lang != "und" and score >= 0.5 and strange <= 2.5))
        if k == 2:
            root = list(range(len(before)))
            for i in range(len(before)):
                for j in range(i):
                    if similarity(before[i]["text"], before[j]["text"]) >= 0.8 and root[i] != root[j]:
                        old, new = max(root[i], root[j]), min(root[i], root[j])
                        root = [new if x == old else x for x in root]
            expected = [min((r["doc_id"] for r, x in zip(before, root) if x == g and r["doc_id"] is not None), default=None) for g in set(root)]
            same([(r["doc_id"],) for r in rows], [(d,) for d in expected])
            assert {tuple(r.values()) for r in rows} <= {tuple(r.values()) for r in before}
        if k == 3:
            same(rowset(rows), rowset(without_benchmark(before, items)))
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = [(r["doc_id"], len(i := library.encode_ordinary(r["text"])), sha(" ".join(map(str, i)).encode()), sha(r["text"].encode()), tuple(i)) for r in before]
    same([(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["token_ids"])) for r in rows], expected)


def test_pipeline_of_nothing(spark, sf, empty):
    """Every stage takes a table without rows, and one of nulls only."""
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0
    nulls = spark.read.parquet(f"{sf}/documents.parquet").limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in spark.read.parquet(f"{sf}/documents.parquet").schema.fields])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, nulls, sf).count() == (0, 0, 1, 3, 3)[k]


def test_stages_keep_extra_columns(spark, docs, sf):
    for stage in (quality.keep_good, lambda d: langid.keep_identified(d, VOCAB), simhash.keep_one, lambda d: decontam.decontaminate(d, spark.read.parquet(f"{sf}/benchmark.parquet"))):
        assert stage(docs).columns == docs.columns and stage(docs).count() <= docs.count()


def test_stages_bound_arrow_batches(spark, docs, sf):
    """What executor and worker hold of a batch is 8 MB, unless the caller has set a limit."""
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, expected in ((None, 8 << 20), (f"{1 << 20}b", 1 << 20)):
            for _, stage in corpus_pipeline.STAGES[2:]:
                spark.conf.set(name, given) if given else spark.conf.unset(name)
                stage(spark, docs.limit(0), sf)
                assert spark.conf.get(name) == f"{expected}b"
    finally:
        spark.conf.set(name, before)


def test_sql_of_queries(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as from read_parquet('{sf}/{t}.parquet/*.parquet')")
    for name, sql in queries.ORACLES.items():
        out = queries.QUERIES[name](spark, sf)
        rows = con.execute(sql)
        names = [c[0] for c in rows.description]
        assert sorted(names) == sorted(out.columns)
        same(out.select(*names).collect(), rows.fetchall())


def similarity(a, b):
    x, y = ({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (ws_words(lower(a)), ws_words(lower(b))))
    return len(x & y) / len(x | y)


def test_connect_leaves_no_link_out():
    """One run with many labels and similarities on both sides of the limit, against all pairs."""
    rng = random.Random(12)
    for _ in range(40):
        base = [rng.getrandbits(64) for _ in range(rng.randint(10, 60))]
        sets = [np.array(sorted({x if rng.random() > rate else rng.getrandbits(64) for x in base}), np.uint64) for rate in [rng.random() * 0.3 for _ in range(25)]]
        labels = np.array([rng.randrange(18) for _ in sets])
        sigs = np.zeros((25, nearcopies.HASHES), np.uint8)
        links = nearcopies.connect(np.arange(25), labels, sigs, np.concatenate(sets), np.array(list(map(len, sets))))

        def closed(pairs):
            root = labels.copy()
            for i, j in pairs:
                root[root == root[j]] = root[i]
            return {tuple(np.flatnonzero(root == r)) for r in root}

        good = [(i, j) for i in range(25) for j in range(i) if 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))]
        assert set(links) <= {p for i, j in good for p in ((i, j), (j, i))} and closed(links) == closed(good) and len(links) < 25


@pytest.mark.parametrize("block", [4, 2048])
def test_near_copies_by_shingles(spark, block):
    """Groups at a similarity of 0.8 against all pairs, most of them beyond four bits; blocks lose none."""
    rng, texts = random.Random(9), []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for edits in (0, 1, 2, 3, 4, 5, 7, 9):
            copy = list(base)
            for at in rng.sample(range(150), edits):
                copy[at] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    root = list(range(len(texts)))
    far = 0
    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                far += (print_of(texts[i]) ^ print_of(texts[j])).bit_count() > 4
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    assert far > 10
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = common.materialize(nearcopies.with_sketch(docs).withColumn("rid", F.monotonically_increasing_id()), "t")
    of = {r.node: r.root for r in nearcopies.node_groups(rows, block=block, block_bytes=block << 12).collect()}
    mine = {r.doc_id: of.get(r.node, r.node) for r in rows.select("__row.doc_id", "node").collect()}
    assert len({(mine[i], root[i]) for i in mine}) == len(set(mine.values())) == len(set(root))
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(root)


def edited(rng, n, edits):
    """Copies of a random text, each with some of its words replaced."""
    base = [f"w{rng.randrange(5000)}" for _ in range(n)]
    for count in edits:
        copy = list(base)
        for at in rng.sample(range(n), count):
            copy[at] = f"x{rng.randrange(5000)}"
        yield " ".join(copy)


@pytest.mark.parametrize("bucket", [3, 65536])
def test_near_copies_by_golay_keys(spark, bucket):
    """Pairs at 0.8 share a codeword within four of both segments of a table, by all codewords; split buckets lose no group."""
    rng = random.Random(13)
    texts = [t for _ in range(10) for t in edited(rng, 150, (0, 0, 2, 4, 5, 6))] + [None, "", "one two", "ONE  two"]
    words = simhash.golay_codewords()
    extended = lambda v: v << 1 | v.bit_count() & 1
    near = lambda v: {k for k in np.flatnonzero(np.bitwise_count(words ^ np.uint32(extended(v))) <= 4).tolist()}
    prints = [nearcopies.sketch(t)[1] for t in texts[:18]]
    keys = [[[near(int(v)) for v in pair] for pair in of] for of in nearcopies.segments(np.array([list(p) for p in prints], np.uint8))]
    root, far = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            if nearcopies.alike(texts[i], texts[j]):
                if i < 18:
                    far += prints[i] != prints[j]
                    assert any(all(a & b for a, b in zip(x, y)) for x, y in zip(keys[i], keys[j]))
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    assert far > 4
    root[-3] = root[-4]  # texts without words are one node
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = common.materialize(nearcopies.with_sketch(docs).withColumn("rid", F.monotonically_increasing_id()), "t")
    of = {r.node: r.root for r in nearcopies.node_groups(rows, bucket=bucket).collect()}
    mine = {r.doc_id: of.get(r.node, r.node) for r in rows.select("__row.doc_id", "node").collect()}
    assert len({(mine[i], root[i]) for i in mine}) == len(set(mine.values())) == len(set(root))


def test_bucket_forest_connects_all_candidates():
    """Runs below and beyond the sizes that are compared pair by pair: the components of all candidates, and no loop."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, (6, 2), np.uint64)
    for copies in (20, 150, 1300):
        of = np.concatenate([np.repeat(0, copies), rng.integers(1, 6, 40)])
        sigs = centres[of] ^ (np.uint64(1) << rng.integers(0, 63, (len(of), 2), np.uint64))
        x, y = nearcopies.bucket_forest(np.zeros(len(of), np.int64), np.where(of < 3, 77, 1234567), sigs)
        assert (of[x] == of[y]).all() and len(x) == len(of) - len(set(of))


def test_hot_template_keeps_support(spark):
    """A template of 15 tokens, with 2^15 - 1 antecedents of equal support, drives out no other rule."""
    hot = "http://a.b.c.spam.com/p/q/r/s/t/u/v?x=1&y=2&z=3"
    rows = [(hot, True)] * 400 + [(f"http://rare.org/bad/{i}", True) for i in range(30)] + [(f"http://rare.org/good/{i}", False) for i in range(570)]
    labels = spark.createDataFrame(rows, "url string, blocked boolean")
    urls = spark.createDataFrame([(hot,), ("http://rare.org/bad/x",), ("http://rare.org/good/x",)], "url string")
    out = urlfilter.judge(urls, rules=(), labels=labels)
    assert [r.verdict for r in out.orderBy("__row.url").collect()] == ["block", "block", "allow"]


def test_near_copies_move_few_rows(spark, monkeypatch):
    """A text has some 53 bucket rows, a group of copies tells a few rows a text, and a small group is settled without a
    join of its pairs with their texts."""
    rng = random.Random(21)
    for copies in (40, 200):
        texts = [t for k in range(2) for t in edited(rng, 200, [1] * (copies // 2))]
        prints = [nearcopies.sketch(t)[1] for t in texts]
        nodes = common.materialize(spark.createDataFrame(list(enumerate(prints)), "node long, print binary"), "t")
        rows = common.materialize(nearcopies.bucket_rows(nodes), "t")
        assert rows.count() <= 54 * copies
        told = nearcopies.run_pairs(rows, ["key"]).count()
        assert copies - 2 <= told <= 24 * copies

    def never(*_):
        raise AssertionError("texts were moved for each pair")

    monkeypatch.setattr(nearcopies, "verified", never)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {0, 100}


def test_large_groups_of_unlike_candidates(spark, monkeypatch):
    """Groups beyond a block whose forest holds pairs that are not alike: what it leaves apart meets again, none is lost."""
    monkeypatch.setattr(nearcopies, "NEAR", 60)
    rng = random.Random(22)
    texts = [t for _ in range(3) for t in edited(rng, 120, (0, 2, 3, 4, 5, 6, 8, 11, 14, 18))]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if nearcopies.alike(texts[i], texts[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    assert len(set(root)) > 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = common.materialize(nearcopies.with_sketch(docs).withColumn("rid", F.monotonically_increasing_id()), "t")
    of = {r.node: r.root for r in nearcopies.node_groups(rows, block=4).collect()}
    mine = {r.doc_id: of.get(r.node, r.node) for r in rows.select("__row.doc_id", "node").collect()}
    assert len({(mine[i], root[i]) for i in mine}) == len(set(mine.values())) == len(set(root))

"""Functions that plans and converters use in part only, on literal cases."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry, imaging, layout, page_tables, splice, text
from pagewright.operators import decode, glyphs, paged, scoring, suppress
from pagewright.sources import files, pages

BOX = "x0 double, y0 double, x1 double, y1 double"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_trim_takes_all_white_space(spark):
    rows = spark.createDataFrame([(c + "x" + c + "y" + c,) for c in sorted(layout.SPACES)] + [("",), (text.WHITE,), ("\u200bx\u200b",), ("\x1cx",), (None,)], "s string")
    again = F.regexp_replace("s", r"(?U)^\s+|\s+$", "")
    assert set(text.WHITE) == layout.SPACES and rows.where(~text.trim("s").eqNullSafe(again)).count() == 0


def test_parity_and_latency(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "only")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, None)], "k int, v string")
    assert tuple(scoring.parity(a, b, "k", "v").first()) == (3, 2)
    samples = spark.createDataFrame([("a", t) for t in (5.0, 1.0, 3.0, 9.0)], "name string, t double")
    assert tuple(scoring.latency(samples, ["name"], "t").first()) == ("a", 1.0, 5.0, 4.5)


def test_report(spark):
    scored = spark.createDataFrame([("p", 2, 3, 1, 1, 2, 0.5), (None, 0, 0, 0, 0, 0, None)], "paper string, n_expected int, n_found int, exact int, missing int, spurious int, rate double")
    assert [r.line for r in scoring.report(scored).collect()] == ["| p | 2 | 3 | 1 (50.0%) | 1 | 2 |", "| **Total** | 0 | 0 | 0 (—) | 0 | 0 |"]


def test_span_text(spark):
    rows = [(1, 0, 1, 0, " late "), (1, 0, 0, 1, "b"), (1, 0, 0, 0, "a"), (1, 1, 0, 0, None), (2, 0, 0, 0, "  ")]
    df = spark.createDataFrame(rows, "k int, block_num int, line_num int, span_num int, text string")
    assert {r.k: r.text for r in decode.span_text(df, ["k"]).collect()} == {1: "a b late", 2: ""}


def test_charsets(spark):
    chars = F.array(F.lit("a"), F.lit("b"))
    assert [one(spark, decode.aligned_charset(chars, F.lit(n))) for n in (2, 3, 4, 9)] == [["a", "b"], ["", "a", "b"], ["", "a", "b", " "], ["", "a", "b", " "]]
    assert one(spark, decode.structure_charset(F.array(F.lit("<tr>"), F.lit("<td>")))) == ["sos", "<tr>", "<td></td>", "eos"]
    assert one(spark, decode.structure_charset(F.array(F.lit("<td></td>"), F.lit("<td>")))) == ["sos", "<td></td>", "eos"]


def test_argmax(spark):
    values = F.array(*map(F.lit, (1.0, 3.0, 3.0, 2.0)))
    assert one(spark, decode.first_argmax(values)) == 1 and one(spark, decode.last_argmax(values, 7)) == 2
    assert one(spark, decode.last_argmax(F.array().cast("array<double>"), 7)) == 7


def test_boxes(spark):
    quad = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((3.0, 9.0), (1.0, 5.0), (8.0, 4.0))))
    assert tuple(one(spark, F.struct(*geometry.of_quad(quad)))) == (1.0, 4.0, 8.0, 9.0)
    box = geometry.from_center(F.lit(0.5), F.lit(0.25), F.lit(0.2), F.lit(0.1), F.lit(100.0), F.lit(200.0))
    assert np.allclose(list(one(spark, F.struct(*box))), [40, 40, 60, 60])
    soft = one(spark, geometry.softmax(F.array(*map(F.lit, (1.0, 2.0, 3.0)))))
    assert np.allclose(soft, np.exp([1, 2, 3]) / np.exp([1, 2, 3]).sum())


def test_usable_detections(spark):
    rows = [(1, 0, 0.9, -5.0, 10.0, 50.0, 300.0), (1, 0, 0.4, 0.0, 0.0, 9.0, 9.0), (1, 0, 0.8, 150.0, 0.0, 190.0, 50.0)]
    many = [(2, 0, 0.5 + i / 5000, 0.0, 0.0, 10.0, 10.0) for i in range(1200)]
    df = spark.createDataFrame(rows + many, f"doc_id long, page_no int, score double, {BOX}")
    out = suppress.usable(df, 100.0, 200.0).collect()
    assert [tuple(r)[3:] for r in out if r.doc_id == 1] == [(0.0, 10.0, 50.0, 200.0)]
    kept = [r.score for r in out if r.doc_id == 2]
    assert len(kept) == suppress.MAX_BOXES and min(kept) == pytest.approx(0.5 + 200 / 5000)


def test_tables_in_an_area(spark):
    tables = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (1, 0, 1, 50.0, 50.0, 60.0, 60.0), (1, 1, 2, 0.0, 0.0, 10.0, 10.0)], f"doc_id long, page_no int, table_no int, {BOX}")
    areas = spark.createDataFrame([(1, 0, 7, 5.0, 5.0, 50.0, 50.0)], f"doc_id long, page_no int, area_no int, {BOX}")
    assert [(r.area_no, r.table_no) for r in pages.tables_in(tables, areas).collect()] == [(7, 0)]


def test_quad_crop():
    image = np.zeros((20, 30, 3))
    image[5:9, 10:22] = 200
    crop = imaging.quad_crop(image, np.array([[10, 5], [22, 5], [22, 9], [10, 9]]))
    assert crop.shape == (4, 12, 3) and crop.min() > 150
    assert imaging.quad_crop(image, np.array([[10, 0], [14, 0], [14, 18], [10, 18]])).shape == (4, 18, 3)


def test_markdown_documents(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: Rope\n---\nbody")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.load_documents(files.scan(spark, str(tmp_path))).collect()}
    assert rows["a.md"].error is None and "Rope" in str(rows["a.md"].doc) and rows["b.md"].doc is None and rows["b.md"].error
    assert [r.text for r in files.read_text_leniently(files.scan(spark, str(tmp_path / "b.md"))).collect()] == [""]


def test_page_source_takes_wildcards(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.jsonl").write_text('{"doc_id": %d, "page_no": 0, "page_md": "x"}\n\n' % k)
    pages.register(spark)
    read = lambda path: sorted(r.doc_id for r in spark.read.format("pagewright_pages").option("path", path).load().collect())
    assert read(f"{tmp_path}/p*.jsonl") == [0, 1, 2] and read(f"file://{tmp_path}/p1.jsonl,{tmp_path}/p2.jsonl") == [1, 2]
    assert pages.matching(f"file://{tmp_path}/p[01].jsonl") == [f"{tmp_path}/p0.jsonl", f"{tmp_path}/p1.jsonl"]


def test_words_and_lines_of_a_page(spark):
    spots = [("a", 10.0), ("b", 18.0), (" ", 26.0), ("c", 34.0), ("d", 200.0)]
    rows = [(1, 0, k, ch, x, 700.0, 7.0, 11.0, "F") for k, (ch, x) in enumerate(spots)] + [(1, 0, 9, "e", 10.0, 650.0, None, None, "F")]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, glyph_no int, ch string, x double, y double, w double, h double, font string")
    whole = paged.paged(df)
    assert [(r.line_no, r.word_no, r.text) for r in paged.word_rows(whole, 792.0).orderBy("line_no", "word_no").collect()] == [(0, 0, "ab"), (0, 1, "c"), (1, 0, "ed")]
    assert [r.text for r in paged.line_rows(whole, 792.0).orderBy("line_no").collect()] == ["ab c", "ed"]
    assert paged.line_rows(whole.limit(0)).count() == 0


def test_text_pages_have_the_glyphs_of_their_lines(spark):
    texts = ["ab  c\n\n\td=∑x\r\n    code α\n" + "wört 𝛼 " * 40, "", "\n\n", None, "x" * 96 + "y\n" * 120]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = paged.pages_of_text(docs)
    assert whole.columns == ["doc_id", "page_no", "rows"]  # glyphs are never moved
    for pages in (whole, paged.gathered(whole)):
        made = paged.lined_glyphs(pages).drop("line_no")
        wanted = glyphs.from_text(docs).select(*made.columns)
        assert made.count() == wanted.count() and made.exceptAll(wanted).count() == 0


def test_owned_runs(spark):
    docs = spark.createDataFrame([(1, "abcdef\nxy")], "doc_id long, text string")
    regions = spark.createDataFrame([(1, 0, 0, 50.0, 80.0, 65.0, 93.0, "text"), (1, 0, 1, 66.0, 80.0, 80.0, 93.0, "text")], f"doc_id long, page_no int, region_no int, {BOX}, label string")
    runs = paged.owned_runs(paged.with_regions(paged.pages_of_text(docs), regions), height=792.0)
    assert [(r.line_no, r.owner, r.n, r.glyphs, r.x0, r.x1) for r in runs.orderBy("line_no", "x0").collect()] == [(0, 0, 2, 1, 50.0, 65.0), (0, 1, 2, 5, 66.0, 81.0), (0, None, 2, 9, 82.0, 97.0), (1, None, 2, 193, 50.0, 65.0)]


def test_text_pages_give_what_their_glyph_frames_give(spark):
    texts = ["∑∏∫√∂ = x\nplain e\n    code here\n\tmore", "    four\n" * 60 + "αβγδεζ  αβγδεζηθ", "none", "    two rows", "    of one key"]
    docs = spark.createDataFrame(list(zip((0, 1, 2, 3, 3), texts)), "doc_id long, text string")
    pages, frame = paged.pages_of_text(docs), glyphs.from_text(docs)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    signals = paged.page_sums(pages, "e").groupBy("doc_id", "page_no").sum("n_math", "n_chars").toDF("doc_id", "page_no", "n_math", "n_chars")
    assert same(signals, glyphs.page_signals(frame))
    assert same(paged.page_sums(paged.paged(frame)), paged.page_sums(paged.gathered(pages)))
    assert same(glyphs.fenced_runs(paged.code_runs(paged.gathered(pages))), glyphs.code_blocks(frame))
    clusters = glyphs.math_clusters(glyphs.top_down(frame))
    assert same(paged.math_clusters(paged.gathered(pages), height=792.0), clusters) and clusters.count() == 2


def test_lines_of_regions_go_to_the_owner_of_most(spark):
    docs = spark.createDataFrame([(1, "abcdefgh"), (2, "abcd")], "doc_id long, text string")
    regions = spark.createDataFrame([(1, 0, 0, 50.0, 80.0, 65.0, 93.0, "text"), (1, 0, 1, 66.0, 80.0, 105.0, 93.0, "text"), (2, 0, 0, 50.0, 80.0, 65.0, 93.0, "text"), (2, 0, 1, 66.0, 80.0, 81.0, 93.0, "formula")], f"doc_id long, page_no int, region_no int, {BOX}, label string")
    rows = paged.region_lines(paged.with_regions(paged.pages_of_text(docs), regions), height=792.0).orderBy("doc_id", "free").collect()
    assert [(r.doc_id, r.free, r.region_no, r.text) for r in rows] == [(1, False, 1, "abcdefg"), (1, True, None, "h"), (2, False, 1, "abcd")]


def test_places_of_words():
    plain, here, there = splice.normalized("  a\t\nbc \n d ")
    assert (plain, here, there) == ("a bc d", [0, 2, 5], [2, 5, 10])
    assert splice.place_images("x\n one\ttwo  three\nfour", [(0.0, 9.0, "x"), (10.0, 19.0, "two three")], [(1.0, 9.0, "i.png")]) == "x\n\n\n![](i.png)\n\n one\ttwo  three\nfour"


def test_links_at_the_threshold(spark):
    # opposite logits of vectors 4766 and 30230 of a table of 40,000: a half on average, but for the last digit
    logits = {1: (-0.0344, 0.0344), 2: (-0.001, 0.001), 3: (float("nan"), 0.0), 4: (None, 1.0), 5: (-900.0, 900.0)}
    both = [(v, 0, 1, a and a * 10, b * 3) for v, (a, b) in logits.items()] + [(v, 1, 0, b * 10, a and a * 3) for v, (a, b) in logits.items()]
    edges = spark.createDataFrame(both, "v long, i int, j int, l0 double, l1 double")
    objects = spark.createDataFrame([(v, *o) for v in logits for o in ((0, "table", "t", 0.0), (1, "table caption", "c", 0.0))], "v long, idx int, label string, text string, y0 double")
    assert sorted(r.v for r in decode.linked_text(edges, objects, ["v"]).collect()) == [2, 3, 5]


def test_cells_of_boxes(spark):
    cells = spark.createDataFrame([(1, 2, 10.0, 0.0, 20.0, 10.0), (1, 1, 10.0, 0.0, 20.0, 10.0), (1, 0, 0.0, 0.0, 10.0, 10.0)], f"k long, cell_no int, {BOX}")
    boxes = spark.createDataFrame([(1, "b", 12.0, 0.0, 18.0, 10.0), (1, "a", 8.0, 0.0, 12.0, 10.0), (1, "far", 90.0, 0.0, 99.0, 9.0), (1, "flat", 5.0, 5.0, 5.0, 5.0), (2, "alone", 0.0, 0.0, 9.0, 9.0)], f"k long, w string, {BOX}")
    taken = lambda df, *c: sorted(tuple(r[n] for n in ("w", "cell_no", *c)) for r in df.collect())
    matched = decode.match_cells(boxes, cells, ["k"])
    assert taken(matched) == [("a", 0), ("b", 1)] and matched.columns == ["k", "w", "x0", "y0", "x1", "y1", "cell_no"]
    assert taken(decode.slot_words(boxes, cells, ["k"]), "share") == [("a", 0, 0.5), ("b", 1, 1.0)]
    assert taken(decode.slot_words(boxes, cells, ["k"], unique=False)) == [("a", 0), ("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    assert taken(decode.slot_words(boxes, cells, ["k"], 0.6, forced=True)) == [("a", 0), ("b", 1), ("far", 0), ("flat", 0)]
    assert "MapInArrow" in matched._jdf.queryExecution().executedPlan().toString()  # pairs are not rated by interpreted lambdas


def test_slots_of_few_and_many_cells(monkeypatch):
    cells = [(10.0 * k, 0.0, 10.0 * k + 12, 10.0) for k in range(9)]
    words = [(x, 1.0, x + 7, 5.0) for x in (0.0, 8.0, 31.0, 82.0, 200.0)] + [(5.0, 5.0, 5.0, 5.0)]
    few = page_tables.slots(cells, words, 0.5)
    assert few[0] == [0, 1, 3, 8, None, None]
    monkeypatch.setattr(page_tables, "FEW", 0)
    assert page_tables.slots(cells, words, 0.5) == few
    assert page_tables.share_in([page_tables.Thing((0.0, 0.0, 10.0, 10.0)), page_tables.Thing((1.0, 1.0, 1.0, 9.0))], (5.0, 5.0, 9.0, 20.0)) == [0.2, 0.0]


def test_title_at_its_place(spark):
    md = F.lit("\n\nA title\nbody")
    assert one(spark, text.with_title(md, text.title_place(md))) == "\n\n# A title\nbody" == one(spark, text.promote_title(md))
    none = F.lit("1, 2, 3\n")
    assert one(spark, text.with_title(none, text.title_place(none))) == "1, 2, 3\n"


def test_source_tables_move_no_words(spark):
    from pagewright.plans import tables

    if os.path.isdir("/root/testdata/sf0.001"):
        plan = tables._source_tables(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan

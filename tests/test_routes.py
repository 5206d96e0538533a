"""Each route of a page end to end, with recognizers that are stubs: text in, Markdown out."""

import json

import pytest
from pyspark.sql import functions as F

from pagewright import pipeline
from pagewright.config import Config
from pagewright.models import Registry
from pagewright.sources import files

GLYPH = "doc_id long, page_no int, glyph_no int, ch string, x double, y double, w double, h double, font string"
PAGE = "doc_id long, page_no int, page_md string, n_images int"
REGION = "doc_id long, page_no int, region_no int, x0 double, y0 double, x1 double, y1 double, label string"
IMAGE = "doc_id long, page_no int, img_no int, x0 double, y0 double, x1 double, y1 double, src string"


def typed(lines, page_no=0, doc_id=1):
    """Glyphs, bottom-up, of (text, x, top, font) lines on one page."""
    spots = [(c, x + 8.0 * i, 792.0 - top - 11.0, font) for text, x, top, font in lines for i, c in enumerate(text) if c != " "]
    return [(doc_id, page_no, k, c, x, y, 7.0, 11.0, font) for k, (c, x, y, font) in enumerate(spots)]


def stub(**answers):
    """A registry of recognizers that answer each crop by a function of it."""

    def factory(answer):
        return lambda: lambda crops: [answer(c) for c in crops]

    return Registry(**{name: factory(answer) for name, answer in answers.items()})


def converted(spark, lines, config, models=None, page_md=None, **frames):
    glyphs = spark.createDataFrame(typed(lines), GLYPH)
    pages = spark.createDataFrame([(1, 0, page_md, 0)], PAGE)
    (doc,) = pipeline.Converter(spark, config, models).convert_pages(pages, glyphs, **frames).collect()
    return doc.md


PLAIN = {"promote_headings": False, "promote_title": False, "detect_code_blocks": False}


def test_fast_route_places_images(spark):
    images = spark.createDataFrame([(1, 0, 0, 50.0, 120.0, 90.0, 160.0, "a.png"), (1, 0, 1, 50.0, 120.0, 52.0, 122.0, "dot.png"), (1, 0, 2, None, None, None, None, "far.png")], IMAGE)
    lines = [("first line of the page", 50, 100, "Times"), ("second line of the page", 50, 200, "Times")]
    md = converted(spark, lines, Config(routing_mode="never", **PLAIN), images=images)
    assert md.index("first") < md.index("](a.png)") < md.index("second") < md.index("![](far.png)") and "dot.png" not in md
    assert "png" not in converted(spark, lines, Config(routing_mode="never", extract_images=False, **PLAIN), images=images)


def test_surgical_route(spark):
    asked = stub(formula=lambda c: {"latex": r"\frac{a}{b}" if 16 <= c["max_tokens"] <= 1024 and c["right"] > c["left"] and c["dpi"] == 200 else "wrong"})
    lines = [("before it", 50, 100, "Times"), ("E=mcc+x", 50, 150, "CMMI10"), ("after it", 50, 200, "Times")]
    md = converted(spark, lines, Config(routing_mode="surgical", **PLAIN), asked)
    assert md == "before it\n$\\frac{a}{b}$\nafter it"
    assert converted(spark, lines, Config(routing_mode="surgical", **PLAIN)) == "before it\nE=mcc+x\nafter it"
    broken = stub(formula=lambda c: {"latex": r"\frac{a}{b"})
    assert "frac" not in converted(spark, lines, Config(routing_mode="surgical", **PLAIN), broken)
    assert "$\\frac{a}{b$" in converted(spark, lines, Config(routing_mode="surgical", sanitize_ocr=False, **PLAIN), broken)


FULL = [("A heading here", 50, 50, "Times"), ("x+y", 50, 100, "CMMI10"), ("cell one two", 50, 150, "Times"), ("Figure 1: what it shows", 50, 300, "Times"), ("Lost footnote", 400, 700, "Times")]
AREAS = [(0, 40, 40, 300, 70, "paragraph_title"), (1, 40, 90, 300, 120, "display_formula"), (2, 40, 140, 300, 170, "table"), (3, 40, 200, 300, 290, "figure"), (4, 40, 295, 300, 320, "figure_caption"), (5, 40, 400, 300, 430, "text")]


def areas(spark, scale=300 / 72):
    return spark.createDataFrame([(1, 0, k, *(float(v) * scale for v in box), label) for k, *box, label in AREAS], REGION)


def test_full_route(spark):
    models = stub(formula=lambda c: {"latex": "x^{2} + y"}, table=lambda c: {"html": "<table><tr><td>h</td></tr><tr><td>v</td></tr></table>"}, ocr=lambda c: {"lines": [{"quad": [], "text": "read by sight", "confidence": 1.0}]})
    images = spark.createDataFrame([(1, 0, 7, 45.0, 205.0, 295.0, 285.0, "fig.png")], IMAGE)
    config = Config(routing_mode="always", render_gate_enabled=False, **PLAIN)
    md = converted(spark, FULL, config, models, regions=areas(spark), images=images)
    assert md.startswith("## A heading here\n\n$$\nx^{2} + y\n$$\n\ncell one two\n\n![Figure 1: what it shows](fig.png)\n\nFigure 1: what it shows\n\nread by sight") and md.endswith("Lost footnote")
    tables = spark.createDataFrame([(1, 0, 0, 45.0, 145.0, 290.0, 165.0, "| own |\n| --- |")], "doc_id long, page_no int, table_no int, x0 double, y0 double, x1 double, y1 double, md string")
    assert "| own |" in converted(spark, FULL, config, models, regions=areas(spark), tables=tables)
    plain = converted(spark, FULL, config, regions=areas(spark))
    assert "x+y" in plain and "read by sight" not in plain and "![" not in plain
    empty = [line for line in FULL if not line[0].startswith("cell")]
    assert "| h |\n| --- |\n| v |" in converted(spark, empty, config, models, regions=areas(spark)).replace("|h|", "| h |")


def test_layout_recognizer_and_page_tables(spark):
    box = lambda x0, y0, x1, y1, label, idx: {"idx": idx, "label": label, "score": 0.95, "x0": x0, "y0": y0, "x1": x1, "y1": y1}
    regions = [{"x0": 40.0 * 300 / 72, "y0": 140.0 * 300 / 72, "x1": 300.0 * 300 / 72, "y1": 170.0 * 300 / 72, "label": "text", "confidence": s} for s in (0.9, 0.8, 0.1)]
    models = stub(layout=lambda c: {"regions": regions if c["right"] > 2000 else []}, page_tables=lambda c: {"objects": [box(600.0, 600.0, 610.0, 610.0, "table", 0)], "edges": []})
    config = Config(routing_mode="always", render_gate_enabled=False, table_backend="auto", **PLAIN)
    md = converted(spark, FULL, config, models)
    assert md.startswith("cell one two") and md.count("cell one two") == 1 and "Lost footnote" in md


def test_render_gate(spark):
    words = " ".join(f"w{i}" for i in range(9))
    lines = [(f"{words} line{k}", 50, 60 + 20 * k, "Times") for k in range(5)] + [("x+y", 50, 300, "CMMI10")]
    regions = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 2400.0, 1150.0, "text"), (1, 0, 1, 0.0, 1200.0, 2400.0, 1400.0, "formula")], REGION)
    of = lambda seen: stub(formula=lambda c: {"latex": "x^{2}"}, ocr=lambda c: {"lines": [{"quad": [], "text": seen, "confidence": 1.0}]})
    other, same = of("nothing like the layer at all"), of(f"{words} line0 line1 line2 line3 line4")
    run = lambda models, **more: converted(spark, lines, Config(routing_mode="always", **PLAIN, **more), models, page_md="own text", regions=regions)
    assert run(other) == "own text" and run(other, render_gate_salvage_inline_math=True) == "own text\n\n$$\nx^{2}\n$$"
    assert "$$\nx^{2}\n$$" in run(same) and "own text" not in run(same) and "own text" not in run(other, render_gate_enabled=False)


def test_no_link_dangles(spark, tmp_path):
    """Links to images, pictures of packages and sheets: each has its file, once, where the link points to."""
    import re

    from tests_support import BOOK, WORD_WITH_PICTURES

    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for name, data in {"note.txt": b"![x](pic.png) ![again](pic.png) ![none](missing.png)", "pic.png": b"PNG", "w.docx": WORD_WITH_PICTURES, "book.xlsx": BOOK}.items():
        (source / name).write_bytes(data)
    docs, kept = pipeline.Converter(spark).ingest_with_assets(files.scan(spark, str(source)), str(out))
    wrote = {r.path: r.n_bytes for r in pipeline.write_files(kept).collect()}
    rows = {r.path.rsplit("/", 1)[1]: r for r in docs.collect() if r.error is None}
    ids = re.findall(r"okf-asset://(img_[0-9a-f]{16})", rows["note.txt"].md)
    assert len(ids) == 2 and all((out / "_assets" / f"{i}.png").read_bytes() == b"PNG" for i in ids) and "(missing.png)" in rows["note.txt"].md
    shown = re.findall(r"!\[(.*?)\]\((assets/office/[^)]+)\)", rows["w.docx"].md)
    assert [alt for alt, _ in shown] == ["second shown first", "image1"] and [(out / path).read_bytes() for _, path in shown] == [b"two", b"one"]
    assert rows["book.xlsx"].data_files == ["book.Da_ta.csv", "book.json"] and json.loads((out / "book.json").read_text())["sheets"] and rows["note.txt"].data_files == []
    assert set(wrote) == {str(p) for p in out.rglob("*") if p.is_file()}


def test_recognize_formula(spark):
    crops = spark.createDataFrame([(1,)], "doc_id long").withColumn("crop", F.struct("doc_id"))
    rows = pipeline.Converter(spark, None, stub(formula=lambda c: {"latex": r"\inL"})).recognize_formula(crops).collect()
    assert rows[0].latex == r"\in L"
    with pytest.raises(Exception):
        pipeline.Converter(spark).recognize_formula(crops)

"""Files to documents: dispatch, failures as rows, workbooks, staging, page sources, streams, recognizers."""

import json

import pytest
from pyspark.sql import functions as F

from pagewright import pipeline
from pagewright.errors import ModelNotAvailable, SourceError, UnsupportedFormat
from pagewright.models import Registry
from pagewright.sources import files, office, pages
from pagewright.streaming import ingest
from tests_support import BOOK, WORD


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    made = {"My Note.txt": b"hello\n![x](pic.png)\n", "sub/deep.MD": "# ü\n".encode(), "bad.txt": b"\xff\xfe\xfa text", "null.txt": b"a\0b", "book.xlsx": BOOK, "w.docx": WORD, "broken.docx": b"no zip", "old.doc": b"x", "art.xml": b"<article><front/></article>", "not.xml": b"<p/>", "pic.png": b"PNG", "skip.exe": b"x"}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_directory(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    docs = pipeline.Converter(spark).convert_directory(str(folder), str(out))
    rows = {r.path.rsplit("/", 1)[1]: r for r in docs.collect()}
    assert "skip.exe" not in rows and rows["deep.MD"].md == "# ü\n" and rows["art.xml"].md == "# \n"
    assert rows["My Note.txt"].n_images == 1 and "okf-asset://img_" in rows["My Note.txt"].md
    assert {n for n, r in rows.items() if r.error} >= {"bad.txt", "null.txt", "broken.docx", "old.doc", "not.xml"}
    assert rows["w.docx"].md == "## Head\n\ntext\n\n| a\\|b |\n| --- |\n" and rows["book.xlsx"].md.startswith("## Da/ta\n\n| name |  | a,\"b\" |")
    assert pipeline.write_markdown(docs).count() == sum(r.error is None for r in rows.values()) and (out / "deep.md").read_text() == "# ü\n"


def test_workbook(spark, folder):
    sheets = office.workbook(BOOK)
    grid = sheets[0]["grid"]
    assert [len(r) for r in grid] == [3, 0, 3, 3] and grid[2][1]["text"] == "2024-01-01" and grid[2][2] == {"text": "1.5", "value": "1.5", "formula": "=SUM(A1:A2)"}
    assert [c["text"] for c in grid[3]] == ["38%", "TRUE", "#N/A"] and [c["value"] for c in grid[3]] == ["0.38", "true", None] and office.place("AB12") == (11, 27)
    found = {r.name: r.content for r in pipeline.Converter(spark).workbook_siblings(files.scan(spark, str(folder))).collect()}
    assert found["book.Da_ta.csv"] == 'name,,"a,""b"""\n,2024-01-01,1.5\n38%,TRUE,#N/A\n' and sorted(found) == ["book.Da_ta.csv", "book.json"]
    book = json.loads(found["book.json"])
    assert book["sheets"][0]["headers"] == ["name", "", 'a,"b"'] and book["sheets"][0]["rows"][2][2] == {"text": "1.5", "value": 1.5, "formula": "=SUM(A1:A2)"} and book["sheets"][1] == {"name": "Empty", "headers": [], "rows": []}
    (picture,) = office.pictures(BOOK)
    assert (picture["alt"], picture["ext"]) == ("image1", "jpg") and office.pictures(b"x") == []


def test_single_file(spark, folder):
    converter = pipeline.Converter(spark)
    assert converter.convert(str(folder / "sub" / "deep.MD")) == "# ü\n" and set(converter.describe()) == {"config", "plan", "models"}
    with pytest.raises(UnsupportedFormat):
        converter.convert(str(folder / "null.txt"))
    with pytest.raises(SourceError):
        converter.convert(str(folder / "none.txt"))


def test_lint(spark, folder, tmp_path):
    lint = lambda md: F.struct(F.startswith(md, F.lit("hello")).alias("fixed"), F.upper(md).alias("content"))
    rows = {r.path.rsplit("/", 1)[1]: r.md for r in pipeline.Converter(spark).ingest(files.scan(spark, str(folder)).where("path like '%.txt' or path like '%.MD'"), str(tmp_path), lint).collect()}
    assert rows["My Note.txt"].startswith("HELLO") and rows["deep.MD"] == "# ü\n"


def test_numbered(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), F.lit(1).alias("one")).repartition(5)
    assert [(r.k, r.place) for r in files.numbered(df, ["k"], "place").orderBy("k").collect()] == [(k, k + 1) for k in range(500)]


def test_pages(spark, tmp_path):
    word = lambda s, x, y: [{"ch": c, "x": x + 8.0 * i, "y": y, "w": 7.0, "h": 11.0, "font": "Courier" if s == "code()" else "Times"} for i, c in enumerate(s)]
    lines = [{"doc_id": 1, "page_no": k, "page_md": md, "n_images": 0, "glyphs": word("My Title", 50, 700) + word("code()", 50, 650)} for k, md in enumerate((None, "Own text."))]
    path = tmp_path / "pages.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)))
    pages.register(spark)
    read = spark.read.format("pagewright_pages").option("path", str(path)).load()
    (doc,) = pipeline.Converter(spark).convert_pages(read, pages.glyphs_of(read)).collect()
    assert doc.md == "# My Title\ncode()\n\n```\ncode()\n```\n\n---\n\nOwn text.\n\n```\ncode()\n```" and doc.n_pages == 2


def test_stream(spark, folder, tmp_path):
    converter, told = pipeline.Converter(spark), []
    run = lambda: ingest.ingest_folder(converter, str(folder), str(tmp_path / "table"), str(tmp_path / "checkpoint"), 4, lambda n, rows: told.append((n, rows))).awaitTermination(120)
    run()
    first = spark.read.parquet(str(tmp_path / "table")).count()
    assert first == sum(n for _, n in told) == 10 and len(told) == 3
    run()
    assert spark.read.parquet(str(tmp_path / "table")).count() == first
    (folder / "late.txt").write_text("late")
    run()
    assert spark.read.parquet(str(tmp_path / "table")).count() == first + 1


def test_stream_of_unsupported_files(spark, tmp_path):
    """A batch without a supported file ends, also when it runs again; the table and checkpoint may lie in the folder."""
    (tmp_path / "a.zzz").write_text("x")
    told = []
    run = lambda: ingest.ingest_folder(pipeline.Converter(spark), f"file://{tmp_path}", str(tmp_path / "out/table"), str(tmp_path / "out/state"), 4, lambda n, rows: told.append(rows)).awaitTermination(120)
    run()
    run()
    assert told == []
    (tmp_path / "b.txt").write_text("text")
    run()
    run()
    assert told == [1] and spark.read.parquet(str(tmp_path / "out/table")).count() == 1


def test_recognizers(spark):
    def factory():
        def run(values):
            if "bad" in values:
                raise ValueError("bad")
            return [{"latex": v.upper()} for v in values]

        return run

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "x string")
    rows = {r.x: (r.latex, r.error) for r in Registry(formula=factory).run("formula", df, "x", batch=2).collect()}
    assert rows["a"][0] == "A" and rows["c"][0] == "C" and rows["bad"][0] is None and "bad" in rows["bad"][1]
    assert [r.latex for r in Registry().run("formula", df, "x").collect()] == [None] * 3
    with pytest.raises(ModelNotAvailable):
        Registry().run("formula", df, "x", required=True)

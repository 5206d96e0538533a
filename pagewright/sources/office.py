"""Office packages read with the standard library: workbooks as grids, word and slide texts, embedded pictures.

Only zipped XML packages are read; the older binary formats give an error, as does anything unreadable. Dates are
numbers with a date format and come as ISO text. A package is one row and its parts are bounded by the file.
"""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
from functools import lru_cache
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as TB
from ..functions import text as T
from ..session import ship

CELL = "struct<text:string,value:string,formula:string>"
SHEETS = f"array<struct<name:string,grid:array<array<{CELL}>>>>"
PICTURES = "array<struct<name:string,alt:string,ext:string,data:binary>>"
PICTURE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "tif", "tiff", "bmp", "emf", "wmf")
#: Number formats that are dates by number.
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))
MAX_COLUMNS, MAX_GRID = 16_384, 5_000_000


class PackageError(ValueError):
    pass


def _tag(el) -> str:
    return el.tag.rpartition("}")[2]


def _part(package: zipfile.ZipFile, name: str):
    try:
        return ElementTree.fromstring(package.read(name))
    except KeyError:
        return None


def _relations(package: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, _, name = part.rpartition("/")
    root = _part(package, f"{folder}/_rels/{name}.rels")
    out = {}
    for r in [] if root is None else root:
        target = r.get("Target", "")
        path = [] if target.startswith("/") else folder.split("/")
        for step in target.lstrip("/").split("/"):
            path = path[:-1] if step == ".." else [*path, step]
        out[r.get("Id")] = "/".join(path)
    return out


def _texts(el, names=("t",)) -> str:
    return "".join(c.text or "" for c in el.iter() if _tag(c) in names)


def number_text(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 9e15 else repr(x)


def _date_styles(package) -> set[int]:
    """Places of cell styles whose format is a date."""
    root = _part(package, "xl/styles.xml")
    if root is None:
        return set()
    formats = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter() if _tag(f) == "numFmt"}
    spelled = {k for k, code in formats.items() if re.search("[ymdhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code), re.I)}
    cells = next((el for el in root if _tag(el) == "cellXfs"), [])
    return {i for i, xf in enumerate(cells) if int(xf.get("numFmtId", 0)) in DATE_FORMATS | spelled}


def _percent_styles(package) -> set[int]:
    root = _part(package, "xl/styles.xml")
    if root is None:
        return set()
    formats = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter() if _tag(f) == "numFmt"}
    cells = next((el for el in root if _tag(el) == "cellXfs"), [])
    return {i for i, xf in enumerate(cells) if int(xf.get("numFmtId", 0)) == 9 or formats.get(int(xf.get("numFmtId", 0)), "") == "0%"}


def _cell(c, shared: list[str], dates: set[int], percents: set[int], epoch: datetime.datetime) -> dict:
    import json

    kind, style = c.get("t", "n"), int(c.get("s", 0))
    parts = {_tag(p): p for p in c}
    raw = parts["v"].text if "v" in parts else None
    formula = f"={parts['f'].text}" if "f" in parts and parts["f"].text else None
    text, value = "", None
    if kind == "inlineStr" and "is" in parts:
        text = _texts(parts["is"])
        value = json.dumps(text, ensure_ascii=False)
    elif raw is None:
        pass
    elif kind == "s":
        text = shared[int(raw)] if int(raw) < len(shared) else ""
        value = json.dumps(text, ensure_ascii=False)
    elif kind == "b":
        text, value = ("TRUE", "true") if raw == "1" else ("FALSE", "false")
    elif kind == "e":
        text = raw
    elif kind in ("str", "d"):
        text, value = raw, json.dumps(raw, ensure_ascii=False)
    else:
        x = float(raw)
        if style in dates:
            when = epoch + datetime.timedelta(days=x)
            text = when.date().isoformat() if x == int(x) else when.isoformat(timespec="seconds")
            value = json.dumps(text)
        else:
            text = f"{number_text(round(x * 100, 10))}%" if style in percents else number_text(x)
            value = number_text(x)
    return {"text": text, "value": value, "formula": formula}


def place(reference: str) -> tuple[int, int]:
    """Row and column, from 0, of ``B3``."""
    letters, digits = re.fullmatch(r"([A-Z]+)([0-9]+)", reference).groups()
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - 64
    return int(digits) - 1, col - 1


def workbook(data: bytes) -> list[dict]:
    """Sheets as ``{name, grid}``; grids are ragged, with empty cells where none is stored."""
    package = zipfile.ZipFile(io.BytesIO(data))
    book = _part(package, "xl/workbook.xml")
    if book is None:
        raise PackageError("not a workbook")
    relations = _relations(package, "xl/workbook.xml")
    strings = _part(package, "xl/sharedStrings.xml")
    shared = [] if strings is None else [_texts(s) for s in strings]
    since_1904 = any(_tag(p) == "workbookPr" and p.get("date1904") in ("1", "true") for p in book.iter())
    epoch = datetime.datetime(1904, 1, 1) if since_1904 else datetime.datetime(1899, 12, 30)
    dates, percents, out = _date_styles(package), _percent_styles(package), []
    for sheet in (s for s in book.iter() if _tag(s) == "sheet"):
        ident = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None)
        root = _part(package, relations.get(ident, ""))
        grid: list[list[dict]] = []
        size = 0
        for c in [] if root is None else (el for el in root.iter() if _tag(el) == "c"):
            row, col = place(c.get("r"))
            size += max(row + 1 - len(grid), 0)
            grid += [[] for _ in range(row + 1 - len(grid))]
            size += max(col + 1 - len(grid[row]), 0)
            if col >= MAX_COLUMNS or size > MAX_GRID:
                raise PackageError("a sheet has cells too far out")
            grid[row] += [{"text": "", "value": None, "formula": None} for _ in range(col + 1 - len(grid[row]))]
            grid[row][col] = _cell(c, shared, dates, percents, epoch)
        out.append({"name": sheet.get("name", ""), "grid": grid})
    return out


def word_markdown(data: bytes) -> str:
    """Paragraphs, headings by style, list items and tables of a word package."""
    package = zipfile.ZipFile(io.BytesIO(data))
    root = _part(package, "word/document.xml")
    if root is None:
        raise PackageError("not a word document")
    body = next((el for el in root if _tag(el) == "body"), [])

    def run_text(p) -> str:
        out = []
        for el in p.iter():
            out.append({"t": el.text or "", "tab": "\t", "br": "\n"}.get(_tag(el), ""))
        return "".join(out).strip()

    def paragraph(p) -> str:
        style = next((v for el in p.iter() if _tag(el) == "pStyle" for k, v in el.attrib.items() if k.endswith("}val")), "")
        text = run_text(p)
        level = re.fullmatch(r"(?i)heading ?([1-6])", style)
        if not text or style.lower() == "title":
            return text and f"# {text}"
        if level:
            return f"{'#' * int(level[1])} {text}"
        return f"- {text}" if any(_tag(el) == "numPr" for el in p.iter()) else text

    def table(t) -> str:
        rows = [[" ".join(filter(None, (run_text(p) for p in c.iter() if _tag(p) == "p"))).replace("|", "\\|") for c in r if _tag(c) == "tc"] for r in t if _tag(r) == "tr"]
        width = max(map(len, rows), default=0)
        lines = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in rows]
        return "\n".join([*lines[:1], f"| {' | '.join(['---'] * width)} |", *lines[1:]]) if width else ""

    blocks = [paragraph(el) if _tag(el) == "p" else table(el) if _tag(el) == "tbl" else "" for el in body]
    return "\n\n".join(filter(None, blocks)) + "\n"


def slides_markdown(data: bytes) -> str:
    """A section for each slide: its title, then its paragraphs."""
    package = zipfile.ZipFile(io.BytesIO(data))
    names = sorted((n for n in package.namelist() if re.fullmatch(r"ppt/slides/slide[0-9]+\.xml", n)), key=lambda n: int(re.search("[0-9]+", n)[0]))
    if not names:
        raise PackageError("not a presentation")
    out = []
    for k, name in enumerate(names, 1):
        title, lines = "", []
        for shape in (el for el in ElementTree.fromstring(package.read(name)).iter() if _tag(el) == "sp"):
            kind = next((el.get("type", "") for el in shape.iter() if _tag(el) == "ph"), "")
            texts = [t for t in (_texts(p) for p in shape.iter() if _tag(p) == "p") if t.strip()]
            if kind in ("title", "ctrTitle") and not title:
                title = " ".join(texts)
            else:
                lines += texts
        out.append("\n\n".join([f"## {title or f'Slide {k}'}", *lines]))
    return "\n\n".join(out) + "\n"


def _shown(package: zipfile.ZipFile, names: set[str]) -> list[tuple[str, str]]:
    """``(part, description)`` of pictures in the order of the document's parts and of their places in them.

    Decorative pictures and those that are only links are left out; a picture that is shown twice comes twice.
    """
    main = [n for n in ("word/document.xml",) if n in names]
    number = lambda n: int("".join(filter(str.isdigit, n.rpartition("/")[2])) or 0)
    main += sorted((n for n in names if n.startswith(("ppt/slides/slide", "xl/drawings/drawing")) and n.endswith(".xml")), key=number)
    main += [n for n in ("word/footnotes.xml", "word/endnotes.xml") if n in names]
    out = []
    for part in main:
        folder, _, base = part.rpartition("/")
        rels = f"{folder}/_rels/{base}.rels"
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(package.read(rels)).iter() if r.get("TargetMode") != "External"} if rels in names else {}

        def walk(element, alt, decorative):
            tag = _tag(element)
            if tag in ("drawing", "pic", "pict", "anchor", "inline"):
                decorative = decorative or any(_tag(e) == "decorative" and e.get("val", "1") not in ("0", "false") for e in element.iter())
            if tag in ("inline", "anchor", "pic"):
                alt = next((e.get("descr") for e in element.iter() if _tag(e) in ("docPr", "cNvPr") and e.get("descr")), alt)
            if tag in ("blip", "imagedata") and not decorative:
                rid = next((v for k, v in element.attrib.items() if k.rpartition("}")[2] in ("embed", "id") and "}" in k), None)
                if targets.get(rid):
                    target = targets[rid]
                    path = posixpath.normpath(target.lstrip("/") if target.startswith("/") else f"{folder}/{target}")
                    if path in names:
                        out.append((path, alt))
            for child in element:
                walk(child, alt, decorative)

        walk(ElementTree.fromstring(package.read(part)), "", False)
    return out


def pictures(data: bytes) -> list[dict]:
    """Pictures in the order of the document; media parts in order of name where no part shows any.

    Empty for what is no package.
    """
    try:
        package = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return []
    media = {}
    for name in sorted(package.namelist()):
        base = name.rpartition("/")[2]
        stem, _, ext = base.rpartition(".")
        if "/media/" in f"/{name.lower()}" and ext.lower() in PICTURE_EXTENSIONS:
            media[name] = (stem or base, "jpg" if ext.lower() == "jpeg" else ext.lower())
    try:
        shown = [(n, alt) for n, alt in _shown(package, set(package.namelist())) if n in media]
    except (ElementTree.ParseError, ValueError):
        shown = []
    return [{"name": n, "alt": alt or media[n][0], "ext": media[n][1], "data": package.read(n)} for n, alt in shown or [(n, "") for n in media]]


def office_pictures(files: DataFrame) -> DataFrame:
    """path, pictures of office files with ``content``."""
    ship(files.sparkSession)
    return files.select("path", _pictures_udf()("content").alias("pictures"))


def _tried(parse, data):
    try:
        return parse(bytes(data)), None
    except (PackageError, zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, AttributeError, OverflowError) as error:
        return None, f"{type(error).__name__}: {error}"


@lru_cache
def _workbook_udf():
    @F.pandas_udf(f"struct<sheets:{SHEETS},error:string>")
    def run(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if c is None else _tried(workbook, c) for c in contents], columns=["sheets", "error"])

    return run


@lru_cache
def _markdown_udf():
    @F.pandas_udf("struct<markdown:string,error:string>")
    def run(contents: pd.Series, exts: pd.Series) -> pd.DataFrame:
        parsers = {"docx": word_markdown, "pptx": slides_markdown}
        rows = [(None, None) if c is None else _tried(parsers[e], c) if e in parsers else (None, f"no reader for {e}") for c, e in zip(contents, exts)]
        return pd.DataFrame(rows, columns=["markdown", "error"])

    return run


@lru_cache
def _pictures_udf():
    @F.pandas_udf(PICTURES)
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: pictures(bytes(c)), na_action="ignore")

    return run


def read_workbook(content) -> Column:
    """``struct(sheets, error)`` of a workbook's bytes."""
    ship()
    return _workbook_udf()(content)


def read_pictures(content) -> Column:
    ship()
    return _pictures_udf()(content)


def empty_cell() -> Column:
    null = F.lit(None).cast("string")
    return F.struct(F.lit("").alias("text"), null.alias("value"), null.alias("formula"))


def rectangular_sheets(sheets) -> Column:
    """Sheets with their grids trimmed and filled up."""
    return F.transform(sheets, lambda s: F.struct(s["name"].alias("name"), TB.rectangular(s["grid"], empty_cell()).alias("grid")))


def sheets_markdown(sheets) -> Column:
    return F.array_join(F.transform(sheets, lambda s: TB.sheet_markdown(s["name"], s["grid"])), "")


def workbook_json(sheets) -> Column:
    return F.concat(F.lit('{"sheets":['), F.array_join(F.transform(sheets, lambda s: TB.sheet_json(s["name"], s["grid"])), ","), F.lit("]}"))


def convert_office(files: DataFrame) -> DataFrame:
    """path, markdown, sheets (null but for workbooks), pictures, error of office files with ``content``."""
    ship(files.sparkSession)
    ext = T.extension(F.col("path"))
    rows = files.withColumn("ext", ext)
    books = rows.where("ext = 'xlsx'").withColumn("r", _workbook_udf()("content"))
    books = books.withColumn("sheets", rectangular_sheets(F.col("r.sheets")))
    books = books.select("path", sheets_markdown(F.col("sheets")).alias("markdown"), "sheets", _pictures_udf()("content").alias("pictures"), F.col("r.error").alias("error"))
    texts = rows.where("ext <> 'xlsx'").withColumn("r", _markdown_udf()("content", "ext"))
    none = F.lit(None).cast(books.schema["sheets"].dataType)
    texts = texts.select("path", F.col("r.markdown").alias("markdown"), none.alias("sheets"), _pictures_udf()("content").alias("pictures"), F.col("r.error").alias("error"))
    return books.unionByName(texts)


def sheet_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Dense sheets from sparse cells (keys, row_no, col_no, text, value, formula): keys, grid.

    A row's cells are placed by a map from column to cell, up to the widest; rows without cells are empty ones between.
    """
    cell = F.struct("text", "value", "formula")
    rows = cells.groupBy(*keys, "row_no").agg(F.map_from_entries(F.collect_list(F.struct("col_no", cell.alias("cell")))).alias("m"), F.max("col_no").alias("last"))
    dense = rows.select(*keys, "row_no", F.transform(F.sequence(F.lit(0), F.col("last")), lambda c: F.coalesce(F.element_at("m", c), empty_cell())).alias("cells"))
    sheets = dense.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("row_no", "cells"))).alias("m"), F.max("row_no").alias("last"))
    no_row = F.array().cast(f"array<{CELL}>")
    grid = F.transform(F.sequence(F.lit(0), F.col("last")), lambda r: F.coalesce(F.element_at("m", r), no_row))
    return sheets.select(*keys, TB.rectangular(grid, empty_cell()).alias("grid"))

"""Tables as Markdown and HTML, from arrays of rows: column expressions, no Python.

A source table is ``rows: array<struct<is_header boolean, cells array<struct<text, colspan, rowspan>>>>`` with
``has_header`` and ``col_count``. A sheet is an array of rows of ``struct<text, value, formula>``. Nulls among texts
are empty cells; a null table gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

CELL = "struct<text:string,colspan:int,rowspan:int>"
TABLE_ROWS = f"array<struct<is_header:boolean,cells:array<{CELL}>>>"


def _filled(text) -> Column:
    return T.trim(F.coalesce(text, F.lit(""))) != ""


def is_plausible(rows, col_count) -> Column:
    """At least two rows and columns, and every row filled to three fifths."""
    full = F.forall(rows, lambda r: F.size(F.filter(r["cells"], lambda c: _filled(c["text"]))) * 5 >= F.size(r["cells"]) * 3)
    return (F.size(rows) >= 2) & (col_count >= 2) & full


def pipe_row(cells, width) -> Column:
    """``| a | b |`` of an array of strings, filled up with empty cells to ``width``."""
    padded = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0)).cast("int")))
    return F.concat(F.lit("| "), F.array_join(F.slice(padded, 1, F.greatest(width, F.lit(1)).cast("int")), " | "), F.lit(" |"))


def rule_row(width) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.greatest(width, F.lit(1)).cast("int")), " | "), F.lit(" |"))


def pipe_table(rows, header_at, width) -> Column:
    """A pipe table of an array of arrays of strings; ``header_at`` (from 0) is the row that comes first."""
    body = F.transform(F.filter(rows, lambda _, i: i != header_at), lambda r: pipe_row(r, width))
    lines = F.concat(F.array(pipe_row(F.get(rows, header_at), width), rule_row(width)), body)
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def widest(rows) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def _header_at(rows) -> Column:
    return (F.array_position(F.transform(rows, lambda r: r["is_header"]), True) - 1).cast("int")


def source_table_gfm(rows, col_count) -> Column:
    texts = F.transform(rows, lambda r: F.transform(r["cells"], lambda c: T.gfm_escape(T.trim(F.coalesce(c["text"], F.lit(""))))))

    def render(cells):
        size = F.struct(F.greatest(_header_at(rows), F.lit(0)).alias("head"), F.greatest(widest(cells), col_count).alias("width"))
        return T.let(size, lambda n: pipe_table(cells, n["head"], n["width"]))

    return T.let(texts, render)


def source_table_html(rows, has_header) -> Column:
    def cells(row, tag):
        span = lambda name, n: F.when(n > 1, F.concat(F.lit(f' {name}="'), n.cast("string"), F.lit('"'))).otherwise("")
        one = lambda c: F.concat(F.lit(f"<{tag}"), span("colspan", c["colspan"]), span("rowspan", c["rowspan"]), F.lit(">"), T.html_escape(F.coalesce(c["text"], F.lit(""))), F.lit(f"</{tag}>\n"))
        return F.concat(F.lit("<tr>\n"), F.array_join(F.transform(row["cells"], one), ""), F.lit("</tr>\n"))

    def render(flagged):
        # a table that only has_header tells of keeps its first row in the body as well
        body = F.filter(rows, lambda _, i: (flagged < 0) | (i != flagged))
        first = cells(F.get(rows, F.greatest(flagged, F.lit(0))), "th")
        head = F.when(has_header | (flagged >= 0), F.concat(F.lit("<thead>\n"), first, F.lit("</thead>\n"))).otherwise("")
        return F.concat(F.lit("<table>\n"), head, F.lit("<tbody>\n"), F.array_join(F.transform(body, lambda r: cells(r, "td")), ""), F.lit("</tbody>\n</table>"))

    return T.let(_header_at(rows), render)


def source_table_markdown(rows, has_header, col_count) -> Column:
    """GFM for plain grids, HTML for merged cells, null for tables without text."""
    any_cell = lambda test: F.exists(rows, lambda r: F.exists(r["cells"], test))
    merged = any_cell(lambda c: (c["colspan"] > 1) | (c["rowspan"] > 1))
    html, gfm = source_table_html(rows, has_header), source_table_gfm(rows, col_count)
    return F.when(any_cell(lambda c: _filled(c["text"])), F.when(merged, html).otherwise(gfm))


# ---------------------------------------------------------------------------------------------- sheets


def is_empty_cell(c) -> Column:
    return (c["text"] == "") & c["formula"].isNull() & c["value"].isNull()


def _has_content(row) -> Column:
    return F.exists(row, lambda c: ~is_empty_cell(c))


def content_rows(grid) -> Column:
    return F.filter(grid, _has_content)


def _texts(row) -> Column:
    return F.transform(row, lambda c: c["text"])


def rectangular(grid, empty: Column) -> Column:
    """Rows without those at the end that are empty, all filled up to the widest."""
    last = F.array_max(F.transform(grid, lambda r, i: F.when(_has_content(r), i + 1)))
    kept = F.slice(grid, 1, F.coalesce(last, F.lit(0)).cast("int"))
    fill = lambda rows, width: F.transform(rows, lambda r: F.concat(r, F.array_repeat(empty, (width - F.size(r)).cast("int"))))
    return T.let(kept, lambda rows: T.let(widest(rows), lambda width: fill(rows, width)))


def headers(grid) -> Column:
    return F.coalesce(_texts(F.get(content_rows(grid), F.lit(0))), F.array().cast("array<string>"))


def sheet_markdown(name, grid) -> Column:
    """A section with the sheet's pipe table; rows without content are left out."""

    def render(rows, width):
        rest = F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda r: pipe_sheet_row(r, width))
        table = F.concat(pipe_sheet_row(F.get(rows, F.lit(0)), width), pipe_sheet_rule(width), F.array_join(rest, ""), F.lit("\n"))
        return F.when(F.size(rows) == 0, F.lit("_(empty sheet)_\n\n")).otherwise(table)

    body = T.let(F.transform(content_rows(grid), _texts), lambda rows: T.let(F.greatest(widest(rows), F.lit(1)), lambda width: render(rows, width)))
    return F.concat(F.lit("## "), name, F.lit("\n\n"), body)


def pipe_sheet_row(cells, width) -> Column:
    padded = F.concat(cells, F.array_repeat(F.lit(""), (width - F.size(cells)).cast("int")))
    return F.concat(F.lit("|"), F.array_join(F.transform(padded, lambda c: F.concat(F.lit(" "), c, F.lit(" |"))), ""), F.lit("\n"))


def pipe_sheet_rule(width) -> Column:
    return F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width.cast("int")), F.lit("\n"))


def csv_field(c) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.rlike(c, F.lit('[",\r\n]')), quoted).otherwise(c)


def sheet_csv(grid) -> Column:
    """Quoted where needed, lines end in a line feed; a row of one empty cell is a pair of quotes. Null if empty."""
    rows = F.transform(content_rows(grid), _texts)

    def line(r):
        text = F.array_join(F.transform(r, csv_field), ",")
        return F.concat(F.when((F.size(r) == 1) & (text == ""), '""').otherwise(text), F.lit("\n"))

    return F.when(F.size(rows) > 0, F.array_join(F.transform(rows, line), ""))


def number_value(x) -> Column:
    """A number as JSON text: whole numbers without a fraction, what is not finite as null."""
    finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = (x == F.floor(x)) & (F.abs(x) < 9.0e15)
    return F.when(finite, F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string")))


def cell_json(c) -> Column:
    """``{"text":..,"value":..}`` and the formula if there is one; ``value`` is JSON text or null."""
    text = F.to_json(F.struct(c["text"].alias("text")))
    head = F.substr(text, F.lit(1), F.length(text) - 1)
    formula = F.to_json(F.struct(c["formula"].alias("formula")))
    tail = F.when(c["formula"].isNotNull(), F.concat(F.lit(","), F.substr(formula, F.lit(2), F.length(formula)))).otherwise("}")
    return F.concat(head, F.lit(',"value":'), F.coalesce(c["value"], F.lit("null")), tail)


def sheet_json(name, grid) -> Column:
    head = F.to_json(F.struct(name.alias("name"), headers(grid).alias("headers")))
    rows = F.array_join(F.transform(grid, lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, cell_json), ","), F.lit("]"))), ",")
    return F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"rows":['), rows, F.lit("]}"))

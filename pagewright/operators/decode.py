"""Outputs of recognizers as rows: greedy CTC text, charsets, matched cells, linked captions, best tokens.

Model outputs arrive as tables (one row for each time step, box or pair), so these are joins and ordered aggregates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import geometry as G
from ..functions import text as T
from ..functions.layout import firsts
from ..session import ship
from .ordered import joined


def first_argmax(values) -> Column:
    """Place (from 0) of the largest element; the first among equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def last_argmax(values, fallback: int) -> Column:
    """The largest element's place, the last among equals; ``fallback`` for an empty array."""
    n = F.size(values)
    return F.when(n > 0, n - F.array_position(F.reverse(values), F.array_max(values))).otherwise(fallback).cast("int")


def ctc_decode(steps: DataFrame, charset: list[str]) -> DataFrame:
    """line_id, text, confidence from ``line_id, t, logits``: best class a step, repeats once, double spaces once.

    A class beyond the charset emits nothing but still ends a repeat; the class at 0 is the blank, whose text is empty,
    yet it counts toward the confidence. Lines without text have no row. Spaces are squeezed on what is emitted.
    """
    best = first_argmax(F.col("logits"))
    rows = steps.select("line_id", "t", best.alias("k"), F.array_max("logits").alias("v"))
    before = F.lag("k").over(Window.partitionBy("line_id").orderBy("t"))
    emitted = rows.withColumn("before", before).where((F.col("before").isNull() | (F.col("before") != F.col("k"))) & (F.col("k") < len(charset)))
    letters = F.array(*[F.lit(c) for c in charset])
    shown = emitted.withColumn("ch", F.get(letters, F.col("k")))
    out = shown.groupBy("line_id").agg(joined("ch", ["t"], "").alias("text"), F.avg("v").alias("confidence"))
    # a single-space symbol after text that ends in a space is not emitted; other symbols keep their own spaces
    return out.withColumn("text", T.trim(F.regexp_replace("text", " {2,}", " "))).where("text <> ''")


def aligned_charset(chars, n_classes) -> Column:
    """Blank first and a space last, as far as the number of classes asks for them."""
    missing = n_classes - F.size(chars)
    with_blank = F.when(missing >= 1, F.concat(F.array(F.lit("")), chars)).otherwise(chars)
    return F.when(missing >= 2, F.array_append(with_blank, F.lit(" "))).otherwise(with_blank)


def structure_charset(tokens) -> Column:
    """Table structure tokens: whole empty cells instead of bare openings, between a start and an end."""
    whole = F.when(F.array_contains(tokens, "<td></td>"), tokens).otherwise(F.array_append(tokens, F.lit("<td></td>")))
    return F.concat(F.array(F.lit("sos")), F.array_remove(whole, "<td>"), F.array(F.lit("eos")))


_CELLS = ("no", "x0", "y0", "x1", "y1")


def _in_cells(boxes: DataFrame, cells: DataFrame, keys: list[str], schema: str, find) -> DataFrame:
    """``boxes`` with the ``schema`` that ``find`` gives, from a batch's bounds of boxes, and of cells and their numbers, of
    all pairs of a box and a cell of its keys, box by box and in order of cells: the place of the box in the batch, and
    columns. A table's cells are gathered to one array, so a box meets them in its row; pairs are rated on flat arrays."""
    ship(boxes.sparkSession)
    gathered = F.array_sort(F.collect_list(F.struct(F.col("cell_no").alias("no"), "x0", "y0", "x1", "y1")))
    rows = boxes.join(cells.groupBy(*keys).agg(gathered.alias("__cells")), keys)
    kept = [c for c in rows.columns if c != "__cells"]
    schema = StructType(rows.select(*kept).schema.fields + StructType.fromDDL(schema).fields)

    def scan(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(start, AT_ONCE)
                lists = batch.column("__cells")
                flat, count = lists.flatten(), np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
                of = np.repeat(np.arange(batch.num_rows), count)
                box = [batch.column(c).to_numpy(zero_copy_only=False).astype(float)[of] for c in _CELLS[1:]]
                at, columns = find(of, box, [flat.field(c).to_numpy(zero_copy_only=False) for c in _CELLS[1:]], flat.field("no").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in kept), *map(pa.array, columns)], names=schema.names)

    return rows.mapInArrow(scan, schema)


#: Boxes whose pairs with cells are rated at a time.
AT_ONCE = 4096


def _sides(box) -> np.ndarray:
    return np.maximum(box[2] - box[0], 0.0) * np.maximum(box[3] - box[1], 0.0)


def _shared(a, b) -> np.ndarray:
    return _sides([np.maximum(a[0], b[0]), np.maximum(a[1], b[1]), np.minimum(a[2], b[2]), np.minimum(a[3], b[3])])


def match_cells(lines: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Each recognized line with the table cell of the best IoU, then the nearest corners; lines off all cells drop out.

    Ties go to the first cell.
    """

    def find(of, box, cell, no):
        inter = _shared(box, cell)
        union = _sides(box) + _sides(cell) - inter
        meets = np.flatnonzero((inter > 0) & (union > 0))
        share = inter[meets] / union[meets]
        meets, share = meets[share > 1e-8], share[share > 1e-8]
        ends = [np.abs(c[meets] - b[meets]) for b, c in zip(box, cell)]
        first, second = ends[0] + ends[1], ends[2] + ends[3]
        order = np.lexsort((no[meets], first + second + np.minimum(first, second), 1 - share, of[meets]))
        best = meets[order[firsts(of[meets][order])]]
        return of[best], [no[best].astype(np.int32)]

    return _in_cells(lines, cells, keys, "cell_no int", find)


def slot_words(words: DataFrame, cells: DataFrame, keys: list[str], threshold: float = 0.5, forced: bool = False, unique: bool = True) -> DataFrame:
    """Words in the cells that hold most of them: one row for each assignment, with ``share``.

    The best cell takes a word from ``threshold`` on, or in any case if ``forced``; others from the threshold on if not
    ``unique``. Ties go to the first cell.
    """

    def find(of, box, cell, no):
        size = _sides(box)
        share = np.divide(_shared(box, cell), size, out=np.zeros(len(size)), where=size > 0)
        order = np.lexsort((no, -share, of))
        if not forced:
            order = order[share[order] >= threshold]
        best = firsts(of[order])
        chosen = order[best | (share[order] >= threshold)] if not unique else order[best]
        return of[chosen], [no[chosen].astype(np.int32), share[chosen]]

    return _in_cells(words, cells, keys, "cell_no int, share double", find)


def slot_confidence(words: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """For each table half of the mean and half of the least of its words' best shares."""
    best = slot_words(words, cells, keys, forced=True)
    return best.groupBy(*keys).agg(((F.avg("share") + F.min("share")) / 2).alias("confidence"))


def _likely(l0: str, l1: str) -> Column:
    """``geometry.edge_probability`` by the C library's ``exp``. Opposite logits are likely by a half on average, so a last
    digit decides at the threshold, and that of the JVM's ``exp`` differs."""

    @F.pandas_udf("double")
    def logistic(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(d):
            try:
                return 1 / (1 + math.exp(d))
            except OverflowError:
                return 0.0

        return pd.Series([one(d) for d in a - b], dtype=float)

    # what is not a number comes back as null
    return F.coalesce(logistic(l0, l1), G.edge_probability(F.col(l0), F.col(l1)))


def linked_text(edges: DataFrame, objects: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Captions and footers of tables: pairs of objects whose two directed edges are likely on average.

    ``edges``: keys, i, j, l0, l1 (logits); ``objects``: keys, idx, label, text, y0. Objects without text are no parts.
    """
    ship(edges.sparkSession)
    tables = objects.where(F.col("label").isin("table", "table rotated")).select(*keys, F.col("idx").alias("i"))
    kind = F.when(F.col("label").startswith("table caption"), "caption").when(F.col("label").startswith("table footer"), "footer")
    parts = objects.withColumn("kind", kind).where("kind is not null and trim(text) <> ''").select(*keys, F.col("idx").alias("j"), "kind", F.trim("text").alias("text"), F.col("y0").alias("part_y"))
    there = edges.select(*keys, "i", "j", "l0", "l1").join(tables, [*keys, "i"]).join(parts, [*keys, "j"])
    back = edges.select(*keys, F.col("i").alias("j"), F.col("j").alias("i"), F.col("l0").alias("b0"), F.col("l1").alias("b1"))
    rows = there.join(back, [*keys, "i", "j"]).withColumn("edge_score", (_likely("l0", "l1") + _likely("b0", "b1")) / 2).where(F.col("edge_score") >= threshold)
    return rows.groupBy(*keys, F.col("i").alias("table_no"), "kind").agg(joined("text", ["part_y", "j"], " ").alias("text"), F.max("edge_score").alias("best_edge"), F.count(F.lit(1)).alias("n_parts"))


def span_text(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Text of words in (block, line, span) order, with spaces."""
    return spans.withColumn("text", F.trim("text")).groupBy(*keys).agg(F.trim(joined("text", ["block_num", "line_num", "span_num"], " ")).alias("text"))

"""Grids of text cells (array<array<string>>, rows may differ in length) and their text forms."""

from __future__ import annotations

import csv

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from gridmark.functions.text import col, let, lines, newlines, strip

GRID = "array<array<string>>"
BEGIN, END, RULE = "\\begin{tabular}", "\\end{tabular}", "\\hline"


def is_blank(row: Column) -> Column:
    return F.forall(row, lambda c: strip(c) == "")


def is_artifact_cell(cell: Column) -> Column:
    return strip(cell).isin("", ".")


def is_artifact_row(row: Column) -> Column:
    return F.forall(row, is_artifact_cell)


def without_blank_rows(grid: Column | str) -> Column:
    return F.filter(col(grid), lambda r: ~is_blank(r))


def without_artifact_rows(grid: Column | str) -> Column:
    return F.filter(col(grid), lambda r: ~is_artifact_row(r))


def _widest(grid: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(grid, F.size)), F.lit(0))


def _filled(row: Column, width: Column) -> Column:
    return F.concat(row, F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0))))


def without_artifact_columns(grid: Column | str) -> Column:
    """Rows of equal width up to the last column that holds something in any row."""

    def used(g: Column) -> Column:
        ends = F.transform(g, lambda r: F.coalesce(F.array_max(F.transform(r, lambda c, i: F.when(is_artifact_cell(c), 0).otherwise(i + 1))), F.lit(0)))
        return F.coalesce(F.array_max(ends), F.lit(0))

    return let(col(grid), lambda g: let(used(g), lambda w: F.transform(g, lambda r: F.slice(_filled(r, w), F.lit(1), w))))


def normalized(grid: Column | str) -> Column:
    return without_artifact_columns(without_artifact_rows(grid))


def plain_text(grid: Column | str) -> Column:
    """Cells joined by commas, rows by line ends; nothing is quoted."""
    return F.array_join(F.transform(col(grid), lambda r: F.array_join(r, ",")), "\n")


def csv_text(grid: Column | str) -> Column:
    return F.concat(plain_text(grid), F.lit("\n"))


def latex_text(grid: Column | str) -> Column:
    """A tabular environment with a rule after each row; short rows are filled up, no rows give an empty text."""

    def text(g: Column, width: Column) -> Column:
        head = F.concat(F.lit(BEGIN + "{|"), F.array_join(F.array_repeat(F.lit("c"), width), "|"), F.lit("|}\n" + RULE + "\n"))
        rows = F.transform(g, lambda r: F.concat(F.array_join(_filled(r, width), " & "), F.lit(" \\\\\n" + RULE + "\n")))
        return F.when(F.size(g) == 0, "").otherwise(F.concat(head, F.array_join(rows, ""), F.lit(END + "\n")))

    return let(col(grid), lambda g: let(_widest(g), lambda w: text(g, w)))


def latex_grid(text: Column | str) -> Column:
    """The cells of a tabular environment; null where there is none. A line that begins one holds no cells."""
    text = col(text)
    kept = F.filter(F.transform(lines(newlines(text)), strip), lambda x: (x != "") & ~F.startswith(x, F.lit(BEGIN)) & ~F.startswith(x, F.lit(END)))
    bare = F.transform(kept, lambda x: strip(F.regexp_replace(strip(F.replace(x, F.lit(RULE), F.lit(""))), r"\\\\$", "")))
    rows = F.transform(F.filter(bare, lambda x: x != ""), lambda x: F.transform(F.split(x, "&", -1), strip))
    return F.when(F.contains(text, F.lit(BEGIN)), rows)


def plain_csv_grid(text: Column | str) -> Column:
    """CSV text without quotes; a blank line is a row without cells."""
    return F.transform(lines(text), lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ",", -1)))


def _reader(strict: bool):
    @F.pandas_udf(ArrayType(ArrayType(StringType())))
    def read(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            try:
                return list(csv.reader(text.splitlines(), strict=strict))
            except csv.Error as error:
                raise ValueError("Target table text is not parseable") from error

        return texts.map(one)

    return read


def with_csv_grid(frame: DataFrame, text: str, out: str, strict: bool = False) -> DataFrame:
    """frame with the grid of its CSV text.

    Texts without quotes are split natively. Only those with quotes are sent to Python's csv reader (it gets nulls for
    the others), in one pass over frame. strict: text that isn't well quoted is an error, else it is read as far as it can be.
    """
    quoted = F.contains(F.col(text), F.lit('"'))
    return frame.withColumn(out, F.when(quoted, _reader(strict)(F.when(quoted, F.col(text)))).otherwise(plain_csv_grid(text)))


def same_shape(a: Column | str, b: Column | str) -> Column:
    return F.transform(col(a), F.size) == F.transform(col(b), F.size)


def is_proper_prefix(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return (F.size(a) < F.size(b)) & (a == F.slice(b, F.lit(1), F.size(a)))


def cell_count(grid: Column | str) -> Column:
    return F.aggregate(col(grid), F.lit(0), lambda n, r: n + F.size(r))


def shape(grid: Column | str) -> tuple[Column, Column]:
    return F.size(col(grid)), _widest(col(grid))


def with_header(grid: Column | str, corner: str = "日\\月") -> Column:
    """The first cell of the first row replaced."""
    return F.transform(col(grid), lambda r, i: F.when((i == 0) & (F.size(r) > 0), F.concat(F.array(F.lit(corner)), F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))))).otherwise(r))


def exploded(frame: DataFrame, grid: str, *keys: str) -> DataFrame:
    """keys, row_index, col_index, text, cell_type of every cell."""
    rows = frame.select(*keys, F.posexplode(grid).alias("row_index", "cells"))
    cells = rows.select(*keys, "row_index", F.col("cells"), F.posexplode("cells").alias("col_index", "text"))
    blank = is_blank(F.col("cells"))
    kind = F.when(F.col("row_index") == 0, "header").when((F.col("col_index") == 0) & ~blank, "index").when(blank, "separator").otherwise("data")
    return cells.select(*keys, "row_index", "col_index", "text", kind.alias("cell_type"))

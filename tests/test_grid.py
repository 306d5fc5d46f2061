import csv

import pytest
from pyspark.sql import functions as F

from gridmark.functions import grid as G


def apply(spark, grids, make):
    frame = spark.createDataFrame(list(enumerate(grids)), f"i int, g {G.GRID}")
    return [r.y for r in sorted(frame.select("i", make(F.col("g")).alias("y")).collect(), key=lambda r: r.i)]


def parse(spark, texts, make):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [r.y for r in sorted(frame.select("i", make(F.col("x")).alias("y")).collect(), key=lambda r: r.i)]


def test_normalized(spark):
    dirty = [["well", "depth", " "], [" .", "", "."], ["north", "", ""], ["south", "7.25", ""], ["", "", ""]]
    clean = [["k", "p", "q"], ["", "4", ""], ["z", "", "."], ["", ".", "x"]]
    assert apply(spark, [dirty, clean, [], [["."]], [["a"], ["b", "c", " . "]]], G.normalized) == [[["well", "depth"], ["north", ""], ["south", "7.25"]], clean, [], [], [["a", ""], ["b", "c"]]]


def test_without_blank_rows(spark):
    rows = [["a", ""], ["1", ""], ["", " "], ["2", "x"]]
    assert apply(spark, [rows, [[]]], G.without_blank_rows) == [[rows[0], rows[1], rows[3]], []]


def test_text_forms(spark):
    grid = [["井", "深"], ["north"], ["", "7.25", "x"]]
    latex = apply(spark, [grid, []], G.latex_text)
    assert latex == ["\\begin{tabular}{|c|c|c|}\n\\hline\n井 & 深 &  \\\\\n\\hline\nnorth &  &  \\\\\n\\hline\n & 7.25 & x \\\\\n\\hline\n\\end{tabular}\n", ""]
    assert apply(spark, [grid, []], G.csv_text) == ["井,深\nnorth\n,7.25,x\n", "\n"]
    assert parse(spark, [latex[0]], G.latex_grid) == [[["井", "深", ""], ["north", "", ""], ["", "7.25", "x"]]]


def test_latex_grid(spark):
    ruled = "\\begin{tabular}{|c|c|}\n\\hline 井 & 深 \\\\\n\\hline  & 3 \\\\ \\hline\n\\hline  &  \\\\\n\\end{tabular}"
    one_line = "\\begin{tabular}{|c|} 1 & 2 \\\\ \\end{tabular}"
    outside = "x & y\n\\begin{tabular}{c}\n1\n\\end{tabular}\nz"
    assert parse(spark, [ruled, one_line, outside, "1,2", ""], G.latex_grid) == [[["井", "深"], ["", "3"], ["", ""]], [], [["x", "y"], ["1"], ["z"]], None, None]


def test_csv_grid(spark):
    texts = ["a,b\n\nc,\n", "", "\n", ",", "a\r\nb\rc", 'x,"y,z"', '"q""r",s', '"x\ny",z', 'a"b,c', '"open', None]
    frame = G.with_csv_grid(spark.createDataFrame(list(enumerate(texts)), "i int, x string"), "x", "g")
    assert {r.i: r.g for r in frame.collect()} == {i: None if t is None else list(csv.reader(t.splitlines())) for i, t in enumerate(texts)}


def test_strict_csv_is_an_error(spark):
    frame = spark.createDataFrame([('"a"b,c',)], "x string")
    with pytest.raises(Exception, match="not parseable"):
        G.with_csv_grid(frame, "x", "g", strict=True).collect()


def test_exploded_kinds(spark):
    frame = spark.createDataFrame([("s", [["h", "x"], ["1", ""], ["", " "], ["2", "y"]])], f"k string, g {G.GRID}")
    kinds = {(r.row_index, r.col_index): r.cell_type for r in G.exploded(frame, "g", "k").collect()}
    assert kinds == {(0, 0): "header", (0, 1): "header", (1, 0): "index", (1, 1): "data", (2, 0): "separator", (2, 1): "separator", (3, 0): "index", (3, 1): "data"}


def test_header(spark):
    assert apply(spark, [[["a", "b"], ["c"]], [[]], []], G.with_header) == [[["日\\月", "b"], ["c"]], [[]], []]

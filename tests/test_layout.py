import pytest
from pyspark.sql import functions as F

from gridmark.functions import layout as L


def token(text, left, top, right, bottom):
    return (text, float(left), float(top), float(right), float(bottom))


LABELS = [token("日期", 35, 181, 141, 229), token("最低", 38, 214, 140, 256), token("年统计", 37, 275, 139, 317)]


def anchor(spark, tokens):
    row = spark.createDataFrame([(tokens,)], f"t {L.TOKENS}").select(L.anchor("t").alias("a")).first().a
    return None if row is None else (row.text, row.top, row.method)


@pytest.mark.parametrize(
    "tokens,expected",
    [
        ([token("平均", 0, 160, 10, 180), token("平均", 0, 100, 10, 120), token("年统计", 0, 158, 20, 182)], ("平均", 100.0, "average_anchor")),
        ([token("年统计", 0, 158, 20, 182)], None),
        ([token("平均", 0, 100, 10, 120), token("年统计", 0, 158, 20, 182)], ("平均", 100.0, "average_anchor")),
        ([token("平均", 0, 160, 10, 180), token("年统计", 0, 158, 20, 182)], ("平均", 160.0, "average_anchor_fallback")),
        ([token("平", 44, 126, 76, 158), *LABELS], ("平", 126.0, "weak_average_anchor")),
        ([token("均", 78, 126, 110, 158), *LABELS], ("均", 126.0, "weak_average_anchor")),
        ([token("平", 44, 126, 76, 158), LABELS[2]], None),
        ([token("平", 240, 126, 272, 158), *LABELS], None),
        ([], None),
    ],
)
def test_anchor(spark, tokens, expected):
    assert anchor(spark, tokens) == expected


def profile(n, dark):
    return [dark.get(i, 0) for i in range(n)]


def cuts(spark, dark, width, height, top):
    frame = spark.createDataFrame([(dark, width, height, top)], "d array<int>, w int, h int, t double")
    cascade = L.cut_cascade("d", "w", "h")
    return tuple(frame.select(L.cut_above("d", "w", "t", up=20).alias("a"), L.cut_below("d", "w", "h").alias("b"), cascade["cut"].alias("c"), cascade["method"].alias("m"), L.crop_cut("d", "w", "h", "t", False).alias("e")).first())


def test_cut_lines(spark):
    assert cuts(spark, profile(220, {140: 120, 180: 120}), 180, 220, 150.0)[0] == 141
    assert cuts(spark, profile(300, {210: 150, 240: 150}), 200, 300, 10.0)[1] == 211
    assert cuts(spark, profile(300, {170: 85}), 200, 300, None) == (None, None, 171, "line_fallback_0.40_0.55", 177)
    assert cuts(spark, profile(300, {}), 200, 300, 50.0) == (None, None, None, None, 50)
    assert cuts(spark, profile(10, {}), 200, 10, None)[4] is None


def test_buffer_and_boxes(spark):
    row = spark.range(1).select(L.with_buffer(F.lit(120), F.lit(200)).alias("a"), L.with_buffer(F.lit(198), F.lit(200)).alias("b"), L.clamped_box(F.expr("array(-5d, 3d, 250d, 3.7d)"), F.lit(200), F.lit(100)).alias("c")).first()
    assert (row.a, row.b, tuple(row.c)) == (126, 200, (0, 3, 200, 3, False))


def plain_lines(tokens):
    items = sorted(((t[2] + t[4]) / 2, (t[1] + t[3]) / 2, k, t[0]) for k, t in enumerate(tokens))
    heights = sorted(t[4] - t[2] for t in tokens)
    reach = max(10.0, min(20.0, 0.4 * heights[len(heights) // 2])) if tokens else 0
    rows = []
    for y, x, _, text in items:
        for row in rows:
            if abs(y - sum(v[0] for v in row) / len(row)) <= reach:
                row.append((y, x, text))
                break
        else:
            rows.append([(y, x, text)])
    rows.sort(key=lambda row: sum(v[0] for v in row) / len(row))
    return ["".join(v[2] for v in sorted(row, key=lambda v: v[1])) for row in rows]


def test_title_lines(spark):
    import random

    rng = random.Random(1)
    cases = [[token(rng.choice("流量表站abc"), x := rng.randint(0, 200), y := rng.randint(0, 60), x + 10, y + rng.randint(5, 40)) for _ in range(rng.randint(0, 9))] for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(cases)), f"i int, t {L.TOKENS}").select("i", L.title_lines("t").alias("y")).collect()
    assert {r.i: r.y for r in rows} == {i: plain_lines(c) for i, c in enumerate(cases)}


def test_recognised_title_and_tokens(spark):
    entries = [([(0, 0), (10, 0), (10, 9)], " 汉江 "), ([(20, 1), (30, 12)], "流量表"), ([(0, 50), (5, 60)], " "), (None, "x")]
    frame = spark.createDataFrame([(entries,)], "e array<struct<points:array<struct<x:int,y:int>>,text:string>>")
    found = frame.select(L.tokens("e", 5.0).alias("t")).first().t
    assert [tuple(t) for t in found] == [("汉江", 0.0, 5.0, 10.0, 14.0), ("流量表", 20.0, 6.0, 30.0, 17.0)]
    title = frame.select(L.recognised_title(L.tokens("e"), "流量").alias("r")).first().r
    assert (title.title, title.success, title.reason) == ("汉江流量表", True, None)
    missing = frame.select(L.recognised_title(L.tokens("e"), "水位").alias("r")).first().r
    assert (missing.title, missing.success, missing.reason) == (None, False, "expected_keyword_missing")


def test_entries(spark):
    rows = [(1, [[(0, 0), (2, 3)], [(5, 5)]], ["a"], [0.5, 0.6]), (2, None, ["a"], [1.0])]
    frame = spark.createDataFrame(rows, "i int, b array<array<struct<x:int,y:int>>>, t array<string>, s array<double>")
    found = {r.i: [(e.text, e.score, len(e.points)) for e in r.e] for r in frame.select("i", L.entries("b", "t", "s").alias("e")).collect()}
    assert found == {1: [("a", 0.5, 2)], 2: []}


def test_placed_tables(spark):
    from gridmark.operators import pages

    rows = [("p", "i", 0, [-5.0, 40.0, 50.0, 90.0], 100, 100), ("p", "i", 1, [120.0, 0.0, 150.0, 9.0], 100, 100), ("p", "i", 2, [0.0, 0.0, 9.0, 9.0], 100, 100)]
    frame = spark.createDataFrame(rows, "pdf_path string, page_image_path string, table_index int, box array<double>, width int, height int")
    good, failed = pages.placed_tables(frame, 30, 0)
    assert {r.table_index: (tuple(r.buffered), tuple(r.title)) for r in good.collect()} == {0: ((0, 10, 50, 90), (0, 10, 50, 40, False)), 2: ((0, 0, 9, 9), (0, 0, 9, 0, True))}
    assert {(r.table_index, r.reason) for r in failed.collect()} == {(1, "invalid_original_box"), (2, "empty_title_roi")}

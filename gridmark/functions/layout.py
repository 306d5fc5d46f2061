"""Decisions on recognised tokens and ink profiles of an image, over arrays of one row.

Tokens are array<struct<text:string,left:double,top:double,right:double,bottom:double>>, profiles array<int>.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from gridmark.functions.text import col, let, strip

TOKENS = "array<struct<text:string,left:double,top:double,right:double,bottom:double>>"
#: Share of a row's width that a line must cover, share of the height to start from.
CASCADE = ((0.60, 0.60), (0.55, 0.60), (0.50, 0.55), (0.40, 0.55), (0.35, 0.55))
#: Words that mark rows of statistics.
AVERAGE, YEAR, WEAK, LABELS = "平均", "年统计", ("平", "均"), ("日期", "最低", "最高", "年统计")


def tokens(entries: Column | str, y_offset: float = 0.0) -> Column:
    """Tokens of array<struct<points:array<struct<x,y>>,text>>: bounding boxes, without blank texts."""
    named = F.filter(col(entries), lambda e: e["text"].isNotNull() & e["points"].isNotNull() & (strip(e["text"]) != ""))

    def box(e: Column) -> Column:
        x, y = F.transform(e["points"], lambda p: p["x"].cast("double")), F.transform(e["points"], lambda p: p["y"].cast("double"))
        return F.struct(strip(e["text"]).alias("text"), F.array_min(x).alias("left"), (F.array_min(y) + y_offset).alias("top"), F.array_max(x).alias("right"), (F.array_max(y) + y_offset).alias("bottom"))

    return F.transform(named, box)


def entries(boxes: Column | str, texts: Column | str, scores: Column | str) -> Column:
    """array<struct<points,text,score>> of an engine's three lists, as far as all of them go; null lists are empty."""
    boxes, texts, scores = col(boxes), col(texts), col(scores)
    n = F.least(*[F.coalesce(F.size(x), F.lit(0)) for x in (boxes, texts, scores)])
    made = F.transform(F.slice(boxes, F.lit(1), n), lambda b, i: F.struct(b.alias("points"), F.get(texts, i).alias("text"), F.get(scores, i).cast("double").alias("score")))
    return F.coalesce(made, F.array())


def title_region(box: Column, height: Column | str, above: int, below: int) -> Column:
    """struct<x1,y1,x2,y2,empty>: where a table's title is looked for, around the upper edge of a box of clamped_box."""
    y1, y2 = F.greatest(F.lit(0), box["y1"] - above), F.least(col(height), box["y1"] + below)
    return F.struct(box["x1"].alias("x1"), y1.alias("y1"), box["x2"].alias("x2"), y2.alias("y2"), (y2 <= y1).alias("empty"))


def _by(items: Column, *keys) -> Column:
    """items in the order of their keys, then of their places."""
    ranked = F.transform(items, lambda t, i: F.struct(*[k(t).alias(f"k{n}") for n, k in enumerate(keys)], i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(ranked), lambda x: x["t"])


def _middle(t: Column) -> Column:
    return (t["top"] + t["bottom"]) / 2


def anchor(items: Column | str) -> Column:
    """struct<text,left,top,right,bottom,method> of the token that begins the statistics rows, or null."""
    holding = lambda ts, *words: F.filter(ts, lambda t: reduce(lambda a, b: a | b, (F.contains(t["text"], F.lit(x)) for x in words)))
    ordered = let(_by(col(items), lambda t: t["top"]), lambda ts: F.struct(ts.alias("all"), holding(ts, AVERAGE).alias("averages"), holding(ts, YEAR).alias("years"), holding(ts, *LABELS).alias("labels")))
    return let(ordered, _anchor)


def _anchor(s: Column) -> Column:
    averages, years, labels = s["averages"], s["years"], s["labels"]
    year_y, first = _middle(F.get(years, 0)), F.get(averages, 0)
    apart = F.coalesce(F.get(F.filter(averages, lambda t: F.abs(_middle(t) - year_y) > 24), 0), first)
    right = F.coalesce(F.array_max(F.transform(F.concat(labels, averages, years), lambda t: t["right"])), F.lit(160.0)) + 12

    def stands(t: Column, edge: Column) -> Column:
        beside = F.exists(labels, lambda o: (o["top"] > t["top"]) & (_middle(o) - _middle(t)).between(12, 120))
        return t["text"].isin(*WEAK) & (t["right"] <= edge) & (t["left"] <= edge - 24) & F.coalesce(_middle(t) < year_y - 24, F.lit(True)) & beside

    weak = let(right, lambda edge: F.get(F.filter(s["all"], lambda t: stands(t, edge)), 0))

    def named(t: Column, method: str) -> Column:
        return F.struct(*[t[k].alias(k) for k in ("text", "left", "top", "right", "bottom")], F.lit(method).alias("method"))

    above = (F.size(averages) > 0) & (F.size(years) > 0) & (_middle(first) < year_y - 24)
    return (
        F.when(F.size(averages) >= 2, let(apart, lambda t: named(t, "average_anchor")))
        .when(above, named(first, "average_anchor"))
        .when(F.size(averages) > 0, named(first, "average_anchor_fallback"))
        .otherwise(let(weak, lambda t: F.when(t.isNotNull(), named(t, "weak_average_anchor"))))
    )


def _dark_rows(profile: Column, width: Column, share: float, start: Column, end: Column) -> Column:
    rows = F.transform(profile, lambda n, i: F.when((n >= width * share) & (i >= start) & (i < end), i))
    return F.filter(rows, lambda i: i.isNotNull())


def cut_above(profile: Column | str, width: Column | str, anchor_top: Column | str, share: float = 0.6, up: int = 80, down: int = 8) -> Column:
    """One below the last dark row around the anchor's top; null if there is none."""
    profile, top = col(profile), col(anchor_top).cast("int")
    found = F.array_max(_dark_rows(profile, col(width), share, F.greatest(top - up, F.lit(0)), F.least(top + down, F.size(profile)))) + 1
    return F.when(top.isNotNull(), found)


def cut_below(profile: Column | str, width: Column | str, height: Column | str, share: float = 0.6, start: float = 0.6) -> Column:
    """One below the first dark row of the lower part."""
    profile = col(profile)
    return F.array_min(_dark_rows(profile, col(width), share, (col(height) * start).cast("int"), F.size(profile))) + 1


def cut_cascade(profile: Column | str, width: Column | str, height: Column | str) -> Column:
    """struct<cut,method> of the first pair of CASCADE that finds a row."""
    tries = []
    for share, start in CASCADE:
        cut = cut_below(profile, width, height, share, start)
        tries.append(F.when(cut.isNotNull(), F.struct(cut.alias("cut"), F.lit(f"line_fallback_{share:.2f}_{start:.2f}").alias("method"))))
    return F.coalesce(*tries)


def with_buffer(cut: Column | str, height: Column | str, buffer: int = 6) -> Column:
    return F.when(col(cut).isNotNull(), F.least(F.greatest(col(cut) + buffer, F.lit(1)), col(height)))


def crop_cut(profile: Column | str, width: Column | str, height: Column | str, anchor_top: Column | str, recognised: bool = True) -> Column:
    """Where the daily rows end: by the line at the anchor, else the anchor, else (without recognition) the cascade."""
    top = col(anchor_top)
    line = cut_above(profile, width, anchor_top)
    direct = F.when(top.isNotNull(), F.greatest(top.cast("int") - 6, F.lit(1)))
    choices = [line, direct] if recognised else [line, direct, cut_cascade(profile, width, height)["cut"]]
    return with_buffer(F.coalesce(*choices), height)


def clamp(value: Column | str, most: Column | str) -> Column:
    return F.when(col(value).isNotNull(), F.greatest(F.lit(0), F.least(col(value).cast("int"), col(most))))


def clamped_box(box: Column | str, width: Column | str, height: Column | str) -> Column:
    """struct<x1,y1,x2,y2,valid> of array<double> within the page; invalid if nothing is left."""
    box = col(box)
    x1, y1, x2, y2 = (clamp(F.get(box, k), width if k % 2 == 0 else height) for k in range(4))
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), ((x2 > x1) & (y2 > y1)).alias("valid"))


def reading_order(boxes: Column | str) -> Column:
    """array<struct<box:array<double>,...>> by top, then left, as whole numbers."""
    return _by(col(boxes), lambda d: F.get(d["box"], 1).cast("int"), lambda d: F.get(d["box"], 0).cast("int"))


def title_lines(items: Column | str) -> Column:
    """array<string>: tokens merged to lines. A token joins the first line whose mean middle is near enough, else begins one."""
    items = F.transform(col(items), lambda t: F.struct(t["text"].alias("text"), ((t["left"] + t["right"]) / 2).alias("x"), _middle(t).alias("y"), (t["bottom"] - t["top"]).alias("h")))
    ordered = _by(items, lambda t: t["y"], lambda t: t["x"])
    empty = F.expr("CAST(array() AS array<struct<sum:double,n:int,items:array<struct<x:double,i:int,text:string>>>>)")

    def reach(ts: Column) -> Column:
        heights = F.array_sort(F.transform(ts, lambda t: t["h"]))
        return F.greatest(F.lit(10.0), F.least(F.lit(20.0), 0.4 * F.get(heights, F.floor(F.size(ts) / 2).cast("int"))))

    def place(rows: Column, t: Column, far: Column) -> Column:
        item = F.struct(t["x"].alias("x"), F.aggregate(rows, F.lit(0), lambda n, r: n + r["n"]).alias("i"), t["text"].alias("text"))
        new = F.struct(t["y"].alias("sum"), F.lit(1).alias("n"), F.array(item).alias("items"))
        add = lambda r: F.struct((r["sum"] + t["y"]).alias("sum"), (r["n"] + 1).alias("n"), F.concat(r["items"], F.array(item)).alias("items"))
        found = F.array_position(F.transform(rows, lambda r: F.abs(t["y"] - r["sum"] / r["n"]) <= far), True).cast("int")
        return let(found, lambda near: F.when(near > 0, F.transform(rows, lambda r, k: F.when(k == near - 1, add(r)).otherwise(r))).otherwise(F.concat(rows, F.array(new))))

    merged = let(ordered, lambda ts: let(reach(ts), lambda far: F.aggregate(ts, empty, lambda rows, t: place(rows, t, far))))
    rows = _by(merged, lambda r: r["sum"] / r["n"])
    return F.transform(rows, lambda r: F.array_join(F.transform(F.array_sort(r["items"]), lambda x: x["text"]), ""))


def recognised_title(items: Column | str, keyword: str) -> Column:
    """struct<lines,merged,title,success,reason>: the first line that holds the keyword."""
    def result(rows: Column) -> Column:
        title = F.get(F.filter(rows, lambda x: F.contains(x, F.lit(keyword))), 0)
        return F.struct(rows.alias("lines"), F.array_join(rows, "").alias("merged"), title.alias("title"), title.isNotNull().alias("success"), F.when(title.isNull(), "expected_keyword_missing").alias("reason"))

    return let(title_lines(items), result)


def line_positions(height: Column, head: int, row: int, rows: Column) -> Column:
    """Edges of a header of ``head`` and ``rows`` rows of ``row`` pixels, from the top; each once."""
    return F.array_distinct(F.concat(F.array(F.lit(0), F.lit(head)), F.transform(F.sequence(F.lit(1), rows), lambda k: F.least(F.lit(head) + k * row, height))))

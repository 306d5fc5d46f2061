"""Dense numbers in the order of a numeric column, without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PIECE, PIECES, MOST = 250_000, 64, 4096


def _place(value: Column, cuts: list) -> Column:
    """How many cuts are below the value: a tree of comparisons, log2 of them for each row."""
    if not cuts:
        return F.lit(0)
    middle = len(cuts) // 2
    return F.when(value > F.lit(cuts[middle]), F.lit(middle + 1) + _place(value, cuts[middle + 1 :])).otherwise(_place(value, cuts[:middle]))


def numbered(frame: DataFrame, order: str, out: str, *ties: str, pieces: int | None = None) -> DataFrame:
    """frame with out: 0, 1, ... by order, then ties; rows without an order come first.

    Rows are cut at approximate quantiles into pieces (at least PIECES, then one for PIECE rows, MOST in all), which are
    counted, and numbered each on its own. Rows of one order value share a piece.
    """
    wanted = pieces or min(MOST, max(PIECES, frame.count() // PIECE))
    cuts = frame.agg(F.percentile_approx(order, [k / wanted for k in range(1, wanted)])).first()[0] or []
    piece = F.when(F.col(order).isNull(), -1).otherwise(_place(F.col(order), sorted(set(cuts))))
    placed = frame.withColumn("__piece", piece)
    counts = placed.groupBy("__piece").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("__piece", before.alias("__before")))  # a row for each piece
    place = F.row_number().over(Window.partitionBy("__piece").orderBy(F.col(order).asc_nulls_first(), *ties))
    return placed.join(starts, "__piece").withColumn(out, F.col("__before") + place - 1).drop("__piece", "__before")

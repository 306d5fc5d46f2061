"""The test tables as grids, runs, names and tokens: one table of days by months per nation and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridmark.functions.grid import csv_text, latex_text
from gridmark.functions.text import sample_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nk, station, river, y, m, d, token: whole prices of a day's orders of a nation, as text."""
    orders, customer, nation, region = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region"))
    days = orders.select("o_custkey", F.to_date("o_orderdate").alias("day"), F.floor("o_totalprice").cast("long").alias("whole"))
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("station"), F.col("r_name").alias("river"))
    by_nation = days.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k"), "day").agg(F.sum("whole").alias("whole"))
    rows = by_nation.join(nations, F.col("k") == F.col("nk"))
    return rows.select("nk", "station", "river", F.year("day").alias("y"), F.month("day").alias("m"), F.dayofmonth("day").alias("d"), F.col("whole").cast("string").alias("token"))


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nk, station, river, y, name, sample_id, g: 32 rows of 13 cells."""
    pairs = F.map_from_entries(F.collect_list(F.struct((F.col("m") * 100 + F.col("d")).alias("k"), "token")))  # a day of a year is there once
    per = daily_cells(spark, sf_dir).groupBy("nk", "station", "river", "y").agg(pairs.alias("t"))

    def day(d: Column) -> Column:
        cells = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.coalesce(F.try_element_at("t", m * 100 + d), F.lit("")))
        return F.concat(F.array(d.cast("string")), cells)

    head = F.array(F.array(F.lit("D/M"), *[F.lit(str(m)) for m in range(1, 13)]))
    name = F.concat_ws("_", "station", F.col("y").cast("string"), "river")
    return per.select("nk", "station", "river", "y", name.alias("name"), sample_id(name).alias("sample_id"), F.concat(head, F.transform(F.sequence(F.lit(1), F.lit(31)), day)).alias("g"))


def _changed(g: Column, row: int, col: int, make) -> Column:
    return F.transform(g, lambda r, i: F.when(i == row, F.transform(r, lambda c, j: F.when(j == col, make(c)).otherwise(c))).otherwise(r))


def predictions(spark: SparkSession, sf_dir: str, a: int = 31, b: int = 1) -> DataFrame:
    """sample_id, image_path, prediction, target_csv, pos: tables as predicted, spoilt in six ways by nation and year."""
    rows = grids(spark, sf_dir)
    g = F.col("g")
    kind = F.pmod(F.col("nk") * a + F.col("y") * b, F.lit(6))
    text = (
        F.when(kind == 0, latex_text(g))
        .when(kind == 1, latex_text(_changed(g, 5, 3, lambda c: F.concat(F.lit("7"), c))))
        .when(kind == 2, latex_text(F.slice(g, 1, 27)))
        .when(kind == 3, latex_text_ragged(g))
        .when(kind == 4, csv_text(g))
        .otherwise(F.replace(latex_text(g), F.lit("\n"), F.lit(" ")))
    )
    return rows.select("sample_id", F.concat(F.lit("img/"), "name", F.lit(".jpg")).alias("image_path"), text.alias("prediction"), csv_text(g).alias("target_csv"), (F.col("nk") * 10000 + F.col("y")).cast("long").alias("pos"))


def latex_text_ragged(g: Column) -> Column:
    """The grid's LaTeX text, the fourth row without its last cell and the & before it."""
    lines = F.split(latex_text(g), "\n", -1)
    return F.array_join(F.transform(lines, lambda x, i: F.when(i == 8, F.regexp_replace(x, r" & [^&]*$", r" \\\\")).otherwise(x)), "\n")


def labels_and_titles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Label files and page images, a year for each nation; every fifth nation has its title twice, every third inside another."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    n = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("year", (F.lit(1990) + F.col("n_nationkey")).cast("string"))
    csvs = n.select(F.col("n_nationkey").cast("long").alias("csv_pos"), F.col("n_name").alias("station_name"), F.col("r_name").alias("river"), "year")
    title = F.concat(F.when(F.col("n_nationkey") % 3 == 1, "X").otherwise(""), "r_name", "n_name", F.lit("站"))
    copies = F.when(F.col("n_nationkey") % 5 == 0, 2).otherwise(1)
    images = n.select("n_nationkey", "year", title.alias("title_text"), F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    return csvs, images.select((F.col("n_nationkey") * 10 + F.col("copy")).cast("long").alias("image_pos"), "title_text", "year")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, sample_id, prediction of events."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("sample_id"), F.col("event_type").alias("prediction"), "user_id")

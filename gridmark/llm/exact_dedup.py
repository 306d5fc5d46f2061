"""Exact dedup: rows of equal text, found by 128-bit content hash and compared byte by byte.

DataFrame operations only. Steps: (1) hash every text (md5 of the text with A-Z lower-cased) and write id,
hash and SHA-256; (2) count hashes, with map-side combine; (3) for rows whose hash occurs more than once, take
the least and the greatest text of each hash, again combined before the shuffle: they are the same bytes if
and only if all texts of that hash are; (4) hashes whose texts differ (collisions) are grouped by the text itself.

The only joins on a hash are plain shuffled joins between written tables, so that adaptive execution splits
a hash that holds a large part of all rows; texts are shuffled by id, which is never skewed.

Defined results. Null text: as the empty text, and empty texts equal each other. Null id: least of all ids.
Rows that repeat both id and text are one document: each counts in group_size and has the same ``kept``.
Empty table: no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridmark.llm.common import Scratch, lower_ascii, prepare


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hash_of=content_hash) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    keep: which id of equal texts stays, "smallest" or "largest". hash_of: from text column to hash column;
    any function gives the same result, a weaker one more byte comparisons.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "exact-dedup")
    texts = docs.select(F.col(id_col).alias("doc_id"), lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("norm"))
    hashed = scratch.put(texts.select("doc_id", hash_of(F.col("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha")), "hashed")
    files = max(12, hashed.count() // 200_000)  # of tables with a row per group
    # max() skips nulls, which are the least ids: so does the largest, and the smallest is null if any is.
    first = F.max("doc_id") if keep == "largest" else F.when(F.count("doc_id") == F.count(F.lit(1)), F.min("doc_id"))
    groups = scratch.put(hashed.groupBy("h").agg(first.alias("keep_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "groups", files)

    shared = hashed.join(groups.select(F.col("h").alias("gh")), F.col("h") == F.col("gh")).select(F.col("doc_id").alias("sid"), "h").distinct()
    same_row = F.col("doc_id").eqNullSafe(F.col("sid")) & (hash_of(F.col("norm")) == F.col("h"))
    compared = texts.join(shared, same_row).select("doc_id", "h", "norm")
    bytes_of = compared.groupBy("h").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    collided = scratch.put(bytes_of.filter("least <> most").select(F.col("h").alias("ch")), "collided", files)

    joined = hashed.join(groups.withColumnRenamed("h", "gh"), F.col("h") == F.col("gh"), "left")
    alone = F.col("gh").isNull()
    result = joined.select("doc_id", "h", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), "sha")
    if not collided.isEmpty():
        differing = compared.join(collided, F.col("h") == F.col("ch"), "left_semi").withColumn("sha", F.unhex(F.sha2("norm", 256)))
        exact = scratch.put(differing.groupBy("h", "norm").agg(first.alias("keep_id"), F.count(F.lit(1)).alias("group_size")).select("h", "norm", "keep_id", "group_size"), "exact", files)
        split = differing.alias("a").join(exact.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.norm") == F.col("b.norm"))).select("a.doc_id", "a.h", "b.keep_id", "b.group_size", "a.sha")
        result = result.join(collided, F.col("h") == F.col("ch"), "left_anti").unionByName(split)
    return result.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """docs without the rows whose text another row keeps; all columns as they were, whatever their names.

    Rows, not ids, go: a row is known by its id and its text (as it is compared), so that rows that share an id, or have
    none, are judged each by its own text. Rows that repeat both are one document and stay together.
    """
    found = exact_dedup(docs, id_col, text_col, keep).filter("NOT kept")
    gone = found.select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("key")).distinct().alias("g")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    norm = lower_ascii(F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")))
    rows = rows.select("row", F.col(f"row.`{id_col}`").alias("id"), F.unhex(F.sha2(norm, 256)).alias("key")).alias("r")
    return rows.join(gone, F.col("r.id").eqNullSafe(F.col("g.id")) & (F.col("r.key") == F.col("g.key")), "left_anti").select("row.*")

"""Mixing sources to target weights: Pfair scheduling of blocks of documents.

DataFrame operations only. A source with weight w (a share of 1) gets its k-th block (k = 0, 1, ...) a release
time floor(k / w) and a deadline ceil((k + 1) / w). Each slot goes to the released block with the earliest
deadline; as weights sum to 1, every block meets its window, so after any number t of slots each source has
had more than t * w - 1 and fewer than t * w + 1 blocks. Weights are whole shares of a period, after which
the schedule repeats: one period is folded in SQL (``aggregate`` over its slots), and the slot of any block
follows by arithmetic.

Rows are numbered within their source without gathering a source in one task: documents are dealt into about
sqrt(rows) hash buckets, counted per source and bucket, and numbered inside these small groups. Where very many rows
share an id or have none, they are dealt by the hash of the whole row.

One period is one row and one task: slots times sources are its steps, which is meant for up to some thousand sources.

The mix ends when every document has been seen once; a source that runs out before that begins another epoch
(its documents come again), so nothing is left out and shares hold throughout. A block has up to ``block``
documents; the last of an epoch can be shorter. The default weights are counts to the power ``alpha``.

Defined results. Null source: a source of its own. Null id or text: a row as any other. Rows that repeat: each
is placed. A source without a weight in given ``weights`` has no slots, and so no rows. Empty table: no rows.
The order inside a source follows the hash of the id, then the id. Other columns play no part, but where many rows share an id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridmark.llm.common import Scratch, prepare

ALPHA, PERIOD, BLOCK, CROWD = 0.7, 1000, 64, 100_000
_SOURCE_BITS = 24
SMALL = 200_000  # sources and slots of a period whose facts are sent to every task; beyond, these are joined by a shuffle
_NONE = "\x00none"


def _shares(totals: DataFrame, weights: dict | None, alpha: float, period: int) -> DataFrame:
    """src, n, a: blocks of each source in a period of sum(a) slots."""
    if weights is None:
        weighed = totals.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    else:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (_NONE if k is None else str(k), float(v))])
        weighed = totals.withColumn("w", F.try_element_at(given, F.col("src"))).filter("w > 0")
    whole = weighed.groupBy().agg(F.sum("w").alias("all_w"))
    return weighed.crossJoin(F.broadcast(whole)).select("src", "n", F.greatest(F.lit(1), F.round(F.col("w") / F.col("all_w") * period).cast("int")).alias("a"))


def schedule(shares: DataFrame) -> DataFrame:
    """One period: src, a, period, turn (0 to a - 1), slot. shares: a row per source with its blocks a in the period.

    A block is a number, its deadline and then its source, so that the least of those released is the one to go.
    """
    listed = shares.groupBy().agg(F.array_sort(F.collect_list(F.struct("src", "a"))).alias("s")).filter(F.size("s") > 0)
    listed = listed.select("s", F.aggregate("s", F.lit(0).cast("long"), lambda p, x: p + x["a"]).alias("p"))
    sources = listed.select("p", F.posexplode("s").alias("i", "x")).select("p", "i", F.col("x.a").alias("a"))
    k, p, a = F.col("k"), F.col("p"), F.col("a")
    blocks = sources.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), a.cast("long") - 1)))
    number = F.shiftleft(F.ceil((k + 1) * p / a), _SOURCE_BITS).bitwiseOR(F.col("i").cast("long"))
    released = blocks.groupBy(F.floor(k * p / a).alias("r")).agg(F.collect_list(number).alias("blocks"))
    times = listed.select(F.explode(F.sequence(F.lit(0).cast("long"), p - 1)).alias("t"))
    by_time = times.join(released, F.col("t") == F.col("r"), "left").groupBy().agg(F.array_sort(F.collect_list(F.struct("t", "blocks"))).alias("by_time"))

    def step(state: Column, x: Column) -> Column:
        ready = F.concat(state["ready"], F.coalesce(x["blocks"], F.array().cast("array<long>")))
        return F.struct(F.array_remove(ready, F.array_min(ready)).alias("ready"), F.concat(state["out"], F.array(F.array_min(ready))).alias("out"))

    none = F.array().cast("array<long>")
    out = F.aggregate("by_time", F.struct(none.alias("ready"), none.alias("out")), step, lambda x: x["out"])
    slots = listed.crossJoin(by_time).select("s", "p", F.posexplode(out).alias("slot", "b"))  # one row each
    source = F.get("s", F.col("b").bitwiseAND(F.lit((1 << _SOURCE_BITS) - 1)).cast("int"))
    turn = F.floor(F.shiftright("b", _SOURCE_BITS) * source["a"] / p) - 1  # of the deadline ceil((turn + 1) * p / a)
    return slots.select(source["src"].alias("src"), source["a"].alias("a"), p.cast("int").alias("period"), turn.cast("int").alias("turn"), "slot")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict | None = None, block: int = BLOCK, alpha: float = ALPHA, period: int = PERIOD, carry: bool = False, crowd: int = CROWD) -> DataFrame:
    """A row per placement of a row of docs: doc_id, source, epoch, block (of its source), slot, release, deadline, position.

    position orders the whole mix. carry adds ``row``, a struct of all columns of docs. crowd: from so many rows in a
    bucket on, rows are dealt by all they hold instead of by their ids.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "mix")
    src = F.coalesce(F.col(source_col).cast("string"), F.lit(_NONE)).alias("src")
    n_rows = docs.count()
    buckets, files = max(1, math.isqrt(n_rows)), max(12, n_rows // 1_000_000)
    dealt = lambda *of: F.pmod(F.xxhash64(*of), F.lit(buckets)).alias("bucket")
    counted = lambda bucket: docs.select(src, bucket).groupBy("src", "bucket").agg(F.count(F.lit(1)).alias("c"))
    bucket = dealt(F.col(id_col))
    counts = scratch.put(counted(bucket), "counts", files)
    if (counts.agg(F.max("c")).first()[0] or 0) > max(crowd, 4 * buckets):  # an id, or none, that many rows share
        bucket = dealt(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not any(x in kind for x in ("map<", "variant"))])
        counts = scratch.put(counted(bucket), "counts-of-rows", files)
    before = F.sum("c").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = scratch.put(counts.select(F.col("src").alias("s2"), F.col("bucket").alias("b2"), F.coalesce(before, F.lit(0)).alias("before")), "starts", files)
    shares = scratch.put(_shares(counts.groupBy("src").agg(F.sum("c").alias("n")), weights, alpha, period), "shares", files)
    plan = scratch.put(schedule(shares), "plan", files)

    # Slots until every source has had its documents once, and each source's blocks by then.
    blocks = F.ceil(F.col("n") / block).cast("long")
    ends = shares.select("src", "n", "a", blocks.alias("per_epoch")).join(plan.select(F.col("src").alias("ps"), "period", "turn", "slot"), F.col("src") == F.col("ps"))
    whole_turns = F.floor((F.col("per_epoch") - 1) / F.col("a"))
    length = ends.filter(F.pmod(F.col("per_epoch") - 1, F.col("a")) == F.col("turn")).groupBy().agg((F.max(whole_turns * F.col("period") + F.col("slot")) + 1).alias("length"))
    per_source = ends.crossJoin(F.broadcast(length)).groupBy("src", "n", "a", "period", "per_epoch").agg(
        F.max(F.floor(F.col("length") / F.col("period")) * F.col("a")).alias("full"),
        F.sum(F.when(F.col("slot") < F.pmod(F.col("length"), F.col("period")), 1).otherwise(0)).alias("rest"),
        F.array_sort(F.collect_list(F.struct("turn", "slot"))).alias("turns"),
    )
    # At most ``period`` slots plus one for each source, whatever the number of rows.
    facts = scratch.put(per_source.select(F.col("src").alias("fs"), "n", "a", "period", "per_epoch", (F.col("full") + F.col("rest")).alias("blocks"), F.transform("turns", lambda x: x["slot"]).alias("slots")), "facts", files)

    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), src, bucket, *kept)
    rows = rows.join(starts, (F.col("src") == F.col("s2")) & (F.col("bucket") == F.col("b2")))
    rows = rows.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("src", "bucket").orderBy("doc_id")) - 1)
    sent = facts.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("slots")), F.lit(0))).first()[0] <= SMALL
    rows = rows.join(F.broadcast(facts) if sent else facts.hint("merge"), F.col("src") == F.col("fs"))
    own = F.floor(F.col("rank") / block)
    rows = rows.withColumn("own", own).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1 - F.col("own")) / F.col("per_epoch")))))
    k, a, p = F.col("k"), F.col("a"), F.col("period")
    rows = rows.withColumn("k", F.col("epoch") * F.col("per_epoch") + F.col("own"))
    rows = rows.withColumn("slot", F.floor(k / a) * p + F.get("slots", F.pmod(k, a).cast("int")))
    return rows.select(
        "doc_id", "source", "epoch", k.alias("block"), "slot", F.floor(k * p / a).alias("release"), F.ceil((k + 1) * p / a).alias("deadline"),
        (F.col("slot") * block + F.pmod(F.col("rank"), F.lit(block))).alias("position"), *(["row"] if carry else []),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """docs in the proportions of the mix: each row once for each of its placements, with the columns it had."""
    return mix_sources(docs, carry=True, **options).select("row.*")

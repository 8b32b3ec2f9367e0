"""Ordered rows: profiles, intervals, offsets, as-of joins, recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def profile(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Per key: least and greatest value, ascent and descent over consecutive rows."""
    delta = F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_d", delta).groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.sum(F.greatest(F.coalesce("_d", F.lit(0.0)), F.lit(0.0))), 6).alias("ascent"), F.round(F.sum(F.greatest(-F.coalesce("_d", F.lit(0.0)), F.lit(0.0))), 6).alias("descent"))


def merged(rows: DataFrame, key: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Unions of touching or overlapping intervals of each key."""
    w = Window.partitionBy(key).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(reach >= F.col(lo), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return rows.groupBy(key, "_run").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi")).drop("_run")


def gaps(rows: DataFrame, key: str, start: Column, end: Column) -> DataFrame:
    """Parts of [start, end] that no interval of the key covers."""
    parts = merged(rows, key).select(key, "lo", "hi")
    w = Window.partitionBy(key).orderBy("lo")
    before = parts.select(key, F.coalesce(F.lag("hi").over(w), start).alias("lo"), F.col("lo").alias("hi"))
    last = parts.groupBy(key).agg(F.max("hi").alias("lo")).select(key, "lo", end.alias("hi"))
    return before.union(last).where("lo < hi")


def as_of(rows: DataFrame, states: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each row with the last state of its key at or before its time: one sort of both sides together, no pairs."""
    both = rows.select(key, F.col(time).alias("t"), F.lit(1).alias("asks"), F.struct(*rows.columns).alias("row"), F.lit(None).cast(states.schema[value].dataType).alias("state"))
    known = states.select(key, F.col(time).alias("t"), F.lit(0).alias("asks"), F.lit(None).cast(both.schema["row"].dataType).alias("row"), F.col(value).alias("state"))
    w = Window.partitionBy(key).orderBy("t", "asks", "state").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.union(known).withColumn("state", F.last("state", ignorenulls=True).over(w)).where("asks = 1").select("row.*", "state")


def offsets(counts: DataFrame, order: str, count: str) -> DataFrame:
    """Exclusive running count (offsets of a compressed sparse row table), summed in two levels.

    Sums of ranges of the order are summed on their own; only one row per range meets in
    one task, so the running count of a large table is not a single task's sort.
    """
    part = F.floor(F.col(order) / 4096)
    sums = counts.groupBy(part.alias("_part")).agg(F.sum(count).alias("_n"))
    before = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.sum(count).over(Window.partitionBy("_part").orderBy(order)) - F.col(count)
    return counts.withColumn("_part", part).withColumn("_within", within).join(before, "_part").select(order, count, (F.col("_before") + F.col("_within")).alias("offset"))


def recent(rows: DataFrame, key: str, target: str, order: list[str], cap: int = 30) -> DataFrame:
    """Move-to-front lists: distinct targets of each key by their last visit, at most cap of them."""
    last = rows.groupBy(key, target).agg(F.max(F.struct(*order)).alias("at"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("at"), target))
    return last.select(key, target, place.alias("place")).where(F.col("place") <= cap)


def circular_span(intervals: DataFrame, key: str, lo: str, hi: str, period: float) -> DataFrame:
    """Smallest arc of a circle that covers all intervals of a key: start, end, length, wraps.

    The arc is the complement of the widest gap between merged intervals (ties to the
    later gap).  Equal starts are combined before the sort, so a key has at most as many rows as different starts.
    """
    rows = intervals.groupBy(key, F.col(lo).alias("lo")).agg(F.max(hi).alias("hi"))
    w = Window.partitionBy(key).orderBy("lo")
    rows = rows.select(key, "lo", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), "hi")
    ends = rows.groupBy(key).agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.max(F.when(F.expr("before < lo"), F.struct((F.col("lo") - F.col("before")).alias("gap"), F.col("lo").alias("start"), F.col("before").alias("end")))).alias("inner"))
    gap = F.greatest(F.struct((F.col("first") + period - F.col("last")).alias("gap"), F.col("first").alias("start"), F.col("last").alias("end")), "inner")
    found = ends.select(key, gap.alias("g"))
    return found.select(key, (F.col("g.start") % period).alias("arc_start"), (F.col("g.end") % period).alias("arc_end"), (period - F.col("g.gap")).alias("arc_length"), (F.col("g.gap") > 0).__and__(F.col("g.start") > F.col("g.end")).alias("wraps"))


def block_leaders(code: DataFrame, key: str, at: str, leads: str) -> DataFrame:
    """code with leader: the place of the nearest leading instruction at or before each."""
    return code.withColumn("leader", F.last(F.when(F.col(leads), F.col(at)), ignorenulls=True).over(Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)))

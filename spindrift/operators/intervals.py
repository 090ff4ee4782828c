"""Interval algebra.  Merging is associative, so it runs within time buckets first and then over what is left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _merge(df: DataFrame, parts: Sequence[str], slack: int | float) -> DataFrame:
    order = Window.partitionBy(*parts).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") > reach + slack), 1).otherwise(0)
    numbered = df.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*parts, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n")).drop("_island")


def merge_intervals(df: DataFrame, *, keys: Sequence[str], start: str, stop: str, bucket: int, slack: int | float = 0) -> DataFrame:
    """keys, start, stop, n: unions of intervals that overlap or lie at most ``slack`` apart, and how many went in.
    Rows with a null bound or start > stop are left out."""
    rows = df.select(*keys, F.col(start).alias("start"), F.col(stop).alias("stop"), F.lit(1).cast("long").alias("n")).where("start <= stop")
    rows = rows.withColumn("_b", F.floor(F.col("start") / bucket))
    return _merge(_merge(rows, [*keys, "_b"], slack).drop("_b"), list(keys), slack)


def islands(df: DataFrame, *, keys: Sequence[str], at: str, gap: int | float, bucket: int) -> DataFrame:
    """Runs of points at most ``gap`` apart: keys, start, stop, n."""
    return merge_intervals(df.withColumn("_to", F.col(at)), keys=keys, start=at, stop="_to", bucket=bucket, slack=gap)


def gaps_between(merged: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """What lies between the merged intervals of each key: keys, start, stop."""
    order = Window.partitionBy(*keys).orderBy("start")
    return merged.select(*keys, F.col("stop").alias("start"), F.lead("start").over(order).alias("stop")).where("stop is not null and stop > start")


def without(df: DataFrame, holes: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Each row's [lo, hi] minus the union of ``holes`` (keys, start, stop; merged): keys, lo, hi, start, stop.

    Holes meet rows by key; their bounds are the cut points, sorted within each row only.
    """
    cut = df.join(holes, list(keys), "left")
    inside = (F.col("stop") > F.col("lo")) & (F.col("start") < F.col("hi"))
    spans = F.sort_array(F.collect_list(F.when(inside, F.struct(F.greatest("start", "lo").alias("a"), F.least("stop", "hi").alias("b")))))
    rows = cut.groupBy(*keys, "lo", "hi").agg(spans.alias("s"))
    left = F.concat(F.array("lo"), F.transform("s", lambda x: x["b"]))
    right = F.concat(F.transform("s", lambda x: x["a"]), F.array("hi"))
    pieces = rows.select(*keys, "lo", "hi", F.explode(F.arrays_zip(left.alias("start"), right.alias("stop"))).alias("p"))
    return pieces.select(*keys, "lo", "hi", F.col("p.start").alias("start"), F.col("p.stop").alias("stop")).where("stop > start")


def total_length(merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    return merged.groupBy(*keys).agg(F.sum(F.col("stop") - F.col("start")).alias("covered"), F.count(F.lit(1)).alias("pieces"))


def shared_length(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))

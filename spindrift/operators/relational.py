"""Joins by key and time, upserts and top-N, as DataFrame -> DataFrame functions.

Time joins sort instead of comparing pairs: both sides are laid in one order per key and time bucket, and what is
known at a bucket's start comes from a table with one row per key and bucket, so a key with very many rows is dealt
over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest_n(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, place: str = "place") -> DataFrame:
    """The first ``n`` rows of each key in ``order``, with their place from 1.  Spark limits each task's rows first."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(place) <= n)


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which null keys are equal; ``keys`` once."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(other, on).drop(*[f"_r_{k}" for k in keys])


def numbered(df: DataFrame, keys: Sequence[str], time: str, order: Sequence, bucket: int, newest: bool = False, number: str = "number") -> DataFrame:
    """Place of each row from 1 within its key, in ``order`` (by ``time``, falling if ``newest``): places within time
    buckets and the rows of the buckets before, so a key with very many rows is dealt over its buckets."""
    rows = df.withColumn("_b", F.floor(F.col(time) / bucket))
    before = Window.partitionBy(*keys).orderBy(F.desc("_b") if newest else F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    out = joined(rows.withColumn("_own", own), counts, [*keys, "_b"])
    return out.withColumn(number, F.col("_own") + F.col("_before")).drop("_own", "_before", "_b")


def with_previous(df: DataFrame, keys: Sequence[str], time: str, bucket: int, previous: str = "previous") -> DataFrame:
    """Each row with the time of the one before it in its key (null for the first; of equal times one follows the other):
    what comes before within a time bucket, else the last time of the buckets before, one row a bucket."""
    rows = df.withColumn("_b", F.floor(F.col(time) / bucket))
    own = F.lag(time).over(Window.partitionBy(*keys, "_b").orderBy(time))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy(*keys, "_b").agg(F.max(time).alias("_last")).withColumn("_carried", F.max("_last").over(earlier)).drop("_last")
    out = joined(rows.withColumn("_own", own), last, [*keys, "_b"])
    return out.withColumn(previous, F.coalesce("_own", "_carried")).drop("_own", "_carried", "_b")


def in_blocks(df: DataFrame, number: str, back: int, ahead: int, size: int = 4096) -> DataFrame:
    """Rows by ``_block`` of their number, with the rows of the neighbouring blocks that lie up to ``back`` before and
    ``ahead`` after, which are not ``_mine``: windows of that reach over key and block are right for the rows that are."""
    at = lambda d: F.floor((F.col(number) + d) / size)
    return df.withColumn("_block", F.explode(F.sequence(at(-ahead), at(back)))).withColumn("_mine", F.col("_block") == at(0))


def best_of(df: DataFrame, keys: Sequence[str], by: Column, columns: Sequence[str]) -> DataFrame:
    """One row per key: ``columns`` of the row where ``by`` is greatest (partial aggregation, no sort)."""
    row = F.max_by(F.struct(*columns), by).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*")


def asof(left: DataFrame, right: DataFrame, *, key: str, time: str, value: str, bucket: int, forward: bool = False) -> DataFrame:
    """``left`` with ``value`` and ``value_time`` of the last row of ``right`` at or before its time (first at or after
    it if ``forward``).  Nulls where there is none, or where key or time is null; of equal times the greatest value counts.
    """
    sign = -1 if forward else 1
    hit = F.struct((F.col(time) * sign).alias("t"), F.col(value).alias("v"))
    known = right.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(value).isNotNull())
    known = known.select(F.col(key).alias("_k"), (F.col(time) * sign).alias("_t"), F.lit(0).alias("_side"), hit.alias("_hit"))
    asks = left.select(F.col(key).alias("_k"), (F.col(time) * sign).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    both = asks.unionByName(known, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_t") / bucket))
    order = Window.partitionBy("_k", "_b").orderBy("_t", "_side", "_hit").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_own", F.last("_hit", ignorenulls=True).over(order)).where("_side = 1")
    marks = both.groupBy("_k", "_b").agg(F.max("_hit").alias("_hit"))
    earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select("_k", "_b", F.last("_hit", ignorenulls=True).over(earlier).alias("_carried"))
    out = own.join(marks, ["_k", "_b"], "left").withColumn("_found", F.coalesce("_own", "_carried"))
    return out.select("_row.*", F.col("_found.v").alias(value if value not in left.columns else f"{value}_then"), (F.col("_found.t") * sign).alias(f"{value}_time"))


def nearest(left: DataFrame, right: DataFrame, *, key: str, time: str, value: str, within: int, bucket: int, other: str) -> DataFrame:
    """``left`` with the nearest row of ``right`` on either side, at most ``within`` away: ``value`` and ``distance``;
    ``other`` and null where there is none.  Of equal distances the earlier one counts."""
    before = asof(left, right, key=key, time=time, value=value, bucket=bucket).withColumnsRenamed({value: "_v0", f"{value}_time": "_t0"})
    both = asof(before, right, key=key, time=time, value=value, bucket=bucket, forward=True).withColumnsRenamed({value: "_v1", f"{value}_time": "_t1"})
    d0, d1 = F.col(time) - F.col("_t0"), F.col("_t1") - F.col(time)
    first = d0.isNotNull() & (d1.isNull() | (d0 <= d1))
    found = F.when(first, d0).otherwise(d1)
    near = found <= within
    return both.select(*left.columns, F.when(near, F.when(first, F.col("_v0")).otherwise(F.col("_v1"))).otherwise(F.lit(other)).alias(value), F.when(near, found).alias("distance"))


def points_in_intervals(points: DataFrame, intervals: DataFrame, *, key: str, time: str, start: str, stop: str, bucket: int, closed: bool = False) -> DataFrame:
    """Pairs of a point and an interval of the same key with start <= time < stop (<= stop if ``closed``)."""
    spread = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(stop) / bucket))))
    inside = (F.col(time) >= F.col(start)) & ((F.col(time) <= F.col(stop)) if closed else (F.col(time) < F.col(stop)))
    return points.withColumn("_b", F.floor(F.col(time) / bucket)).join(spread.where(F.col(start) <= F.col(stop)), [key, "_b"]).where(inside).drop("_b")


def overlapping(a: DataFrame, b: DataFrame, *, key: str, a_span: tuple[str, str], b_span: tuple[str, str], bucket: int) -> DataFrame:
    """Pairs of intervals of the same key that share more than a point, with ``shared``, what they share.  Each pair is
    found once, in the bucket where both are there first."""
    (a0, a1), (b0, b1) = a_span, b_span

    def spread(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.where(F.col(lo) <= F.col(hi)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))))

    shared = F.least(a1, b1) - F.greatest(a0, b0)
    pairs = spread(a, a0, a1).join(spread(b, b0, b1), [key, "_b"])
    return pairs.withColumn("shared", shared).where((F.col("shared") > 0) & (F.col("_b") == F.floor(F.greatest(a0, b0) / bucket))).drop("_b")


def upsert(base: DataFrame, fresh: DataFrame, keys: Sequence[str], prefer: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Full outer merge: ``prefer`` columns come from ``fresh`` where it has them, ``keep`` columns from ``base``;
    ``origin`` says both, base or fresh."""
    a = base.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in (*prefer, *keep)], F.lit(True).alias("_a"))
    b = fresh.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in (*prefer, *keep)], F.lit(True).alias("_b"))
    origin = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "base").otherwise("fresh")
    new = [F.coalesce(f"_b_{c}", f"_a_{c}").alias(c) for c in prefer] + [F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in keep]
    return a.join(b, list(keys), "full_outer").select(*keys, *new, origin.alias("origin"))


def overlay(live: DataFrame, seed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``live`` and those rows of ``seed`` that none of ``keys`` finds in ``live`` (each key by itself)."""
    rest = seed
    for k in keys:
        rest = rest.join(live.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return live.unionByName(rest.select(live.columns))


def overridden(df: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``df`` with the values of ``columns`` that ``other`` has for its key (one row each) instead of its own."""
    given = other.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns])
    return df.join(given, key, "left").withColumns({c: F.coalesce(f"_o_{c}", c) for c in columns}).drop(*[f"_o_{c}" for c in columns])


def inverted(df: DataFrame, word: str, item: str, block: int = 1 << 16) -> DataFrame:
    """word, block, items: an inverted index in blocks, each item once and in order; a word of very many items has many rows,
    none of more than ``block`` items."""
    rows = df.where(F.col(word).isNotNull() & F.col(item).isNotNull()).select(word, item).distinct().withColumn("block", F.floor(F.col(item) / block))
    return rows.groupBy(word, "block").agg(F.sort_array(F.collect_list(item)).alias("items"))


def first_pairs(left: DataFrame, right: DataFrame, *, key: str, time: str, words: str, within: int) -> DataFrame:
    """key, id, other: of each ``left`` row (key, id, time, words) the ``right`` row of least id of the same key at most ``within`` away
    that shares a word.  Rows meet by key, word and stretch of time, and each word brings its least id only."""
    stretch = F.floor(F.col(time) / within)
    asked = left.select(key, "id", F.col(time).alias("_t"), F.explode(words).alias("_w")).withColumn("_b", F.explode(F.sequence(F.floor((F.col("_t") - within) / within), F.floor((F.col("_t") + within) / within))))
    there = right.select(F.col(key).alias("_k"), F.col("id").alias("other"), F.col(time).alias("_u"), F.explode(words).alias("_v"), stretch.alias("_c"))
    met = asked.join(there, (F.col(key) == F.col("_k")) & (F.col("_w") == F.col("_v")) & (F.col("_b") == F.col("_c"))).where(F.abs(F.col("_t") - F.col("_u")) <= within)
    return met.groupBy(key, "id").agg(F.min("other").alias("other"))

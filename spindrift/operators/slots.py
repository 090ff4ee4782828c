"""Slots of a week for uploads: how many, when, and which of them are filled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import newest_n

HOUR = 3_600_000_000
DAY = 24 * HOUR
WEEK = 7 * DAY
#: A Monday (microseconds), how early an upload may be for its slot, hours between a day's first and last slot.
MONDAY = 4 * DAY
LATE = 2 * HOUR
SPREAD = 6 * HOUR
MOST = 21  # slots of a week: three a day


def week_of(c: Column) -> Column:
    """Number of the week, Monday to Sunday, UTC."""
    return F.floor((c - MONDAY) / WEEK)


def quota(rate: Column, before: Column) -> Column:
    """Uploads of a week: the whole part of the rate, and one more for its fraction if the week before had fewer than the
    rate rounded up."""
    whole = F.floor(rate)
    return whole + F.when((rate > whole) & (before < F.ceil(rate)), 1).otherwise(0)


def week_slots(plans: DataFrame, uploads: DataFrame) -> DataFrame:
    """``key, week, q, slot`` (from 0, by time) and ``at``: each plan's slots from its first week to the last week of any upload
    and the one after.

    ``plans``: key, rate (a week), days (0: Monday), hour, start (microseconds).  The quota carries over: a week that fell short
    asks for the rounded-up rate in the next one.  It is dealt to the days, the first ones more; a day's slots run from
    its hour, six hours back in the afternoon, on in the morning.  At most ``MOST`` a week."""
    counts = uploads.groupBy("key", week_of(F.col("at")).alias("week")).agg(F.count(F.lit(1)).alias("n"))
    last = uploads.agg((F.max(week_of(F.col("at"))) + 1).alias("last"))
    weeks = plans.where(F.size("days") > 0).join(F.broadcast(last)).withColumn("week", F.explode(F.sequence(week_of(F.col("start")), F.greatest(F.col("last"), week_of(F.col("start"))))))
    before = counts.select("key", (F.col("week") + 1).alias("week"), F.col("n").alias("before"))
    weeks = weeks.join(before, ["key", "week"], "left").withColumn("q", F.least(F.lit(MOST), quota(F.col("rate"), F.coalesce("before", F.lit(0)))).cast("long"))
    days = weeks.where("q > 0").select("*", F.posexplode("days").alias("i", "day"))
    n = F.floor(F.col("q") / F.size("days")) + F.when(F.col("i") < F.col("q") % F.size("days"), 1).otherwise(0)
    days = days.withColumn("n", n).where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    sign = F.when(F.col("hour") >= 12, -1).otherwise(1)
    off = F.floor(sign * SPREAD * F.col("k") / F.greatest(F.lit(1), F.col("n") - 1)).cast("long")
    at = MONDAY + F.col("week") * WEEK + F.col("day").cast("long") * DAY + F.col("hour").cast("long") * HOUR + off
    days = days.withColumn("at", at)
    listed = days.groupBy("key", "week", "q", "start").agg(F.array_sort(F.collect_list("at")).alias("ats"))
    return listed.select("key", "week", "q", "start", F.posexplode("ats").alias("slot", "at")).withColumn("slot", F.col("slot").cast("long"))


def matched(slots: DataFrame, uploads: DataFrame, keys: Sequence[str], late: int = LATE) -> DataFrame:
    """keys, slot, id: slots (keys, slot, at) and the uploads (keys, id, at) that fill them, one to one.

    Pairs are taken greedily: uploads at most ``late`` before their slot, or after it, first; then the nearest; then by time
    and id of the upload, then by slot.  A slot can only get one of its best ``MOST`` uploads, as no more can be taken by the
    other slots, so a week of very many uploads comes down to a few pairs before they meet."""
    pairs = slots.select(*keys, "slot", F.col("at").alias("_slot")).join(uploads.select(*keys, "id", F.col("at").alias("_up")), list(keys))
    pairs = pairs.withColumn("order", F.struct((F.col("_slot") > F.col("_up") + late).alias("early"), F.abs(F.col("_up") - F.col("_slot")).alias("off"), F.col("_up").alias("up"), F.col("id").alias("id"), F.col("slot").alias("slot")))
    few = newest_n(pairs, [*keys, "slot"], ["order"], MOST).groupBy(*keys).agg(F.array_sort(F.collect_list("order")).alias("x"), F.first("id").alias("_id"), F.first("slot").alias("_slot"))
    empty = F.array_remove(F.array(F.struct(F.col("_slot").alias("slot"), F.col("_id").alias("id"))), F.struct(F.col("_slot").alias("slot"), F.col("_id").alias("id")))

    def take(done: Column, p: Column) -> Column:
        used = F.exists(done, lambda d: (d["slot"] == p["slot"]) | (d["id"] == p["id"]))
        return F.when(used, done).otherwise(F.concat(done, F.array(F.struct(p["slot"].alias("slot"), p["id"].alias("id")))))

    return few.select(*keys, F.explode(F.aggregate("x", empty, take)).alias("m")).select(*keys, "m.slot", "m.id")


def open_slots(plans: DataFrame, uploads: DataFrame) -> DataFrame:
    """key, week, q, slot, at: slots that no upload fills, from the plan's start on."""
    slots = week_slots(plans, uploads)
    filled = matched(slots, uploads.withColumn("week", week_of(F.col("at"))), ["key", "week"])
    return slots.join(filled.select("key", "week", "slot"), ["key", "week", "slot"], "left_anti").where("at >= start").select("key", "week", "q", "slot", "at")

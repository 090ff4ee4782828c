"""Moments along a recording: shots by place, cutaways in gaps, spikes, kept numbers, rows of equals, best of close ones.

Events are rows of a ``key`` with a time; neighbours are found in blocks of running numbers, so a key with very many rows
is many tasks' work, and only what belongs together (a cluster of close events) meets in one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import islands, merge_intervals
from .relational import asof, in_blocks, joined, numbered, overlapping, points_in_intervals

#: Seconds of a recording's head and tail, of a cutaway, of the slack around a gap.
HEAD, TAIL = 30.0, 20.0
CUTAWAY, BEFORE_GAP, INTO_GAP, AFTER_GAP, EDGE = 2.0, 1.5, 1.0, 1.5, 0.05


def _around(df: DataFrame, keys: Sequence[str], time: str, order: Sequence, bucket: float, back: int, ahead: int) -> tuple[DataFrame, Window]:
    """Rows with ``num``, in blocks with their neighbours; and the window in which these are right for ``_mine`` rows."""
    rows = in_blocks(numbered(df, keys, time, order, bucket, number="num"), "num", back=back, ahead=ahead)
    return rows, Window.partitionBy(*keys, "_block").orderBy("num")


def without_rows_of_equals(df: DataFrame, keys: Sequence[str], time: str, order: Sequence, value: str, bucket: float, most: int = 4, keep: int = 2) -> DataFrame:
    """``df`` without what comes after the first ``keep`` of a row of more than ``most`` equal values.  A row is judged by ``most``
    neighbours on either side, which is all that it takes."""
    rows, w = _around(df, keys, time, order, bucket, most, most)
    same = lambda n: F.lag(value, n).over(w).eqNullSafe(F.col(value)) & F.lag("num", n).over(w).isNotNull() if n > 0 else F.lead(value, -n).over(w).eqNullSafe(F.col(value)) & F.lead("num", -n).over(w).isNotNull()

    def length(sign: int) -> Column:
        """How many equal ones follow on that side, ``most`` at the most."""
        out, run = F.lit(0), F.lit(True)
        for n in range(1, most + 1):
            run = run & same(sign * n)
            out = out + F.when(run, 1).otherwise(0)
        return out

    rows = rows.withColumns({"_back": length(1), "_on": length(-1)}).where("_mine")
    return rows.where(~((F.col("_back") >= keep) & (F.col("_back") + F.col("_on") + 1 > most))).select(*df.columns)


def shot_lengths(cuts: DataFrame, lengths: DataFrame, bucket: float = 600.0) -> DataFrame:
    """key, part, n, median: of the shots between 0, the cuts (key, at) and the end (key, dur), the median length among those
    whose middle is in the first HEAD seconds, the last TAIL, or between."""
    marks = cuts.join(lengths, "key").where("at > 0 and at < dur").select("key", "dur", F.col("at").cast("double").alias("at")).distinct()
    marks = marks.unionByName(lengths.select("key", "dur", F.explode(F.array(F.lit(0.0), F.col("dur").cast("double"))).alias("at")))
    rows, w = _around(marks, ["key"], "at", ["at"], bucket, 0, 1)
    shots = rows.withColumn("to", F.lead("at").over(w)).where("_mine and to is not null")
    middle = (F.col("at") + F.col("to")) / 2
    part = F.when(middle < HEAD, "head").when(middle > F.col("dur") - TAIL, "tail").otherwise("body")
    return shots.groupBy("key", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.percentile(F.col("to") - F.col("at"), F.lit(0.5)).alias("median"))


def cutaways(gaps: DataFrame, cuts: DataFrame, bucket: float = 60.0) -> DataFrame:
    """key, a, b (a gap between what is said) and ``lo, hi``: the first other scene in it, between two cuts in a row at least
    CUTAWAY seconds apart that begin and end about within the gap; what of it lies in the gap is as long too."""
    rows, w = _around(cuts.select("key", F.col("at").cast("double").alias("at")), ["key"], "at", ["at"], bucket * 10, 0, 1)
    pairs = rows.withColumn("to", F.lead("at").over(w)).where("_mine").where(F.col("to") - F.col("at") >= CUTAWAY).select("key", F.col("at").alias("c1"), F.col("to").alias("c2"))
    wide = gaps.withColumns({"_from": F.col("a") - BEFORE_GAP, "_to": F.col("b") - INTO_GAP})
    met = points_in_intervals(pairs, wide.select("key", "a", "b", "_from", "_to"), key="key", time="c1", start="_from", stop="_to", bucket=bucket).where(F.col("c2") <= F.col("b") + AFTER_GAP)
    lo, hi = F.greatest("a", F.col("c1") + EDGE), F.least("b", F.col("c2") - EDGE)
    found = met.withColumns({"lo": lo, "hi": hi}).where(F.col("hi") - F.col("lo") >= CUTAWAY)
    return found.groupBy("key", "a", "b").agg(F.min(F.struct("c1", "lo", "hi")).alias("x")).select("key", "a", "b", "x.lo", "x.hi")


def spikes(signal: DataFrame, talk: DataFrame, *, reach: int, rise: float, least: float, longest: int, slack: int, bucket: int = 4096) -> DataFrame:
    """key, start, stop, top: spikes of a signal (key, i, level: one row a step): at least ``rise`` above the median of ``reach`` steps
    on either side (the ends repeat the first and last level), above ``least``, fewer than ``longest`` steps in a row, and not
    begun within ``slack`` steps of talk (key, a, b: steps)."""
    ends = signal.groupBy("key").agg(F.min_by("level", "i").alias("first"), F.max_by("level", "i").alias("last"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    pad = lambda edge, start: ends.select("key", F.explode(F.sequence(start, start + reach - 1)).alias("i"), F.col(edge).alias("level"), F.lit(True).alias("pad"))
    every = signal.select("key", F.col("i").cast("long").alias("i"), "level", F.lit(False).alias("pad")).unionByName(pad("first", F.col("lo") - reach)).unionByName(pad("last", F.col("hi") + 1))
    rows = in_blocks(every, "i", back=reach, ahead=reach, size=bucket)
    middle = F.expr(f"percentile(level, 0.5) OVER (PARTITION BY key, _block ORDER BY i ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING)")
    hot = rows.withColumn("mid", middle).where("_mine and not pad").where((F.col("level") - F.col("mid") >= rise) & (F.col("level") > least))
    runs = islands(hot, keys=["key"], at="i", gap=1, bucket=bucket).where(F.col("n") < longest)
    spoken = talk.select("key", (F.col("a") - slack).alias("_a"), (F.col("b") + slack).alias("_b2"))
    inside = points_in_intervals(runs, spoken, key="key", time="start", start="_a", stop="_b2", bucket=bucket, closed=True).select("key", "start").distinct()
    quiet = runs.join(inside, ["key", "start"], "left_anti")
    top = points_in_intervals(hot.select("key", "i", "level"), quiet.select("key", "start", "stop"), key="key", time="i", start="start", stop="stop", bucket=bucket, closed=True)
    return top.groupBy("key", "start", "stop").agg(F.max("level").alias("top"))


def assigned_numbers(asked: DataFrame, stored: DataFrame, keys: Sequence[str], time: str, order: Sequence, bucket: int) -> DataFrame:
    """``asked`` (keys, id, want) with ``number``: the one it wants, if that is positive; else the one that is ``stored`` (keys, id,
    number); else the next after all that were ever used or wanted, in order."""
    top = stored.groupBy(*keys).agg(F.max("number").alias("_s")).join(asked.where("want > 0").groupBy(*keys).agg(F.max("want").alias("_w")), list(keys), "full").select(*keys, F.greatest("_s", "_w").alias("_top"))
    known = asked.join(stored.select(*keys, "id", F.col("number").alias("_n")), [*keys, "id"], "left").withColumn("_n", F.when(F.col("want") > 0, F.col("want")).otherwise(F.col("_n")))
    fresh = numbered(known.where("_n is null"), keys, time, order, bucket, number="_k")
    fresh = joined(fresh, asked.select(*keys).distinct().join(top, list(keys), "left"), keys)
    return known.where("_n is not null").select(*asked.columns, F.col("_n").cast("long").alias("number")).unionByName(fresh.select(*asked.columns, (F.coalesce("_top", F.lit(0)) + F.col("_k")).cast("long").alias("number")))


def best_of_close(events: DataFrame, keys: Sequence[str], time: str, score: str, gap: int, bucket: int) -> DataFrame:
    """Events without those closer than ``gap`` to the one kept before, unless their score is higher (then they take its place),
    and ``share``, the score over the key's highest.  Events at least ``gap`` from the one before begin anew, so each such
    cluster is one fold."""
    clusters = islands(events, keys=keys, at=time, gap=gap - 1, bucket=bucket).select(*keys, F.col("start").alias("_start"), F.col("stop").alias("_stop"))
    key = F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys])
    rows = points_in_intervals(events.withColumn("_key", key), clusters.withColumn("_key", key).select("_key", "_start", "_stop"), key="_key", time=time, start="_start", stop="_stop", bucket=bucket, closed=True)
    cell = F.struct(F.col(time).alias("t"), F.col("id").alias("id"), F.col(score).alias("s"))
    each = rows.groupBy(*keys, "_start").agg(F.array_sort(F.collect_list(cell)).alias("x"))
    nothing = F.filter("x", lambda e: F.lit(False))

    def step(kept: Column, e: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        near = last.isNotNull() & (e["t"] - last["t"] < gap)
        better = F.when(e["s"] > last["s"], F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(e))).otherwise(kept)
        return F.when(near, better).otherwise(F.concat(kept, F.array(e)))

    kept = each.select(*keys, F.explode(F.aggregate("x", nothing, step)).alias("e")).select(*keys, F.col("e.t").alias(time), F.col("e.id").alias("id"), F.col("e.s").alias(score))
    top = kept.groupBy(*keys).agg(F.max(score).alias("_top"))
    return joined(kept, top, keys).withColumn("share", F.col(score) / F.col("_top")).drop("_top")


def onsets(signal: DataFrame, talk: DataFrame, *, rise: float = 9.0, least: float = -38.0, back: int = 10, peak: int = 4, tail: tuple[int, int] = (12, 20), fall: float = 8.0, apart: int = 25, bucket: int = 4096) -> DataFrame:
    """key, i: sudden sounds of a signal (key, i, level: one row a step): at least ``rise`` above the least of the ``back`` steps before
    (the first level, where there are fewer), above ``least``, not going on (the mean of the steps ``tail`` after it is ``fall``
    below its peak, if there are such steps), not in talk (key, a, b: steps, both within), and ``apart`` steps after the one
    before at least."""
    first = signal.groupBy("key").agg(F.min_by("level", "i").alias("_first"), F.min("i").alias("_lo"))
    rows = in_blocks(signal.select("key", F.col("i").cast("long").alias("i"), "level"), "i", back=back, ahead=tail[1], size=bucket)
    w = Window.partitionBy("key", "_block").orderBy("i")
    rows = rows.withColumns({"_base": F.min("level").over(w.rowsBetween(-back, -1)), "_peak": F.max("level").over(w.rowsBetween(0, peak - 1)), "_tail": F.avg("level").over(w.rowsBetween(tail[0], tail[1] - 1))}).where("_mine")
    rows = joined(rows, first, ["key"])
    base = F.when(F.col("i") - F.col("_lo") < back, F.least(F.coalesce("_base", "_first"), F.col("_first"))).otherwise(F.col("_base"))
    rows = rows.where((F.col("level") - base >= rise) & (F.col("level") > least) & (F.col("_tail").isNull() | (F.col("_tail") <= F.col("_peak") - fall))).select("key", "i")
    said = points_in_intervals(rows, talk.select("key", "a", "b"), key="key", time="i", start="a", stop="b", bucket=bucket, closed=True).select("key", "i").distinct()
    rows = rows.join(said, ["key", "i"], "left_anti")
    clusters = islands(rows, keys=["key"], at="i", gap=apart - 1, bucket=bucket).select("key", F.col("start").alias("_start"), F.col("stop").alias("_stop"))
    each = points_in_intervals(rows, clusters, key="key", time="i", start="_start", stop="_stop", bucket=bucket, closed=True).groupBy("key", "_start").agg(F.array_sort(F.collect_list("i")).alias("x"))
    step = lambda kept, i: F.when(i - F.coalesce(F.try_element_at(kept, F.lit(-1)), i - apart) < apart, kept).otherwise(F.concat(kept, F.array(i)))
    return each.select("key", F.explode(F.aggregate("x", F.filter("x", lambda i: F.lit(False)), step)).alias("i"))


def smoothed(track: DataFrame, radius: int, bucket: int = 4096) -> DataFrame:
    """key, i, value of a track (key, i, value; null: missing): missing values between the nearest known ones in proportion, beyond
    them the nearest; then means over ``radius`` steps on either side, fewer at the ends, the same number on both.  A track without
    a known value stays null."""
    known = track.where("value is not null").withColumn("_at", F.col("i"))
    both = asof(track.select("key", "i", "value"), known.select("key", "i", F.struct("_at", "value").alias("_p")), key="key", time="i", value="_p", bucket=bucket).drop("_p_time")
    both = asof(both, known.select("key", "i", F.struct("_at", "value").alias("_n")), key="key", time="i", value="_n", bucket=bucket, forward=True).drop("_n_time")
    p, n = F.col("_p"), F.col("_n")
    between = p["value"] + (n["value"] - p["value"]) * (F.col("i") - p["_at"]) / F.nullif(n["_at"] - p["_at"], F.lit(0))
    filled = both.select("key", "i", F.coalesce("value", F.coalesce(between, p["value"], n["value"])).alias("value"))
    ends = track.groupBy("key").agg(F.min("i").alias("_lo"), F.max("i").alias("_hi"))
    rows = joined(in_blocks(filled, "i", back=radius, ahead=radius, size=bucket), ends, ["key"])
    w = Window.partitionBy("key", "_block").orderBy("i")
    reach = F.least(F.lit(radius), F.col("i") - F.col("_lo"), F.col("_hi") - F.col("i"))
    means = F.array(*[F.avg("value").over(w.rowsBetween(-r, r)) for r in range(radius + 1)])
    return rows.withColumn("_m", means).where("_mine").select("key", "i", F.get("_m", reach.cast("int")).alias("value"))


def montages(cuts: DataFrame, music: DataFrame, talk: DataFrame, *, span: int, least: int = 5, level: float = 0.3, quiet: float = 0.3, bucket: int) -> DataFrame:
    """key, start, stop: rows of quick cuts (key, at): at least ``least`` within ``span`` of one, with music (key, at, level: its mean in
    the span above ``level``) and talk (key, a, b) over less than ``quiet`` of it, to the last of these cuts.  Quick cuts that begin
    before a montage's end carry it on, whatever is heard."""
    marks = cuts.select("key", "at").distinct()
    spread = marks.withColumn("_b", F.explode(F.sequence(F.floor(F.col("at") / bucket), F.floor((F.col("at") + span) / bucket))))
    later = marks.select("key", F.col("at").alias("to"), F.floor(F.col("at") / bucket).alias("_b"))
    met = spread.join(later, ["key", "_b"]).where((F.col("to") >= F.col("at")) & (F.col("to") <= F.col("at") + span))
    quick = met.groupBy("key", "at").agg(F.count(F.lit(1)).alias("n"), F.max("to").alias("last")).where(F.col("n") >= least).withColumn("_end", F.col("at") + span)
    heard = points_in_intervals(music.select("key", F.col("at").alias("_m"), "level"), quick.select("key", "at", "_end"), key="key", time="_m", start="at", stop="_end", bucket=bucket, closed=True)
    loud = heard.groupBy("key", "at").agg(F.avg("level").alias("music"))
    merged = merge_intervals(talk, keys=["key"], start="a", stop="b", bucket=bucket).select("key", "start", "stop")
    said = overlapping(quick.select("key", "at", "_end"), merged, key="key", a_span=("at", "_end"), b_span=("start", "stop"), bucket=bucket).groupBy("key", "at").agg(F.sum("shared").alias("said"))
    rows = quick.join(loud, ["key", "at"], "left").join(said, ["key", "at"], "left")
    fine = (F.coalesce("music", F.lit(0.0)) > level) & (F.coalesce("said", F.lit(0)) < quiet * span)
    rows = rows.select("key", "at", "last", fine.alias("fine"))
    # cuts that overlap one another may carry on a montage: only these meet
    groups = merge_intervals(rows, keys=["key"], start="at", stop="last", bucket=bucket).select("key", F.col("start").alias("_s"), F.col("stop").alias("_t"))
    each = points_in_intervals(rows, groups, key="key", time="at", start="_s", stop="_t", bucket=bucket, closed=True).groupBy("key", "_s").agg(F.array_sort(F.collect_list(F.struct("at", "last", "fine"))).alias("x"))
    nothing = F.transform(F.filter("x", lambda c: F.lit(False)), lambda c: F.struct(c["at"].alias("a"), c["last"].alias("b")))

    def step(found: Column, c: Column) -> Column:
        end = F.try_element_at(found, F.lit(-1))
        new = F.struct(c["at"].alias("a"), c["last"].alias("b"))
        on = F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(F.struct(end["a"].alias("a"), F.greatest(end["b"], c["last"]).alias("b"))))
        return F.when(end.isNotNull() & (c["at"] < end["b"]), on).when(c["fine"], F.concat(found, F.array(new))).otherwise(found)

    return each.select("key", F.explode(F.aggregate("x", nothing, step)).alias("m")).select("key", F.col("m.a").alias("start"), F.col("m.b").alias("stop"))


def quiet_drift(history: DataFrame, uploads: DataFrame, *, apart: int, week: int, bucket: int) -> DataFrame:
    """key, pairs, drift: how much a count (key, at, subs) changes a week by itself: the median over records in a row at least
    ``apart`` with no upload (key, at) after the one and up to the other; 0 at least, and 0 without such a pair."""
    rows, w = _around(history.where("subs is not null and at is not null").select("key", "at", "subs"), ["key"], "at", ["at", "subs"], bucket, 1, 0)
    pairs = rows.withColumns({"_at": F.lag("at").over(w), "_subs": F.lag("subs").over(w)}).where("_mine").where(F.col("at") - F.col("_at") >= apart)
    # the last upload at or before a record's end tells whether there was one since its start
    known = uploads.select("key", "at", F.col("at").alias("_up")).where("at is not null")
    seen = asof(pairs.select("key", "at", "subs", "_at", "_subs"), known, key="key", time="at", value="_up", bucket=bucket)
    still = seen.where(F.col("_up").isNull() | (F.col("_up") <= F.col("_at")))
    drift = still.groupBy("key").agg(F.count(F.lit(1)).alias("pairs"), F.percentile((F.col("subs") - F.col("_subs")) / ((F.col("at") - F.col("_at")) / F.lit(week)), F.lit(0.5)).alias("_d"))
    return history.select("key").distinct().join(drift, "key", "left").select("key", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.greatest(F.lit(0.0), F.coalesce("_d", F.lit(0.0))).alias("drift"))

"""Profiles of channels: newest-N, quantiles, spread, cadence, ranks, shares."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import stats
from ..operators.relational import best_of, in_blocks, newest_n, numbered, with_previous
from ..sources.tables import DAY, VIDEOS, table, videos
from .registry import SQL, query

RECENT = 30
R = lambda c: F.round(c, 6)


def recent(spark, sf_dir, n=RECENT):
    rows = newest_n(videos(spark, sf_dir), ["channel", "fmt"], [F.desc("pub"), "id"], n)
    return rows.withColumn("pos", F.col("place") - 1).drop("place")


@query("w7_newest_n", f"WITH {VIDEOS} SELECT channel, fmt, id, pos + 1 AS place FROM v WHERE pos < 15")
def w7(spark, sf_dir):
    return newest_n(videos(spark, sf_dir), ["channel", "fmt"], [F.desc("pub"), "id"], 15).select("channel", "fmt", "id", "place")


@query("o5_top3", f"WITH {VIDEOS} SELECT channel, fmt, id, views, place FROM (SELECT *, row_number() OVER (PARTITION BY channel, fmt ORDER BY views DESC, pos) AS place FROM v WHERE pos < 30) WHERE place <= 3")
def o5(spark, sf_dir):
    return newest_n(recent(spark, sf_dir), ["channel", "fmt"], [F.desc("views"), "pos"], 3).select("channel", "fmt", "id", "views", "place")


@query("o7_best_video", f"WITH {VIDEOS} SELECT channel, id, views FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY views DESC, id) AS k FROM v) WHERE k = 1")
def o7(spark, sf_dir):
    return best_of(videos(spark, sf_dir), ["channel"], F.struct("views", -F.col("id")), ["id", "views"])


@query(
    "a7_channel_profile",
    f"""WITH {VIDEOS} SELECT v.channel, v.fmt, count(*) AS n30, round(median(views), 6) AS median, round(avg(views), 6) AS mean, round(quantile_cont(views, 0.9), 6) AS p90,
    round(median(views) FILTER (WHERE pos < 15), 6) AS median15, max(views) AS top, round(median(views) / any_value(c_acctbal), 6) AS reach
    FROM v LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = channel WHERE pos < 30 AND views > 0 GROUP BY v.channel, v.fmt""",
)
def a7(spark, sf_dir):
    subs = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("channel"), F.col("c_acctbal").alias("subs"))
    rows = recent(spark, sf_dir).where(stats.valid("views"))
    out = rows.groupBy("channel", "fmt").agg(
        F.count(F.lit(1)).alias("n30"), stats.median("views").alias("m"), R(F.avg("views")).alias("mean"), R(F.percentile("views", F.lit(0.9))).alias("p90"),
        R(F.expr("percentile(views, 0.5) FILTER (WHERE pos < 15)")).alias("median15"), F.max("views").alias("top"),
    )
    out = out.join(subs, "channel", "left")
    return out.select("channel", "fmt", "n30", R("m").alias("median"), "mean", "p90", "median15", "top", R(F.col("m") / F.col("subs")).alias("reach"))


@query(
    "a2_deciles",
    "WITH d AS (SELECT event_type AS fmt, quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM events GROUP BY 1) SELECT fmt, k::BIGINT AS decile, round(q[k], 6) AS value FROM d, range(1, 10) r(k)",
)
def a2(spark, sf_dir):
    got = stats.exact_quantiles(videos(spark, sf_dir), ["fmt"], "views", [k / 10 for k in range(1, 10)])
    return got.select("fmt", F.round(F.col("share") * 10).cast("long").alias("decile"), R("quantile").alias("value"))


@query("a3_index_quantile", f"WITH {VIDEOS} SELECT channel, fmt, list_sort(list(views))[(floor(count(*) * 0.5) + 1)::INT] AS upper_median, list_sort(list(views))[(floor(count(*) * 0.75) + 1)::INT] AS p75 FROM v WHERE pos < 30 GROUP BY channel, fmt")
def a3(spark, sf_dir):
    rows = recent(spark, sf_dir).groupBy("channel", "fmt").agg(F.collect_list("views").alias("x"))
    return rows.select("channel", "fmt", stats.index_quantile(F.col("x"), 0.5).alias("upper_median"), stats.index_quantile(F.col("x"), 0.75).alias("p75"))


@query("a4_spread", "SELECT event_type AS fmt, round(stddev_samp(value), 6) AS sd1, round(stddev_pop(value), 6) AS sd0, round(sqrt(var_pop(value) * count(*) / (count(*) - 2)), 6) AS sd2 FROM events GROUP BY 1")
def a4(spark, sf_dir):
    n = F.count(F.lit(1))
    return videos(spark, sf_dir).groupBy("fmt").agg(R(F.stddev_samp("views")).alias("sd1"), R(F.stddev_pop("views")).alias("sd0"), R(F.sqrt(F.var_pop("views") * n / (n - 2))).alias("sd2"))


@query(
    "a5_robust_z",
    """WITH m AS (SELECT event_type AS fmt, median(value) AS med FROM events GROUP BY 1), d AS (SELECT event_type AS fmt, median(abs(value - med)) AS mad FROM events JOIN m ON fmt = event_type GROUP BY 1)
    SELECT event_id AS id, round((value - med) / (1.4826 * mad + 1e-3), 6) AS z FROM events JOIN m ON m.fmt = event_type JOIN d ON d.fmt = event_type""",
)
def a5(spark, sf_dir):
    return stats.robust_z(videos(spark, sf_dir), ["fmt"], "views").select("id", R("z").alias("z"))


@query(
    "a6_cadence",
    f"""WITH {VIDEOS}, e AS (SELECT max(pub) AS now FROM v),
    g AS (SELECT channel, fmt, pub, (lag(pub) OVER (PARTITION BY channel ORDER BY pub DESC, id) - pub) / 86400e6 AS gap, now FROM v, e)
    SELECT channel, count(*) AS n, round(count(*) FILTER (WHERE now - pub <= 90 * 86400000000) / (least(90.0, greatest(7.0, (any_value(now) - min(pub)) / 86400e6)) / 7), 6) AS per_week,
    round(count(*) FILTER (WHERE fmt = 'view' AND now - pub <= 90 * 86400000000) / (least(90.0, greatest(7.0, (any_value(now) - min(pub)) / 86400e6)) / 7), 6) AS views_per_week,
    round(count(*) FILTER (WHERE fmt = 'click' AND now - pub <= 90 * 86400000000) / (least(90.0, greatest(7.0, (any_value(now) - min(pub)) / 86400e6)) / 7), 6) AS clicks_per_week,
    floor((any_value(now) - max(pub)) / 86400e6)::BIGINT AS last_days, CASE WHEN count(gap) >= 3 AND avg(gap) > 0 THEN round(stddev_pop(gap) / avg(gap), 6) END AS cv,
    CASE WHEN (any_value(now) - max(pub)) / 86400e6 <= 14 THEN 'active' WHEN (any_value(now) - max(pub)) / 86400e6 <= 45 THEN 'slow' WHEN (any_value(now) - max(pub)) / 86400e6 <= 180 THEN 'rare' ELSE 'stopped' END AS activity
    FROM g GROUP BY channel HAVING count(*) >= 3""",
)
def a6(spark, sf_dir):
    rows = videos(spark, sf_dir)
    now = rows.agg(F.max("pub")).first()[0] or 0
    gap = (F.col("pub") - F.col("previous")) / DAY
    age = lambda c: (F.lit(now) - c) / DAY
    late = lambda test: F.sum((test & (F.lit(now) - F.col("pub") <= 90 * DAY)).cast("long"))
    out = with_previous(rows, ["channel"], "pub", 7 * DAY).withColumn("gap", gap).groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"), late(F.lit(True)).alias("in90"), late(F.col("fmt") == "view").alias("views90"), late(F.col("fmt") == "click").alias("clicks90"), age(F.min("pub")).alias("oldest"),
        age(F.max("pub")).alias("last"), F.count("gap").alias("gaps"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("sd_gap"),
    )
    span = F.least(F.lit(90.0), F.greatest(F.lit(7.0), F.col("oldest"))) / 7
    cv = F.when((F.col("gaps") >= 3) & (F.col("mean_gap") > 0), R(F.col("sd_gap") / F.col("mean_gap")))
    activity = F.when(F.col("last") <= 14, "active").when(F.col("last") <= 45, "slow").when(F.col("last") <= 180, "rare").otherwise("stopped")
    return out.where("n >= 3").select("channel", "n", R(F.col("in90") / span).alias("per_week"), R(F.col("views90") / span).alias("views_per_week"), R(F.col("clicks90") / span).alias("clicks_per_week"), F.floor("last").alias("last_days"), cv.alias("cv"), activity.alias("activity"))


@query(
    "a8_group_summary",
    f"""WITH {VIDEOS}, p AS (SELECT channel, fmt, median(views) AS m FROM v WHERE pos < 30 GROUP BY 1, 2)
    SELECT c_mktsegment AS grp, fmt, count(*) AS channels, round(median(m), 6) AS median, round(quantile_cont(m, 0.75), 6) AS p75 FROM p JOIN customer ON c_custkey = channel GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def a8(spark, sf_dir):
    groups = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel"), F.col("c_mktsegment").alias("grp"))
    each = recent(spark, sf_dir).groupBy("channel", "fmt").agg(stats.median("views").alias("m")).join(groups, "channel")
    return each.groupBy("grp", "fmt").agg(F.count(F.lit(1)).alias("channels"), R(stats.median("m")).alias("median"), R(F.percentile("m", F.lit(0.75))).alias("p75")).where("channels >= 2")


@query("a15_counts_rollup", "SELECT coalesce(event_type, 'all') AS kind, coalesce(user_id, -1) AS channel, count(*) AS n FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL GROUP BY ROLLUP (event_type, user_id)")
def a15(spark, sf_dir):
    rows = videos(spark, sf_dir).where("fmt is not null and channel is not null")
    return rows.rollup(F.col("fmt").alias("f"), F.col("channel").alias("c")).agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("f", F.lit("all")).alias("kind"), F.coalesce("c", F.lit(-1)).alias("channel"), "n")


@query(
    "a16_weighted_vote",
    """WITH s AS (SELECT user_id AS channel, event_type AS fmt, sum(round(value * 100)::BIGINT) AS w, min(event_id) AS f FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY w DESC, f) AS k FROM s)
    SELECT channel, max(fmt) FILTER (WHERE k = 1) AS fmt, round(max(w) FILTER (WHERE k = 1) / sum(w), 6) AS share, max(fmt) FILTER (WHERE k = 2) AS runner_up FROM r GROUP BY channel""",
)
def a16(spark, sf_dir):
    rows = videos(spark, sf_dir).withColumn("w", F.round(F.col("views") * 100).cast("long"))
    return stats.weighted_vote(rows, ["channel"], "fmt", "w", "id").withColumn("share", R("share"))


@query("a17_weighted_means", "SELECT event_type AS fmt, round(sum(value * event_id) / sum(event_id), 6) AS weighted, round(10 * log10(sum(event_id * pow(10, value / 1000)) / sum(event_id)), 6) AS energy FROM events GROUP BY 1")
def a17(spark, sf_dir):
    w = F.col("id")
    return videos(spark, sf_dir).groupBy("fmt").agg(R(F.sum(F.col("views") * w) / F.sum(w)).alias("weighted"), R(10 * F.log10(F.sum(w * F.pow(F.lit(10.0), F.col("views") / 1000)) / F.sum(w))).alias("energy"))


@query(
    "a18_quantile_barycentre",
    """WITH d AS (SELECT user_id AS channel, event_type AS fmt, count(*) AS n, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM events GROUP BY 1, 2)
    SELECT fmt, k::BIGINT AS place, round(sum(n * q[k]) / sum(n), 6) AS value FROM d, range(1, 4) r(k) GROUP BY 1, 2""",
)
def a18(spark, sf_dir):
    each = videos(spark, sf_dir).groupBy("channel", "fmt").agg(F.count(F.lit(1)).alias("n"), F.percentile("views", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    rows = each.select("fmt", "n", F.posexplode("q").alias("k", "x"))
    return rows.groupBy("fmt", "k").agg(R(F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("value")).select("fmt", (F.col("k") + 1).cast("long").alias("place"), "value")


@query("a19_weighted_mode", "SELECT p_brand AS brand, p_type AS kind FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY sum(p_size) DESC, p_type) AS k FROM part GROUP BY 1, 2) WHERE k = 1")
def a19(spark, sf_dir):
    sums = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.sum("p_size").alias("w"))
    return newest_n(sums, ["p_brand"], [F.desc("w"), "p_type"], 1).select(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))


@query("a30_progress", "SELECT o_custkey AS name, count(*) AS n, bool_or(o_orderstatus = 'F') AS done, bool_or(o_orderpriority = '1-URGENT') AS urgent, max(o_totalprice) AS top FROM orders GROUP BY 1")
def a30(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("o_orderstatus") == "F").alias("done"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.max("o_totalprice").alias("top"))


@query(
    "a20_post_hour",
    """WITH h AS (SELECT event_type AS fmt, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2), a AS (SELECT f.fmt, r.h, sum(coalesce(n, 0)) AS c FROM (SELECT DISTINCT event_type AS fmt FROM events) f, range(24) r(h), (VALUES (-1), (0), (1)) d(d)
    LEFT JOIN h ON h.fmt = f.fmt AND h.h = (r.h + d.d + 24) % 24 GROUP BY 1, 2) SELECT fmt, h::BIGINT AS hour, c::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY fmt ORDER BY c DESC, abs(h - 18), h DESC) AS k FROM a) WHERE k = 1""",
)
def a20(spark, sf_dir):
    hour = F.hour(F.timestamp_micros("pub"))
    near = videos(spark, sf_dir).groupBy("fmt", hour.alias("h")).agg(F.count(F.lit(1)).alias("n")).select("fmt", "n", F.explode(F.array(*[F.pmod(F.col("h") + d, F.lit(24)) for d in (-1, 0, 1)])).alias("h"))
    sums = near.groupBy("fmt", "h").agg(F.sum("n").alias("n"))
    return newest_n(sums, ["fmt"], [F.desc("n"), F.abs(F.col("h") - 18), F.desc("h")], 1).select("fmt", F.col("h").cast("long").alias("hour"), "n")


@query("w19_weekly_counts", "SELECT date_trunc('week', o_orderdate + INTERVAL 9 HOUR)::DATE AS week, count(*) AS n FROM orders GROUP BY 1")
def w19(spark, sf_dir):
    local = F.col("o_orderdate").cast("timestamp") + F.expr("interval 9 hours")
    return table(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("week", local)).alias("week")).agg(F.count(F.lit(1)).alias("n"))


@query("s31_daily_ledger", "SELECT ((ts - INTERVAL 8 HOUR))::DATE AS day, event_type AS op, sum(round(value * 100)::BIGINT)::BIGINT AS cost FROM events GROUP BY 1, 2")
def s31(spark, sf_dir):
    day = F.to_date(F.from_utc_timestamp(F.timestamp_micros("pub"), "America/Los_Angeles"))
    return videos(spark, sf_dir).groupBy(day.alias("day"), F.col("fmt").alias("op")).agg(F.sum(F.round(F.col("views") * 100).cast("long")).alias("cost"))


@query(
    "w2_resumed",
    f"""WITH {VIDEOS}, k AS (SELECT *, lag(pub) OVER (PARTITION BY channel ORDER BY pub, id) AS before FROM v)
    SELECT channel, max(pub) AS resumed, max(pub - before) AS longest FROM k WHERE pub - before > 86400000000 GROUP BY channel""",
)
def w2(spark, sf_dir):
    gaps = with_previous(videos(spark, sf_dir), ["channel"], "pub", 7 * DAY).withColumn("gap", F.col("pub") - F.col("previous")).where(F.col("gap") > DAY)
    return gaps.groupBy("channel").agg(F.max("pub").alias("resumed"), F.max("gap").alias("longest"))


@query(
    "a28_checkup",
    f"""WITH {VIDEOS}, e AS (SELECT max(pub) AS now FROM v), r AS (SELECT * FROM (SELECT v.*, row_number() OVER (PARTITION BY channel, fmt ORDER BY pos) AS k FROM v, e WHERE now - pub >= 7 * 86400000000) WHERE k <= 10)
    SELECT channel, fmt, count(*) AS ripe, round(median(views), 6) AS median, round(quantile_cont(views, 0.25), 6) AS p25 FROM r GROUP BY 1, 2""",
)
def a28(spark, sf_dir):
    rows = videos(spark, sf_dir)
    now = rows.agg(F.max("pub")).first()[0] or 0
    ripe = newest_n(rows.where(F.col("pub") <= now - 7 * DAY), ["channel", "fmt"], [F.desc("pub"), "id"], 10)
    return ripe.groupBy("channel", "fmt").agg(F.count(F.lit(1)).alias("ripe"), R(stats.median("views")).alias("median"), R(F.percentile("views", F.lit(0.25))).alias("p25"))


@query("w10_position_stats", "SELECT channel, part, count(*) AS n, round(median(views), 6) AS median FROM (SELECT user_id AS channel, value AS views, CASE WHEN day(ts) <= 10 THEN 'head' WHEN day(ts) > 20 THEN 'tail' ELSE 'body' END AS part FROM events) GROUP BY 1, 2")
def w10(spark, sf_dir):
    d = F.dayofmonth(F.timestamp_micros("pub"))
    part = F.when(d <= 10, "head").when(d > 20, "tail").otherwise("body")
    return videos(spark, sf_dir).groupBy("channel", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), R(stats.median("views")).alias("median"))


@query("w13_first_seen", "SELECT user_id AS channel, event_type AS fmt, min(epoch_us(ts)) AS first_seen, max(epoch_us(ts)) AS last_seen FROM events GROUP BY 1, 2")
def w13(spark, sf_dir):
    return videos(spark, sf_dir).groupBy("channel", "fmt").agg(F.min("pub").alias("first_seen"), F.max("pub").alias("last_seen"))


@query("w18_max_normalised", "SELECT event_id AS id, round(value / m, 6) AS share FROM events JOIN (SELECT event_type AS k, max(value) AS m FROM events GROUP BY 1) ON k = event_type")
def w18(spark, sf_dir):
    rows = videos(spark, sf_dir)
    top = rows.groupBy("fmt").agg(F.max("views").alias("m"))
    return rows.join(top, "fmt").select("id", R(F.col("views") / F.col("m")).alias("share"))


@query(
    "w17_montage",
    f"""WITH {VIDEOS} SELECT channel, id, n FROM (SELECT channel, id, pos, count(*) OVER (PARTITION BY channel ORDER BY pub RANGE BETWEEN CURRENT ROW AND 21600000000 FOLLOWING) AS n FROM v) WHERE n >= 3""",
)
def w17(spark, sf_dir):
    ahead = Window.partitionBy("channel").orderBy("pub").rangeBetween(0, 6 * DAY // 24)
    return videos(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(ahead)).where("n >= 3").select("channel", "id", "n")


@query("w1_neighbour_residual", f"WITH {VIDEOS} SELECT channel, fmt, id, round(coalesce(ln(views) - quantile_cont(ln(views), 0.5) OVER (PARTITION BY channel, fmt ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING EXCLUDE CURRENT ROW), 0), 6) AS resid FROM v WHERE pos < 120 AND views > 0")
def w1(spark, sf_dir):
    rows = recent(spark, sf_dir, 120).where(stats.valid("views"))
    return stats.neighbour_residual(rows, keys=["channel", "fmt"], order=["pos"], value="views").select("channel", "fmt", "id", R("resid").alias("resid"))


@query("o8_retention", "SELECT o_custkey AS name, o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k <= 5")
def o8(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return newest_n(rows, ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"], 5).select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("id"))


@query("o2_recency", "SELECT c_custkey AS name, greatest(max(o_orderdate), max(l_shipdate)) AS recent FROM customer JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def o2(spark, sf_dir):
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate").join(shipped, "o_orderkey", "left")
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"))
    return known.join(rows.groupBy(F.col("o_custkey").alias("name")).agg(F.greatest(F.max("o_orderdate"), F.max("shipped")).alias("recent")), "name")


# Registered a second time under the names of the time when the first ones still cut rows.
def _near(spark, sf_dir, reach):
    return in_blocks(numbered(videos(spark, sf_dir), ["channel", "fmt"], "pub", [F.desc("pub"), "id"], DAY, newest=True), "number", reach, reach)


_BLOCK = ["channel", "fmt", "_block"]


@query("w14_sequence_numbers_whole", f"WITH {VIDEOS} SELECT channel, id, row_number() OVER (PARTITION BY channel ORDER BY pub, id) AS number FROM v")
@query("w14_sequence_numbers", f"WITH {VIDEOS} SELECT channel, id, row_number() OVER (PARTITION BY channel ORDER BY pub, id) AS number FROM v")
def w14(spark, sf_dir):
    return numbered(videos(spark, sf_dir), ["channel"], "pub", ["pub", "id"], DAY).select("channel", "id", "number")


@query("w3_trailing_minimum_whole", f"WITH {VIDEOS} SELECT channel, fmt, id, round(views - min(views) OVER (PARTITION BY channel, fmt ORDER BY pos DESC ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS rise FROM v")
@query("w3_trailing_minimum", f"WITH {VIDEOS} SELECT channel, fmt, id, round(views - min(views) OVER (PARTITION BY channel, fmt ORDER BY pos DESC ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS rise FROM v")
def w3(spark, sf_dir):
    low = F.min("views").over(Window.partitionBy(*_BLOCK).orderBy(F.desc("number")).rowsBetween(-10, -1))
    return _near(spark, sf_dir, 10).withColumn("rise", R(F.col("views") - low)).where("_mine").select("channel", "fmt", "id", "rise")


@query("w16_rolling_median_whole", f"WITH {VIDEOS} SELECT channel, fmt, id, round(views - quantile_cont(views, 0.5) OVER (PARTITION BY channel, fmt ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS spike FROM v")
@query("w16_rolling_median", f"WITH {VIDEOS} SELECT channel, fmt, id, round(views - quantile_cont(views, 0.5) OVER (PARTITION BY channel, fmt ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS spike FROM v")
def w16(spark, sf_dir):
    mid = F.expr("percentile(views, 0.5) OVER (PARTITION BY channel, fmt, _block ORDER BY number ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
    return _near(spark, sf_dir, 2).withColumn("spike", R(F.col("views") - mid)).where("_mine").select("channel", "fmt", "id", "spike")


@query("w11_moving_average_whole", f"WITH {VIDEOS} SELECT channel, fmt, id, round(avg(views) OVER (PARTITION BY channel, fmt ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM v")
@query("w11_moving_average", f"WITH {VIDEOS} SELECT channel, fmt, id, round(avg(views) OVER (PARTITION BY channel, fmt ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM v")
def w11(spark, sf_dir):
    mean = F.avg("views").over(Window.partitionBy(*_BLOCK).orderBy("number").rowsBetween(-2, 2))
    return _near(spark, sf_dir, 2).withColumn("smooth", R(mean)).where("_mine").select("channel", "fmt", "id", "smooth")


@query("j1_ordered_lookup_whole", f"WITH {VIDEOS} SELECT channel, pos, c_name AS label, views FROM v JOIN customer ON c_custkey = channel WHERE pos < {RECENT}")
@query("j1_ordered_lookup", f"WITH {VIDEOS} SELECT channel, pos, c_name AS label, views FROM v JOIN customer ON c_custkey = channel WHERE pos < {RECENT}")
def j1(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel"), F.col("c_name").alias("label"))
    return recent(spark, sf_dir).join(names, "channel").select("channel", "pos", "label", "views")

"""Interval algebra and runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.intervals import gaps_between, islands, merge_intervals, total_length, without
from ..sources.tables import DAY, HOUR, VIDEOS, table, videos
from .registry import query

_RUN = f"""{VIDEOS}, i AS (SELECT channel, pub AS a, pub + 7200000000 AS b FROM v WHERE fmt IN ('click', 'view')), f AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY channel ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 600000000 THEN 0 ELSE 1 END AS new FROM i),
  g AS (SELECT *, sum(new) OVER (PARTITION BY channel ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM f), m AS (SELECT channel, min(a) AS start, max(b) AS stop, count(*) AS n FROM g GROUP BY channel, k)"""


def merged(spark, sf_dir):
    rows = videos(spark, sf_dir).where("fmt in ('click', 'view')").withColumn("to", F.col("pub") + 2 * HOUR)
    return merge_intervals(rows, keys=["channel"], start="pub", stop="to", bucket=DAY, slack=HOUR // 6)


@query(
    "w4_islands",
    f"""WITH {VIDEOS}, f AS (SELECT channel, pub, CASE WHEN pub - lag(pub) OVER (PARTITION BY channel ORDER BY pub) <= 21600000000 THEN 0 ELSE 1 END AS new FROM v), g AS (SELECT *, sum(new) OVER (PARTITION BY channel ORDER BY pub ROWS UNBOUNDED PRECEDING) AS k FROM f)
    SELECT channel, min(pub) AS start, max(pub) AS stop, count(*) AS n FROM g GROUP BY channel, k""",
)
def w4(spark, sf_dir):
    return islands(videos(spark, sf_dir), keys=["channel"], at="pub", gap=6 * HOUR, bucket=DAY)


@query("w5_interval_merge", f"WITH {_RUN} SELECT channel, start, stop, n FROM m")
def w5(spark, sf_dir):
    return merged(spark, sf_dir)


@query("a33_union_length", f"WITH {_RUN} SELECT channel, sum(stop - start)::BIGINT AS covered, count(*) AS pieces FROM m GROUP BY 1")
def a33(spark, sf_dir):
    return total_length(merged(spark, sf_dir), ["channel"])


@query("e3_interval_gaps", f"WITH {_RUN}, d AS (SELECT channel, stop AS start, lead(start) OVER (PARTITION BY channel ORDER BY start) AS stop FROM m) SELECT channel, start, stop FROM d WHERE stop > start")
def e3(spark, sf_dir):
    return gaps_between(merged(spark, sf_dir), keys=["channel"])


@query(
    "e3_interval_minus",
    f"""WITH {_RUN}, w AS (SELECT channel, min(start) - 3600000000 AS lo, max(stop) + 3600000000 AS hi FROM m GROUP BY 1), c AS (SELECT w.channel, lo, hi, start, stop FROM w JOIN m ON m.channel = w.channel),
    p AS (SELECT channel, lo AS start, min(start) AS stop FROM c GROUP BY channel, lo UNION ALL SELECT channel, stop, lead(start) OVER (PARTITION BY channel ORDER BY start) FROM m UNION ALL SELECT channel, max(stop), hi FROM c GROUP BY channel, hi)
    SELECT channel, start, stop FROM p WHERE stop > start""",
)
def e3_minus(spark, sf_dir):
    holes = merged(spark, sf_dir)
    frame = holes.groupBy("channel").agg((F.min("start") - HOUR).alias("lo"), (F.max("stop") + HOUR).alias("hi"))
    return without(frame, holes, keys=["channel"]).select("channel", "start", "stop")


@query("w8_turn_changes", "SELECT conv_id, count(*) AS turns, sum((role IS DISTINCT FROM before AND before IS NOT NULL)::INT)::BIGINT AS changes FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY 1")
def w8(spark, sf_dir):
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("before", before)
    changed = F.col("before").isNotNull() & ~F.col("role").eqNullSafe(F.col("before"))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(changed.cast("long")).alias("changes"))


@query(
    "w9_run_length_filter",
    f"""WITH {VIDEOS}, l AS (SELECT channel, id, pub, fmt, CASE WHEN fmt = lag(fmt) OVER (PARTITION BY channel ORDER BY pub, id) THEN 0 ELSE 1 END AS new FROM v), g AS (SELECT *, sum(new) OVER (PARTITION BY channel ORDER BY pub, id ROWS UNBOUNDED PRECEDING) AS k FROM l),
    n AS (SELECT *, count(*) OVER (PARTITION BY channel, k) AS run, row_number() OVER (PARTITION BY channel, k ORDER BY pub, id) AS place FROM g) SELECT channel, id FROM n WHERE run <= 2 OR place <= 1""",
)
def w9(spark, sf_dir):
    order = Window.partitionBy("channel").orderBy("pub", "id")
    rows = videos(spark, sf_dir).withColumn("new", F.when(F.col("fmt") == F.lag("fmt").over(order), 0).otherwise(1))
    rows = rows.withColumn("k", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("channel", "k")
    rows = rows.withColumns({"run": F.count(F.lit(1)).over(run), "place": F.row_number().over(run.orderBy("pub", "id"))})
    return rows.where("run <= 2 or place <= 1").select("channel", "id")


@query("w12_lead_pairs", f"WITH {VIDEOS} SELECT channel, id, nxt - pub AS until_next FROM (SELECT *, lead(pub) OVER (PARTITION BY channel ORDER BY pub, id) AS nxt FROM v) WHERE nxt - pub >= 7200000000")
def w12(spark, sf_dir):
    after = F.lead("pub").over(Window.partitionBy("channel").orderBy("pub", "id"))
    return videos(spark, sf_dir).withColumn("until_next", after - F.col("pub")).where(F.col("until_next") >= 2 * HOUR).select("channel", "id", "until_next")


@query("e2_event_union", "SELECT 'order' AS kind, o_custkey AS key, epoch_us(o_orderdate) AS at, o_totalprice AS amount, NULL::VARCHAR AS note FROM orders UNION ALL SELECT event_type, user_id, epoch_us(ts), value, props FROM events")
def e2(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_custkey").alias("key"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"), F.col("o_totalprice").alias("amount"))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("value").alias("amount"), F.col("props").alias("note"))
    return orders.unionByName(rows, allowMissingColumns=True)


@query("g8_busiest_window", f"WITH {VIDEOS}, c AS (SELECT channel, (pub // 86400000000) AS day, count(*) AS n FROM v GROUP BY 1, 2) SELECT channel, day, n FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY n DESC, day) AS k FROM c) WHERE k = 1")
def g8(spark, sf_dir):
    counts = videos(spark, sf_dir).groupBy("channel", F.floor(F.col("pub") / DAY).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("channel").agg(F.max_by(F.struct("day", "n"), F.struct("n", -F.col("day"))).alias("b")).select("channel", "b.day", "b.n")

"""Slots of the week and what fills them, and peaks: greedy choices in SQL and in folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import slots
from ..sources.tables import DAY, HOUR, videos
from .registry import query

_UPS = "u AS (SELECT user_id AS channel, event_id AS id, epoch_us(ts) AS up FROM events WHERE event_type = 'purchase')"


def _greedy(pairs: str, keys: str) -> str:
    """Recursive SQL: pairs (keys, early, off, up, id, slot) in order, taken where neither slot nor id is."""
    on = " AND ".join(f"g.{k} = p.{k}" for k in keys.split(", "))
    cols = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY early, off, up, id, slot) AS k FROM {pairs}),
    g AS (SELECT {keys}, k, [slot] AS ss, [id] AS ii FROM n WHERE k = 1
      UNION ALL SELECT {cols}, p.k, CASE WHEN list_contains(g.ss, p.slot) OR list_contains(g.ii, p.id) THEN g.ss ELSE list_append(g.ss, p.slot) END, CASE WHEN list_contains(g.ss, p.slot) OR list_contains(g.ii, p.id) THEN g.ii ELSE list_append(g.ii, p.id) END FROM g JOIN n p ON {on} AND p.k = g.k + 1),
    f AS (SELECT {keys}, arg_max(ss, k) AS ss, arg_max(ii, k) AS ii FROM g GROUP BY {keys})"""


@query(
    "j20_slot_matching",
    f"""WITH RECURSIVE {_UPS}, w AS (SELECT *, up // 604800000000 AS week FROM u), s AS (SELECT channel, week, i AS slot, week * 604800000000 + (2 * i + 1) * 86400000000 + 64800000000 AS at_ FROM (SELECT DISTINCT channel, week FROM w), range(3) t(i)),
    p AS (SELECT s.channel, s.week, at_ > up + 7200000000 AS early, abs(up - at_) AS off, up, id, slot FROM s JOIN w ON w.channel = s.channel AND w.week = s.week), {_greedy('p', 'channel, week')}
    SELECT channel, week, unnest(ss) AS slot, unnest(ii) AS id FROM f""",
)
def j20(spark, sf_dir):
    """A week's three slots of each channel and what was uploaded then, over all uploads."""
    ups = videos(spark, sf_dir).where("fmt = 'purchase' and pub is not null").select("channel", F.floor(F.col("pub") / (7 * DAY)).alias("week"), "id", F.col("pub").alias("at"))
    three = ups.select("channel", "week").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    three = three.withColumn("at", F.col("week") * 7 * DAY + (2 * F.col("slot") + 1) * DAY + 18 * HOUR)
    return slots.matched(three, ups, ["channel", "week"]).select("channel", "week", "slot", "id")


@query(
    "m5_open_slots",
    f"""WITH RECURSIVE {_UPS}, w AS (SELECT *, (up - 345600000000) // 604800000000 AS week FROM u), l AS (SELECT max(week) + 1 AS last FROM w),
    pl AS (SELECT channel, 0.5 + channel % 5 * 0.75 AS rate, CASE channel % 3 WHEN 0 THEN [0] WHEN 1 THEN [1, 4] ELSE [0, 2, 5] END AS days, CASE WHEN channel % 2 = 0 THEN 9 ELSE 18 END AS hour, min(up) AS start FROM u GROUP BY 1),
    k AS (SELECT pl.*, unnest(range((start - 345600000000) // 604800000000, last + 1)) AS week FROM pl, l), c AS (SELECT channel, week, count(*) AS n FROM w GROUP BY 1, 2),
    q AS (SELECT k.*, (floor(rate) + CASE WHEN rate > floor(rate) AND coalesce(c.n, 0) < ceil(rate) THEN 1 ELSE 0 END)::BIGINT AS q FROM k LEFT JOIN c ON c.channel = k.channel AND c.week = k.week - 1),
    d0 AS (SELECT *, unnest(range(len(days))) AS i FROM q WHERE q > 0), d AS (SELECT *, days[i + 1] AS day, q // len(days) + CASE WHEN i < q % len(days) THEN 1 ELSE 0 END AS n FROM d0),
    t0 AS (SELECT *, unnest(range(n)) AS j FROM d WHERE n > 0),
    t AS (SELECT channel, week, q, start, 345600000000 + week * 604800000000 + day * 86400000000 + hour * 3600000000 + floor(CASE WHEN hour >= 12 THEN -1 ELSE 1 END * 21600000000 * j / greatest(1, n - 1))::BIGINT AS at_ FROM t0),
    s AS (SELECT *, row_number() OVER (PARTITION BY channel, week ORDER BY at_) - 1 AS slot FROM t),
    p AS (SELECT s.channel, s.week, at_ > up + 7200000000 AS early, abs(up - at_) AS off, up, id, slot FROM s JOIN w ON w.channel = s.channel AND w.week = s.week), {_greedy('p', 'channel, week')}
    SELECT s.channel, s.week, s.q, s.slot, s.at_ AS slot_at FROM s LEFT JOIN f ON f.channel = s.channel AND f.week = s.week WHERE at_ >= start AND NOT coalesce(list_contains(f.ss, s.slot), false)""",
)
def m5(spark, sf_dir):
    """Slots that a channel's uploads leave open: its rate, days and hour go by its number, its plan starts with its first
    upload."""
    ups = videos(spark, sf_dir).where("fmt = 'purchase' and pub is not null").select(F.col("channel").alias("key"), "id", F.col("pub").alias("at"))
    third = F.col("key") % 3
    days = F.when(third == 0, F.array(F.lit(0))).when(third == 1, F.array(F.lit(1), F.lit(4))).otherwise(F.array(F.lit(0), F.lit(2), F.lit(5)))
    plans = ups.groupBy("key").agg(F.min("at").alias("start")).withColumns({"rate": 0.5 + F.col("key") % 5 * 0.75, "days": days, "hour": F.when(F.col("key") % 2 == 0, 9).otherwise(18)})
    return slots.open_slots(plans, ups).select(F.col("key").alias("channel"), "week", "q", "slot", F.col("at").alias("slot_at"))

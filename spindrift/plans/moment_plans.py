"""Queries of moments along a recording, over the driver's events: a user is a recording, a second of it an hour."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import moments, talk
from ..sources.tables import DAY, HOUR, VIDEOS, table, videos
from .registry import query

_HOURS = "(pub - 1704067200000000) / 3600e6"


def _events(spark, sf_dir):
    """key, at (hours since the year began, as seconds), fmt, views."""
    return videos(spark, sf_dir).where("pub is not null").select(F.col("channel").alias("key"), "id", "fmt", "views", "pub", ((F.col("pub") - 1704067200000000) / 3600e6).alias("at"))


@query(
    "w9_rows_of_equals",
    f"""WITH {VIDEOS}, l AS (SELECT channel, id, pub, floor(views) AS k, CASE WHEN floor(views) > 40 IS NOT DISTINCT FROM lag(floor(views) > 40) OVER (PARTITION BY channel ORDER BY pub, id) AND row_number() OVER (PARTITION BY channel ORDER BY pub, id) > 1 THEN 0 ELSE 1 END AS new FROM v), g AS (SELECT *, sum(new) OVER (PARTITION BY channel ORDER BY pub, id ROWS UNBOUNDED PRECEDING) AS r FROM l),
    n AS (SELECT *, count(*) OVER (PARTITION BY channel, r) AS run, row_number() OVER (PARTITION BY channel, r ORDER BY pub, id) AS place FROM g) SELECT channel, id FROM n WHERE run <= 4 OR place <= 2""",
)
def w9_rows(spark, sf_dir):
    """Events without what comes after the first two of more than four in a row that are on one side of 40."""
    rows = videos(spark, sf_dir).withColumn("high", F.floor("views") > 40).select("channel", "id", "pub", "high")
    return moments.without_rows_of_equals(rows, ["channel"], "pub", ["pub", "id"], "high", 7 * DAY).select("channel", "id")


@query(
    "w10_shot_lengths",
    f"""WITH {VIDEOS}, d AS (SELECT channel AS key, max({_HOURS}) + 1 AS dur FROM v GROUP BY 1), m AS (SELECT DISTINCT channel AS key, {_HOURS} AS at_ FROM v WHERE fmt = 'view' AND {_HOURS} > 0 UNION ALL SELECT key, 0.0 FROM d UNION ALL SELECT key, dur FROM d),
    s AS (SELECT key, at_, lead(at_) OVER (PARTITION BY key ORDER BY at_) AS to_ FROM m) SELECT s.key, CASE WHEN (at_ + to_) / 2 < 30 THEN 'head' WHEN (at_ + to_) / 2 > dur - 20 THEN 'tail' ELSE 'body' END AS part, count(*) AS n, round(median(to_ - at_), 5) AS median FROM s JOIN d ON d.key = s.key WHERE to_ IS NOT NULL GROUP BY 1, 2""",
)
def w10_shots(spark, sf_dir):
    rows = _events(spark, sf_dir)
    lengths = rows.groupBy("key").agg((F.max("at") + 1).alias("dur"))
    return moments.shot_lengths(rows.where("fmt = 'view'").select("key", "at"), lengths).withColumn("median", F.round("median", 5))


@query(
    "w12_cutaways",
    f"""WITH {VIDEOS}, e AS (SELECT channel AS key, {_HOURS} AS at_, fmt FROM v), p AS (SELECT * FROM (SELECT key, at_ AS c1, lead(at_) OVER (PARTITION BY key ORDER BY at_) AS c2 FROM e WHERE fmt <> 'view') WHERE c2 - c1 >= 2),
    g AS (SELECT * FROM (SELECT key, at_ + 1 AS a, lead(at_) OVER (PARTITION BY key ORDER BY at_) AS b FROM e WHERE fmt = 'view') WHERE b > a),
    m AS (SELECT g.key, a, b, c1, greatest(a, c1 + 0.05) AS lo, least(b, c2 - 0.05) AS hi FROM g JOIN p ON p.key = g.key AND c1 >= a - 1.5 AND c1 < b - 1 AND c2 <= b + 1.5)
    SELECT key, round(a, 4) AS a, round(b, 4) AS b, round(lo, 4) AS lo, round(hi, 4) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY key, a, b ORDER BY c1) AS k FROM m WHERE hi - lo >= 2) WHERE k = 1""",
)
def w12_scenes(spark, sf_dir):
    """Other events as cuts, in the gaps between views (an hour each)."""
    rows = _events(spark, sf_dir)
    seen = rows.where("fmt = 'view'").select("key", "at")
    numbered, w = moments._around(seen, ["key"], "at", ["at"], 600.0, 0, 1)
    gaps = numbered.withColumn("b", F.lead("at").over(w)).where("_mine").select("key", (F.col("at") + 1).alias("a"), "b").where("b > a")
    got = moments.cutaways(gaps, rows.where("fmt <> 'view'").select("key", "at"))
    return got.select("key", *[F.round(c, 4).alias(c) for c in ("a", "b", "lo", "hi")])


@query(
    "w14_assigned_numbers",
    f"""WITH {VIDEOS}, s AS (SELECT channel, id, row_number() OVER (PARTITION BY channel ORDER BY id) * 2 AS number FROM v WHERE id % 5 = 0), q AS (SELECT channel, id, pub, CASE WHEN id % 11 = 0 THEN id % 100 ELSE 0 END AS want FROM v),
    t AS (SELECT channel, greatest(coalesce(max(n), 0), coalesce(max(w), 0)) AS top FROM (SELECT channel, number AS n, NULL AS w FROM s UNION ALL SELECT channel, NULL, want FROM q WHERE want > 0) GROUP BY 1),
    k AS (SELECT q.*, CASE WHEN want > 0 THEN want ELSE s.number END AS n FROM q LEFT JOIN s ON s.channel = q.channel AND s.id = q.id)
    SELECT channel, id, n AS number FROM k WHERE n IS NOT NULL UNION ALL SELECT k.channel, id, coalesce(top, 0) + row_number() OVER (PARTITION BY k.channel ORDER BY pub, id) FROM k LEFT JOIN t ON t.channel = k.channel WHERE n IS NULL""",
)
def w14_assigned(spark, sf_dir):
    """Events as parts of a series: some have a number already, some want one, the rest go on after all of these."""
    rows = videos(spark, sf_dir).select("channel", "id", "pub")
    own = moments.numbered(rows.where("id % 5 = 0"), ["channel"], "id", ["id"], 4096, number="k")
    asked = rows.withColumn("want", F.when(F.col("id") % 11 == 0, F.col("id") % 100).otherwise(0))
    return moments.assigned_numbers(asked, own.select("channel", "id", (F.col("k") * 2).alias("number")), ["channel"], "pub", ["pub", "id"], 7 * DAY).select("channel", "id", "number")


@query(
    "w16_spikes",
    f"""WITH {VIDEOS}, o AS (SELECT channel AS key, row_number() OVER (PARTITION BY channel ORDER BY pub, id) AS i, views AS level, fmt FROM v), e AS (SELECT key, arg_min(level, i) AS f, arg_max(level, i) AS l, max(i) AS hi FROM o GROUP BY 1),
    x AS (SELECT key, i, level FROM o UNION ALL SELECT key, unnest([-1, 0]), f FROM e UNION ALL SELECT key, unnest([hi + 1, hi + 2]), l FROM e), m AS (SELECT *, quantile_cont(level, 0.5) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mid FROM x),
    h AS (SELECT m.*, i - row_number() OVER (PARTITION BY m.key ORDER BY i) AS r FROM m JOIN e ON e.key = m.key WHERE i BETWEEN 1 AND hi AND level - mid >= 12 AND level > 15), g AS (SELECT key, min(i) AS start, max(i) AS stop, max(level) AS top FROM h GROUP BY key, r HAVING count(*) < 3),
    t AS (SELECT key, i AS a, i + 1 AS b FROM o WHERE fmt = 'purchase') SELECT key, start, stop, top FROM g WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.key = g.key AND g.start BETWEEN a - 1 AND b + 1)""",
)
def w16_spikes(spark, sf_dir):
    """A user's events in order as a signal, purchases as talk of two steps."""
    rows = moments.numbered(videos(spark, sf_dir).withColumnRenamed("channel", "key"), ["key"], "pub", ["pub", "id"], 7 * DAY, number="i")
    talk = rows.where("fmt = 'purchase'").select("key", F.col("i").alias("a"), (F.col("i") + 1).alias("b"))
    return moments.spikes(rows.select("key", "i", F.col("views").alias("level")), talk, reach=2, rise=12, least=15, longest=3, slack=1)


@query(
    "w18_best_of_close",
    f"""WITH RECURSIVE {VIDEOS}, c AS (SELECT channel, fmt, pub, id, views, row_number() OVER (PARTITION BY channel, fmt ORDER BY pub, id, views) AS k FROM v),
    g AS (SELECT channel, fmt, k, [{{'t': pub, 'id': id, 's': views}}] AS kept FROM c WHERE k = 1 UNION ALL SELECT g.channel, g.fmt, c.k, CASE WHEN pub - kept[len(kept)].t >= 36000000000 THEN list_append(kept, {{'t': pub, 'id': id, 's': views}}) WHEN views > kept[len(kept)].s THEN list_append(kept[:len(kept) - 1], {{'t': pub, 'id': id, 's': views}}) ELSE kept END
      FROM g JOIN c ON c.channel = g.channel AND c.fmt = g.fmt AND c.k = g.k + 1),
    f AS (SELECT channel, fmt, unnest(arg_max(kept, k)) AS e FROM g GROUP BY 1, 2) SELECT channel, fmt, e.id AS id, round(e.s / max(e.s) OVER (PARTITION BY channel, fmt), 6) AS share FROM f""",
)
def w18_close(spark, sf_dir):
    """Of events of a kind less than ten hours apart the best, and its share of the kind's best."""
    got = moments.best_of_close(videos(spark, sf_dir).where("pub is not null"), ["channel", "fmt"], "pub", "views", 10 * HOUR, 7 * DAY)
    return got.select("channel", "fmt", "id", F.round("share", 6).alias("share"))


_STEPS = f"{VIDEOS}, o AS (SELECT channel AS key, row_number() OVER (PARTITION BY channel ORDER BY pub, id) AS i, views AS level, fmt FROM v)"


def _steps(spark, sf_dir):
    """key, i, level, fmt: a user's events in order."""
    rows = moments.numbered(videos(spark, sf_dir).withColumnRenamed("channel", "key"), ["key"], "pub", ["pub", "id"], 7 * DAY, number="i")
    return rows.select("key", "i", F.col("views").alias("level"), "fmt")


@query(
    "w3_onsets",
    f"""WITH RECURSIVE {_STEPS}, m AS (SELECT *, min(level) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS b, first_value(level) OVER (PARTITION BY key ORDER BY i) AS f, max(level) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS pk, avg(level) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN 4 FOLLOWING AND 7 FOLLOWING) AS t FROM o),
    h AS (SELECT key, i FROM m WHERE level - CASE WHEN i <= 10 THEN least(coalesce(b, f), f) ELSE b END >= 9 AND level > 12 AND (t IS NULL OR t <= pk - 8) AND NOT EXISTS (SELECT 1 FROM o x WHERE x.key = m.key AND x.fmt = 'purchase' AND m.i BETWEEN x.i AND x.i + 1)),
    c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i) AS k FROM h), g AS (SELECT key, k, [i] AS kept FROM c WHERE k = 1 UNION ALL SELECT g.key, c.k, CASE WHEN c.i - kept[len(kept)] >= 5 THEN list_append(kept, c.i) ELSE kept END FROM g JOIN c ON c.key = g.key AND c.k = g.k + 1)
    SELECT key, unnest(arg_max(kept, k)) AS i FROM g GROUP BY 1""",
)
def w3_onsets(spark, sf_dir):
    """Sudden values of a user's events in order; purchases are talk of two steps."""
    rows = _steps(spark, sf_dir)
    talk = rows.where("fmt = 'purchase'").select("key", F.col("i").alias("a"), (F.col("i") + 1).alias("b"))
    return moments.onsets(rows.select("key", "i", "level"), talk, least=12, tail=(4, 8), apart=5)


@query(
    "w11_smoothed_tracks",
    f"""WITH {_STEPS}, k AS (SELECT key, i, CASE WHEN fmt <> 'error' THEN level END AS x FROM o), s AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi, last_value(x IGNORE NULLS) OVER p AS px, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER n AS ni, first_value(x IGNORE NULLS) OVER n AS nx FROM k
      WINDOW p AS (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY key ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    f AS (SELECT key, i, coalesce(x, px + (nx - px) * (i - pi) / nullif(ni - pi, 0), px, nx) AS x, least(2, i - 1, count(*) OVER (PARTITION BY key) - i) AS r FROM s)
    SELECT key, i, round(CASE r WHEN 0 THEN x WHEN 1 THEN avg(x) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) ELSE avg(x) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 6) AS value FROM f""",
)
def w11_tracks(spark, sf_dir):
    """A user's events in order as a track that errors leave open."""
    rows = _steps(spark, sf_dir).select("key", "i", F.when(F.col("fmt") != "error", F.col("level")).alias("value"))
    return moments.smoothed(rows, 2).withColumn("value", F.round("value", 6))


@query(
    "a34_speaker_seconds",
    """WITH s AS (SELECT conv_id AS key, role AS label, turn * 60.0::DOUBLE AS a, turn * 60.0::DOUBLE + length(text) / 20.0 AS b FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL AND length(text) / 20.0 >= 0.8),
    l AS (SELECT *, lag(label) OVER (PARTITION BY key ORDER BY a, b, label) AS before, row_number() OVER (PARTITION BY key ORDER BY a, b, label) AS k FROM s), w AS (SELECT key, sum(b - a) AS whole, count(*) FILTER (before <> label) AS turns, count(DISTINCT label) AS speakers, arg_max(b, k) - min(a) AS span FROM l GROUP BY 1)
    SELECT l.key, label, round(sum(b - a) / any_value(whole), 6) AS share, round(sum(b - a), 4) AS seconds, any_value(speakers) AS speakers, round(any_value(turns) * 60 / greatest(1.0, any_value(span)), 6) AS turns_per_minute FROM l JOIN w ON w.key = l.key GROUP BY 1, 2""",
)
def a34_seconds(spark, sf_dir):
    """Turns as segments: one begins every minute and takes a second for twenty characters."""
    start, said = F.col("turn") * 60.0, F.length("text") / 20.0
    rows = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("key"), start.alias("start"), (start + said).alias("end"), said.alias("said"), F.col("role").alias("label"))
    got = talk.speaker_shares(rows, seconds=F.col("said"))
    return got.select("key", "label", rounded("share", 6).alias("share"), rounded("seconds", 4).alias("seconds"), "speakers", rounded("turns_per_minute", 6).alias("turns_per_minute"))


@query(
    "a31_chapter_summaries",
    """WITH s AS (SELECT conv_id AS key, turn * 60.0::DOUBLE + i * 4.0::DOUBLE AS start, x AS text FROM (SELECT conv_id, turn, unnest(range(len(l))) AS i, unnest(l) AS x FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations WHERE text IS NOT NULL))),
    o AS (SELECT key, text, min(start) AS start FROM s GROUP BY 1, 2), c AS (SELECT *, floor(start / 90) * 90 AS chapter, least(length(text), 120) + CASE WHEN text LIKE '%a.' THEN 50 ELSE 0 END AS score FROM o),
    t AS (SELECT *, row_number() OVER (PARTITION BY key, chapter ORDER BY score DESC, start, text) AS k FROM c)
    SELECT key, chapter, row_number() OVER (PARTITION BY key, chapter ORDER BY start, text) AS place, start, md5(text) AS text_md5 FROM t WHERE k <= 3""",
)
def a31_chapters(spark, sf_dir):
    """Lines as sentences, in chapters of 90 seconds; long ones count, and those that end in a certain way."""
    rows = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("key"), "turn", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    score = F.least(F.length("text"), F.lit(120)) + F.when(F.col("text").endswith("a."), 50).otherwise(0)
    got = talk.chapter_summaries(rows.select("key", (F.col("turn") * 60.0 + F.col("i") * 4.0).alias("start"), "text"), score)
    return got.select("key", "chapter", "place", "start", F.md5("text").alias("text_md5"))


@query(
    "w17_montages",
    f"""WITH RECURSIVE {VIDEOS}, c AS (SELECT DISTINCT channel AS key, pub AS at_ FROM v WHERE fmt = 'view'), q0 AS (SELECT *, count(*) OVER w AS n, last_value(at_) OVER w AS last FROM c WINDOW w AS (PARTITION BY key ORDER BY at_ RANGE BETWEEN CURRENT ROW AND {48 * HOUR} FOLLOWING)),
    q AS (SELECT * FROM q0 WHERE n >= 3), m AS (SELECT q.key, q.at_, avg(views) AS music FROM q JOIN v ON v.channel = q.key AND v.fmt = 'click' AND v.pub BETWEEN q.at_ AND q.at_ + {48 * HOUR} GROUP BY 1, 2),
    t0 AS (SELECT channel AS key, pub AS a, pub + {4 * HOUR} AS b, CASE WHEN pub <= max(pub + {4 * HOUR}) OVER (PARTITION BY channel ORDER BY pub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM v WHERE fmt = 'purchase'),
    t1 AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY a ROWS UNBOUNDED PRECEDING) AS g FROM t0), t AS (SELECT key, min(a) AS a, max(b) AS b FROM t1 GROUP BY key, g),
    s AS (SELECT q.key, q.at_, sum(least(b, q.at_ + {48 * HOUR}) - greatest(a, q.at_)) AS said FROM q JOIN t ON t.key = q.key AND a < q.at_ + {48 * HOUR} AND b > q.at_ GROUP BY 1, 2),
    x AS (SELECT q.key, q.at_, q.last, coalesce(music, 0) > 15 AND coalesce(said, 0) < 0.15 * {48 * HOUR} AS fine, row_number() OVER (PARTITION BY q.key ORDER BY q.at_) AS k FROM q LEFT JOIN m ON m.key = q.key AND m.at_ = q.at_ LEFT JOIN s ON s.key = q.key AND s.at_ = q.at_),
    g AS (SELECT key, k, CASE WHEN fine THEN [{{'a': at_, 'b': last}}] ELSE [] END AS f FROM x WHERE k = 1 UNION ALL SELECT g.key, x.k, CASE WHEN len(f) > 0 AND at_ < f[len(f)].b THEN list_append(f[:len(f) - 1], {{'a': f[len(f)].a, 'b': greatest(f[len(f)].b, last)}}) WHEN fine THEN list_append(f, {{'a': at_, 'b': last}}) ELSE f END FROM g JOIN x ON x.key = g.key AND x.k = g.k + 1)
    SELECT key, e.a AS start, e.b AS stop FROM (SELECT key, unnest(arg_max(f, k)) AS e FROM g GROUP BY 1)""",
)
def w17_montages(spark, sf_dir):
    """Three views within two days are quick cuts, clicks the music, purchases four hours of talk."""
    rows = videos(spark, sf_dir).select(F.col("channel").alias("key"), "fmt", F.col("pub").alias("at"), F.col("views").alias("level"))
    talk_ = rows.where("fmt = 'purchase'").select("key", F.col("at").alias("a"), (F.col("at") + 4 * HOUR).alias("b"))
    return moments.montages(rows.where("fmt = 'view'"), rows.where("fmt = 'click'"), talk_, span=48 * HOUR, least=3, level=15, quiet=0.15, bucket=7 * DAY)


@query(
    "w2_quiet_drift",
    f"""WITH {VIDEOS}, h AS (SELECT channel AS key, pub AS at_, views AS subs FROM v WHERE fmt IN ('view', 'click')), u AS (SELECT channel AS key, pub AS at_ FROM v WHERE fmt = 'purchase'),
    p AS (SELECT key, at_, subs, lag(at_) OVER w AS at0, lag(subs) OVER w AS subs0 FROM h WINDOW w AS (PARTITION BY key ORDER BY at_, subs)), q AS (SELECT * FROM p WHERE at_ - at0 >= {12 * HOUR} AND NOT EXISTS (SELECT 1 FROM u WHERE u.key = p.key AND u.at_ > at0 AND u.at_ <= p.at_)),
    d AS (SELECT key, count(*) AS pairs, median((subs - subs0) / ((at_ - at0) / {7 * DAY}.0)) AS d FROM q GROUP BY 1) SELECT k.key, coalesce(pairs, 0) AS pairs, round(greatest(0.0, coalesce(d, 0.0)), 6) AS drift FROM (SELECT DISTINCT key FROM h) k LEFT JOIN d ON d.key = k.key""",
)
def w2_drift(spark, sf_dir):
    """Views and clicks as records of a count, purchases as uploads; records half a day apart or more."""
    rows = videos(spark, sf_dir).select(F.col("channel").alias("key"), "fmt", F.col("pub").alias("at"), F.col("views").alias("subs"))
    got = moments.quiet_drift(rows.where("fmt in ('view', 'click')"), rows.where("fmt = 'purchase'"), apart=12 * HOUR, week=7 * DAY, bucket=7 * DAY)
    return got.withColumn("drift", F.round("drift", 6))

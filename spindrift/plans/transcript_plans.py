"""Queries of transcript, template and plan rules, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import transcript
from ..operators.relational import numbered, with_previous
from ..sources import files
from ..sources.tables import ALL_TITLES, DAY, HOUR, VIDEOS, table, titles, videos
from .registry import query

R = lambda c, n=6: F.round(c, n)
_TURNS = "SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL"


@query(
    "f8_sentences",
    rf"""WITH w AS (SELECT conv_id, turn, unnest(range(len(x))) AS pos, unnest(x) AS word FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda s: s <> '') AS x FROM ({_TURNS}))),
    b AS (SELECT *, coalesce(regexp_matches(lag(word) OVER (PARTITION BY conv_id, turn ORDER BY pos), '[.?!]+["'')]*$'), false)::INT AS new FROM w),
    s AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY pos)::BIGINT AS sentence FROM b)
    SELECT conv_id, turn, sentence, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM s GROUP BY 1, 2, 3""",
)
def f8(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    return transcript.sentences(transcript.words_of(rows, ["conv_id", "turn"], "text"), ["conv_id", "turn"]).drop("first")


@query(
    "f10_word_times",
    rf"""WITH w AS (SELECT conv_id, turn, unnest(range(len(x))) AS pos, unnest(x) AS word FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda s: s <> '') AS x FROM ({_TURNS}))),
    c AS (SELECT *, sum(length(word)) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS upto, sum(length(word)) OVER (PARTITION BY conv_id, turn) AS whole FROM w)
    SELECT conv_id, turn, pos, round(10 * turn + 8.0 * (upto - length(word)) / whole, 4) AS s, round(10 * turn + 8.0 * upto / whole, 4) AS e FROM c""",
)
def f10(spark, sf_dir):
    """Turns of eight seconds each: times of their words by characters."""
    rows = table(spark, sf_dir, "conversations").where("text is not null").withColumns({"a": F.col("turn") * 10.0, "b": F.col("turn") * 10.0 + 8})
    return transcript.spread_words(rows, ["conv_id", "turn"], "text", "a", "b").select("conv_id", "turn", F.col("at").alias("pos"), R("s", 4).alias("s"), R("e", 4).alias("e"))


@query(
    "f5_stripped_words",
    f"""WITH {ALL_TITLES}, w AS (SELECT id, unnest(regexp_extract_all(lower(title), '[a-z]{{3,}}')) AS w FROM t), s AS (SELECT id, CASE WHEN w LIKE '%ing' AND length(w) >= 5 THEN w[:-4] WHEN w LIKE '%ed' AND length(w) >= 4 THEN w[:-3] WHEN w LIKE '%s' AND length(w) >= 3 THEN w[:-2] ELSE w END AS stem FROM w)
    SELECT stem, count(*) AS n, count(DISTINCT id) AS titles FROM s GROUP BY 1""",
)
def f5(spark, sf_dir):
    """Words of all titles without the first suffix that leaves two letters."""
    rows = titles(spark, sf_dir).select("id", F.explode(F.regexp_extract_all(F.lower("title"), F.lit("([a-z]{3,})"))).alias("w"))
    return rows.select("id", transcript.strip_suffix(F.col("w"), ["ing", "ed", "s"]).alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("titles"))


_FIXES = {"the": "THE", "a": "one", "and": "&"}


@query(
    "f6_corrections",
    rf"""WITH w AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: struct_pack(x := x, core := regexp_extract(x, '^((?s:.*?))([,.?!]*)$', 1), tail := regexp_extract(x, '^((?s:.*?))([,.?!]*)$', 2))) AS l FROM ({_TURNS}))
    SELECT conv_id, turn, md5(array_to_string(list_transform(l, lambda p: CASE p.core WHEN 'the' THEN 'THE' || p.tail WHEN 'a' THEN 'one' || p.tail WHEN 'and' THEN '&' || p.tail ELSE p.x END), ' ')) AS digest FROM w""",
)
def f6(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", F.md5(transcript.correct("text", _FIXES).cast("binary")).alias("digest"))


@query(
    "f3_skeletons",
    "SELECT regexp_replace(p_name, '(ring|widget|bolt|red)', '{}') AS skeleton, count(*) AS n FROM part WHERE len(regexp_extract_all(p_name, 'ring|widget|bolt|red')) = 1 GROUP BY 1",
)
def f3(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(transcript.skeleton("p_name", "ring|widget|bolt|red").alias("skeleton"))
    return rows.where("skeleton is not null").groupBy("skeleton").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p14_heard",
    """WITH w AS (SELECT l_orderkey AS file, l_suppkey % 4 AS seg, (10 * l_linenumber + 10 * l_linenumber + l_quantity / 10) / 2 AS m FROM lineitem), r AS (SELECT l_orderkey AS file, 10 * l_linenumber + l_discount * 10 AS a, 10 * l_linenumber + 2 AS b FROM lineitem WHERE l_returnflag = 'N'),
    h AS (SELECT file, seg, EXISTS (SELECT 1 FROM r WHERE r.file = w.file AND w.m BETWEEN r.a AND r.b) AS hit FROM w) SELECT file, seg, count(*) AS words, count(*) FILTER (hit) AS inside FROM h GROUP BY 1, 2 HAVING 2 * count(*) FILTER (hit) > count(*)""",
)
def p14(spark, sf_dir):
    """Segments most of whose words lie where speech is."""
    rows = table(spark, sf_dir, "lineitem")
    at = F.col("l_linenumber") * 10.0
    words = rows.select(F.col("l_orderkey").alias("file"), (F.col("l_suppkey") % 4).alias("seg"), at.alias("s"), (at + F.col("l_quantity") / 10).alias("e"))
    speech = rows.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("file"), (at + F.col("l_discount") * 10).alias("a"), (at + 2).alias("b"))
    return transcript.heard(words, speech, ["file", "seg"], 10.0)


@query(
    "p18_frame_scores",
    """SELECT l_orderkey AS id, l_linenumber AS n, round((CASE WHEN l_discount * 8 > 0.6 THEN 0.5 ELSE 1 - 0.3 * greatest(0, l_discount * 8 - 0.35) END) * greatest(0.3, 1 - 1.6 * greatest(0, l_tax * 8 - 0.15)), 6) AS mult FROM lineitem""",
)
def p18(spark, sf_dir):
    mult = transcript.blur_multiplier(F.col("l_discount") * 8) * transcript.subject_multiplier(F.col("l_tax") * 8)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), R(mult).alias("mult"))


@query(
    "p7_published",
    "SELECT o_orderkey AS id FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P' AND (o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_totalprice > 300000)",
)
def p7(spark, sf_dir):
    """Neither held back nor locked, and public, unlisted or scheduled."""
    c = F.col
    public = c("o_orderpriority").isin("1-URGENT", "2-HIGH") | (c("o_totalprice") > 300000)
    return table(spark, sf_dir, "orders").where((c("o_orderpriority") != "5-LOW") & (c("o_orderstatus") != "P") & public).select(c("o_orderkey").alias("id"))


@query(
    "p9_clean_input",
    "SELECT c_custkey AS id, substr(c_name, 1, 12) AS name, round(least(greatest(c_acctbal, 0), 5000), 2) AS balance, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'OTHER' END AS segment, c_mktsegment NOT IN ('BUILDING', 'MACHINERY') OR c_acctbal NOT BETWEEN 0 AND 5000 OR length(c_name) > 12 AS changed FROM customer",
)
def p9(spark, sf_dir):
    """Lengths cut, numbers clamped, choices from a list; and whether anything was changed."""
    c = F.col
    known = c("c_mktsegment").isin("BUILDING", "MACHINERY")
    return table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("id"), F.substring("c_name", 1, 12).alias("name"), F.round(F.least(F.greatest("c_acctbal", F.lit(0.0)), F.lit(5000.0)), 2).alias("balance"),
        F.when(known, c("c_mktsegment")).otherwise("OTHER").alias("segment"), (~known | ~c("c_acctbal").between(0, 5000) | (F.length("c_name") > 12)).alias("changed"),
    )


@query(
    "n1_iso_times",
    """SELECT o_orderkey AS id, CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '1-URGENT' THEN epoch(o_orderdate) - 32400 ELSE epoch(o_orderdate) END::DOUBLE AS at FROM orders""",
)
def n1(spark, sf_dir):
    """Times written with Z, with an offset of nine hours, or no times at all."""
    local = F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("o_orderpriority") == "5-LOW", "last week").when(F.col("o_orderpriority") == "1-URGENT", F.concat(local, F.lit("+09:00"))).otherwise(F.concat(local, F.lit("Z")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), files.iso_seconds(text).alias("at"))


@query(
    "n5_quota_days",
    """WITH t AS (SELECT epoch(o_orderdate)::BIGINT + (o_orderkey % 24) * 3600 AS sec FROM orders), y AS (SELECT sec, year(make_timestamp(sec * 1000000)) AS y FROM t),
    d AS (SELECT sec, make_date(y, 3, 1) AS m, make_date(y, 11, 1) AS n FROM y), s AS (SELECT sec, m + ((7 - dayofweek(m)) % 7 + 7)::INT AS a, n + ((7 - dayofweek(n)) % 7)::INT AS b FROM d),
    o AS (SELECT sec, CASE WHEN sec >= epoch(a) + 36000 AND sec < epoch(b) + 32400 THEN -7 ELSE -8 END AS off FROM s) SELECT CAST(make_timestamp((sec + off * 3600)::BIGINT * 1000000) AS DATE) AS day, count(*) AS n FROM o GROUP BY 1""",
)
def n5(spark, sf_dir):
    at = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1_000_000).cast("long") + (F.col("o_orderkey") % 24) * 3600
    return table(spark, sf_dir, "orders").select(transcript.quota_day(at).alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("n16_cost_model", "SELECT event_id AS id, round(value * 0.27 * 2, 4) AS small, round(value * 0.8 * 2, 4) AS large, CASE WHEN value * 0.8 * 2 > 60 THEN 'small' ELSE 'large' END AS choice FROM events WHERE value IS NOT NULL")
def n16(spark, sf_dir):
    """Seconds of two models for a piece, on a machine of two threads: rate * length * max(1, 4 / threads)."""
    slow = F.greatest(F.lit(1.0), F.lit(4) / F.lit(2))
    small, large = F.col("value") * 0.27 * slow, F.col("value") * 0.8 * slow
    return table(spark, sf_dir, "events").where("value is not null").select(F.col("event_id").alias("id"), R(small, 4).alias("small"), R(large, 4).alias("large"), F.when(large > 60, "small").otherwise("large").alias("choice"))


@query("o1_by_views", f"WITH {VIDEOS} SELECT channel, fmt, id, row_number() OVER (PARTITION BY channel, fmt ORDER BY views DESC, pos) AS place FROM v")
def o1(spark, sf_dir):
    """Videos by views; equal ones keep the listing's order."""
    order = [F.desc("views"), F.desc("pub"), "id"]
    rows = numbered(videos(spark, sf_dir), ["channel", "fmt"], "views", order, 5, newest=True, number="place")
    return rows.select("channel", "fmt", "id", F.col("place").cast("long").alias("place"))


@query(
    "o4_ranked_takeaways",
    """WITH k AS (SELECT p_brand AS brand, p_type AS text, round(avg(p_retailprice), 4) AS score, max(p_size) >= 49 AS met, min(p_size) <= 1 AS hidden FROM part GROUP BY 1, 2)
    SELECT brand, text, row_number() OVER (PARTITION BY brand ORDER BY hidden, met, -score, text) AS place FROM k""",
)
def o4(spark, sf_dir):
    """Points of a brand: hidden ones last, then those whose plan is met, by falling score, then text."""
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("text")).agg(F.round(F.avg("p_retailprice"), 4).alias("score"), (F.max("p_size") >= 49).alias("met"), (F.min("p_size") <= 1).alias("hidden"))
    order = Window.partitionBy("brand").orderBy("hidden", "met", F.desc("score"), "text")
    return rows.select("brand", "text", F.row_number().over(order).cast("long").alias("place"))


@query(
    "a31_summary",
    rf"""WITH w AS (SELECT conv_id, turn, unnest(range(len(x))) AS pos, unnest(x) AS s FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[.?!]\s+'), lambda s: s <> '') AS x FROM ({_TURNS}))),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, s ORDER BY turn, pos) AS k FROM w) WHERE k = 1), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(s) DESC, turn, pos) AS p FROM f)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS place, turn, s AS sentence FROM r WHERE p <= 3""",
)
def a31(spark, sf_dir):
    """Three sentences of each conversation, each sentence once, the longest ones, in their order."""
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    rows = rows.select("conv_id", "turn", F.posexplode(F.filter(F.split("text", r"[.?!]\s+"), lambda s: s != "")).alias("at", "sentence"))
    first = rows.groupBy("conv_id", "sentence").agg(F.min(F.struct("turn", "at")).alias("f")).select("conv_id", "sentence", "f.turn", "f.at")
    best = first.withColumn("p", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(F.length("sentence")), "turn", "at"))).where("p <= 3")
    return best.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "at")).cast("long").alias("place"), "turn", "sentence")


@query(
    "a34_speaker_shares",
    f"""WITH t AS (SELECT conv_id, turn, role, length(text) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, role, round(sum(n) * 1.0 / sum(sum(n)) OVER (PARTITION BY conv_id), 6) AS share, count(*) FILTER (before IS NULL OR before <> role) AS turns FROM t WHERE role IS NOT NULL GROUP BY 1, 2""",
)
def a34(spark, sf_dir):
    """Each speaker's share of what is said, and how often they take the word."""
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = table(spark, sf_dir, "conversations").where("text is not null").withColumn("before", before).where("role is not null")
    each = rows.groupBy("conv_id", "role").agg(F.sum(F.length("text")).alias("n"), F.count_if(F.col("before").isNull() | (F.col("before") != F.col("role"))).alias("turns"))
    return each.select("conv_id", "role", R(F.col("n") / F.sum("n").over(Window.partitionBy("conv_id"))).alias("share"), "turns")


@query(
    "m7_due_reminders",
    f"""WITH {VIDEOS}, l AS (SELECT channel, min(pub) AS start, max(pub) FILTER (fmt = 'purchase') AS last, (SELECT max(pub) FROM v) AS now FROM v GROUP BY 1)
    SELECT channel, (now - coalesce(last, start)) // {DAY} AS days, last IS NULL AS never FROM l WHERE channel % 5 > 0 AND now - coalesce(last, start) >= {7 * DAY}""",
)
def m7(spark, sf_dir):
    """Channels that ask to be reminded and whose last checkup (a purchase), or whose start, is seven days back or more."""
    last = videos(spark, sf_dir).groupBy("channel").agg(F.min("pub").alias("start"), F.max(F.when(F.col("fmt") == "purchase", F.col("pub"))).alias("last"), F.max("pub").alias("_newest"))
    now = F.broadcast(last.agg(F.max("_newest").alias("now")))  # one row
    since = F.col("now") - F.coalesce("last", "start")
    return last.where("channel % 5 > 0").crossJoin(now).where(since >= 7 * DAY).select("channel", F.floor(since / DAY).cast("long").alias("days"), F.col("last").isNull().alias("never"))


_WORD = "CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE 'ab' || chr((44032 + (c_custkey * 37) % 11172)::INT) END"


@query(
    "f4_filled_templates",
    f"""WITH w AS (SELECT c_custkey AS id, {_WORD} AS w FROM customer), k AS (SELECT *, unicode(right(w, 1)) - 44032 AS l FROM w), p AS (SELECT *, l BETWEEN 0 AND 11171 AS ko, l % 28 AS f FROM k)
    SELECT id, w || CASE WHEN ko AND f = 0 THEN '를' ELSE '을' END || ' 보다' AS object, w || CASE WHEN ko AND f NOT IN (0, 8) THEN '으로' ELSE '로' END || ' 가다' AS way FROM p""",
)
def f4(spark, sf_dir):
    """Templates filled with names and with Korean words, whose particles follow the last syllable."""
    word = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).otherwise(F.concat(F.lit("ab"), F.decode(F.unhex(F.lpad(F.hex(F.lit(44032) + (F.col("c_custkey") * 37) % 11172), 4, "0")), "UTF-16BE")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), word.alias("w"))
    return rows.select("id", transcript.fill_template(F.lit("{}을 보다"), F.col("w")).alias("object"), transcript.fill_template(F.lit("{}로 가다"), F.col("w")).alias("way"))


@query("p11_nearly_only", "SELECT p_partkey AS id, p_name AS name FROM part WHERE regexp_matches(p_name, 'ring|bolt') AND length(regexp_replace(regexp_replace(regexp_replace(p_name, 'ring|bolt', '', 'g'), 'small|large', '', 'g'), '\\s+', '', 'g')) <= 3")
def p11(spark, sf_dir):
    """Names that are a cue and next to nothing else."""
    return table(spark, sf_dir, "part").where(transcript.nearly_only(F.col("p_name"), "ring|bolt", "small|large", 3)).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("n12_packed_arrays", "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 3) AS total, 0 AS broken FROM embeddings WHERE embedding IS NOT NULL")
def n12(spark, sf_dir):
    """Vectors packed as text and unpacked; text that is cut short gives none."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").withColumn("packed", transcript.pack_array("embedding"))
    back = rows.select("vec_id", transcript.unpack_array("packed").alias("x"), F.size(transcript.unpack_array(F.expr("substring(packed, 1, length(packed) - 5)"))).alias("broken"))
    return back.select("vec_id", F.size("x").cast("long").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 3).alias("total"), "broken")


@query(
    "m6_checkup_upsert",
    "WITH e AS (SELECT user_id AS channel, event_id AS id, epoch_us(ts) AS pub FROM events WHERE event_type = 'purchase'), l AS (SELECT *, lead(pub) OVER (PARTITION BY channel ORDER BY pub, id) AS after FROM e) SELECT channel, id FROM l WHERE after IS NULL OR after - pub >= 3 * 86400000000",
)
def m6(spark, sf_dir):
    """Checkups in order of time: one that comes within three days of the last that was kept takes its place, so those stay
    that none follows within three days."""
    rows = videos(spark, sf_dir).where("fmt = 'purchase'").groupBy("channel", "pub").agg(F.max("id").alias("id")).withColumn("back", -F.col("pub"))
    rows = with_previous(rows, ["channel"], "back", 7 * DAY, "after")
    return rows.where(F.col("after").isNull() | (-F.col("after") - F.col("pub") >= 3 * DAY)).select("channel", "id")

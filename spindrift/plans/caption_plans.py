"""Queries of text on screen, of sounds beside talk, and of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, captions, cues, scores
from ..sources.tables import table
from .registry import query

_LINES = """l AS (SELECT l_orderkey AS video, l_linenumber AS n, CASE l_linenumber % 6 WHEN 0 THEN l_shipmode_ WHEN 1 THEN '12:' || l_linenumber || '0' WHEN 2 THEN l_returnflag || '!!' WHEN 3 THEN '(' || l_returnflag || ' thought)' WHEN 4 THEN 'the word ' || l_linestatus ELSE '!!!' END AS text,
  l_quantity / 130 AS h, CASE WHEN l_tax > 0.05 THEN 'white' WHEN l_tax > 0.02 THEN 'red' ELSE 'black' END AS color, CASE WHEN l_discount > 0.06 THEN 'top' WHEN l_discount > 0.03 THEN 'middle' ELSE 'bottom' END AS place, l_discount * 8 AS x0, l_tax * 8 AS y0, l_discount * 8 + l_quantity / 100 AS x1, l_tax * 8 + 0.1 AS y1,
  l_quantity / 10 AS lasts, CASE WHEN l_linenumber % 4 = 0 THEN l_discount * 10 END AS said, l_orderkey % 3 > 0 AS transcript, 0.75 + l_discount * 2 AS sure FROM (SELECT *, 'by ' || l_returnflag AS l_shipmode_ FROM lineitem))"""


def _lines(spark, sf_dir):
    """Order lines as lines of text on screen."""
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    text = F.when(n % 6 == 0, F.concat(F.lit("by "), flag)).when(n % 6 == 1, F.concat(F.lit("12:"), n.cast("string"), F.lit("0"))).when(n % 6 == 2, F.concat(flag, F.lit("!!"))).when(n % 6 == 3, F.concat(F.lit("("), flag, F.lit(" thought)"))).when(n % 6 == 4, F.concat(F.lit("the word "), "l_linestatus")).otherwise("!!!")
    off, tax = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("video"), n.alias("n"), text.alias("text"), (F.col("l_quantity") / 130).alias("h"), F.when(tax > 0.05, "white").when(tax > 0.02, "red").otherwise("black").alias("color"),
        F.when(off > 0.06, "top").when(off > 0.03, "middle").otherwise("bottom").alias("place"), (off * 8).alias("x0"), (tax * 8).alias("y0"), (off * 8 + F.col("l_quantity") / 100).alias("x1"), (tax * 8 + 0.1).alias("y1"),
        (F.col("l_quantity") / 10).alias("lasts"), F.when(n % 4 == 0, off * 10).alias("said"), (F.col("l_orderkey") % 3 > 0).alias("transcript"), (0.75 + off * 2).alias("sure"),
    )


@query(
    "p15_screen_lines",
    f"""WITH {_LINES}, t AS (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS t FROM l), c AS (SELECT *, length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS k FROM t),
    ok AS (SELECT * FROM c WHERE h <= 0.35 AND t <> '' AND CASE WHEN regexp_matches(t, '[가-힣]') THEN true WHEN regexp_full_match(t, '[\\d:.,%/-]+') THEN k >= 2 AND sure >= 0.8 ELSE k >= 2 AND length(t) >= 2 AND sure >= 0.85 AND k >= 0.6 * length(t) END),
    f AS (SELECT o_orderkey AS video, 0.1 AS a, 0.1 AS b, 0.5 AS c, 0.4 AS d FROM orders WHERE o_orderkey % 2 = 0)
    SELECT video, n, text FROM ok WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.video = ok.video AND (x0 + x1) / 2 BETWEEN a - 0.01 AND c + 0.01 AND (y0 + y1) / 2 BETWEEN b - 0.01 AND d + 0.01
      AND greatest(0, least(x1, c + 0.01) - greatest(x0, a - 0.01)) * greatest(0, least(y1, d + 0.01) - greatest(y0, b - 0.01)) >= 0.5 * greatest(1e-6, (x1 - x0) * (y1 - y0)))""",
)
def p15(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    fixed = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("video"), F.lit(0.1).alias("a"), F.lit(0.1).alias("b"), F.lit(0.5).alias("c"), F.lit(0.4).alias("d"))
    return captions.outside_fixed(rows.where(captions.plausible(F.col("text"), F.col("h"), F.col("sure"))), fixed).select("video", "n", "text")


@query(
    "p16_caption_kinds",
    f"""WITH {_LINES}, t AS (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS t, ((x0 < 0.25 OR x1 > 0.75) AND (y0 < 0.25 OR y1 > 0.75) AND x1 - x0 < 0.5) AS corner, color NOT IN ('white', 'black') AS colored, regexp_matches(text, '[!?]') AS loud FROM l)
    SELECT video, n, CASE WHEN regexp_matches(t, '^[!?.~]+$') THEN 'sfx'
      WHEN coalesce(said >= 0.6, false) THEN CASE WHEN h >= 0.1 OR (place <> 'bottom' AND (colored OR h >= 0.045)) OR (colored AND (h >= 0.07 + 0.02 OR loud)) THEN 'emph' ELSE 'speech' END
      WHEN (regexp_matches(text, '\\d+\\s*(m|km|%|kg|cm)|\\d+\\s*:\\s*\\d+') AND length(t) <= 14) OR regexp_full_match(t, '[\\d:.,%/~-]+') OR (h < 0.045 AND corner AND lasts >= 3) THEN 'info'
      WHEN NOT transcript AND place = 'bottom' AND color = 'white' AND lasts >= 2 AND h < 0.07 THEN 'speech' WHEN regexp_matches(text, '^\\(.*\\)$') THEN 'inner'
      WHEN h >= 0.07 OR color <> 'white' OR loud THEN 'emph' WHEN place = 'bottom' THEN 'speech' ELSE 'situ' END AS kind FROM t""",
)
def p16(spark, sf_dir):
    box = F.struct("x0", "y0", "x1", "y1")
    kind = captions.caption_kind(*[F.col(c) for c in ("text", "h", "color", "place")], box, *[F.col(c) for c in ("lasts", "said", "transcript")])
    return _lines(spark, sf_dir).select("video", "n", kind.alias("kind"))


@query(
    "j28_clear_sounds",
    """WITH w AS (SELECT user_id AS key, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + 3600 AS e FROM events WHERE event_type IN ('view', 'click')),
    q AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) / 1e6 AS lo, epoch_us(ts) / 1e6 + value * 60 AS hi FROM events WHERE event_type NOT IN ('view', 'click'))
    SELECT key, id FROM q WHERE lo <= hi AND NOT EXISTS (SELECT 1 FROM w WHERE w.key = q.key AND s < hi - least(0.02, (hi - lo) / 4) AND e > lo + least(0.02, (hi - lo) / 4))
      AND NOT (EXISTS (SELECT 1 FROM w WHERE w.key = q.key AND e BETWEEN lo - 0.35 AND lo + 0.05) AND EXISTS (SELECT 1 FROM w WHERE w.key = q.key AND s BETWEEN hi - 0.05 AND hi + 0.35))""",
)
def j28(spark, sf_dir):
    """Views and clicks as talk of an hour, the other events as sounds of some minutes."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), at.alias("lo"), "value", F.col("event_type").isin("view", "click").alias("talk"))
    words = rows.where("talk").select("key", F.col("lo").alias("s"), (F.col("lo") + 3600).alias("e"))
    return captions.clear_of_talk(rows.where("not talk").select("key", "id", "lo", (F.col("lo") + F.col("value") * 60).alias("hi")), words, 3600.0).select("key", "id")


@query(
    "u4_strict_answers",
    """WITH a AS (SELECT c_custkey AS id, c_custkey % 6 AS way, c_name, c_mktsegment, c_nationkey FROM customer)
    SELECT id, CASE way WHEN 3 THEN 'none' WHEN 4 THEN 'broken' ELSE 'ok' END AS state, CASE WHEN way NOT IN (3, 4) THEN 'about ' || c_name END AS summary, CASE WHEN way NOT IN (3, 4) THEN CASE WHEN way = 5 THEN 1 ELSE 2 END END AS risks,
    CASE WHEN way NOT IN (3, 4) THEN 2 END AS actions, CASE WHEN way NOT IN (3, 4) THEN CASE WHEN c_nationkey > 2 THEN 'plain' ELSE c_mktsegment END END AS first_action FROM a""",
)
def u4(spark, sf_dir):
    """Customers as answers: bare, fenced, in talk, without an object, cut short, with single values for lists."""
    rows = table(spark, sf_dir, "customer").withColumn("way", F.col("c_custkey") % 6)
    risks = F.when(F.col("way") == 5, F.lit('"one  risk"')).otherwise(F.lit('["a", " ", "b"]'))
    body = F.format_string('{"summary": "about   %s", "risks": %s, "actions": [{"text": "%s", "why": "x", "priority": %d}, "plain", {"text": " "}, 7]}', "c_name", risks, "c_mktsegment", "c_nationkey")
    body = F.replace(body, F.lit(", 7]"), F.lit("]"))
    text = F.when(F.col("way") == 1, F.concat(F.lit("so:\n```json\n"), body, F.lit("\n```\nthat is {it}"))).when(F.col("way") == 2, F.concat(F.lit("I think "), body, F.lit(" is it"))).when(F.col("way") == 3, F.lit("no idea")).when(F.col("way") == 4, F.concat(F.substring(body, F.lit(1), F.length(body) - 3), F.lit("}"))).otherwise(body)
    got = answers.parse_answers(rows.select(F.col("c_custkey").alias("id"), text.alias("text")), "text")
    size = lambda c: F.when(F.col("state") == "ok", F.size(c)).cast("int")
    return got.select("id", "state", "summary", size("risks").alias("risks"), size("actions").alias("actions"), F.get("actions", F.lit(0))["text"].alias("first_action"))


_CREW = cues.Crew(slates=(("once more", True), ("again", True), ("wait", False)), cues=("wrong,? again", "^again again$"), fillers=("so", "well"), sorry=("sorry",), oops="oops|no", strong=("one", "two", "go"), weak=("left", "right"), ending="s")
_SAID = "CASE l_linenumber % 7 WHEN 0 THEN 'so once more' WHEN 1 THEN 'wait, ' || l_returnflag || l_linestatus || CASE WHEN l_tax > 0.04 THEN ' well' ELSE 'xx' END WHEN 2 THEN 'wrong, again' || CASE WHEN l_tax > 0.04 THEN '!' ELSE '' END WHEN 3 THEN 'left ' || CASE WHEN l_tax > 0.04 THEN 'rights' ELSE 'left' END WHEN 4 THEN 'so one, two' || l_linestatus WHEN 5 THEN 'go goes ' || CAST(floor(l_quantity) AS INT) WHEN 6 THEN 'left!' ELSE 'x' END"


@query(
    "p11_crew_lines",
    f"""WITH s AS (SELECT l_orderkey AS id, l_linenumber AS n, {_SAID} AS t FROM lineitem),
    r AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, 'once more', ' ', 'g'), 'again', ' ', 'g'), 'wait', ' ', 'g') AS rest, regexp_replace(regexp_replace(t, 'wrong,? again', ' ', 'g'), '^again again$', ' ', 'g') AS rest2 FROM s),
    w AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '\\s+'), lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda x: x NOT IN ('', 'so', 'well')) AS ws,
      length(regexp_replace(array_to_string(list_filter(list_transform(regexp_split_to_array(rest, '\\s+'), lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda x: x NOT IN ('', 'so', 'well', 'sorry')), ''), 'oops|no', '', 'g')) AS k,
      length(regexp_replace(array_to_string(list_filter(list_transform(regexp_split_to_array(rest2, '\\s+'), lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda x: x NOT IN ('', 'so', 'well', 'sorry')), ''), 'oops|no', '', 'g')) AS k2 FROM r),
    p AS (SELECT *, list_distinct(flatten(list_transform(ws, lambda x: regexp_extract_all(x, 'right|left|one|two|go')))) AS parts FROM w)
    SELECT id, n, regexp_matches(t, 'once more|again|wait') AND k <= CASE WHEN regexp_matches(t, 'once more|again') THEN 3 ELSE 2 END AS slate, NOT contains(t, '!') AND regexp_matches(t, 'wrong,? again|^again again$') AND k2 <= 3 AS cue,
    len(ws) > 0 AND len(list_filter(ws, lambda x: NOT (regexp_full_match(x, '[0-9]+') OR regexp_full_match(x, '(?:right|left|one|two|go)+s?')))) = 0 AND (len(list_filter(ws, lambda x: regexp_full_match(x, '[0-9]+'))) > 0 OR list_has_any(parts, ['one', 'two', 'go']) OR len(parts) >= 2 OR regexp_matches(t, '!\\s*$')) AS chant FROM p""",
)
def p11_lines(spark, sf_dir):
    """Order lines as what is said on the set."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.expr(_SAID).alias("t"))
    t = F.col("t")
    return rows.select("id", "n", cues.is_slate(t, _CREW).alias("slate"), cues.is_cue(t, _CREW).alias("cue"), cues.is_chant(t, _CREW).alias("chant"))


@query("p18_action_scores")
def p18_action(spark, sf_dir):
    """An order as a frame: its lines are people, a seventh line the ball; each third order was not looked at."""
    box = F.struct((F.col("l_discount") * 8).alias("x"), (F.col("l_tax") * 4).alias("y"), (F.col("l_quantity") / 400).alias("w"), (F.col("l_quantity") / 70).alias("h"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), box.alias("box"))
    frames = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") < 7, F.struct("n", "box")))), lambda p: p["box"]).alias("people"), F.max(F.when(F.col("n") == 7, F.col("box"))).alias("ball"))
    frames = frames.withColumn("people", F.when(F.col("id") % 3 > 0, F.col("people")))
    main = scores.main_person(F.col("people"), F.col("ball"))
    return frames.withColumn("main", main).select("id", "main", scores.action(F.col("people"), F.col("ball")).alias("action"), scores.protagonist(F.col("people"), F.col("main")).alias("protagonist"))

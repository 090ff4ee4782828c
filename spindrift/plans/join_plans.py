"""Joins: upserts, semi and anti joins, as-of, nearest and interval joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fingerprint
from ..operators.relational import asof, first_pairs, inverted, nearest, newest_n, overlapping, overlay, overridden, points_in_intervals, upsert
from ..sources.stage import staged
from ..sources.tables import DAY, HOUR, VIDEOS, table, videos
from .registry import query

R = lambda c: F.round(c, 6)
_KIND = lambda rows, kind: rows.where(F.col("fmt") == kind)


@query(
    "j2_upsert",
    """WITH a AS (SELECT c_custkey AS id, c_name AS title, c_acctbal AS views FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT o_custkey AS id, min(o_orderpriority) AS title, max(o_totalprice) AS views FROM orders GROUP BY 1)
    SELECT coalesce(a.id, b.id) AS id, coalesce(b.views, a.views) AS views, coalesce(a.title, b.title) AS title, CASE WHEN a.id IS NULL THEN 'fresh' WHEN b.id IS NULL THEN 'base' ELSE 'both' END AS origin FROM a FULL JOIN b ON a.id = b.id""",
)
def j2(spark, sf_dir):
    base = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("views"))
    fresh = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderpriority").alias("title"), F.max("o_totalprice").alias("views"))
    return upsert(base, fresh, ["id"], prefer=["views"], keep=["title"])


@query("j4_retain_referenced", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j4(spark, sf_dir):
    used = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(used, "c_custkey", "left_semi").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query(
    "j5_overlay",
    """WITH l AS (SELECT s_suppkey AS key, s_nationkey AS alt, s_name AS name, 'live' AS grp FROM supplier), s AS (SELECT c_custkey AS key, c_nationkey AS alt, c_name AS name, c_mktsegment AS grp FROM customer),
    u AS (SELECT * FROM l UNION ALL SELECT * FROM s WHERE key NOT IN (SELECT key FROM l) AND alt NOT IN (SELECT alt FROM l)), o AS (SELECT p_partkey AS key, CASE WHEN p_size > 25 THEN p_brand END AS grp, CASE WHEN p_size % 2 = 0 THEN p_name END AS name FROM part)
    SELECT u.key, alt, coalesce(o.name, u.name) AS name, coalesce(o.grp, u.grp) AS grp FROM u LEFT JOIN o ON o.key = u.key""",
)
def j5(spark, sf_dir):
    """Suppliers over customers, by key and by nation; names and groups that a list of parts gives win."""
    live = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("alt"), F.col("s_name").alias("name"), F.lit("live").alias("grp"))
    seed = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("alt"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("grp"))
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("grp"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("name"))
    return overridden(overlay(live, seed, ["key", "alt"]), own, "key", ["name", "grp"])


@query(
    "j6_composite_anti",
    """SELECT o.o_orderkey AS id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND (l.l_returnflag = 'R' OR l.l_shipdate >= o.o_orderdate + INTERVAL 90 DAY))""",
)
def j6(spark, sf_dir):
    o, item = table(spark, sf_dir, "orders").alias("o"), table(spark, sf_dir, "lineitem").alias("l")
    late = (F.col("l.l_returnflag") == "R") | (F.col("l.l_shipdate") >= F.col("o.o_orderdate") + F.expr("interval 90 days"))
    return o.join(item, (F.col("l.l_orderkey") == F.col("o.o_orderkey")) & late, "left_anti").select(F.col("o_orderkey").alias("id"))


@query(
    "j7_first_pair_in_range",
    f"""WITH {VIDEOS} SELECT channel, id, other FROM (SELECT a.channel, a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.pub, b.id) AS k FROM v a JOIN v b ON a.channel = b.channel AND a.fmt = 'purchase' AND b.fmt = 'signup'
    AND abs(a.pub - b.pub) <= 86400000000) WHERE k = 1""",
)
def j7(spark, sf_dir):
    rows = videos(spark, sf_dir)
    spans = _KIND(rows, "purchase").select("channel", "id", (F.col("pub") - DAY).alias("lo"), (F.col("pub") + DAY).alias("hi"))
    points = _KIND(rows, "signup").select("channel", F.col("id").alias("other"), F.col("pub").alias("at"))
    pairs = points_in_intervals(points, spans, key="channel", time="at", start="lo", stop="hi", bucket=DAY, closed=True)
    first = F.min(F.struct("at", "other")).alias("first")
    return pairs.groupBy("channel", "id").agg(first).select("channel", "id", F.col("first.other").alias("other"))


_TITLED = r"""e AS (SELECT event_id AS id, user_id % 20 AS channel, epoch_us(ts) AS pub, event_type IN ('view', 'click') AS long_, list_distinct(list_filter(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z]{3,10}'), lambda w: w NOT IN ('the', 'and', 'that', 'que', 'die', 'der', 'les'))) AS words FROM events JOIN documents ON doc_id = event_id WHERE text IS NOT NULL)"""


@query(
    "j7_long_short_pairs",
    f"""WITH {_TITLED}, p AS (SELECT a.channel, a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS k FROM e a JOIN e b ON a.channel = b.channel AND a.long_ AND NOT b.long_ AND abs(a.pub - b.pub) <= 14 * 86400000000 AND list_has_any(a.words, b.words))
    SELECT channel, id, other FROM p WHERE k = 1""",
)
def j7_titles(spark, sf_dir):
    """Events with the title of the document of their number: views and clicks are long, the others short; of each long one the
    first short one (by number) within 14 days with a word of its title."""
    title = F.lower(F.split("text", "\n")[0])
    words = F.array_distinct(F.filter(F.regexp_extract_all(title, F.lit("([a-z]{3,10})")), lambda w: ~w.isin("the", "and", "that", "que", "die", "der", "les")))
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), words.alias("words"))
    rows = videos(spark, sf_dir).select("id", (F.col("channel") % 20).alias("channel"), "pub", F.col("fmt").isin("view", "click").alias("long")).join(docs, "id")
    return first_pairs(rows.where("long"), rows.where("not long"), key="channel", time="pub", words="words", within=14 * DAY)


@query(
    "j8_asof_backward",
    f"""WITH {VIDEOS} SELECT p.id, coalesce(h.views, f.views) AS views_then FROM (SELECT * FROM v WHERE fmt = 'purchase') p ASOF LEFT JOIN (SELECT * FROM v WHERE fmt = 'view') h ON p.channel = h.channel AND p.pub >= h.pub
    LEFT JOIN (SELECT channel, arg_min(views, pub) AS views FROM v WHERE fmt = 'view' GROUP BY 1) f ON f.channel = p.channel""",
)
def j8(spark, sf_dir):
    rows = videos(spark, sf_dir)
    history = _KIND(rows, "view")
    first = history.groupBy("channel").agg(F.min_by("views", "pub").alias("first"))
    found = asof(_KIND(rows, "purchase").select("channel", "id", "pub"), history, key="channel", time="pub", value="views", bucket=2 * DAY)
    return found.join(first, "channel", "left").select("id", F.coalesce("views", "first").alias("views_then"))


@query(
    "j9_asof_two_sided",
    f"""WITH {VIDEOS}, h AS (SELECT * FROM v WHERE fmt = 'view') SELECT p.id, CASE WHEN p.pub - b.pub <= 2 * 86400000000 THEN b.views WHEN f.pub - p.pub <= 86400000000 THEN f.views END AS views_near
    FROM (SELECT * FROM v WHERE fmt = 'purchase') p ASOF LEFT JOIN h b ON p.channel = b.channel AND p.pub >= b.pub ASOF LEFT JOIN h f ON p.channel = f.channel AND p.pub <= f.pub""",
)
def j9(spark, sf_dir):
    rows = videos(spark, sf_dir)
    history = _KIND(rows, "view")
    back = asof(_KIND(rows, "purchase").select("channel", "id", "pub"), history, key="channel", time="pub", value="views", bucket=2 * DAY).withColumnsRenamed({"views": "v0", "views_time": "t0"})
    both = asof(back, history, key="channel", time="pub", value="views", bucket=2 * DAY, forward=True)
    near = F.when(F.col("pub") - F.col("t0") <= 2 * DAY, F.col("v0")).when(F.col("views_time") - F.col("pub") <= DAY, F.col("views"))
    return both.select("id", near.alias("views_near"))


@query(
    "j10_interpolated_asof",
    f"""WITH {VIDEOS}, h AS (SELECT * FROM v WHERE fmt = 'view') SELECT p.id, round(CASE WHEN b.pub = f.pub THEN b.views ELSE b.views + (f.views - b.views) * (p.pub - b.pub) / (f.pub - b.pub) END, 6) AS level
    FROM (SELECT * FROM v WHERE fmt = 'purchase') p ASOF JOIN h b ON p.channel = b.channel AND p.pub >= b.pub ASOF JOIN h f ON p.channel = f.channel AND p.pub <= f.pub""",
)
def j10(spark, sf_dir):
    rows = videos(spark, sf_dir)
    history = _KIND(rows, "view")
    back = asof(_KIND(rows, "purchase").select("channel", "id", "pub"), history, key="channel", time="pub", value="views", bucket=2 * DAY).withColumnsRenamed({"views": "v0", "views_time": "t0"})
    both = asof(back, history, key="channel", time="pub", value="views", bucket=2 * DAY, forward=True).where("v0 is not null and views is not null")
    level = F.when(F.col("t0") == F.col("views_time"), F.col("v0")).otherwise(F.col("v0") + (F.col("views") - F.col("v0")) * (F.col("pub") - F.col("t0")) / F.nullif(F.col("views_time") - F.col("t0"), F.lit(0)))
    return both.select("id", R(level).alias("level"))


@query(
    "j12_point_in_interval",
    f"WITH {VIDEOS} SELECT p.id AS point, i.id AS span FROM v p JOIN v i ON p.channel = i.channel AND p.fmt = 'view' AND i.fmt = 'purchase' AND p.pub >= i.pub AND p.pub < i.pub + 43200000000",
)
def j12(spark, sf_dir):
    rows = videos(spark, sf_dir)
    spans = _KIND(rows, "purchase").select("channel", F.col("id").alias("span"), F.col("pub").alias("lo"), (F.col("pub") + 12 * HOUR).alias("hi"))
    points = _KIND(rows, "view").select("channel", F.col("id").alias("point"), "pub")
    return points_in_intervals(points, spans, key="channel", time="pub", start="lo", stop="hi", bucket=DAY).select("point", "span")


@query(
    "j13_interval_anti",
    f"WITH {VIDEOS} SELECT id FROM v p WHERE fmt = 'error' AND NOT EXISTS (SELECT 1 FROM v i WHERE i.channel = p.channel AND i.fmt = 'click' AND p.pub BETWEEN i.pub - 21600000000 AND i.pub + 21600000000)",
)
def j13(spark, sf_dir):
    rows = videos(spark, sf_dir)
    spans = _KIND(rows, "click").select("channel", (F.col("pub") - 6 * HOUR).alias("lo"), (F.col("pub") + 6 * HOUR).alias("hi"))
    points = _KIND(rows, "error").select("channel", "id", "pub")
    near = points_in_intervals(points, spans, key="channel", time="pub", start="lo", stop="hi", bucket=DAY, closed=True).select("id").distinct()
    return points.join(near, "id", "left_anti").select("id")


@query(
    "j14_overlap_duration",
    f"""WITH {VIDEOS} SELECT a.id, sum(least(a.pub + 21600000000, b.pub + 43200000000) - greatest(a.pub, b.pub))::BIGINT AS shared FROM v a JOIN v b ON a.channel = b.channel AND a.fmt = 'click' AND b.fmt = 'view'
    AND least(a.pub + 21600000000, b.pub + 43200000000) > greatest(a.pub, b.pub) GROUP BY 1""",
)
def j14(spark, sf_dir):
    rows = videos(spark, sf_dir)
    a = _KIND(rows, "click").select("channel", "id", F.col("pub").alias("a0"), (F.col("pub") + 6 * HOUR).alias("a1"))
    b = _KIND(rows, "view").select("channel", F.col("pub").alias("b0"), (F.col("pub") + 12 * HOUR).alias("b1"))
    return overlapping(a, b, key="channel", a_span=("a0", "a1"), b_span=("b0", "b1"), bucket=DAY).groupBy("id").agg(F.sum("shared").alias("shared"))


@query(
    "j15_nearest_event",
    f"""WITH {VIDEOS}, x AS (SELECT e.id, o.fmt, abs(e.pub - o.pub) AS d, row_number() OVER (PARTITION BY e.id ORDER BY abs(e.pub - o.pub), o.pub) AS k FROM v e JOIN v o ON e.channel = o.channel AND e.fmt = 'error' AND o.fmt IN ('click', 'purchase')
    AND abs(e.pub - o.pub) <= 21600000000) SELECT v.id, coalesce(x.fmt, 'other') AS kind, x.d AS distance FROM v LEFT JOIN x ON x.id = v.id AND k = 1 WHERE v.fmt = 'error'""",
)
def j15(spark, sf_dir):
    rows = videos(spark, sf_dir)
    around = rows.where("fmt in ('click', 'purchase')").select("channel", "pub", F.col("fmt").alias("kind"))
    return nearest(_KIND(rows, "error").select("channel", "id", "pub"), around, key="channel", time="pub", value="kind", within=6 * HOUR, bucket=DAY, other="other").select("id", "kind", "distance")


@query(
    "j11_forecast_check",
    f"""WITH {VIDEOS}, f AS (SELECT channel, fmt, min(pub) AS begun, quantile_cont(views, 0.1) AS lo, quantile_cont(views, 0.9) AS hi FROM v WHERE pos >= 5 GROUP BY 1, 2)
    SELECT f.fmt, count(*) AS n, round(avg((views BETWEEN lo AND hi)::INT), 6) AS coverage FROM v JOIN f USING (channel, fmt) WHERE pub >= begun + 5 * 86400000000 GROUP BY 1""",
)
def j11(spark, sf_dir):
    rows = videos(spark, sf_dir)
    newest = newest_n(rows, ["channel", "fmt"], [F.desc("pub"), "id"], 5).select("id")
    bands = rows.join(newest, "id", "left_anti").groupBy("channel", "fmt").agg(F.min("pub").alias("at"), F.percentile("views", F.lit(0.1)).alias("lo"), F.percentile("views", F.lit(0.9)).alias("hi"))
    later = rows.join(bands, ["channel", "fmt"]).where(F.col("pub") >= F.col("at") + 5 * DAY)
    return later.groupBy("fmt").agg(F.count(F.lit(1)).alias("n"), R(F.avg(F.col("views").between(F.col("lo"), F.col("hi")).cast("int"))).alias("coverage"))


@query("j24_inverted_index", "SELECT w AS word, count(DISTINCT p_partkey) AS parts, string_agg(DISTINCT p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR) AS index_ FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def j24(spark, sf_dir):
    """Word -> the parts whose names have it, in blocks that are joined at the end."""
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    index = inverted(words, "word", "p_partkey").groupBy("word").agg(F.sum(F.size("items")).alias("parts"), F.flatten(F.collect_list("items")).alias("items"))
    return index.select("word", "parts", F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",").alias("index_"))


@query("j25_enrichment", "SELECT s_suppkey AS id, n_name AS nation, r_name AS region, s_acctbal > 0 AS solvent FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def j25(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "supplier")
    rows = rows.join(nation, rows.s_nationkey == nation.n_nationkey, "left").join(region, nation.n_regionkey == region.r_regionkey, "left")
    return rows.select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), (F.col("s_acctbal") > 0).alias("solvent"))


@query(
    "j26_longest_prefix",
    """WITH f AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS f FROM part UNION SELECT DISTINCT p_name FROM part WHERE p_partkey % 7 = 0), x AS (SELECT p_partkey AS id, p_name || '_' || p_partkey AS name FROM part)
    SELECT id, arg_max(f, length(f)) AS owner FROM x JOIN f ON starts_with(name, f || '_') OR starts_with(name, f || ' ') GROUP BY id""",
)
def j26(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    folders = parts.select(F.split("p_name", " ")[0].alias("owner")).union(parts.where("p_partkey % 7 = 0").select("p_name")).distinct()
    # every prefix that ends before a separator, longest first: an equi join instead of a test of all pairs
    named = parts.select(F.col("p_partkey").alias("id"), F.concat_ws("_", "p_name", "p_partkey").alias("name"))
    cuts = F.filter(F.sequence(F.lit(2), F.length("name")), lambda i: F.substring("name", i, F.lit(1)).isin("_", " "))
    prefixes = named.select("id", F.explode(F.transform(cuts, lambda i: F.substring("name", F.lit(1), i - 1))).alias("owner"))
    return prefixes.join(folders, "owner").groupBy("id").agg(F.max_by("owner", F.length("owner")).alias("owner"))


@query(
    "j17_hamming_join",
    r"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[^ \t\n\x0b\x0c\r]+'))) AS w FROM documents WHERE text IS NOT NULL),
    h AS (SELECT doc_id, md5(w) AS h FROM w), b AS (SELECT doc_id, k, sum(CASE WHEN (('0x' || h[k // 4 + 1])::BIGINT >> (3 - k % 4)) & 1 = 1 THEN 1 ELSE -1 END) > 0 AS bit FROM h, range(64) t(k) GROUP BY 1, 2),
    f AS (SELECT doc_id, string_agg(bit::INT::VARCHAR, '' ORDER BY k) AS s FROM b GROUP BY 1), r AS (SELECT s, min(doc_id) AS id FROM f GROUP BY 1)
    SELECT a.id AS a, b.id AS b, hamming(a.s, b.s)::BIGINT AS distance FROM r a JOIN r b ON a.id < b.id AND hamming(a.s, b.s) <= 7""",
)
def j17(spark, sf_dir):
    """Pairs of distinct 64-bit fingerprints at most 7 bits apart, each by the least document that has it.

    A fingerprint has, bit by bit, what most of a text's distinct words have in their hash: copies with a few words changed
    are a few bits apart, texts of other words about half of them."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("text"))
    prints = fingerprint.fingerprints(rows, "id", "text").where("hash is not null").groupBy("hash").agg(F.min("id").alias("id"))
    return fingerprint.near_pairs(staged(prints, "prints"))


@query("e5_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def e5(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("m2_changed", "WITH a AS (SELECT o_custkey AS k, o_orderpriority AS p, max(o_totalprice) AS t FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2), b AS (SELECT o_custkey AS k, o_orderpriority AS p, max(o_totalprice) AS t FROM orders GROUP BY 1, 2) SELECT b.k AS key, b.p AS part, CASE WHEN a.k IS NULL THEN 'new' ELSE 'changed' END AS state FROM b LEFT JOIN a ON a.k = b.k AND a.p = b.p WHERE a.t IS DISTINCT FROM b.t")
def m2(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("part"), "o_totalprice", "o_orderkey")
    last = rows.where("o_orderkey % 2 = 0").groupBy("key", "part").agg(F.max("o_totalprice").alias("was"))
    now = rows.groupBy("key", "part").agg(F.max("o_totalprice").alias("is"))
    both = now.join(last, ["key", "part"], "left").where(~F.col("is").eqNullSafe(F.col("was")))
    return both.select("key", "part", F.when(F.col("was").isNull(), "new").otherwise("changed").alias("state"))


@query("m4_ripe_only", f"WITH {VIDEOS}, e AS (SELECT max(pub) AS now FROM v) SELECT id, round(views * (1 - exp(-((now - pub) / 86400e6 / 7) / 0.5)), 6) AS accrued FROM v, e WHERE now - pub >= 7 * 86400000000")
def m4(spark, sf_dir):
    rows = videos(spark, sf_dir)
    now = rows.agg(F.max("pub")).first()[0] or 0
    age = (F.lit(now) - F.col("pub")) / DAY / 7
    return rows.where(F.col("pub") <= now - 7 * DAY).select("id", R(F.col("views") * (1 - F.exp(-age / 0.5))).alias("accrued"))



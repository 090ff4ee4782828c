"""Column expressions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.text import tokens
from ..operators import stats
from ..operators.relational import numbered
from ..sources.tables import ALL_TITLES, table, titles
from .registry import query

R = lambda c: F.round(c, 6)


@query("p1_valid_numbers", "SELECT event_id AS id, value FROM events WHERE value > 0 AND NOT isnan(value) AND NOT isinf(value)")
def p1(spark, sf_dir):
    return numbers.keep_valid(table(spark, sf_dir, "events"), "value").select(F.col("event_id").alias("id"), "value")


@query("n2_safe_int", "SELECT event_id AS id, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) >= 0 THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def n2(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), numbers.safe_int(F.get_json_object("props", "$.k")).alias("k"))


@query("n3_timecodes", "SELECT event_id AS id, printf('%02d:%02d:%02d,%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS stamp, printf('%d:%02d', ms // 60000, (ms // 1000) % 60) AS short FROM (SELECT event_id, round(value * 1000)::BIGINT AS ms FROM events)")
def n3(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), numbers.timecode(F.col("value")).alias("stamp"), numbers.short_time(F.col("value")).alias("short"))


@query("n4_local_week", "SELECT o_orderkey AS id, date_trunc('week', o_orderdate + INTERVAL 9 HOUR)::DATE AS monday, (isodow(o_orderdate + INTERVAL 9 HOUR) - 1)::BIGINT AS weekday FROM orders")
def n4(spark, sf_dir):
    local = F.from_utc_timestamp(F.col("o_orderdate").cast("timestamp"), "Asia/Seoul")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date(F.date_trunc("week", local)).alias("monday"), F.weekday(local).cast("long").alias("weekday"))


_CHANCE = "c AS (SELECT c_custkey AS id, c_acctbal AS v, abs(c_acctbal) / 10000 AS p, abs(c_acctbal) / 10000 - c_nationkey / 60.0 AS lo, abs(c_acctbal) / 10000 + c_nationkey / 40.0 AS hi, c_nationkey % 4 = 0 AS doubts FROM customer)"


@query(
    "n6_display_numbers",
    f"""WITH {_CHANCE}, r AS (SELECT *, (5 * round_even(100 * p / 5, 0))::BIGINT AS m, (5 * round_even(100 * lo / 5, 0))::BIGINT AS l0, (5 * round_even(100 * hi / 5, 0))::BIGINT AS h0 FROM c), s AS (SELECT *, greatest(0, least(l0, m)) AS l, least(100, greatest(h0, m)) AS h FROM r)
    SELECT id, CASE WHEN v >= 1000 THEN printf('%.1fk', floor(v / 100) / 10) ELSE printf('%d', floor(v)::BIGINT) END AS shown, CASE WHEN v <= 0 THEN 0 WHEN floor(log10(v)) - 1 > 0 THEN (round_even(v / pow(10, floor(log10(v)) - 1), 0) * pow(10, floor(log10(v)) - 1))::BIGINT ELSE round_even(v, 0)::BIGINT END AS two_digits,
    CASE WHEN p < 0.05 THEN 'under 5%' WHEN p > 0.95 THEN 'over 95%' ELSE 'about ' || m || '%' END AS chance, l || '~' || h || '%' AS range_, CASE WHEN doubts THEN 'low' WHEN h - l <= 25 THEN 'high' WHEN h - l <= 45 THEN 'middle' ELSE 'low' END AS confidence, h - l > 60 AS wide FROM s""",
)
def n6(spark, sf_dir):
    share = F.abs("c_acctbal") / 10000
    chance = numbers.shown_chance(share, share - F.col("c_nationkey") / 60.0, share + F.col("c_nationkey") / 40.0, F.col("c_nationkey") % 4 == 0)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), numbers.shown(F.col("c_acctbal")).alias("shown"), numbers.two_digits(F.col("c_acctbal")).alias("two_digits"), chance.alias("c"))
    return rows.select("id", "shown", "two_digits", F.col("c.text").alias("chance"), F.col("c.range").alias("range_"), F.col("c.confidence").alias("confidence"), F.col("c.wide").alias("wide"))


def cdf_sql(z: str) -> str:
    """The rational approximation of Phi(z) in SQL."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    poly = f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    tail = f"(exp(-({z}) * ({z}) / 2) / 2.5066282746310002 * {poly})"
    return f"CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END"


@query("n8_normal_cdf", f"SELECT c_custkey AS id, c_acctbal / 1000 AS z, {cdf_sql('(c_acctbal / 1000)')} AS p FROM customer")
def n8(spark, sf_dir):
    """Phi of each customer's balance in thousands."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("z"), numbers.normal_cdf(F.col("c_acctbal") / 1000).alias("p"))


@query("n7_display_step", "SELECT c_custkey AS id, (CASE WHEN abs(c_acctbal) < 100 THEN 1 WHEN abs(c_acctbal) < 1000 THEN 10 WHEN abs(c_acctbal) < 10000 THEN 100 WHEN abs(c_acctbal) < 100000 THEN 1000 ELSE 10000 END)::BIGINT AS step FROM customer")
def n7(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), numbers.step(F.abs("c_acctbal")).alias("step"))


@query("n9_log_ratio", "SELECT l_orderkey AS id, l_linenumber::BIGINT AS line, round(ln(greatest(l_quantity, 0.05) / greatest(l_discount, 0.05)), 6) AS ratio, round(abs(l_quantity - l_tax) / greatest(abs(l_quantity), abs(l_tax), 1), 6) AS relative FROM lineitem")
def n9(spark, sf_dir):
    a, b, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("line"), R(numbers.log_ratio(a, b, 0.05)).alias("ratio"), R(numbers.relative(a, t, 1.0)).alias("relative"))


@query(
    "n10_decile_distance",
    "WITH d AS (SELECT user_id AS channel, list_transform(quantile_cont(value, [0.25, 0.5, 0.75]), lambda x: greatest(x, 0.05)) AS q FROM events GROUP BY 1), b AS (SELECT list_transform(quantile_cont(value, [0.25, 0.5, 0.75]), lambda x: greatest(x, 0.05)) AS q FROM events) SELECT channel, round((abs(ln(d.q[1] / b.q[1])) + abs(ln(d.q[2] / b.q[2])) + abs(ln(d.q[3] / b.q[3]))) / 3, 6) AS w FROM d, b",
)
def n10(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), "value", F.lit("all").alias("every"))

    def quarters(key):
        found = stats.exact_quantiles(rows, [key], "value", [0.25, 0.5, 0.75])
        return found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("share", "quantile"))), lambda x: x["quantile"]).alias("q"))

    whole = F.broadcast(quarters("every").select(F.col("q").alias("whole")))  # one row
    return quarters("channel").crossJoin(whole).select("channel", R(numbers.decile_distance(F.col("q"), F.col("whole"), 0.05)).alias("w"))


@query("f13_url_key", r"SELECT page_id AS id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages WHERE url IS NOT NULL")
def f13(spark, sf_dir):
    host = F.lower(F.regexp_extract("url", r"^https?://([^/?#]+)", 1))
    return table(spark, sf_dir, "pages").where("url is not null").select(F.col("page_id").alias("id"), host.alias("host"), F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1).alias("path"))


@query("f14_hash_id", "SELECT c_custkey AS id, substr(sha1(c_name), 1, 16) AS fid FROM customer")
def f14(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.substring(F.sha1(F.col("c_name").cast("binary")), 1, 16).alias("fid"))


@query("e1_token_sets", f"WITH {ALL_TITLES}, w AS (SELECT id, channel, pos, list_distinct(regexp_extract_all(lower(title), '[a-z가-힣]{{2,10}}')) AS w FROM t) SELECT a.id, b.id AS other, len(list_intersect(a.w, b.w))::BIGINT AS shared FROM w a JOIN w b ON a.channel = b.channel AND b.pos = a.pos + 1 WHERE len(list_intersect(a.w, b.w)) > 0")
def e1(spark, sf_dir):
    rows = numbered(titles(spark, sf_dir), ["channel"], "id", [F.desc("id")], 4096, newest=True, number="pos").select("channel", "pos", "id", F.array_distinct(tokens("title")).alias("w"))
    after = rows.select("channel", (F.col("pos") - 1).alias("pos"), F.col("id").alias("other"), F.col("w").alias("x"))
    return rows.join(after, ["channel", "pos"]).select("id", "other", F.size(F.array_intersect("w", "x")).cast("long").alias("shared")).where("shared > 0")


@query("e4_first_of_each", "SELECT p_name AS name, p_partkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part) WHERE k = 1")
def e4(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))


@query("p5_p6_provenance", "SELECT s_suppkey AS id, coalesce(CASE WHEN s_acctbal < 0 THEN 'manual' END, CASE WHEN n_name IN ('FRANCE', 'GERMANY', 'NATION_1', 'NATION_2') THEN 'own' WHEN n_name IS NOT NULL THEN 'other' END, 'unknown') AS origin FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def p5(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "supplier")
    rows = rows.join(nation, rows.s_nationkey == nation.n_nationkey, "left")
    manual = F.when(F.col("s_acctbal") < 0, "manual")
    auto = F.when(F.col("n_name").isin("FRANCE", "GERMANY", "NATION_1", "NATION_2"), "own").when(F.col("n_name").isNotNull(), "other")
    return rows.select(F.col("s_suppkey").alias("id"), F.coalesce(manual, auto, F.lit("unknown")).alias("origin"))


@query("p8_stale", "SELECT o_custkey AS key, max(o_orderdate) AS listed FROM orders GROUP BY 1 HAVING (SELECT max(o_orderdate) FROM orders) - max(o_orderdate) >= INTERVAL 30 DAY")
def p8(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    now = rows.agg(F.max("o_orderdate")).first()[0]
    last = rows.groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderdate").alias("listed"))
    return last.where(F.col("listed") <= F.lit(now).cast("timestamp_ntz") - F.expr("interval 30 days"))


@query("p10_error_kinds", "SELECT event_id AS id, CASE WHEN regexp_matches(props, '\"k\": [0-9]\\D') THEN 'small' WHEN regexp_matches(props, '\"k\": [5-9][0-9]') THEN 'large' WHEN regexp_matches(props, '\"k\"') THEN 'medium' ELSE 'none' END AS kind FROM events WHERE props IS NOT NULL")
def p10(spark, sf_dir):
    rules = [("small", r'"k": [0-9]\D'), ("large", r'"k": [5-9][0-9]'), ("medium", '"k"')]
    return table(spark, sf_dir, "events").where("props is not null").select(F.col("event_id").alias("id"), numbers.first_rule(F.col("props"), rules, "none").alias("kind"))


@query("p17_rule_score", "SELECT o_orderkey AS id, greatest(0, 100 - 20 * (o_totalprice < 1000)::INT - 20 * (o_orderstatus = 'P')::INT - 7 * (o_orderpriority = '5-LOW')::INT)::BIGINT AS score FROM orders")
def p17(spark, sf_dir):
    bad = [F.col("o_totalprice") < 1000, F.col("o_orderstatus") == "P"]
    warn = [F.col("o_orderpriority") == "5-LOW"]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), numbers.rule_score(bad, warn).alias("score"))


@query("o3_natural_order", "SELECT p_partkey AS id, row_number() OVER (PARTITION BY p_type ORDER BY regexp_extract(p_brand, '[A-Za-z#]+'), regexp_extract(p_brand, '[0-9]+')::INT, p_partkey) AS place FROM part")
def o3(spark, sf_dir):
    from pyspark.sql.window import Window

    order = [F.regexp_extract("p_brand", "[A-Za-z#]+", 0), F.regexp_extract("p_brand", "[0-9]+", 0).cast("int"), "p_partkey"]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.row_number().over(Window.partitionBy("p_type").orderBy(*order)).cast("long").alias("place"))

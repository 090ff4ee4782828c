"""Stores, caches and file listings, each over a driver's table laid out in the form that the source reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files, library, store
from ..sources.tables import table
from .registry import query

_MICROS = "epoch_us(o_orderdate)::BIGINT"


@query(
    "s6_upserted_documents",
    f"SELECT o_custkey AS key, max({_MICROS}) AS \"at\", arg_max(o_orderkey, [{_MICROS}, o_orderkey]) AS value FROM orders GROUP BY 1",
)
def s6(spark, sf_dir):
    """Orders as versions of their customer's document, upserted in three batches that come late and one of them twice."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"), F.col("o_orderkey").alias("value"))
    docs = store.DocumentStore(spark, files.fresh_folder(spark, "store"), "key long, at long, value long", key="key", at="at").create()
    month = F.month(F.timestamp_micros("at"))
    for part in (month > 8, month <= 4, month.between(5, 8), month > 8):
        docs.upsert(rows.where(part))
    return docs.read()


@query(
    "s32_followed_log",
    "SELECT md5(l) AS line_md5, count(*) AS n, 0::BIGINT AS again FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM conversations WHERE text IS NOT NULL) GROUP BY 1",
)
def s32(spark, sf_dir):
    """Lines of conversations as a log that is followed twice while it grows: each line once, numbers without gaps."""
    home = files.fresh_folder(spark, "log")
    lines = table(spark, sf_dir, "conversations").where("text is not null").select("turn", F.explode(F.split("text", "\n")).alias("value"))
    lines.where("turn % 2 = 0").select("value").write.mode("append").text(f"{home}/log")
    first = store.follow_log(spark, f"{home}/log", f"{home}/out", f"{home}/state")
    lines.where("turn % 2 = 1").select("value").write.mode("append").text(f"{home}/log")
    total = store.follow_log(spark, f"{home}/log", f"{home}/out", f"{home}/state")
    known = store.lines_since(spark, f"{home}/out", 0)
    later = store.lines_since(spark, f"{home}/out", first).select(F.count(F.lit(1)).alias("later"), F.max("n").alias("last"))
    # gaps or numbers given twice would show here
    again = later.select((F.col("later") - (total - first) + F.col("last") - (total - 1)).alias("again"))
    return known.groupBy(F.md5("line").alias("line_md5")).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(again))


@query(
    "s24_artefact_cache",
    """WITH p AS (SELECT p_partkey AS k, 'f' || p_partkey AS name, p_size::BIGINT AS size, p_retailprice AS mtime FROM part)
    SELECT name, size, mtime, CASE WHEN k % 5 = 0 OR k % 7 = 0 OR k % 11 = 0 OR k % 13 = 0 THEN size * 10 ELSE size * 10 + 1 END AS value, NOT (k % 5 = 0 OR k % 7 = 0 OR k % 11 = 0 OR k % 13 = 0) AS reused FROM p""",
)
def s24(spark, sf_dir):
    """Parts as files; of some the artefact is of an older version, another size or time, or not there: only these are
    computed again (their value ends in 0)."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("mtime"))
    old = parts.where("k % 5 <> 0").select(
        F.when(F.col("k") % 7 == 0, 3).otherwise(4).alias("ver"), "name", (F.col("size") + F.when(F.col("k") % 11 == 0, 1).otherwise(0)).alias("size"),
        F.when(F.col("k") % 13 == 0, None).otherwise(F.col("mtime")).alias("mtime"), (F.col("size") * 10 + 1).alias("value"),
    )
    got = store.refreshed(old, parts.drop("k"), lambda stale: stale.withColumn("value", F.col("size") * 10), 4)
    return got.select("name", "size", "mtime", "value", "reused")


@query(
    "s25_newer_listing",
    """WITH l AS (SELECT user_id AS channel, event_type AS source, max(epoch_us(ts)) AS t, list(event_id ORDER BY event_id DESC) AS ids FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2)
    SELECT channel, arg_max(source, t) AS source, max(t) AS "at", unnest(arg_max(ids, t)[:300]) AS id FROM l GROUP BY 1""",
)
def s25(spark, sf_dir):
    """Of a user's clicks and views the list with the later last one, newest first, 300 rows at most."""
    rows = table(spark, sf_dir, "events").where("event_type in ('view', 'click')")
    lists = rows.groupBy(F.col("user_id").alias("channel"), F.col("event_type").alias("source")).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("at"), F.sort_array(F.collect_list("event_id"), asc=False).alias("ids"))
    return store.newer(lists, ["channel"], "at", "ids").select("channel", "source", "at", F.explode("ids").alias("id"))


@query(
    "s22_renamed_work",
    """WITH f AS (SELECT 'n' || s_suppkey AS name, s_nationkey::BIGINT AS size, floor(s_acctbal / 10) AS mtime FROM supplier WHERE s_suppkey % 3 <> 0), w AS (SELECT 'o' || c_custkey AS old, c_nationkey::BIGINT AS size, floor(c_acctbal / 10) + 0.5 AS mtime FROM customer),
    p1 AS (SELECT old, name, abs(f.mtime - w.mtime) AS off FROM w JOIN f ON f.size = w.size AND abs(f.mtime - w.mtime) <= 2),
    m1 AS (SELECT a.* FROM (SELECT old, arg_min(name, (off, name)) AS name FROM p1 GROUP BY 1) a JOIN (SELECT name, arg_min(old, (off, old)) AS old FROM p1 GROUP BY 1) b ON a.old = b.old AND a.name = b.name),
    p2 AS (SELECT * FROM p1 WHERE old NOT IN (SELECT old FROM m1) AND name NOT IN (SELECT name FROM m1)),
    m2 AS (SELECT a.* FROM (SELECT old, arg_min(name, (off, name)) AS name FROM p2 GROUP BY 1) a JOIN (SELECT name, arg_min(old, (off, old)) AS old FROM p2 GROUP BY 1) b ON a.old = b.old AND a.name = b.name),
    p3 AS (SELECT * FROM p2 WHERE old NOT IN (SELECT old FROM m2) AND name NOT IN (SELECT name FROM m2)),
    m3 AS (SELECT a.* FROM (SELECT old, arg_min(name, (off, name)) AS name FROM p3 GROUP BY 1) a JOIN (SELECT name, arg_min(old, (off, old)) AS old FROM p3 GROUP BY 1) b ON a.old = b.old AND a.name = b.name)
    SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3""",
)
def s22(spark, sf_dir):
    """Customers as work and suppliers as files: same nation, balances within 20, each to its nearest."""
    made = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_nationkey").cast("long").alias("size"), F.floor(F.col("s_acctbal") / 10).cast("double").alias("mtime"))
    work = table(spark, sf_dir, "customer").select(F.concat(F.lit("o"), F.col("c_custkey").cast("string")).alias("old"), F.col("c_nationkey").cast("long").alias("size"), (F.floor(F.col("c_acctbal") / 10) + 0.5).cast("double").alias("mtime"))
    return library.renamed(work, made)

"""Regressions, calibration, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from ..sources.tables import VIDEOS, table, videos
from .registry import query

R = lambda c: F.round(c, 6)
_PEERS = f"""{VIDEOS}, p AS (SELECT fmt, ln(c_acctbal) AS x, ln(median(views)) AS y, c_mktsegment AS grp, channel FROM v JOIN customer ON c_custkey = channel WHERE c_acctbal > 0 AND views > 0 GROUP BY fmt, channel, c_acctbal, c_mktsegment HAVING count(*) >= 3)"""


def peers(spark, sf_dir):
    """fmt, channel, grp, x = ln subscribers, y = ln of the usual views; channels with three views at least."""
    subs = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("channel"), F.log("c_acctbal").alias("x"), F.col("c_mktsegment").alias("grp"))
    each = videos(spark, sf_dir).where(stats.valid("views")).groupBy("fmt", "channel").agg(F.count(F.lit(1)).alias("n"), stats.median("views").alias("m")).where("n >= 3")
    return each.join(subs, "channel").select("fmt", "channel", "grp", "x", F.log("m").alias("y"))


_FIT = """f AS (SELECT fmt, count(*) AS n, least(greatest(regr_slope(y, x), 0), 1) AS slope, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM p GROUP BY 1 HAVING count(*) >= 3 AND regr_sxx(y, x) > 1e-12)"""


@query("a21_line_fit", f"WITH {_PEERS}, {_FIT} SELECT fmt, n, round(slope, 6) AS slope, round(my - slope * mx, 6) AS intercept, round(greatest(0.2, sqrt(greatest(syy - 2 * slope * sxy + slope * slope * sxx, 0) / (n - 2))), 6) AS tau FROM f")
def a21(spark, sf_dir):
    return stats.line_fit(peers(spark, sf_dir), ["fmt"], "x", "y").select("fmt", "n", R("slope").alias("slope"), R("intercept").alias("intercept"), R("tau").alias("tau"))


@query("a21_group_shift", f"WITH {_PEERS}, {_FIT} SELECT p.fmt, grp, count(*) AS n, round(sum(y - (my - slope * mx) - slope * x) / (count(*) + 5), 6) AS shift FROM p JOIN f ON f.fmt = p.fmt GROUP BY 1, 2")
def a21_group(spark, sf_dir):
    rows = peers(spark, sf_dir)
    fit = stats.line_fit(rows, ["fmt"], "x", "y").drop("n")
    off = F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")
    return rows.join(fit, "fmt").groupBy("fmt", "grp").agg(F.count(F.lit(1)).alias("n"), R(F.sum(off) / (F.count(F.lit(1)) + 5)).alias("shift"))


@query(
    "a23_elasticity",
    f"""WITH {_PEERS}, {_FIT}, c AS (SELECT fmt, channel, ln(count(*) / 30.0 * 7) AS cad FROM v GROUP BY 1, 2), e AS (SELECT p.fmt, cad, y - (my - slope * mx) - slope * x AS off FROM p JOIN f ON f.fmt = p.fmt JOIN c ON c.fmt = p.fmt AND c.channel = p.channel)
    SELECT fmt, count(*) AS n, round(least(greatest(regr_slope(off, cad) * count(*) / (count(*) + 20), -0.3), 0), 6) AS elasticity FROM e GROUP BY 1 HAVING count(*) >= 5""",
)
def a23(spark, sf_dir):
    rows = peers(spark, sf_dir)
    fit = stats.line_fit(rows, ["fmt"], "x", "y").drop("n")
    pace = videos(spark, sf_dir).groupBy("fmt", "channel").agg(F.log(F.count(F.lit(1)) / 30.0 * 7).alias("cad"))
    off = rows.join(fit, "fmt").join(pace, ["fmt", "channel"]).select("fmt", "cad", (F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")).alias("off"))
    n = F.count(F.lit(1))
    shrunk = F.regr_slope("off", "cad") * n / (n + 20)
    return off.groupBy("fmt").agg(n.alias("n"), R(F.least(F.greatest(shrunk, F.lit(-0.3)), F.lit(0.0))).alias("elasticity")).where("n >= 5")


@query(
    "a24_leave_one_out",
    f"""WITH {_PEERS}, l AS (SELECT a.fmt, a.channel, any_value(a.x) AS x, any_value(a.y) AS y, count(*) AS n, regr_slope(b.y, b.x) AS s, regr_intercept(b.y, b.x) AS i, regr_syy(b.y, b.x) AS syy, regr_sxy(b.y, b.x) AS sxy FROM p a JOIN p b ON a.fmt = b.fmt AND a.channel <> b.channel GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT fmt, sum((abs(y - i - s * x) <= 1.2816 * sqrt(greatest(syy - s * sxy, 0) / (n - 2)))::INT)::BIGINT AS hit, count(*) AS n FROM l WHERE sqrt(greatest(syy - s * sxy, 0) / (n - 2)) > 0 GROUP BY 1""",
)
def a24(spark, sf_dir):
    return stats.leave_one_out(peers(spark, sf_dir), ["fmt"], "x", "y")


@query("a27_brier", "SELECT quality, count(*) AS n, round(avg(pow(least(length(text) / 2000.0, 1) - toxic, 2)), 6) AS brier FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1")
def a27(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.least(F.length("text") / 2000.0, F.lit(1.0)).alias("p"))
    rows = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null").join(docs, "doc_id")
    return rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), R(F.avg((F.col("p") - F.col("toxic")) ** 2)).alias("brier"))


@query(
    "a25_posterior",
    f"""WITH {_PEERS}, {_FIT}, o AS (SELECT v.channel, v.fmt, least(count(*), 8) AS k, avg(ln(views)) AS m FROM v WHERE views > 0 GROUP BY 1, 2)
    SELECT o.channel, o.fmt, round((k / 1.0 * m + (my - slope * mx + slope * p.x) / 0.25) / (k / 1.0 + 1 / 0.25), 6) AS mean, round(sqrt(1 / (k / 1.0 + 1 / 0.25)), 6) AS sd FROM o JOIN f ON f.fmt = o.fmt JOIN p ON p.fmt = o.fmt AND p.channel = o.channel""",
)
def a25(spark, sf_dir):
    """Normal prior from the line of all channels (sd 0.5), own evidence with sd 1, counted as eight rows at most."""
    rows = peers(spark, sf_dir)
    fit = stats.line_fit(rows, ["fmt"], "x", "y").drop("n")
    own = videos(spark, sf_dir).where(stats.valid("views")).groupBy("channel", "fmt").agg(F.least(F.count(F.lit(1)), F.lit(8)).alias("k"), F.avg(F.log("views")).alias("m"))
    both = own.join(rows.join(fit, "fmt").select("fmt", "channel", (F.col("intercept") + F.col("slope") * F.col("x")).alias("prior")), ["fmt", "channel"])
    precision = F.col("k") + F.lit(4.0)
    return both.select("channel", "fmt", R((F.col("k") * F.col("m") + 4.0 * F.col("prior")) / precision).alias("mean"), R(F.sqrt(1 / precision)).alias("sd"))


@query("p19_evidence_weights", f"WITH {VIDEOS}, e AS (SELECT max(pub) AS now FROM v) SELECT id, CASE WHEN age <= 10 THEN 1.0 ELSE 0.5 END AS weight, round(views * (1 - exp(-(age / 7) / 1.5)), 6) AS scaled FROM (SELECT id, views, (now - pub) / 86400e6 AS age FROM v, e) WHERE age <= 20 AND 1 - exp(-(age / 7) / 1.5) >= 0.3")
def p19(spark, sf_dir):
    rows = videos(spark, sf_dir)
    now = rows.agg(F.max("pub")).first()[0] or 0
    aged = rows.withColumn("age", (F.lit(now) - F.col("pub")) / 86400e6).withColumn("ripe", 1 - F.exp(-(F.col("age") / 7) / 1.5))
    return aged.where("age <= 20 and ripe >= 0.3").select("id", F.when(F.col("age") <= 10, 1.0).otherwise(0.5).alias("weight"), R(F.col("views") * F.col("ripe")).alias("scaled"))

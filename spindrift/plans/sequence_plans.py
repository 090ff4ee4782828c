"""Queries of the sequential operators, the forecast, and a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import normal_cdf
from ..operators import forecast, sequential
from ..operators.relational import in_blocks, joined, newest_n, numbered
from ..sources.tables import DAY, VIDEOS, table, videos
from ..streaming.history import weekly_counts
from .model_plans import _PEERS, peers
from .registry import query
from .scalar_plans import cdf_sql


@query(
    "w6_peak_picking",
    f"""WITH RECURSIVE {VIDEOS}, m AS (SELECT channel, list_sort(list(views))[count(*) // 2 + 1] + 6 AS above FROM v GROUP BY 1),
    c AS (SELECT v.channel, id, pub, row_number() OVER (PARTITION BY v.channel ORDER BY views DESC, pub DESC, id) AS k FROM v JOIN m ON m.channel = v.channel WHERE views >= above),
    g AS (SELECT channel, k, [pub] AS pubs, [id] AS ids FROM c WHERE k = 1 UNION ALL SELECT g.channel, c.k, CASE WHEN len(pubs) < 10 AND len(list_filter(pubs, lambda p: abs(p - pub) <= 18000000000)) = 0 THEN list_append(pubs, pub) ELSE pubs END,
      CASE WHEN len(pubs) < 10 AND len(list_filter(pubs, lambda p: abs(p - pub) <= 18000000000)) = 0 THEN list_append(ids, id) ELSE ids END FROM g JOIN c ON c.channel = g.channel AND c.k = g.k + 1),
    f AS (SELECT channel, unnest(arg_max(pubs, k)) AS pub, unnest(arg_max(ids, k)) AS id FROM g GROUP BY 1) SELECT channel, id, row_number() OVER (PARTITION BY channel ORDER BY pub) AS place FROM f""",
)
def w6(spark, sf_dir):
    """Peaks of a channel's events: at least 6 above the upper median, more than 5 hours apart, ten at most; the highest first,
    of equal ones the latest, numbered by time.

    A pick keeps others out of three cells of 5 hours at most, so ten picks come before anything lower than the highest
    values of 28 cells; what is lower cannot be picked and stays out of the channel's group."""
    most, apart = 10, 5 * DAY // 24
    rows = videos(spark, sf_dir).where("views is not null and not isnan(views) and pub is not null").select("channel", "id", "pub", "views", F.floor(F.col("pub") / apart).alias("cell"))
    cells = rows.groupBy("channel", "cell").agg(F.max("views").alias("high"), F.count(F.lit(1)).alias("n"))
    full = 3 * (most - 1) + 1
    bar = newest_n(cells, ["channel"], [F.desc("high")], full).groupBy("channel").agg(F.when(F.count(F.lit(1)) == full, F.min("high")).alias("bar"))
    middle = cells.groupBy("channel").agg((F.floor(F.sum("n") / 2) + 1).alias("number"))
    above = joined(numbered(rows.select("channel", "views"), ["channel"], "views", ["views"], 5), middle, ["channel", "number"]).select("channel", (F.col("views") + 6).alias("above"))
    cells = joined(joined(cells, bar, ["channel"]), above, ["channel"]).withColumn("bar", F.greatest("above", "bar"))
    rows = joined(rows, cells.where("high >= bar").select("channel", "cell", "bar", "above"), ["channel", "cell"]).where("views >= bar")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = sorted(sequential.pick_peaks(pdf["pub"].tolist(), pdf["views"].tolist(), apart, pdf["above"][0], most))
        return pdf.loc[kept, ["channel", "id"]].assign(place=range(1, len(kept) + 1))

    return sequential.per_group(rows.select("channel", "id", "pub", "views", "above"), ["channel"], ["pub", "id"], "channel long, id long, place long", pick)


@query("o6_diverse_top", f"WITH {VIDEOS}, c AS (SELECT *, row_number() OVER (PARTITION BY channel, fmt ORDER BY views DESC, id) AS k FROM v), d AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY views DESC, id) AS place FROM c WHERE k <= 2) SELECT channel, id, place FROM d WHERE place <= 5")
def o6(spark, sf_dir):
    """Best five of a channel, two of a kind at most.  The cap alone ranks within kinds first."""
    capped = newest_n(videos(spark, sf_dir), ["channel", "fmt"], [F.desc("views"), "id"], 2).drop("place")
    return newest_n(capped, ["channel"], [F.desc("views"), "id"], 5).select("channel", "id", "place")


_IOU = "greatest(0, least(b.x, x) + 20 - greatest(b.x, x)) * greatest(0, least(b.y, y) + 10 - greatest(b.y, y))"


@query(
    "j19_box_suppression",
    f"""WITH RECURSIVE c AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, 100 * l_discount AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem),
    g AS (SELECT l_orderkey, k, [{{'x': x, 'y': y, 'n': l_linenumber}}] AS kept FROM c WHERE k = 1 UNION ALL SELECT g.l_orderkey, c.k, CASE WHEN len(list_filter(kept, lambda b: {_IOU} / (400 - {_IOU}) > 0.3)) = 0 THEN list_append(kept, {{'x': x, 'y': y, 'n': l_linenumber}}) ELSE kept END
      FROM g JOIN c ON c.l_orderkey = g.l_orderkey AND c.k = g.k + 1)
    SELECT l_orderkey, unnest(list_transform(arg_max(kept, k), lambda b: b.n)) AS l_linenumber FROM g GROUP BY 1""",
)
def j19(spark, sf_dir):
    """Boxes of an order's lines, without those that a better one covers.

    Of lines with the same box only the best can stay, so an order's array has each box once, however many lines it has
    (boxes with a null stay apart: they share nothing with their like)."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (100 * F.col("l_discount")).alias("y"), F.col("l_extendedprice").cast("double").alias("score"))
    last = F.struct(F.col("score").isNull(), ~F.isnan("score"), -F.col("score"), F.col("l_linenumber").isNull(), "l_linenumber").alias("place")
    apart = F.when(F.col("x").isNull() | F.col("y").isNull(), F.col("l_linenumber")).alias("apart")
    boxes = rows.groupBy("l_orderkey", "x", "y", apart).agg(F.min(last).alias("place"))
    ranked = boxes.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("place", "x", "y"))).alias("lines"))
    kept = sequential.suppressed("lines", 20, 10, 0.3)
    kept = F.when(F.col("l_orderkey").isNull(), F.slice(kept, 1, 1)).otherwise(kept)
    return ranked.select("l_orderkey", F.explode(kept).alias("kept")).select("l_orderkey", F.col("kept.place.l_linenumber").alias("l_linenumber"))


def _turns(spark, sf_dir, by, back):
    """Turns with their number in the conversation, in blocks of ``by`` with those up to ``back`` before."""
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("text").alias("line"))
    return in_blocks(numbered(rows, ["conv_id"], "turn", ["turn", "line"], 256), by, back, 0, 256)


@query("j16_retakes")
def j16(spark, sf_dir):
    """Lines that repeat one of the five before them in their conversation, by matching share of 0.7 of the whole texts: every
    fourth line of a turn is made the one before it, said again with a word more."""
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", F.col("turn").cast("long").alias("_t"), F.split("text", "\n").alias("x"))
    said = F.transform("x", lambda line, i: F.when(i % 4 == 3, F.concat(F.get("x", i - 1), F.lit(" so"))).otherwise(line))
    rows = rows.select("conv_id", "_t", F.posexplode(said).alias("_i", "line")).select("conv_id", (F.col("_t") * 100_000 + F.col("_i")).alias("turn"), "line")
    order = Window.partitionBy("conv_id", "_block").orderBy("number").rowsBetween(-5, -1)
    lines = in_blocks(numbered(rows, ["conv_id"], "turn", ["turn", "line"], 100_000 * 64), "number", 5, 0, 256)
    before = lines.withColumn("before", F.collect_list(F.struct("turn", "line")).over(order)).where("_mine and size(before) > 0")

    @F.pandas_udf("long")
    def nearest_alike(line: pd.Series, before: pd.Series) -> pd.Series:
        def one(s, earlier):
            return next((r["turn"] for r in reversed(list(earlier)) if sequential.alike(r["line"], s, 0.7)), None)

        return pd.Series([one(s, b) for s, b in zip(line, before)], dtype="Int64")

    return before.select("conv_id", "turn", nearest_alike("line", "before").alias("earlier")).where("earlier is not null")


@query("j21_line_coalescing")
def j21(spark, sf_dir):
    """Turns in events, by matching share of 0.8 of the whole texts.  Texts are compared block by block; a conversation's
    group gets the numbers of the turns alike only."""
    order = Window.partitionBy("conv_id", "_block").orderBy("turn").rangeBetween(-2, 0)
    near = _turns(spark, sf_dir, "turn", 2).withColumn("near", F.collect_list(F.struct("number", "line")).over(order)).where("_mine")

    @F.pandas_udf("array<long>")
    def those_alike(number: pd.Series, line: pd.Series, near: pd.Series) -> pd.Series:
        return pd.Series([[r["number"] for r in rs if r["number"] < n and sequential.alike(r["line"], s, 0.8)] for n, s, rs in zip(number, line, near)])

    rows = near.select("conv_id", "turn", "number", those_alike("number", "line", "near").alias("alike"))

    def group(turns: dict) -> tuple:
        alike = [set(x) for x in turns["alike"]]
        events = sequential.coalesce_lines(turns["turn"].tolist(), lambda i, j: j + 1 in alike[i], 2.5)
        return range(len(alike)), {"event": events}

    return sequential.over_groups(rows, ["conv_id"], ["number"], "conv_id long, turn long, event long", group)


@query("w15_pause_chapters")
def w15(spark, sf_dir):
    """Chapters of a channel's events: one to three days, cut at the longest pause.

    A cut is the longest pause of two days, so longer than all of the three cells of 6 hours before it, or as long as all
    of the three after it.  Only such events get into the channel's group; pauses are taken cell by cell."""
    cell, minute = DAY // 4, 60_000_000
    rows = videos(spark, sf_dir).where("pub is not null").select("channel", "id", "pub", F.floor(F.col("pub") / cell).alias("cell"))
    in_time = Window.partitionBy("channel").orderBy("cell")
    ends = rows.groupBy("channel", "cell").agg(F.max("pub").alias("last")).select("channel", "cell", F.lag("last").over(in_time).alias("before"), (F.max("last").over(Window.partitionBy("channel")) + minute).alias("end"))
    own = F.lag("pub").over(Window.partitionBy("channel", "cell").orderBy("pub", "id"))
    rows = joined(rows.withColumn("own", own), ends, ["channel", "cell"]).withColumn("gap", F.col("pub") - F.coalesce("own", "before") - minute)
    longest = rows.groupBy("channel", "cell").agg(F.max("gap").alias("longest"))
    near = longest.select("channel", "cell", F.max("longest").over(in_time.rangeBetween(-3, -1)).alias("left"), F.max("longest").over(in_time.rangeBetween(1, 3)).alias("right"))
    may = F.col("gap").isNull() | F.col("left").isNull() | F.col("right").isNull() | (F.col("gap") > F.col("left")) | (F.col("gap") >= F.col("right"))
    rows = joined(rows, near, ["channel", "cell"]).where(may).select("channel", "id", "pub", "gap", "end")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["pub"].tolist()
        cuts = sequential.cut_at_gaps(at, pdf["gap"].tolist(), int(pdf["end"][0]), DAY, 3 * DAY)
        return pd.DataFrame({"channel": pdf["channel"][0], "chapter": range(1, len(cuts) + 1), "start": [at[i] for i in cuts]})

    return sequential.per_group(rows, ["channel"], ["pub", "id"], "channel long, chapter long, start long", cut)


@query("f9_caption_lines")
def f9(spark, sf_dir):
    """Line breaks of benchmark items at 40 places, by dynamic programming over each item's words."""

    @F.pandas_udf("array<string>")
    def lines(text: pd.Series) -> pd.Series:
        def one(s):
            words = (s or "").split()
            cuts = [*sequential.split_lines(words, 40), len(words)]
            return [" ".join(words[a:b]) for a, b in zip(cuts, cuts[1:])]

        return text.map(one)

    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(lines("text")).alias("line", "text"))
    return rows.select("item_id", F.col("line").cast("long").alias("line"), "text")


@query(
    "f11_first_fit_tags",
    """WITH RECURSIVE n AS (SELECT p_brand, p_name, min(p_partkey) AS at_ FROM part GROUP BY 1, 2), c AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY at_) AS k FROM n),
    g AS (SELECT p_brand, 0::BIGINT AS k, 0 AS used, []::VARCHAR[] AS kept FROM (SELECT DISTINCT p_brand FROM c) UNION ALL
      SELECT g.p_brand, c.k, CASE WHEN used + length(p_name) + (len(kept) > 0)::INT <= 60 THEN used + length(p_name) + (len(kept) > 0)::INT ELSE used END, CASE WHEN used + length(p_name) + (len(kept) > 0)::INT <= 60 THEN list_append(kept, p_name) ELSE kept END FROM g JOIN c ON c.p_brand = g.p_brand AND c.k = g.k + 1)
    SELECT p_brand, array_to_string(arg_max(kept, k), ',') AS tags FROM g GROUP BY 1""",
)
def f11(spark, sf_dir):
    """Names of a brand's parts, first fit into 60 characters.  Once a name does not fit, none of its length fits later, so
    of each length only the first that fill the 60 characters by themselves can be taken."""
    names = table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("at"))
    names = newest_n(names.withColumn("n", F.length("p_name")), ["p_brand", "n"], ["at"], 61).where("n is null or place = 1 or place * (n + 1) <= 61")
    top = names.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("at", "p_name"))).alias("t"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def add(s, x):
        need = F.length(x["p_name"]) + F.when(F.size(s["kept"]) > 0, 1).otherwise(0)
        fits = (s["used"] + need <= 60) & ~F.array_contains(s["kept"], x["p_name"])
        return F.struct(F.when(fits, s["used"] + need).otherwise(s["used"]).alias("used"), F.when(fits, F.array_append(s["kept"], x["p_name"])).otherwise(s["kept"]).alias("kept"))

    return top.select("p_brand", F.aggregate("t", start, add, lambda s: F.concat_ws(",", s["kept"])).alias("tags"))


@query(
    "a22_theil_sen",
    f"""WITH {_PEERS}, s AS (SELECT a.fmt, median((b.y - a.y) / (b.x - a.x)) AS slope FROM p a JOIN p b ON a.fmt = b.fmt AND a.channel < b.channel AND abs(b.x - a.x) > 1e-12 GROUP BY 1)
    SELECT p.fmt, count(*) AS n, round(median(y - coalesce(slope, 0) * x), 6) AS intercept, round(any_value(coalesce(slope, 0)), 6) AS slope FROM p LEFT JOIN s ON s.fmt = p.fmt GROUP BY 1""",
)
def a22(spark, sf_dir):
    """Per format, over the channels that are compared (one row each)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = sequential.theil_sen(pdf["x"], pdf["y"])
        return pd.DataFrame({"fmt": [pdf["fmt"][0]], "n": [len(pdf)], "intercept": [round(a, 6)], "slope": [round(b, 6)]})

    return sequential.per_group(peers(spark, sf_dir).select("fmt", "x", "y"), ["fmt"], ["x", "y"], "fmt string, n long, intercept double, slope double", fit)


@query(
    "a26_reliability",
    f"""WITH {VIDEOS}, o AS (SELECT fmt, avg(ln(views)) AS m, stddev(ln(views)) AS s FROM v WHERE views > 0 GROUP BY 1)
    SELECT v.fmt, round(avg(1 - ({cdf_sql('((ln(50.0) - m) / s)')})), 6) AS predicted, round(avg((views >= 50)::INT), 6) AS observed FROM v JOIN o ON o.fmt = v.fmt WHERE views > 0 GROUP BY 1""",
)
def a26(spark, sf_dir):
    """Mean predicted chance of passing 50 views against the observed share, per format."""
    rows = videos(spark, sf_dir).where("views > 0")
    own = rows.groupBy("fmt").agg(F.avg(F.log("views")).alias("m"), F.stddev(F.log("views")).alias("s"))
    both = rows.join(own, "fmt")
    chance = 1 - normal_cdf((F.log(F.lit(50.0)) - F.col("m")) / F.col("s"))
    return both.groupBy("fmt").agg(F.round(F.avg(chance), 6).alias("predicted"), F.round(F.avg((F.col("views") >= 50).cast("double")), 6).alias("observed"))


_SIMS = 60  # paths of each of the 100 samples, as the reference runs them


def _calibrated(spark, sf_dir):
    return forecast.bootstrap(peers(spark, sf_dir).select("fmt", "x", "y"))


@query(
    "t1_bootstrap",
    f"""WITH {_PEERS}, r AS (SELECT fmt, x, y, row_number() OVER (PARTITION BY fmt ORDER BY x, y) AS k, count(*) OVER (PARTITION BY fmt) AS n FROM p),
    d AS (SELECT fmt, s AS sample, ('0x' || md5('7/' || fmt || '/' || s || '/' || k)[:8])::BIGINT % n + 1 AS k FROM r, range(1, 100) t(s)), e AS (SELECT r.fmt, sample, x, y FROM d JOIN r ON r.fmt = d.fmt AND r.k = d.k UNION ALL SELECT fmt, 0, x, y FROM r),
    g AS (SELECT fmt, sample, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM e GROUP BY 1, 2), f AS (SELECT *, CASE WHEN sxx > 1e-12 THEN greatest(0, least(1, sxy / sxx)) ELSE 0 END AS b FROM g)
    SELECT fmt, sample, round(my - b * mx, 6) AS a, round(b, 6) AS b, round(greatest(0.2, sqrt(greatest(0, syy - 2 * b * sxy + b * b * sxx) / greatest(n - 2, 1))), 6) AS tau FROM f""",
)
def t1(spark, sf_dir):
    return _calibrated(spark, sf_dir).select("fmt", "sample", *[F.round(c, 6).alias(c) for c in ("a", "b", "tau")])


@query("t4_forecast_bands")
def t4(spark, sf_dir):
    return forecast.bands(forecast.simulate(_calibrated(spark, sf_dir), subs=1000.0, rate=2.0, sims=_SIMS))


@query("t4_milestones")
def t4_goals(spark, sf_dir):
    return forecast.milestones(forecast.simulate(_calibrated(spark, sf_dir), subs=1000.0, rate=2.0, sims=_SIMS), [1100.0, 1500.0, 3000.0])


@query("t5_plan_variants")
def t5(spark, sf_dir):
    """Median at the end of the year for each format and plan; all plans see the same draws."""
    fits, out = _calibrated(spark, sf_dir), None
    for name, rate in (("less", 1.0), ("same", 2.0), ("more", 4.0)):
        end = forecast.simulate(fits, subs=1000.0, rate=rate, sims=_SIMS).where(F.col("week") == forecast.WEEKS)
        row = end.groupBy("fmt").agg(F.percentile("subs", F.lit(0.5)).alias("p50")).select("fmt", F.lit(name).alias("plan"), "p50")
        out = row if out is None else out.unionByName(row)
    return out


@query("s5_stream_weekly", f"WITH {VIDEOS} SELECT fmt, (pub // 604800000000)::BIGINT AS week, count(*) AS n, round(sum(views), 4) AS total FROM v GROUP BY 1, 2")
def s5(spark, sf_dir):
    """The events file as a stream, counted by week and taken up to its end."""
    return weekly_counts(spark, sf_dir)

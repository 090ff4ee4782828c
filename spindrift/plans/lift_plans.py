"""What titles have in common with success: formulas, topics, series and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import lift, stats
from ..operators.relational import newest_n
from ..sources.tables import ALL_TITLES, NEWEST_TITLES, newest_titles, titles
from .registry import SQL, query

R = lambda c: F.round(c, 6)
_RESID = f"""{NEWEST_TITLES}, r AS (SELECT *, coalesce(ln(views) - quantile_cont(ln(views), 0.5) OVER (PARTITION BY channel ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING EXCLUDE CURRENT ROW), 0) AS resid, count(*) OVER (PARTITION BY channel) AS total FROM t)"""
_CLEAN = r"trim(regexp_replace(regexp_replace(title, '#\S+', '', 'g'), '\s+', ' ', 'g'), ' |ㅣ-')"
_HITS = " UNION ALL ".join([f"SELECT channel, id, resid, '{k}' AS formula, regexp_matches(title, '{rx.replace(chr(39), chr(39) * 2)}') AS hit FROM r WHERE total >= 6" for k, rx in lift.FORMULAS.items()] + [f"SELECT channel, id, resid, '{k}', length({_CLEAN}) {op} FROM r WHERE total >= 6" for k, op in (("short", "<= 20"), ("long", ">= 40"))])


def residuals(spark, sf_dir):
    return stats.neighbour_residual(newest_titles(spark, sf_dir), keys=["channel"], order=["pos"], value="views")


@query("p4_formula_hits", f"WITH {_RESID}, h AS ({_HITS}) SELECT channel, id, formula FROM h WHERE hit")
def p4(spark, sf_dir):
    return lift.with_formulas(lift.at_least(residuals(spark, sf_dir), ["channel"], 6), "title").where("hit").select("channel", "id", "formula")


@query(
    "a9_formula_lift",
    f"""WITH {_RESID}, h AS ({_HITS}) SELECT channel, formula, count(*) FILTER (WHERE hit) AS n, round(avg(hit::INT), 6) AS share, round(exp(median(resid) FILTER (WHERE hit) - median(resid) FILTER (WHERE NOT hit)), 6) AS mult,
    count(*) FILTER (WHERE hit) >= 3 AND count(*) FILTER (WHERE NOT hit) >= 3 AS ok FROM h GROUP BY 1, 2""",
)
def a9(spark, sf_dir):
    return lift.formula_lift(residuals(spark, sf_dir), ["channel"], "title").withColumns({"share": R("share"), "mult": R("mult")})


_WORDS = "SELECT DISTINCT channel, id, resid, total, unnest(regexp_extract_all(lower(title), '[a-z가-힣]{2,10}')) AS word FROM r WHERE total >= 5"


@query(
    "a10_topic_lift",
    f"""WITH {_RESID}, w AS ({_WORDS}), m AS (SELECT channel, median(resid) AS mid FROM r GROUP BY 1), g AS (SELECT w.channel, word, count(*) AS n, round(exp(median(resid) - any_value(mid)), 6) AS mult FROM w JOIN m ON m.channel = w.channel GROUP BY 1, 2 HAVING count(*) >= 3 AND count(*) < any_value(total))
    SELECT channel, word, n, mult FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY round(mult * ln(1 + n), 5) DESC, word) AS k FROM g) WHERE k <= 20""",
)
def a10(spark, sf_dir):
    out = lift.topic_lift(residuals(spark, sf_dir), ["channel"], F.array_distinct(text.tokens("title"))).withColumn("mult", R("mult"))
    return newest_n(out, ["channel"], [F.desc(F.round(F.col("mult") * F.log1p(F.col("n").cast("double")), 5)), "word"], 20).select("channel", "word", "n", "mult")


_Q = lambda rx: rx.replace("'", "''")
_NAMES = f"""list_concat(list_transform(list_filter(list_transform(regexp_extract_all(title, '{_Q(lift.SERIES_BOXED)}', 1), lambda x: trim(regexp_replace(x, '{_Q(lift.SERIES_NUMBER)}', ''))), lambda x: length(x) >= 2), lambda x: '[' || x || ']'),
    list_transform(list_filter([trim(regexp_extract(title, '{_Q(lift.SERIES_PART)}', 1), '{_Q(lift.SERIES_MARKS)}')], lambda x: length(x) >= 2), lambda x: x || ' N탄'), list_transform(list_filter([trim(regexp_extract(title, '{_Q(lift.SERIES_HEAD)}', 1))], lambda x: x <> ''), lambda x: x || ' |'))"""


@query(
    "a11_series",
    rf"""WITH {_RESID}, s AS (SELECT DISTINCT channel, id, views, resid, unnest({_NAMES}) AS name FROM r)
    SELECT channel, name, count(*) AS n, round(median(views), 6) AS median, round(exp(median(resid)), 6) AS mult, arg_max(id, struct_pack(a := views, b := id)) AS top FROM s WHERE length(regexp_replace(name, '[^A-Za-z가-힣]', '', 'g')) >= 2 GROUP BY 1, 2 HAVING count(*) >= 1""",
)
def a11(spark, sf_dir):
    """One row is enough here: these titles are random, and hardly two share a name."""
    return lift.series(residuals(spark, sf_dir), ["channel"], "title", least=1).withColumns({"median": R("median"), "mult": R("mult")})


@query(
    "a12_fixed_tags",
    f"""WITH {ALL_TITLES}, n AS (SELECT channel, count(*) AS total FROM t GROUP BY 1 HAVING count(*) >= 5), w AS (SELECT DISTINCT channel, id, unnest(regexp_extract_all(lower(title), '[a-z]{{2,10}}')) AS tag FROM t)
    SELECT w.channel, tag, count(*) AS n, total AS of FROM w JOIN n ON n.channel = w.channel GROUP BY 1, 2, 4 HAVING count(*) >= 0.2 * total""",
)
def a12(spark, sf_dir):
    return lift.supported(titles(spark, sf_dir), ["channel"], F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("([a-z]{2,10})"))), share=0.2, least=5).withColumnRenamed("item", "tag")


@query("a29_ranked_terms", f"WITH {ALL_TITLES}, w AS (SELECT channel, unnest(regexp_extract_all(lower(title), '(theand|then|the|and|of|in)')) AS term FROM t) SELECT channel, term, n FROM (SELECT channel, term, count(*) AS n, row_number() OVER (PARTITION BY channel ORDER BY count(*) DESC, term) AS k FROM w GROUP BY 1, 2) WHERE k <= 3")
def a29(spark, sf_dir):
    return lift.ranked_terms(titles(spark, sf_dir), ["channel"], "title", ["the", "and", "of", "in", "then", "theand"], 3)


@query(
    "a14_takeaways",
    f"""WITH {_RESID}, h AS ({_HITS}), f AS (SELECT channel, formula, count(*) FILTER (WHERE hit) AS n, exp(median(resid) FILTER (WHERE hit) - median(resid) FILTER (WHERE NOT hit)) AS mult, count(*) FILTER (WHERE hit) >= 3 AND count(*) FILTER (WHERE NOT hit) >= 3 AS ok FROM h GROUP BY 1, 2)
    SELECT formula, count(*) AS channels, sum(n)::BIGINT AS n, round(sum(ln(mult) * n / (n + 6)) / count(*), 6) AS score FROM f WHERE ok GROUP BY 1""",
)
def a14(spark, sf_dir):
    each = lift.formula_lift(residuals(spark, sf_dir), ["channel"], "title").where("ok")
    return lift.pooled(each, "formula").withColumn("score", R("score"))


#: Titles as channels make them: a show and its number before the line, tags after it.
_MADE_TITLE = "'[Show ' || (id % 4) || 'x EP. ' || (id % 9) || '] ' || title || CASE WHEN id % 10 < 7 THEN ' #drill' ELSE '' END || CASE WHEN id % 5 > 0 THEN ' #Daily' ELSE '' END"
_MADE = _RESID.replace("t AS (", "t0 AS (", 1).replace(", r AS (", f", t AS (SELECT channel, id, {_MADE_TITLE} AS title, views, pos FROM t0), r AS (", 1)


@query(
    "a13_pattern_bundles",
    rf"""WITH {_MADE}, h AS ({_HITS}), f AS (SELECT channel, formula, count(*) FILTER (WHERE hit) AS n FROM h GROUP BY 1, 2 HAVING count(*) FILTER (WHERE hit) >= 3 AND count(*) FILTER (WHERE NOT hit) >= 3),
    w AS ({_WORDS}), m AS (SELECT channel, median(resid) AS mid FROM r GROUP BY 1), g AS (SELECT w.channel, word, count(*) AS n, exp(median(resid) - any_value(mid)) AS mult FROM w JOIN m ON m.channel = w.channel GROUP BY 1, 2 HAVING count(*) >= 3 AND count(*) < any_value(total)),
    tp AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY round(mult * ln(1 + n), 5) DESC, word) AS k FROM g),
    sn AS (SELECT DISTINCT channel, id, views, resid, unnest({_NAMES}) AS name FROM r), se AS (SELECT channel, name, count(*) AS n, exp(median(resid)) AS mult FROM sn WHERE length(regexp_replace(name, '[^A-Za-z가-힣]', '', 'g')) >= 2 GROUP BY 1, 2 HAVING count(*) >= 2),
    sk AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY n DESC, round(mult, 6) DESC, name) AS k FROM se),
    tg AS (SELECT DISTINCT channel, id, total, unnest(regexp_extract_all(lower(title), '#[0-9A-Za-z가-힣_]+')) AS tag FROM r WHERE total >= 5), tc AS (SELECT channel, tag, count(*) AS n FROM tg GROUP BY 1, 2 HAVING count(*) >= 0.6 * any_value(total)),
    tk AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY tag = '#daily', n DESC, tag) AS k FROM tc)
    SELECT c.channel, c.n, coalesce((SELECT string_agg(formula || ':' || n, ',' ORDER BY formula) FROM f WHERE f.channel = c.channel), '') AS formulas, coalesce((SELECT string_agg(word, ',' ORDER BY k) FROM tp WHERE tp.channel = c.channel AND k <= 20), '') AS topics,
    coalesce((SELECT string_agg(name || ':' || n, ',' ORDER BY k) FROM sk WHERE sk.channel = c.channel AND k <= 8), '') AS series, coalesce((SELECT string_agg(tag || ':' || n, ',' ORDER BY k) FROM tk WHERE tk.channel = c.channel AND k <= 4), '') AS tags FROM (SELECT channel, count(*) AS n FROM r GROUP BY 1) c""",
)
def a13(spark, sf_dir):
    made = newest_titles(spark, sf_dir).withColumn("title", F.expr(_MADE_TITLE))
    rows = stats.neighbour_residual(made, keys=["channel"], order=["pos"], value="views")
    got = lift.bundle(rows, "channel", "title", F.array_distinct(text.tokens("title")), generic=["#daily"])
    joined = lambda c, f: F.array_join(F.transform(c, f), ",").alias(c)
    return got.select("channel", "n", joined("formulas", lambda x: F.concat(x["formula"], F.lit(":"), x["n"].cast("string"))), joined("topics", lambda x: x["word"]), joined("series", lambda x: F.concat(x["name"], F.lit(":"), x["n"].cast("string"))), joined("tags", lambda x: F.concat(x["tag"], F.lit(":"), x["n"].cast("string"))))


@query("f1_clean_title", rf"WITH {ALL_TITLES} SELECT id, {_CLEAN} AS clean, length({_CLEAN}) AS n FROM t")
def f1(spark, sf_dir):
    clean = text.clean_title("title")
    return titles(spark, sf_dir).select("id", clean.alias("clean"), F.length(clean).cast("long").alias("n"))


@query("f2_title_key", rf"WITH {ALL_TITLES} SELECT id, lower(regexp_replace(regexp_replace(title, '\[[^\]]*\]|\([^)]*\)|#\S+', '', 'g'), '[^0-9A-Za-z가-힣]', '', 'g')) AS key FROM t")
def f2(spark, sf_dir):
    return titles(spark, sf_dir).select("id", text.title_key("title").alias("key"))


# Names of the time when the queries above still cut first lines and rows:
for _name, _function in (("f1_clean_title", f1), ("f2_title_key", f2), ("p4_formula_hits", p4), ("a9_formula_lift", a9), ("a10_topic_lift", a10), ("a11_series", a11), ("a12_fixed_tags", a12), ("a14_takeaways", a14), ("a29_ranked_terms", a29)):
    query(f"{_name}_whole", SQL[_name])(_function)


@query("p2_letter_ratio", "SELECT doc_id AS id, CASE WHEN b = 0 THEN 0.0 ELSE round(a / b, 6) END AS ratio, CASE WHEN b = 0 THEN false ELSE a / b >= 0.3 END AS mostly FROM (SELECT doc_id, len(regexp_extract_all(text, '[a-m]'))::DOUBLE AS a, len(regexp_extract_all(text, '[A-Za-z]'))::DOUBLE AS b FROM documents WHERE text IS NOT NULL)")
def p2(spark, sf_dir):
    ratio = text.letter_ratio("text", "[a-m]", "[A-Za-z]")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select(F.col("doc_id").alias("id"), R(ratio).alias("ratio"), (ratio >= 0.3).alias("mostly"))


@query("p3_description_flags", "SELECT page_id AS id, regexp_matches(html, '(?i)<h1') AS headed, regexp_matches(html, '(?i)https?://') AS linked, regexp_matches(html, '(?i)copyright|&copy;') AS owned FROM pages WHERE html IS NOT NULL")
def p3(spark, sf_dir):
    flags = {"headed": "(?i)<h1", "linked": "(?i)https?://", "owned": "(?i)copyright|&copy;"}
    return text.flags(spark.read.parquet(f"{sf_dir}/pages.parquet").where("html is not null"), "html", flags).select(F.col("page_id").alias("id"), *flags)

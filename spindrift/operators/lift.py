"""Lift of title patterns: how much better rows with a pattern did than rows around them without it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_title
from .relational import newest_n

# Title patterns by name.  Two more, short and long, go by the length of the cleaned title.
FORMULAS = {
    "question": r"\?|？|까\s*$|까[!.~]|나요|을까|할까|될까",
    "number": r"(?i)\d+\s?가지|\d+\s?개|TOP\s?\d+|\d+\s?분",
    "auth": r"국가대표|국대|前|現|(?:^|\s)전\s|(?:^|\s)현\s|감독|코치|득점왕|레전드",
    "vs": r"(?i)\bvs\b|대결|1\s?:\s?1|1대1|맞대결",
    "howto": r"하는\s?법|방법|꿀팁|팁|비법",
    "why": r"이유|왜",
    "series": r"(?i)\[[^\]]+\]|EP\.?\s?\d+|\d+\s?탄|시즌\s?\d+",
    "compile": r"모음|몰아보기|총정리|완전정복|정리",
    "target": r"초보|입문|초등|유소년|아마추어|동호인",
    "promise": r"무조건|바로|끝|99%|완벽",
    "engage": r"맞춰|몇\s?번|댓글|저장|공유|보여줘|퀴즈",
    "emph": r"!|ㄷㄷ|ㅋㅋ|[\x{1F300}-\x{1FAFF}☀-➿]",
    "hashtag": r"#[0-9A-Za-z가-힣_]",
    "quote": r"""["“”'‘’][^"“”'‘’]{1,15}["“”'‘’]""",
}
SHORT, LONG = 20, 40

# Where a title names its series (in brackets, before a numbered part, before a bar or colon), the number at
# a name's end that does not belong to it, and what is stripped off a name.
SERIES_BOXED = r"[\[【]([^\]】]{1,24})[\]】]"
SERIES_PART = r"([가-힣A-Za-z][^\[\]|:#]{1,14}?)\s*[\"“’']?\s*\d+\s?탄"
SERIES_HEAD = r"^\s*([^|:ㅣ\[\]#]{2,20}?)\s*[|:ㅣ]"
SERIES_NUMBER = r"(?i)\s*(?:EP\.?\s?\d+|#?\d+\s?탄|시즌\s?\d+|\d+)\s*$"
SERIES_MARKS = " \"“”'‘’-·|:"


def at_least(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of keys that have at least ``n`` rows, with ``total``."""
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= n)
    return df.join(totals, list(keys))


def with_formulas(df: DataFrame, title: str) -> DataFrame:
    """Each row once per formula, with ``formula`` and ``hit``."""
    size = F.length(clean_title(title))
    tests = [F.struct(F.lit(k).alias("formula"), F.col(title).rlike(rx).alias("hit")) for k, rx in FORMULAS.items()]
    tests += [F.struct(F.lit("short").alias("formula"), (size <= SHORT).alias("hit")), F.struct(F.lit("long").alias("formula"), (size >= LONG).alias("hit"))]
    return df.withColumn("_f", F.explode(F.array(*tests))).select("*", "_f.formula", "_f.hit").drop("_f")


def formula_lift(df: DataFrame, keys: Sequence[str], title: str, resid: str = "resid", least: int = 6) -> DataFrame:
    """keys, formula, n, share, mult, ok: mult = exp(median residual with - without); ok with three rows on both sides."""
    rows = with_formulas(at_least(df, keys, least), title)
    out = rows.groupBy(*keys, "formula").agg(
        F.sum(F.col("hit").cast("long")).alias("n"), F.sum((~F.col("hit")).cast("long")).alias("_rest"), F.avg(F.col("hit").cast("int")).alias("share"),
        F.expr(f"percentile({resid}, 0.5) FILTER (WHERE hit)").alias("_with"), F.expr(f"percentile({resid}, 0.5) FILTER (WHERE NOT hit)").alias("_without"),
    )
    return out.select(*keys, "formula", "n", "share", F.exp(F.col("_with") - F.col("_without")).alias("mult"), ((F.col("n") >= 3) & (F.col("_rest") >= 3)).alias("ok"))


def topic_lift(df: DataFrame, keys: Sequence[str], words: Column, resid: str = "resid", least_rows: int = 5, least: int = 3) -> DataFrame:
    """keys, word, n, mult: words of at least ``least`` rows but not of all; mult against the key's own median."""
    rows = at_least(df, keys, least_rows)
    mid = rows.groupBy(*keys).agg(F.percentile(resid, F.lit(0.5)).alias("_mid"))
    hits = rows.select(*keys, "total", resid, F.explode(words).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("total"), F.percentile(resid, F.lit(0.5)).alias("_m"))
    hits = hits.where((F.col("n") >= least) & (F.col("n") < F.col("total"))).join(mid, list(keys))
    return hits.select(*keys, "word", "n", F.exp(F.col("_m") - F.col("_mid")).alias("mult"))


def series(df: DataFrame, keys: Sequence[str], title: str, resid: str = "resid", least: int = 2) -> DataFrame:
    """keys, name, n, median, mult, top: series of ``least`` rows or more, by the names that titles give them."""
    boxed = F.transform(F.regexp_extract_all(title, F.lit(SERIES_BOXED)), lambda x: F.btrim(F.regexp_replace(x, SERIES_NUMBER, "")))
    boxed = F.transform(F.filter(boxed, lambda x: F.length(x) >= 2), lambda x: F.concat(F.lit("["), x, F.lit("]")))
    part = F.btrim(F.regexp_extract(title, SERIES_PART, 1), F.lit(SERIES_MARKS))
    head = F.btrim(F.regexp_extract(title, SERIES_HEAD, 1))
    one = lambda name, least, end: F.when(F.length(name) >= least, F.array(F.concat(name, F.lit(end)))).otherwise(F.array().cast("array<string>"))
    names = df.select(*keys, "id", "views", resid, F.explode(F.array_distinct(F.concat(boxed, one(part, 2, " N탄"), one(head, 1, " |")))).alias("name"))
    names = names.where(F.length(F.regexp_replace("name", "[^A-Za-z가-힣]", "")) >= 2)
    out = names.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n"), F.percentile("views", F.lit(0.5)).alias("median"), F.exp(F.percentile(resid, F.lit(0.5))).alias("mult"), F.max_by("id", F.struct("views", "id")).alias("top"))
    return out.where(F.col("n") >= least)


def supported(df: DataFrame, keys: Sequence[str], items: Column, share: float, least: int) -> DataFrame:
    """keys, item, n, of: items of at least ``share`` of a key's rows, for keys with at least ``least`` rows."""
    rows = at_least(df, keys, least).select(*keys, "total", F.explode(items).alias("item"))
    return rows.groupBy(*keys, "item").agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("of")).where(F.col("n") >= share * F.col("of"))


def ranked_terms(df: DataFrame, keys: Sequence[str], title: str, terms: Sequence[str], n: int) -> DataFrame:
    """The ``n`` most frequent terms; longer terms are matched first, and matches do not overlap."""
    rx = "(" + "|".join(sorted(terms, key=lambda t: (-len(t), t))) + ")"
    hits = df.select(*keys, F.explode(F.regexp_extract_all(F.lower(title), F.lit(rx))).alias("term"))
    return newest_n(hits.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n")), keys, [F.desc("n"), "term"], n).drop("place")


def pooled(each: DataFrame, key: str) -> DataFrame:
    """Evidence of many channels in one score: mean of ln(mult), each shrunk by n / (n + 6)."""
    ev = F.log("mult") * F.col("n") / (F.col("n") + 6)
    return each.groupBy(key).agg(F.count(F.lit(1)).alias("channels"), F.sum("n").alias("n"), (F.sum(ev) / F.count(F.lit(1))).alias("score"))


TAG = r"(#[0-9A-Za-z가-힣_]+)"


def fixed_tags(df: DataFrame, keys: Sequence[str], title: str, generic: Sequence[str] = (), share: float = 0.6, least: int = 5, most: int = 4) -> DataFrame:
    """keys, tag, n, place: hashtags of at least ``share`` of a key's titles (of keys with ``least``), those of every channel
    (``generic``) last, then by titles and name; ``most`` of them."""
    tags = F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit(TAG)))
    rows = supported(df, keys, tags, share, least).withColumnRenamed("item", "tag")
    last = F.col("tag").isin(*generic) if generic else F.lit(False)
    return newest_n(rows, keys, [last, F.desc("n"), "tag"], most).select(*keys, "tag", "n", "place")


def bundle(df: DataFrame, key: str, title: str, words: Column, resid: str = "resid", generic: Sequence[str] = ()) -> DataFrame:
    """One row per channel: ``n`` titles, ``formulas`` (sure ones: formula, n, mult), ``topics`` (the 20 strongest: word, n, mult),
    ``series`` (the 8 longest: name, n, mult) and ``tags``, each an array in order; empty where there is none."""
    sorted_ = lambda rows, name, order, *cells: rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*cells).alias("_c")))), lambda x: x["_c"]).alias(name))
    formulas = sorted_(formula_lift(df, [key], title).where("ok"), "formulas", ["formula"], "formula", "n", "mult")
    strength = -F.round(F.col("mult") * F.log1p(F.col("n").cast("double")), 5)
    topics = newest_n(topic_lift(df, [key], words, resid).withColumn("_s", strength), [key], ["_s", "word"], 20)
    topics = sorted_(topics, "topics", ["place"], "word", "n", "mult")
    found = newest_n(series(df, [key], title, resid), [key], [F.desc("n"), F.desc(F.round("mult", 6)), "name"], 8)
    found = sorted_(found, "series", ["place"], "name", "n", "mult")
    tags = sorted_(fixed_tags(df, [key], title, generic), "tags", ["place"], "tag", "n")
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    for part in (formulas, topics, found, tags):
        name = next(c for c in part.columns if c != key)
        out = out.join(part, key, "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out

"""Fuzzy joins of titles: a set-similarity join with prefix, length and position filters, verified on the letters.

Two titles are linked if they differ, at least ``jaccard`` of their words are shared, and either the words of one stand
in a row in the other (a word or two were added or taken off) or ``ratio`` of their letters are in a longest common
subsequence.  Titles of the same words in the same order are one class; classes are compared, not rows, so copies cost
nothing.

Words are ordered from rare to frequent.  Titles that share enough words share one of their first (rarest) ones, so
only these meet, and only where lengths, places and bitmaps of the words leave room for enough
shared ones.  A word that very many titles
hold is thus a key only for titles of hardly anything rarer.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import staged
from .sequential import common

LEAST, JACCARD, RATIO = 6, 0.5, 0.8
BITMAPS = 4
_WORD = "([0-9A-Za-z가-힣À-ÖØ-öø-ÿ]+)"


def title_words(c: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(_WORD))


def classes(rows: DataFrame, id_col: str, title: str, least: int = LEAST) -> DataFrame:
    """One row per class of titles: ``class`` (least id), ``seq`` (its words, spaces between) and ``n`` rows.  Titles of
    fewer than ``least`` letters, and rows without an id, are in none."""
    seq = F.array_join(title_words(title), " ")
    named = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), seq.alias("seq"))
    return named.where(F.length(F.replace("seq", F.lit(" "), F.lit(""))) >= least).groupBy("seq").agg(F.min("_id").alias("class"), F.count(F.lit(1)).alias("n"))


def ranked_words(titles: DataFrame, frequency: DataFrame) -> DataFrame:
    """class, words: the distinct words of each of ``titles`` (class, seq), rare ones first (ties: by letters)."""
    cells = titles.select("class", F.explode(F.array_distinct(F.split("seq", " "))).alias("word"))
    cells = cells.join(frequency, "word", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("word"))))
    return cells.groupBy("class").agg(order.alias("_w")).select("class", F.transform("_w", lambda x: x["word"]).alias("words"))


def _side(df: DataFrame, mark: str, columns: Sequence[str]) -> DataFrame:
    return df.select("word", *[F.col(c).alias(f"{mark}_{c}") for c in columns])


def prefixes(titles: DataFrame, jaccard: float) -> DataFrame:
    """The first words of each title: one of them is shared by any title that has ``jaccard`` of the words in common."""
    n = F.size("words")
    first = F.slice("words", F.lit(1), n - F.ceil(F.lit(jaccard) * n).cast("int") + 1)
    return titles.select("class", n.alias("size"), *[b.alias(f"bits{i}") for i, b in enumerate(word_bits("words"))], F.posexplode(first).alias("place", "word"))


def word_bits(words: str) -> list[Column]:
    """A bit for each word, by its hash, of 64 * BITMAPS: two titles have at most as many unlike bits as unlike words."""
    at = lambda w: F.pmod(F.xxhash64(w), F.lit(64 * BITMAPS))
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), (at(w) % 64).cast("int"))
    own = lambda i: lambda acc, w: F.when(F.floor(at(w) / 64) == i, acc.bitwiseOR(bit(w))).otherwise(acc)
    return [F.aggregate(words, F.lit(0).cast("long"), own(i)) for i in range(BITMAPS)]


def candidates(left: DataFrame, right: DataFrame, jaccard: float) -> DataFrame:
    """a, b: classes (class, words) that share one of their first words and may share enough of them."""
    parts = ["class", "size", "place", *[f"bits{i}" for i in range(BITMAPS)]]
    met = _side(prefixes(left, jaccard), "a", parts).join(_side(prefixes(right, jaccard), "b", parts), "word")
    sizes = F.least("a_size", "b_size") >= F.lit(jaccard) * F.greatest("a_size", "b_size")
    room = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))  # this word and those after it
    enough = room >= F.lit(jaccard / (1 + jaccard)) * (F.col("a_size") + F.col("b_size")) - F.least("a_place", "b_place") - 1e-9
    unlike = sum(F.bit_count(F.col(f"a_bits{i}").bitwiseXOR(F.col(f"b_bits{i}"))) for i in range(BITMAPS))
    enough = enough & (unlike <= F.lit((1 - jaccard) / (1 + jaccard)) * (F.col("a_size") + F.col("b_size")) + 1e-9)
    return met.where(sizes & enough & (F.col("a_class") != F.col("b_class"))).select(F.col("a_class").alias("a"), F.col("b_class").alias("b")).distinct()


def alike_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, jaccard: float, ratio: float) -> DataFrame:
    """a, b, how: those of ``pairs`` whose titles (class, seq) share enough words and letters."""
    text = lambda df, k: df.select(F.col("class").alias(k), F.col("seq").alias(f"{k}_seq"), F.array_distinct(F.split("seq", " ")).alias(f"{k}_words"))
    full = pairs.join(text(left, "a"), "a").join(text(right, "b"), "b").where("a_seq <> b_seq")
    shared = F.size(F.array_intersect("a_words", "b_words"))
    full = full.where(shared >= F.lit(jaccard) * (F.size("a_words") + F.size("b_words") - shared) - 1e-9)
    key = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    inside = F.when(F.contains(padded("a_seq"), padded("b_seq")), "contains").when(F.contains(padded("b_seq"), padded("a_seq")), "within")
    full = full.select("a", "b", inside.alias("how"), key("a_seq").alias("x"), key("b_seq").alias("y"))
    sized = 2 * F.least(F.length("x"), F.length("y")) >= F.lit(ratio) * (F.length("x") + F.length("y"))
    near = F.pandas_udf(lambda x, y: pd.Series([2 * common(a, b) >= ratio * (len(a) + len(b)) for a, b in zip(x, y)], dtype=bool), "boolean")
    alike = full.where(F.col("how").isNull() & sized).where(near("x", "y")).withColumn("how", F.lit("alike"))
    return full.where("how is not null").select("a", "b", "how").union(alike.select("a", "b", "how"))


def fuzzy_links(left: DataFrame, right: DataFrame, *, jaccard: float = JACCARD, ratio: float = RATIO) -> DataFrame:
    """Links between :func:`classes` of both sides: ``a`` and ``b`` (classes), ``how`` (contains, within or alike; the first that
    holds).  A class of the same title is no link."""
    frequency = right.select(F.explode(F.array_distinct(F.split("seq", " "))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    a, b = (staged(ranked_words(s, frequency), "titles") for s in (left, right))
    return alike_pairs(candidates(a, b, jaccard), left, right, jaccard, ratio)


def fuzzy_join(left: DataFrame, right: DataFrame, *, id_col: str = "id", title: str = "title", least: int = LEAST, jaccard: float = JACCARD, ratio: float = RATIO) -> DataFrame:
    """:func:`fuzzy_links` of two tables of titles, with the classes' rows: ``a`` (least id of the class in ``left``), ``b`` (in
    ``right``), ``n_a``, ``n_b``, ``how``."""
    sides = [staged(classes(df, id_col, title, least), "classes") for df in (left, right)]
    rows = lambda s, k: s.select(F.col("class").alias(k), F.col("n").alias(f"n_{k}"))
    links = fuzzy_links(*sides, jaccard=jaccard, ratio=ratio)
    return links.join(rows(sides[0], "a"), "a").join(rows(sides[1], "b"), "b").select("a", "b", "n_a", "n_b", "how")

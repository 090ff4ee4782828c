"""Transcript rules: sentences, times of words, corrections, what is heard where, scores of frames."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def words_of(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per word: ``keys, at`` (from 0) and ``word``."""
    return df.select(*keys, F.posexplode(F.filter(F.split(text, r"\s+"), lambda x: x != "")).alias("at", "word"))


def sentences(words: DataFrame, keys: Sequence[str], *, end: str = r"[.?!]+[\"')]*$", gap: str | None = None, least: float = 1.2) -> DataFrame:
    """Words in order -> sentences: one ends with a mark of its last word, or before a pause (column ``gap``, seconds before
    the word) of ``least``.  Returns ``keys, sentence`` (from 0), ``first`` (its first word's place), ``n`` and ``text``."""
    order = Window.partitionBy(*keys).orderBy("at")
    breaks = F.coalesce(F.lag("word").over(order).rlike(end), F.lit(False))
    if gap:
        breaks = breaks | (F.col(gap) >= least)
    rows = words.withColumn("_new", breaks.cast("int")).withColumn("sentence", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    return rows.groupBy(*keys, "sentence").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), joined.alias("text"))


def spread_words(df: DataFrame, keys: Sequence[str], text: str, start: str, end: str) -> DataFrame:
    """Times of words from those of their text, in proportion to the words' characters (one at least)."""
    rows = words_of(df, [*keys, start, end], text).withColumn("_c", F.greatest(F.length("word"), F.lit(1)))
    order = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.sum("_c").over(order)).withColumn("_all", F.sum("_c").over(Window.partitionBy(*keys)))
    place = lambda n: F.col(start) + (F.col(end) - F.col(start)) * n / F.col("_all")
    return rows.select(*keys, F.col("at").cast("long").alias("at"), "word", place(F.col("_upto") - F.col("_c")).alias("s"), place(F.col("_upto")).alias("e"))


def strip_suffix(c: Column, suffixes: Sequence[str], least: int = 2) -> Column:
    """Without the first of ``suffixes`` that ends it, if at least ``least`` characters stay."""
    out = F.lit(None).cast("string")
    for s in reversed(suffixes):
        out = F.when(c.endswith(s) & (F.length(c) - len(s) >= least), F.substring(c, F.lit(1), F.length(c) - len(s))).otherwise(out)
    return F.coalesce(out, c)


def correct(c: str | Column, fixes: dict[str, str]) -> Column:
    """A text with whole words (between spaces) replaced; a mark at the word's end stays."""
    table = F.create_map(*[F.lit(x) for pair in fixes.items() for x in pair])

    def one(x: Column) -> Column:
        core = F.regexp_extract(x, r"^(.*?)([,.?!]*)$", 1)
        right = F.try_element_at(table, core)
        return F.coalesce(F.concat(right, F.regexp_extract(x, r"^(.*?)([,.?!]*)$", 2)), x)

    return F.array_join(F.transform(F.split(c, " "), one), " ")


def skeleton(title: str | Column, topics: str, slot: str = "{}") -> Column:
    """A title with its only topic replaced by a slot; null unless exactly one of ``topics`` (a pattern) occurs once."""
    rx = f"({topics})"
    return F.when(F.size(F.regexp_extract_all(title, F.lit(rx))) == 1, F.regexp_replace(title, rx, F.lit(slot)))


def heard(words: DataFrame, regions: DataFrame, keys: Sequence[str], bucket: float) -> DataFrame:
    """Segments (``keys``) of which more than half of the words' middles lie within some region of their file.

    ``words``: keys (the first is the file), s, e.  ``regions``: file, a, b.  Joined by file and time bucket."""
    file = keys[0]
    mid = words.withColumn("_m", (F.col("s") + F.col("e")) / 2).withColumn("_w", F.monotonically_increasing_id())
    spans = regions.select(F.col(file).alias("_f"), "a", "b", F.explode(F.sequence(F.floor(F.col("a") / bucket), F.floor(F.col("b") / bucket))).alias("_k"))
    on = (F.col(file) == F.col("_f")) & (F.floor(F.col("_m") / bucket) == F.col("_k")) & F.col("_m").between(F.col("a"), F.col("b"))
    inside = mid.join(spans, on, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("inside"))
    return words.groupBy(*keys).agg(F.count(F.lit(1)).alias("words")).join(inside, list(keys)).where(2 * F.col("inside") > F.col("words"))


def blur_multiplier(blur: Column) -> Column:
    """Whole up to 0.35, then falling by 0.3 per unit; half above 0.6."""
    return F.when(blur > 0.6, 0.5).otherwise(1 - 0.3 * F.greatest(F.lit(0.0), blur - 0.35))


def subject_multiplier(blur: Column) -> Column:
    """Whole up to 0.15, then falling steeply, 0.3 at least."""
    return F.greatest(F.lit(0.3), 1 - 1.6 * F.greatest(F.lit(0.0), blur - 0.15))


def quota_day(at: Column) -> Column:
    """Day on the US Pacific coast of seconds since 1970: UTC-7 from the second Sunday of March, 10:00 UTC, to the first
    Sunday of November, 9:00 UTC; else UTC-8."""
    t = F.timestamp_seconds(at)
    sunday = lambda month, nth: F.date_add(F.next_day(F.date_sub(F.make_date(F.year(t), F.lit(month), F.lit(1)), 1), "Sun"), 7 * (nth - 1))
    seconds = lambda day, hour: F.unix_seconds(day.cast("timestamp")) + 3600 * hour
    summer = (at >= seconds(sunday(3, 2), 10)) & (at < seconds(sunday(11, 1), 9))
    return F.to_date(F.timestamp_seconds(at + F.when(summer, -7 * 3600).otherwise(-8 * 3600)))


#: Pairs of particles after a syllable with and without a final consonant.
PARTICLES = {"은": "는", "이": "가", "을": "를", "과": "와", "으로": "로"}


def fill_template(template: Column, word: Column) -> Column:
    """``{}`` becomes the word, and a particle right after it the form that the word's last syllable asks for; after other
    than Korean letters it stays.  Of the pair with 으로, a final ㄹ counts as none."""
    last = F.ascii(F.right(word, F.lit(1))) - 0xAC00
    korean, final = last.between(0, 11171), last % 28
    out = F.replace(template, F.lit("{}"), word)
    for closed, open_ in PARTICLES.items():
        bare = (final == 0) | (final == 8) if closed == "으로" else final == 0
        for given in (closed, open_):
            out = F.when(korean & F.contains(template, F.lit("{}" + given)), F.replace(template, F.lit("{}" + given), F.concat(word, F.when(bare, open_).otherwise(closed)))).otherwise(out)
    return out


def nearly_only(c: Column, pattern: str, fillers: str, most: int) -> Column:
    """Whether ``pattern`` occurs and, without it, ``fillers`` and white space, at most ``most`` characters are left."""
    return c.rlike(pattern) & (F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, pattern, ""), fillers, ""), r"\s+", "")) <= most)


def pack_array(c: str | Column) -> Column:
    """Numbers as base64 of compressed little-endian singles."""

    @F.pandas_udf("string")
    def packed(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else base64.b64encode(zlib.compress(np.asarray(x, "<f4").tobytes())).decode())

    return packed(c)


def unpack_array(c: str | Column) -> Column:
    """The numbers of ``pack_array``; what is not of that form is an empty array."""

    def one(x):
        try:
            return np.frombuffer(zlib.decompress(base64.b64decode(x or "", validate=True)), "<f4")
        except (ValueError, zlib.error):
            return np.zeros(0, np.float32)

    @F.pandas_udf("array<float>")
    def unpacked(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return unpacked(c)

"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# What is taken out of a title for reading and for comparison, and the marks that are stripped off its ends.
TAG = r"#\S+"
ASIDE = r"\[[^\]]*\]|\([^)]*\)|#\S+"
NOT_KEY = "[^0-9A-Za-z가-힣]"
END_MARKS = " |ㅣ-"


def clean_title(c: str | Column) -> Column:
    """Without tags, white space in one, bars and dashes off the ends."""
    return F.btrim(F.regexp_replace(F.regexp_replace(c, TAG, ""), r"\s+", " "), F.lit(END_MARKS))


def title_key(c: str | Column) -> Column:
    """For comparison: bracketed parts, tags and all but letters and digits go; lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, ASIDE, ""), NOT_KEY, ""))


def tokens(c: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z가-힣]{2,10})"))


def letter_ratio(c: str | Column, some: str, all_: str) -> Column:
    """Share of the characters of ``all_`` that are of ``some``; 0 without any."""
    n = lambda rx: F.size(F.regexp_extract_all(c, F.lit(f"({rx})"))).cast("double")
    return F.when(n(all_) == 0, 0.0).otherwise(n(some) / F.nullif(n(all_), F.lit(0.0)))


def flags(df: DataFrame, c: str, patterns: dict[str, str]) -> DataFrame:
    return df.withColumns({k: F.col(c).rlike(rx) for k, rx in patterns.items()})

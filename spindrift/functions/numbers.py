"""Number and time expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_valid(df: DataFrame, c: str) -> DataFrame:
    """Rows whose value is positive and finite."""
    return df.where((F.col(c) > 0) & ~F.isnan(c) & (F.col(c) < float("inf")))


def rounded(c: str | Column, places: int) -> Column:
    """To so many places by the double's own value, as SQL databases and the reference do: 1.025, which lies below it, gives
    1.02, where ``F.round`` goes by the shortest decimals that name it."""
    c = F.col(c) if isinstance(c, str) else c
    got = F.round(c * 10.0**places) / 10.0**places
    return F.when(F.isnan(got) | (F.abs(got) == float("inf")), c).otherwise(got)


def safe_int(c: Column) -> Column:
    """A whole number from 0 up, else null."""
    n = c.try_cast("bigint")
    return F.when(n >= 0, n)


def timecode(seconds: Column) -> Column:
    ms = F.round(seconds * 1000).cast("long")
    unit = lambda n, of: F.pmod(F.floor(ms / n), F.lit(of))
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), unit(60_000, 60), unit(1000, 60), F.pmod(ms, F.lit(1000)))


def short_time(seconds: Column) -> Column:
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%d:%02d", F.floor(ms / 60_000), F.pmod(F.floor(ms / 1000), F.lit(60)))


def shown(c: Column) -> Column:
    """Thousands with one digit after the point, cut; smaller numbers whole."""
    return F.when(c >= 1000, F.format_string("%.1fk", F.floor(c / 100) / 10)).otherwise(F.format_string("%d", F.floor(c)))


def two_digits(c: Column) -> Column:
    """A positive number to two significant digits, as a whole number; 0 for what is not."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(c)) - 1)
    return F.when(c > 0, F.when(unit > 1, F.bround(c / unit) * unit).otherwise(F.bround(c))).otherwise(0).cast("long")


def round5(p: Column) -> Column:
    """A share in per cent, to the nearest five."""
    return (5 * F.bround(100 * p / 5)).cast("long")


def shown_chance(p: Column, lo: Column, hi: Column, doubts: Column) -> Column:
    """A chance and its range as they are shown: ``p, lo, hi`` in fives, ``text``, ``range``, ``confidence`` (high, middle or low by the
    range's width; always low with ``doubts``) and ``wide``."""
    mid = round5(p)
    low, high = F.greatest(F.lit(0), F.least(round5(lo), mid)), F.least(F.lit(100), F.greatest(round5(hi), mid))
    text = F.when(p < 0.05, "under 5%").when(p > 0.95, "over 95%").otherwise(F.concat(F.lit("about "), mid.cast("string"), F.lit("%")))
    sure = F.when(doubts, "low").when(high - low <= 25, "high").when(high - low <= 45, "middle").otherwise("low")
    return F.struct(mid.alias("p"), low.alias("lo"), high.alias("hi"), text.alias("text"), F.concat(low.cast("string"), F.lit("~"), high.cast("string"), F.lit("%")).alias("range"), sure.alias("confidence"), (high - low > 60).alias("wide"))


def step(c: Column) -> Column:
    """The step in which a number is shown."""
    out = F.when(c < 100, 1).when(c < 1000, 10).when(c < 10_000, 100).when(c < 100_000, 1000).otherwise(10_000)
    return out.cast("long")


def log_ratio(a: Column, b: Column, floor: float) -> Column:
    return F.log(F.greatest(a, F.lit(floor)) / F.greatest(b, F.lit(floor)))


def relative(a: Column, b: Column, floor: float) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(floor))


def decile_distance(a: Column, b: Column, floor: float) -> Column:
    """Mean |ln ratio| of two arrays of quantiles."""
    off = F.zip_with(a, b, lambda x, y: F.abs(log_ratio(x, y, floor)))
    return F.aggregate(off, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def first_rule(c: Column, rules: Sequence[tuple[str, str]], other: str) -> Column:
    """Name of the first pattern that is found."""
    return F.coalesce(*[F.when(c.rlike(rx), F.lit(name)) for name, rx in rules], F.lit(other))


def rule_score(bad: Sequence[Column], warn: Sequence[Column]) -> Column:
    """100, less 20 for each bad sign and 7 for each warning, 0 at least."""
    lost = lambda tests, n: [F.when(t, n).otherwise(0) for t in tests]
    total = reduce(lambda a, b: a + b, lost(bad, 20) + lost(warn, 7), F.lit(0))
    return F.greatest(F.lit(0), 100 - total).cast("long")


def normal_cdf(z: Column) -> Column:
    """Phi(z) by a rational approximation, to 7.5e-8: Spark has no erf."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)

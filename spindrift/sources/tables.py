"""The driver's tables in the roles of the analytics operators, and the same roles as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import newest_n

HOUR = 3_600_000_000
DAY = 24 * HOUR
ALL = 1 << 62


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel, fmt, id, views, pub (epoch microseconds): one row per event."""
    pub = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), F.col("event_type").alias("fmt"), F.col("event_id").alias("id"), F.col("value").alias("views"), pub.alias("pub"))


def titles(spark: SparkSession, sf_dir: str, newest: int | None = None) -> DataFrame:
    """channel, id, title, views: every document with its whole first line as title; with ``newest`` only so many of each
    source, and their pos from 0."""
    title = F.split("text", "\n")[0]
    rows = table(spark, sf_dir, "documents").where("text is not null and n_chars > 0").select(F.col("source").alias("channel"), F.col("doc_id").alias("id"), title.alias("title"), F.col("n_chars").cast("double").alias("views"))
    if newest is None:
        return rows
    return newest_n(rows, ["channel"], [F.desc("id")], newest).withColumn("pos", F.col("place") - 1).drop("place")


def newest_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 120 of each source, with whole first lines: what the reference mines its patterns from."""
    return titles(spark, sf_dir, 120)


VIDEOS = """v AS (SELECT user_id AS channel, event_type AS fmt, event_id AS id, value AS views, epoch_us(ts) AS pub,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) - 1 AS pos FROM events)"""
ALL_TITLES = """t AS (SELECT source AS channel, doc_id AS id, split_part(text, chr(10), 1) AS title, n_chars::DOUBLE AS views,
  row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) - 1 AS pos FROM documents WHERE text IS NOT NULL AND n_chars > 0)"""
NEWEST_TITLES = ALL_TITLES.replace("t AS (SELECT", "t AS (SELECT * FROM (SELECT", 1) + " WHERE pos < 120)"

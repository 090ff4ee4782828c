"""Append-only history as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WEEK = 7 * 24 * 3_600_000_000


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir; the warehouse where both are one machine."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return conf.rstrip("/") if conf else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stream"


def upsert_batches(stream: DataFrame, merge, checkpoint: str):
    """A streaming query that hands each micro-batch to ``merge(batch, batch_id)``; a batch that is retried has the
    same id, so ``merge`` can write to a path of that id."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial sums of each micro-batch, written once per batch id, and their total."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(sf_dir)
    home = f"{shared_dir(spark)}/weekly-{uuid.uuid4().hex[:12]}"
    pub = F.unix_micros(F.col("ts").cast("timestamp"))

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy(F.col("event_type").alias("fmt"), F.floor(pub / WEEK).alias("week")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        rows.write.mode("overwrite").parquet(f"{home}/parts/batch={number}")

    upsert_batches(stream, merge, f"{home}/state").awaitTermination()
    parts = spark.read.schema("fmt string, week long, n long, total double").parquet(f"{home}/parts")
    return parts.groupBy("fmt", "week").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))

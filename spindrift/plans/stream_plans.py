"""Streams with state, over the driver's events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming.history import shared_dir
from ..streaming.stability import OUTPUT, run_to_end, settled_files, state_session
from .registry import query


@query(
    "m1_settled_files",
    """WITH o AS (SELECT 'u' || user_id AS path, epoch_us(ts) // 1000 AS t, length(event_type)::BIGINT AS size, (floor(value)::BIGINT % 2) AS mtime FROM events),
    l AS (SELECT *, row_number() OVER w AS k, lag(t) OVER w AS t0, lag(size) OVER w AS size0, lag(mtime) OVER w AS mtime0 FROM o WINDOW w AS (PARTITION BY path ORDER BY t, size, mtime)),
    c AS (SELECT *, t0 IS NULL OR t - t0 > 172800000 AS sight, size <> size0 OR mtime <> mtime0 AS changed FROM l),
    e AS (SELECT *, sum((sight OR changed)::INT) OVER (PARTITION BY path ORDER BY k) AS epoch FROM c),
    g AS (SELECT path, epoch, min(t) AS since, max(t) AS last, bool_or(sight AND k0 = k) AS sight, any_value(size) AS size, any_value(mtime) AS mtime FROM (SELECT *, min(k) OVER (PARTITION BY path, epoch) AS k0 FROM e) GROUP BY 1, 2),
    h AS (SELECT *, lead(since) OVER (PARTITION BY path ORDER BY epoch) AS until, max(last) OVER () AS now FROM g)
    SELECT path, since AS "at", CASE WHEN sight THEN 'ready' ELSE 'copying' END AS event, size, mtime FROM h
    UNION ALL SELECT path, since + 21600000, 'ready', size, mtime FROM h WHERE NOT sight AND since + 21600000 <= coalesce(until, greatest(last, now))""",
)
def m1(spark, sf_dir):
    """Events as listings of one file a user: whole after six hours without a change, forgotten after two days."""
    own, home = state_session(spark), f"{shared_dir(spark)}/settled-{uuid.uuid4().hex[:12]}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = own.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(sf_dir)
    size, mtime = F.length("event_type"), F.floor("value") % 2
    listings = events.select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("ts").cast("timestamp").alias("seen"), size.alias("size"), mtime.alias("mtime"))
    run_to_end(settled_files(listings, stable=6 * 3600, forget=48 * 3600), f"{home}/out", f"{home}/state")
    return spark.read.schema(OUTPUT).parquet(f"{home}/out").select("path", "at", "event", "size", "mtime")

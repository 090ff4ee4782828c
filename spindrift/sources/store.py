"""Tables that are kept up to date: documents by key, a log that is followed, artefacts by version, the newer of two lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

PARTS = 64
LISTED = 300


class DocumentStore:
    """Documents by key in a partitioned folder; an upsert rewrites the partitions that it touches and no others.

    Spark stages what it writes and moves it in when the job has gone through, partition by partition, so a write that
    fails changes nothing.  Of a key's documents the one with the greatest ``at`` stays, of equal times the greatest
    document, so an upsert that is done again, or comes late, changes nothing either."""

    def __init__(self, spark: SparkSession, path: str, schema: str, *, key: str, at: str, parts: int = PARTS):
        self.spark, self.path, self.key, self.at, self.parts = spark, path, key, at, parts
        self.schema = f"{schema}, part int"
        self.columns = [f.name for f in spark.createDataFrame([], schema).schema]

    def create(self) -> DocumentStore:
        """An empty store, unless there is one."""
        self.spark.createDataFrame([], self.schema).write.mode("append").partitionBy("part").parquet(self.path)
        return self

    def read(self) -> DataFrame:
        return self._stored().select(*self.columns)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def upsert(self, batch: DataFrame, change: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Take in ``batch``; rows without a key or time are left out.  ``change`` may rework what the touched partitions
        then hold before it is written: if it fails, nothing is."""
        part = F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")
        fresh = batch.select(*self.columns).where(F.col(self.key).isNotNull() & F.col(self.at).isNotNull()).withColumn("part", part)
        touched = [r.part for r in fresh.select("part").distinct().collect()]  # PARTS numbers at most
        if not touched:
            return
        both = self._stored().where(F.col("part").isin(touched)).unionByName(fresh)
        rest = [c for c in self.columns if c not in (self.key, self.at)]
        merged = both.groupBy("part", self.key).agg(F.max(F.struct(self.at, *rest)).alias("_d")).select("part", self.key, "_d.*")
        if change:
            merged = change(merged)
        out = merged.select(*self.columns, "part").repartition(len(touched), "part")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take in all that a stream has now, batch by batch; a batch that is retried is taken in again."""
        return stream.writeStream.foreachBatch(lambda batch, _: self.upsert(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_log(spark: SparkSession, folder: str, out: str, checkpoint: str, *, archive: str | None = None) -> int:
    """Take over the lines that a log (a folder of segments that only grow in number) has gained, and return how many lines
    there are now.

    ``out`` holds ``n`` (running number from 0) and ``line``: who knows n lines reads on from there.  Each segment is taken
    once, by name, wherever rotation puts it afterwards: with ``archive`` Spark moves it there itself when it is done.
    Numbers go on from what earlier batches have; a batch that is retried writes the same lines with the same numbers."""
    lines = spark.readStream.schema("value string").option("cleanSource", "archive" if archive else "off")
    if archive:
        lines = lines.option("sourceArchiveDir", archive)
    stream = lines.text(folder).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def take(batch: DataFrame, number: int) -> None:
        known = spark.read.schema("n long, line string, batch int").parquet(out)
        before = known.where(F.col("batch") < number).count() if number else 0
        # numbered segment by segment: places within one, and the lines of the segments before it (one row a segment)
        own = batch.withColumn("place", F.monotonically_increasing_id()).withColumn("i", F.row_number().over(Window.partitionBy("file").orderBy("start", "place")))
        sizes = own.groupBy("file").agg(F.count(F.lit(1)).alias("size"))
        sizes = sizes.withColumn("first", F.coalesce(F.sum("size").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + before)
        rows = own.join(sizes.select("file", "first"), "file")
        rows.select((F.col("first") + F.col("i") - 1).alias("n"), F.col("value").alias("line")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    spark.createDataFrame([], "n long, line string, batch int").write.mode("append").partitionBy("batch").parquet(out)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("n long, line string, batch int").parquet(out).count()


def lines_since(spark: SparkSession, out: str, n: int) -> DataFrame:
    """Lines from number ``n`` on."""
    return spark.read.schema("n long, line string, batch int").parquet(out).where(F.col("n") >= n).select("n", "line")


def refreshed(artefacts: DataFrame, files: DataFrame, compute: Callable[[DataFrame], DataFrame], version: int, models: Sequence[str] = ()) -> DataFrame:
    """Artefacts of all ``files`` (name, size, mtime, and what is computed from): those of ``artefacts`` (ver, name, size, mtime, value,
    and a boolean for each of ``models``: had it then) that are of this version and file are taken over, the others
    computed.  With ``models`` (booleans of the files too: there now), one that was missing then and is there now asks for
    it again.  ``reused`` says which way a row came.  A name that several rows hold counts as its greatest."""
    now = files.withColumnsRenamed({m: f"_now_{m}" for m in models})
    same = (F.col("ver") == version) & F.col("_size").eqNullSafe(F.col("size")) & F.col("_mtime").eqNullSafe(F.col("mtime"))
    for m in models:
        same = same & ~(F.coalesce(F.col(f"_now_{m}"), F.lit(False)) & ~F.coalesce(F.col(m), F.lit(False)))
    kept = artefacts.groupBy("name").agg(F.max(F.struct("ver", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), "value", *models)).alias("_a")).select("name", "_a.*")
    joined = now.join(kept, "name", "left")
    good = joined.where(F.coalesce(same, F.lit(False)))
    stale = now.join(good.select("name"), "name", "left_anti").withColumnsRenamed({f"_now_{m}": m for m in models})
    fresh = compute(stale).select("name", "size", "mtime", "value", *models, F.lit(False).alias("reused"))
    old = good.select("name", "size", "mtime", "value", *models, F.lit(True).alias("reused"))
    return old.unionByName(fresh).withColumn("ver", F.lit(version))


def newer(lists: DataFrame, keys: Sequence[str], at: str, rows: str, most: int = LISTED) -> DataFrame:
    """Of lists of the same keys (an array of rows each, with its time), the one of the latest time, its first ``most`` rows;
    an empty or null list counts only where there is no other.  Of equal times the first source by name."""
    some = F.coalesce(F.size(rows) > 0, F.lit(False))
    first = F.min_by(F.struct("source", at, F.slice(rows, 1, most).alias(rows)), F.struct(~some, -F.coalesce(F.col(at), F.lit(0)), "source"))
    return lists.groupBy(*keys).agg(first.alias("_b")).select(*keys, "_b.*")

"""A library of files: listings, folders, formats that cannot be used, work whose file is gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings of recordings that cannot be used as they are, seconds that times of change may differ.
UNUSABLE = ["mts", "m2ts", "m2t", "ts", "avi", "wmv", "asf", "mpg", "mpeg", "vob", "mod", "tod", "3gp", "3g2", "flv", "f4v", "mxf", "dv", "rm", "rmvb", "divx", "ogv", "insv", "360"]
USABLE = ["mp4", "mov", "mkv", "webm", "m4v"]
SLACK = 2.0


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), name, top (first folder on the way, null if none), size, mtime (seconds) of all files below.
    Contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    below = F.regexp_replace("path", "^.*?" + folder.rstrip("/").split("/")[-1] + "/", "")
    rows = rows.select(below.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))
    return rows.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.nullif(F.regexp_extract("path", "^([^/]+)/", 1), F.lit("")).alias("top"), "size", "mtime")


def ending(c: str | Column) -> Column:
    return F.lower(F.regexp_extract(c, r"\.([^./]+)$", 1))


def videos(files: DataFrame, marks: DataFrame) -> DataFrame:
    """Usable files with ``analysed`` and ``recent``, the latest of the file's own time and of all ``marks`` (name, kind, at)
    there are of it; by ``recent`` falling, then by name."""
    latest = marks.groupBy("name").agg(F.max("at").alias("_at"), F.max(F.col("kind") == "analysed").alias("analysed"))
    rows = files.where(ending("name").isin(USABLE)).join(latest, "name", "left")
    out = rows.select("name", "size", F.coalesce("analysed", F.lit(False)).alias("analysed"), F.greatest("mtime", "_at").alias("recent"))
    return out.orderBy(F.desc("recent"), "name")


def folders(files: DataFrame, copying: DataFrame, deepest: int = 6, endings: list[str] = USABLE) -> DataFrame:
    """Of each top folder: usable files not deeper than ``deepest`` folders, their bytes, and how many are in ``copying`` (path)."""
    depth = F.size(F.split("path", "/")) - 1
    rows = files.where(F.col("top").isNotNull() & ending("name").isin(endings) & (depth <= deepest)).join(copying.select("path").distinct().withColumn("_c", F.lit(1)), "path", "left")
    return rows.groupBy("top").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.count("_c").alias("copying"))


def unusable(files: DataFrame) -> DataFrame:
    """Recordings right in the folder that cannot be used as they are: name, size, ending."""
    return files.where(F.col("top").isNull()).select("name", "size", ending("name").alias("ending")).where(F.col("ending").isin(UNUSABLE))


def orphans(work: DataFrame, files: DataFrame) -> DataFrame:
    """Work (old, size, mtime) whose file is gone by name, whatever its case; work without a size is none."""
    here = files.select(F.lower("name").alias("_n")).distinct()
    return work.where("size is not null and old is not null").join(here, F.lower("old") == F.col("_n"), "left_anti")


def _best(pairs: DataFrame, key: str, other: str) -> DataFrame:
    """Of each ``key`` its nearest ``other`` (ties: by name)."""
    return pairs.groupBy(key).agg(F.min_by(other, F.struct("off", other)).alias(other))


def renamed(work: DataFrame, files: DataFrame, slack: float = SLACK, rounds: int = 3) -> DataFrame:
    """old, name: orphaned work and the file that its own became, one to one.

    A file fits if its size is the same and its time of change at most ``slack`` off (any time, if the work has none).  Work
    and file are matched that are each other's nearest, ties by name; among what is left, the same again, ``rounds`` times.
    Files that have work of their own name fit none."""
    lost = orphans(work, files).groupBy("old").agg(F.max(F.struct("size", "mtime")).alias("_w")).select("old", "_w.*")
    own = work.select(F.lower("old").alias("_o")).distinct()
    free = files.join(own, F.lower("name") == F.col("_o"), "left_anti").groupBy("name").agg(F.max(F.struct("size", "mtime")).alias("_f")).select("name", F.col("_f.size").alias("size"), F.col("_f.mtime").alias("_m"))
    spread = F.explode(F.sequence(F.floor((F.col("mtime") - slack) / slack), F.floor((F.col("mtime") + slack) / slack)))
    timed = lost.where("mtime is not null").withColumn("_b", spread).join(free.withColumn("_b", F.floor(F.col("_m") / slack)), ["size", "_b"])
    timed = timed.select("old", "name", F.abs(F.col("_m") - F.col("mtime")).alias("off")).where(F.col("off") <= slack)
    untimed = lost.where("mtime is null").join(free, "size").select("old", "name", F.lit(0.0).alias("off"))
    pairs, found = timed.unionByName(untimed), None
    for _ in range(rounds):
        mutual = _best(pairs, "old", "name").join(_best(pairs, "name", "old"), ["old", "name"])
        found = mutual if found is None else found.unionByName(mutual)
        pairs = pairs.join(mutual.select("old"), "old", "left_anti").join(mutual.select("name"), "name", "left_anti")
    return found

"""Who speaks how much, and what was said in short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relational import in_blocks, newest_n, numbered

SHORTEST = 0.8  # seconds of a segment below which a voice cannot be told


def speaker_shares(segments: DataFrame, bucket: float = 600.0, seconds: Column | None = None) -> DataFrame:
    """key, label, share, seconds, speakers, turns_per_minute: of the segments (key, start, end, label) long enough, how much of
    the time each speaker has, and how often the word goes to another in a minute between the first and the last.

    ``seconds``: a segment's length where it is known; end - start falls a little short of it far from 0."""
    length = F.round(F.col("end") - F.col("start"), 6) if seconds is None else seconds
    rows = segments.where(F.col("label").isNotNull() & F.col("start").isNotNull() & (length >= SHORTEST)).select("key", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "label")
    near = in_blocks(numbered(rows, ["key"], "start", ["start", "end", "label"], bucket, number="num"), "num", back=1, ahead=0)
    before = F.lag("label").over(Window.partitionBy("key", "_block").orderBy("num"))
    near = near.withColumn("_turn", F.coalesce(before != F.col("label"), F.lit(False))).where("_mine")
    whole = near.groupBy("key").agg(F.sum(F.col("end") - F.col("start")).alias("_all"), F.count_if("_turn").alias("_turns"), F.countDistinct("label").alias("speakers"), (F.max_by("end", "num") - F.min("start")).alias("_span"))
    each = near.groupBy("key", "label").agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))
    return each.join(whole, "key").select("key", "label", (F.col("seconds") / F.col("_all")).alias("share"), "seconds", "speakers", (F.col("_turns") * 60 / F.greatest(F.lit(1.0), "_span")).alias("turns_per_minute"))


def chapter_summaries(sentences: DataFrame, score: Column, chapters: DataFrame | None = None, every: float = 90.0, most: int = 3) -> DataFrame:
    """key, chapter (its start), place, start, text: of each chapter's sentences (key, start, text) the ``most`` of highest ``score``, of
    equal ones the earlier, in order of time; a sentence that was said before in the recording does not count again.

    ``chapters``: key, t (starts; what is before the first is in none); without them, stretches of ``every`` seconds."""
    once = sentences.where("text is not null and start is not null").withColumn("_s", score).groupBy("key", "text").agg(F.min_by(F.struct("start", "_s"), "start").alias("_x")).select("key", "text", F.col("_x.start").alias("start"), F.col("_x._s").alias("_s"))
    if chapters is None:
        rows = once.withColumn("chapter", F.floor(F.col("start") / every) * every)
    else:
        bounds = chapters.groupBy("key").agg(F.array_sort(F.collect_set(F.col("t").cast("double"))).alias("_t"))  # a few chapters a recording
        rows = once.join(bounds, "key").withColumn("chapter", F.array_max(F.filter("_t", lambda t: t <= F.col("start")))).where("chapter is not null").drop("_t")
    top = newest_n(rows, ["key", "chapter"], [F.desc("_s"), "start", "text"], most)
    in_time = Window.partitionBy("key", "chapter").orderBy("start", "text")
    return top.select("key", "chapter", F.row_number().over(in_time).cast("long").alias("place"), "start", "text")

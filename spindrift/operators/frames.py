"""Structural events of a recording from its frames: pictures that are like nothing else in it.

Frames are rows: ``video``, ``t`` (second, from 0), ``hash`` (64 bits), ``hist`` (array<double>), ``flat`` and ``sat``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import islands

#: Bits that tell pictures apart, seconds left out beside a shot, lengths of a shot, limits of a graphic.
APART, BEFORE, AFTER = 24, 2, 3
SHOT_MIN, SHOT_MAX = 0.4, 4.0
CHI, GRAPHIC_FLAT, GRAPHIC_SAT = 0.5, 0.06, 0.35
TITLE_FLAT = 0.04
INTRO_MIN, INTRO_MAX, INTRO_SHARE = 20.0, 60.0, 0.15
BLOCK = 4096  # frames of one recording that a task holds at once
BANDS = 4
NONE = 127  # farther than any two of 64 bits


def shots(cuts: DataFrame, lengths: DataFrame) -> DataFrame:
    """video, a, b: what lies between 0, the cuts (video, at) and the recording's end (video, dur), SHOT_MIN to SHOT_MAX long."""
    marks = cuts.select("video", F.col("at").cast("double").alias("at")).join(lengths.select("video", "dur"), "video").where("at > 0 and at < dur")
    ends = lengths.select("video", F.explode(F.array(F.lit(0.0), F.col("dur"))).alias("at"))
    edges = marks.select("video", "at").union(ends).distinct()
    # the next edge lies within SHOT_MAX, if the shot is one of these: look in this bucket of time and the next
    spread = lambda df, ahead: df.withColumn("_k", F.explode(F.sequence(F.floor(F.col("at") / SHOT_MAX), F.floor(F.col("at") / SHOT_MAX) + ahead)))
    later = edges.select("video", F.col("at").alias("b"), F.floor(F.col("at") / SHOT_MAX).alias("_k"))
    near = spread(edges, 1).join(later, ["video", "_k"]).where(F.col("b") > F.col("at"))
    found = near.groupBy("video", F.col("at").alias("a")).agg(F.min("b").alias("b"))
    return found.where((F.col("b") - F.col("a")).between(SHOT_MIN, SHOT_MAX))


def chi_square(p: str | Column, q: str | Column) -> Column:
    """Half the sum of (p - q)^2 / (p + q) over the bins."""
    cells = F.zip_with(p, q, lambda x, y: (x - y) * (x - y) / (x + y + 1e-6))
    return 0.5 * F.aggregate(cells, F.lit(0.0), lambda a, v: a + v)


def mean_histograms(frames: DataFrame, bins: int) -> DataFrame:
    """video, mean: of each bin, over all frames."""
    return frames.groupBy("video").agg(F.array(*[F.avg(F.get("hist", F.lit(i))) for i in range(bins)]).alias("mean"))


def _packed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """Frames in blocks of time: video, block, and one array of structs."""
    return rows.groupBy("video", F.floor(F.col("t") / BLOCK).alias(name)).agg(F.collect_list(F.struct("t", "hash", *columns)).alias(f"{name}_rows"))


def witnessed(asked: DataFrame, frames: DataFrame, apart: int = APART) -> DataFrame:
    """``asked`` (video, t, hash, lo, hi) without those that have a near frame among the first and last ones with the same
    quarter of the bits: most frames are settled here, with at most two witnesses a quarter and its value."""
    width = 64 // BANDS
    quarters = lambda c: F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(F.shiftleft(c, 64 - width * (i + 1)), 64 - width).alias("v")) for i in range(BANDS)])
    keyed = lambda df: df.withColumn("_q", F.explode(quarters(F.col("hash"))))
    ends = keyed(frames).groupBy("video", "_q").agg(F.min(F.struct("t", "hash")).alias("x"), F.max(F.struct("t", "hash")).alias("y"))
    met = keyed(asked).join(ends, ["video", "_q"])
    near = lambda w: ~F.col(f"{w}.t").between(F.col("lo"), F.col("hi")) & (F.bit_count(F.col(f"{w}.hash").bitwiseXOR(F.col("hash"))) < apart)
    settled = met.where(near("x") | near("y")).select("video", "t").distinct()
    return asked.join(settled, ["video", "t"], "left_anti")


def far_frames(asked: DataFrame, frames: DataFrame, apart: int = APART) -> DataFrame:
    """video, t of the ``asked`` frames (video, t, hash, lo, hi) that differ in at least ``apart`` bits from every frame of
    their recording outside seconds lo to hi (both left out); not those without such a frame.

    What two witnesses do not settle meets all frames of its recording, block by block: tiles of frames, never pairs as
    rows, and of each tile only the nearest distance of each asked frame comes back."""
    known = frames.where("hash is not null").groupBy("video", "t").agg(F.min("hash").alias("hash"))
    rest = witnessed(asked, known, apart)
    tiles = _packed(rest, "ask", "lo", "hi").join(_packed(known, "all"), "video")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ask, every = row["ask_rows"], row["all_rows"]
                t, bits = np.array([r["t"] for r in every]), _bits(every)
                near = np.full(len(ask), NONE)
                for top in range(0, len(ask), 128):
                    part = ask[top : top + 128]
                    differ = np.bitwise_count(_bits(part)[:, None] ^ bits).astype(np.int64)
                    lo, hi = (np.array([r[c] for r in part])[:, None] for c in ("lo", "hi"))
                    near[top : top + 128] = np.where((t >= lo) & (t <= hi), NONE, differ).min(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([row["video"]] * len(ask), pa.int64()), pa.array([r["t"] for r in ask], pa.int64()), pa.array(near, pa.int64())], names=["video", "t", "near"])

    found = tiles.select(F.col("video").cast("long").alias("video"), "ask_rows", "all_rows").mapInArrow(run, "video long, t long, near long")
    return found.groupBy("video", "t").agg(F.min("near").alias("near")).where((F.col("near") >= apart) & (F.col("near") < NONE)).select("video", "t")


def _bits(rows: list[dict]) -> np.ndarray:
    return np.array([r["hash"] for r in rows], np.int64).view(np.uint64)


def inserts(frames: DataFrame, cuts: DataFrame, bins: int) -> DataFrame:
    """Short shots of a picture from elsewhere: video, a, b, seconds, odd.

    At least half of a shot's whole seconds must be odd: a graphic (flat and colourful), far in colours from the recording's mean
    and far in shape from all of it but the shot's own surroundings.  Shots that begin within a title card of the intro
    do not count."""
    lengths = frames.groupBy("video").agg((F.max("t") + 1).cast("double").alias("dur"))
    short = shots(cuts, lengths)
    inside = short.select("video", "a", "b", F.explode(F.sequence(F.ceil("a").cast("long"), F.floor("b").cast("long"))).alias("t")).where("t >= a and t < b")
    rows = inside.join(frames, ["video", "t"]).join(mean_histograms(frames, bins), "video")
    odd = (chi_square(F.col("hist"), F.col("mean")) > CHI) & (F.col("flat") < GRAPHIC_FLAT) & (F.col("sat") > GRAPHIC_SAT)
    asked = rows.where(odd & F.col("hash").isNotNull()).select("video", "t", "hash", (F.floor("a") - BEFORE).cast("long").alias("lo"), (F.floor("b") + AFTER - 1).cast("long").alias("hi"))
    far = far_frames(asked, frames).withColumn("far", F.lit(1))
    counted = rows.select("video", "a", "b", "t").join(far, ["video", "t"], "left").groupBy("video", "a", "b").agg(F.count(F.lit(1)).alias("seconds"), F.count("far").alias("odd"))
    return counted.where(2 * F.col("odd") >= F.col("seconds")).join(in_titles(short, frames, lengths), ["video", "a"], "left_anti")


def title_cards(frames: DataFrame, lengths: DataFrame) -> DataFrame:
    """video, start, stop (after the last second): flat, colourful seconds in a row within the intro."""
    intro = F.floor(F.greatest(F.lit(INTRO_MIN), F.least(F.lit(INTRO_MAX), F.col("dur") * INTRO_SHARE)))
    early = frames.join(lengths.select("video", intro.alias("intro")), "video").where((F.col("t") < F.col("intro")) & (F.col("flat") < TITLE_FLAT) & (F.col("sat") > GRAPHIC_SAT))
    return islands(early, keys=["video"], at="t", gap=1, bucket=BLOCK).select("video", "start", (F.col("stop") + 1).alias("stop"))


def in_titles(short: DataFrame, frames: DataFrame, lengths: DataFrame) -> DataFrame:
    """video, a of the shots that begin within a title card: at most a minute of cards a recording."""
    intro = F.floor(F.greatest(F.lit(INTRO_MIN), F.least(F.lit(INTRO_MAX), F.col("dur") * INTRO_SHARE)))
    early = short.join(lengths.select("video", intro.alias("intro")), "video").where("a < intro").select("video", "a")
    return early.join(title_cards(frames, lengths), "video").where("a >= start and a < stop").select("video", "a").distinct()

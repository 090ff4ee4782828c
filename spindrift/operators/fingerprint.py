"""Fingerprints of texts, and the join of those that differ in few bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BANDS, BITS, APART = 4, 16, 7


def word_bits(word: bytes) -> int:
    """The first 64 bits of a word's hash."""
    return int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:8], "big")


def fingerprint(words: set[bytes], known: dict[bytes, int]) -> int | None:
    """Bit by bit, whether more of the words have it than not; None without a word.  ``known``: bits of words met before."""
    if not words:
        return None
    for w in words:
        if w not in known:
            known[w] = word_bits(w)
    own = np.array([known[w] for w in words], ">u8")
    ones = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(own)).tobytes(), "big", signed=True)


def fingerprints(rows: DataFrame, id_col: str, text: str, most_known: int = 1 << 18) -> DataFrame:
    """id, hash (long): of each text's distinct words (between white space); null for a text without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            out = []
            for raw in batch.column("text").cast(pa.binary()):
                out.append(fingerprint(set((raw.as_py() or b"").split()), known))
                if len(known) > most_known:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.int64())], names=["id", "hash"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, hash long")


def near_pairs(prints: DataFrame) -> DataFrame:
    """a, b, distance of ``prints`` (id, hash; each hash once) at most ``APART`` bits apart, a < b.

    Of four bands of 16 bits one differs in a bit at most, so one side is sent by its bands, the other by its bands and
    all that differ in one bit; the pair is taken in the first band that brings it together.  Both sides are shuffled: by the
    size of the table that they are read from, Spark would take one for small and build it on the driver."""
    bands = F.array(*[F.shiftrightunsigned("hash", BITS * i).bitwiseAND(F.lit((1 << BITS) - 1)) for i in range(BANDS)])
    rows = prints.withColumn("f", bands)
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(BITS)])
    left = rows.select(F.col("id").alias("a"), F.col("hash").alias("x"), F.posexplode("f").alias("band", "key"))
    right = rows.select(F.col("id").alias("b"), F.col("hash").alias("y"), F.posexplode("f").alias("band", "own")).withColumn("flip", F.explode(flips))
    right = right.select("b", "y", "band", F.col("own").bitwiseXOR(F.col("flip")).alias("key"))
    differ = F.col("x").bitwiseXOR(F.col("y"))
    distance = F.bit_count(differ).cast("long")
    first = F.lit(None).cast("int")
    for i in reversed(range(BANDS)):
        part = F.bit_count(F.shiftrightunsigned(differ, BITS * i).bitwiseAND(F.lit((1 << BITS) - 1)))
        first = F.when(part <= 1, i).otherwise(first)
    pairs = left.hint("merge").join(right, ["band", "key"]).where((F.col("a") < F.col("b")) & (distance <= APART) & (first == F.col("band")))
    return pairs.select("a", "b", distance.alias("distance"))

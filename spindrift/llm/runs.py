"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on what survives.

A run is a stretch of words that keeps its smallest period q (words q apart are the same), as long as it can be, with a
length of at least max(min_length, min_exponent * q).  Shifted by q it lies on itself but for q words, so each of its
words is in a k-gram that occurs again in the document, with k the least such overlap over all q: words outside repeated
k-grams cannot join runs.  The mask is taken from hashes of k-grams, which may let words through but never hold one back;
the search itself compares words.  What survives falls into segments, and a run lies within one.  Main-Lorentz halves a segment,
finds the runs across its middle from four arrays of common prefixes, and goes on with the halves: n log n steps for n
surviving words.

Each document is worked on alone, in one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded_batches, mix64, released, text_slices
from .rules import numbered_words

MIN_LENGTH = 6
MIN_EXPONENT = 4

Run = tuple[int, int, int]  # start, length, period


def least_overlap(min_length: int, min_exponent: int) -> int:
    """Words that a run of any period shares at least with itself shifted by the period."""
    return min(max(min_length, min_exponent * q) - q for q in range(1, min_length + 2))


def repeated_mask(ids: np.ndarray, k: int) -> np.ndarray:
    """Of each word, whether it is in a k-gram that occurs twice or more (surely True if so)."""
    inside, n = np.zeros(len(ids), bool), len(ids) - k + 1
    if n < 2:
        return inside
    word, key = mix64(ids.astype(np.uint64) + U64(0x9E3779B97F4A7C15)), np.zeros(n, np.uint64)
    for j in range(k):
        key = key * U64(0xD6E8FEB86659FD93) + word[j : j + n]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return inside
    again = np.isin(key, twice)
    for j in range(k):
        inside[j : j + n] |= again
    return inside


def _prefixes(s: list[int], count: int) -> list[int]:
    """Common prefix of s and s[i:], for i below ``count`` (the first is not used)."""
    z, left, right, n = [0] * count, 0, 0, len(s)
    for i in range(1, count):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def _matches(s: list[int], z: list[int], text: list[int], count: int) -> list[int]:
    """Common prefix of s and text[i:], for i below ``count``; ``z``: prefixes of s, as many."""
    out, left, right, n, m = [0] * count, 0, 0, len(s), len(text)
    for i in range(count):
        k = min(right - i, z[i - left]) if left < i < right else 0
        while k < n and i + k < m and s[k] == text[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        out[i] = k
    return out


def segment_runs(s: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[Run]:
    """All runs of a sequence, by start and period (min_exponent: 2 at least)."""
    found: dict[tuple[int, int], int] = {}
    todo = [(0, len(s))]
    while todo:
        lo, hi = todo.pop()
        most = (hi - lo) // min_exponent  # no run within lo..hi has a larger period
        if hi - lo < min_length or not most:
            continue
        mid = (lo + hi) // 2
        todo += [(lo, mid), (mid, hi)]
        back, front = s[lo:mid][::-1], s[mid:hi]
        near, far = min(most, len(back)), min(most, len(front))
        z_back, z_front = _prefixes(back, most + 1), _prefixes(front, most + 1)
        # period p, with p words at least right of the middle: s[mid..] against s[mid+p..], and what ends at both
        ending = _matches(back, z_back, s[lo : mid + far][::-1], far + 1)
        # with p words at least left of it: s[mid-p..] against s[mid..], and what ends at both
        starting = _matches(front, z_front, s[mid - near : hi], near + 1)
        spans = [(mid - ending[far - p], mid + p + z_front[p], p) for p in range(1, far + 1)]
        spans += [(mid - p - z_back[p], mid + starting[near - p], p) for p in range(1, near + 1)]
        for a, b, p in spans:
            if b - a < min_length or b - a < min_exponent * p:
                continue
            if a and s[a - 1] == s[a - 1 + p] or b < len(s) and s[b] == s[b - p]:
                continue  # goes on beyond this half: found whole where it does not
            found[a, b] = min(p, found.get((a, b), p))
    return sorted((a, b - a, p) for (a, b), p in found.items())


def word_runs(ids: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[Run]:
    """All runs of a document's words, by start and period."""
    mask = repeated_mask(ids, least_overlap(min_length, min_exponent))
    edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    out = []
    for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist()):
        if b - a >= min_length:
            out += [(a + start, length, p) for start, length, p in segment_runs(ids[a:b].tolist(), min_length, min_exponent)]
    return out


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Of each word, whether no run has it after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:n]) == 0


def collapse_runs(docs: DataFrame, *, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``docs`` with its columns but the text, ``n_words``, ``runs`` (by start, then period) and ``collapsed``: the words
    that no run has after its first period, joined by one space.

    Words are what spaces and \\x09 to \\x0d separate; they are the same if their bytes are.  A null or empty text has
    no words, no runs and an empty ``collapsed``.  Rows are worked on one by one, repeated rows and ids too; columns of
    these names are replaced.  ``rewrite(doc_id, words)`` may change the words of a row before."""
    added = ["n_words", "runs", "collapsed"]
    others = [c for c in docs.columns if c not in [*added, "text"]]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema]
    schema = ", ".join([*fields, "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"])
    run_type = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            found, counts, texts = [], [], []
            keys = piece.column("doc_id").to_pylist() if rewrite else [None] * piece.num_rows
            for key, raw in zip(keys, piece.column("text").cast(pa.binary()).to_pylist()):
                words = (raw or b"").split()
                if rewrite:
                    words = rewrite(key, words)
                runs = word_runs(numbered_words(words), min_length, min_exponent)
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                counts.append(len(words))
                kept = words if not runs else [w for w, k in zip(words, kept_words(len(words), runs).tolist()) if k]
                texts.append(b" ".join(kept))
            columns = [piece.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(found, run_type), pa.array(texts, pa.binary()).cast(pa.string())], names=[*others, *added])

    return bounded_batches(docs).select(*others, F.col("text").cast("string").alias("text")).mapInArrow(released(run), schema)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's periodic tails: of each tenth document by hash, the words from some place on are a few of them again
    and again.  Rows without an id stay as they are."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def op13_runs(spark, sf_dir: str) -> DataFrame:
    """Contract query: the runs of every document, with the contract's tails."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = collapse_runs(docs, rewrite=planted)
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    rows = rows.withColumn("best", best).withColumn("length", -F.col("best.less"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), "length", F.col("best.period").alias("period"),
        F.expr("1000 * length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )

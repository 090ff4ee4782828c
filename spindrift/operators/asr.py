"""Words that a speech recogniser made up: hallucinations and echoes of its prompt.

Words come as rows: ``key`` (the recording), ``at`` (place, long), ``s`` and ``e`` (milliseconds, long), ``p`` (confidence) and
``w``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sequential import over_groups

#: What counts as a word's characters, foreign scraps, and the limits of the rules.
NOT_PLAIN = "[^0-9A-Za-z가-힣]"
COLLAPSED_MS = 50  # a character
COLLAPSED_P, FOREIGN_P, SILENT_P = 0.15, 0.5, 0.6
SILENT_SHARE = 0.95
RUN, RUN_MS, NEAR_MS, COVER = 3, 100, 20_000, 0.8
REPEATS, KEEP = 4, 2
ECHO_RUN, ECHO_P = 6, 0.5
STRETCH_MS, HALO_MS = 600_000, 60_000
_FOREIGN = re.compile("[A-Za-z0-9]*[A-Za-z]{3,}[A-Za-z0-9]*")


def _letters(c: str) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), NOT_PLAIN, "")


def collapsed_runs(starts: np.ndarray, collapsed: np.ndarray) -> list[tuple[int, int]]:
    """Collapsed words in a row whose starts lie within ``RUN_MS`` of the first, ``RUN`` at least, picked from the left."""
    runs, i, n = [], 0, len(starts)
    odd = np.flatnonzero(collapsed)
    while True:
        at = np.searchsorted(odd, i)
        if at == len(odd):
            return runs
        i = j = int(odd[at])
        while j < n and collapsed[j] and starts[j] - starts[i] <= RUN_MS:
            j += 1
        if j - i >= RUN:
            runs.append((i, j))
            i = j
        else:
            i += 1


def is_shadow(own: list[str], near: str) -> bool:
    """Whether most letters of ``own`` words are, next to a neighbour's, in ``near``."""
    pairs = [own[k] + own[k + 1] in near for k in range(len(own) - 1)]
    heard = [pairs[k] if k < len(pairs) else False for k in range(len(own))]
    heard = [h or (k > 0 and pairs[k - 1]) for k, h in enumerate(heard)]
    return sum(len(w) for w, h in zip(own, heard) if h) >= COVER * sum(map(len, own))


def repeated(words: np.ndarray) -> np.ndarray:
    """Of each word, whether it is in a row of more than ``REPEATS`` equal ones and not among the first ``KEEP``."""
    cuts = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(cuts, len(words)))
    place = np.arange(len(words)) - np.repeat(cuts, sizes)
    return (np.repeat(sizes, sizes) > REPEATS) & (place >= KEEP) & (words != "")


def in_silence(s: np.ndarray, e: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each word [s, e], whether it is nearly all within the silences [a, b], or starts in one if it has no length."""
    inside, touched = np.zeros(len(s)), np.zeros(len(s), bool)
    for lo, hi in zip(a, b):
        inside += np.maximum(0, np.minimum(e, hi) - np.maximum(s, lo))
        touched |= (s >= lo) & (s <= hi)
    return np.where(e > s, inside >= SILENT_SHARE * (e - s), touched)


def stretch_rules(words: Mapping, silences: Mapping) -> np.ndarray:
    """The rule of each word (s, e, p, t, in order) of a stretch, null where none holds."""
    s, e, p, t = np.asarray(words["s"]), np.asarray(words["e"]), np.asarray(words["p"], float), np.asarray(words["t"], object)
    size = np.array([len(x) for x in t], np.int64)
    some, collapsed = size > 0, (size > 0) & (e - s < COLLAPSED_MS * size)
    sure = np.where(np.isnan(p), 1.0, p)
    rule = np.full(len(t), None, object)
    quiet = in_silence(s, e, np.asarray(silences["s"]), np.asarray(silences["e"])) & some & (sure < SILENT_P)
    rule[quiet & ~collapsed] = "soft"
    rule[repeated(t)] = "repeated"
    said = "".join(x for x, c in zip(t, collapsed) if not c)
    upto = np.concatenate([[0], np.cumsum(np.where(collapsed, 0, size))])
    for i, j in collapsed_runs(s, collapsed):
        lo, hi = np.searchsorted(s, s[i] - NEAR_MS, "left"), np.searchsorted(s, s[i] + NEAR_MS, "right")
        if is_shadow(list(t[i:j]), said[upto[lo] : upto[hi]]):
            rule[i:j] = "mirrored"
    unsure = np.array([bool(_FOREIGN.fullmatch(x)) for x in t], bool) & (sure < FOREIGN_P)
    rule[quiet & collapsed] = "silent"
    rule[unsure] = "foreign"
    rule[collapsed & (sure < COLLAPSED_P)] = "collapsed"
    return rule


def hallucinations(words: DataFrame, silences: DataFrame) -> DataFrame:
    """``words`` with ``rule``, why a word is made up (null: it is not), the first that holds of

    collapsed (no time for its letters, hardly sure), foreign (a foreign scrap, unsure), silent (in silence, unsure and
    collapsed), mirrored (collapsed words at one point whose letters are said nearby), repeated (the same word again and
    again) and soft (in silence and unsure only: to be looked at, no reason to drop it).

    Recordings are dealt in stretches of ``STRETCH_MS``, each with the words up to ``HALO_MS`` before and after, so a
    very long one is many tasks' work and words go through one shuffle.  What a rule looks at lies within that reach: a
    row of equal or of collapsed words that goes on for longer is seen anew by each stretch.  ``silences``: key, a, b.
    Words without a time are left out; a null confidence counts as sure, a null word as empty."""
    spread = lambda lo, hi: F.explode(F.sequence(F.floor((lo - HALO_MS) / STRETCH_MS), F.floor((hi + HALO_MS) / STRETCH_MS))).alias("part")
    s, e = F.col("s"), F.col("e")
    spoken = words.where("s is not null and e is not null").select("key", spread(s, s), "at", "s", "e", "p", "w", _letters("w").alias("t"))
    quiet = silences.where("a <= b").select("key", spread(F.col("a"), F.col("b")), F.lit(None).cast("long").alias("at"), F.col("a").cast("long").alias("s"), F.col("b").cast("long").alias("e"), F.lit(None).cast("double").alias("p"), F.lit(None).cast("string").alias("w"), F.lit(None).cast("string").alias("t"))

    def run(rows: dict) -> tuple:
        word = np.array([t is not None for t in rows["t"]])
        own, mine = np.flatnonzero(word), (rows["s"] // STRETCH_MS == rows["part"]) & word
        if not mine.any():
            return own[:0], {}
        rule = stretch_rules({c: x[own] for c, x in rows.items()}, {c: rows[c][~word] for c in "se"})
        stay = mine[own]
        return own[stay], {"rule": rule[stay]}

    kind = words.schema["key"].dataType.simpleString()
    return over_groups(spoken.unionByName(quiet), ["key", "part"], ["s", "at", "e"], f"key {kind}, at long, s long, e long, p double, w string, rule string", run)


def echoes(words: DataFrame, hint: DataFrame) -> DataFrame:
    """Segments (``key, seg``) that repeat the recogniser's hint: at least ``ECHO_RUN`` tokens in the hint's order, unsure on
    average, two thirds of the segment's or more.  One row each: ``n``, the longest such run, and ``tokens``.

    ``words``: key, seg, at (from 0 in the segment), p, w.  ``hint``: h (place from 0), term, a dictionary's tokens: a token's
    place in the segment less its place in the hint is the same along a run, so runs are islands of each difference.
    Null confidences count as sure."""
    rows = words.withColumn("tok", F.regexp_replace(F.coalesce("w", F.lit("")), "[,.?!…~]+$", "")).withColumn("p", F.coalesce("p", F.lit(1.0)))
    size = rows.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("tokens"))
    hits = rows.join(hint.withColumnRenamed("term", "tok"), "tok").withColumn("d", F.col("at") - F.col("h"))
    line = Window.partitionBy("key", "seg", "d")
    island = F.col("at") - F.row_number().over(line.orderBy("at"))
    # every suffix of an island is a run that cannot go on: its length and its mean confidence
    rest = Window.partitionBy("key", "seg", "d", "island").orderBy("at").rowsBetween(0, Window.unboundedFollowing)
    runs = hits.withColumn("island", island).withColumn("n", F.count(F.lit(1)).over(rest)).withColumn("sure", F.sum("p").over(rest))
    rows = runs.where(F.col("n") >= ECHO_RUN).join(size, ["key", "seg"]).where((3 * F.col("n") >= 2 * F.col("tokens")) & (F.col("sure") / F.col("n") < ECHO_P))
    return rows.groupBy("key", "seg").agg(F.max("n").alias("n"), F.first("tokens").alias("tokens"))

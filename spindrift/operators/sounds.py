"""Word times moved to where sound is: an order-keeping choice of starts, then ends that fit.

Words come as rows: ``key`` (the recording), ``at`` (place, long), ``s`` and ``e`` (milliseconds, long) and ``w``; blobs of sound as
``key, a, b``.  Recordings are dealt in stretches with the words and blobs around them, so a long one is many tasks' work.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequential import over_groups

#: How far ahead a start may be moved, least distance of starts, cost of starting in silence, milliseconds
#: of a letter below which a word has no time, bounds of a moved word's length.
AHEAD, APART, SILENT, LETTER, LEAST, MOST = 800, 50, 1000, 60, 120, 300
STRETCH, HALO = 600_000, 60_000


def choices(s: int, e: int, blobs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Starts that a word may take, with their costs: its own (dear in silence), and those of blobs that begin soon after
    it or within it."""
    inside = any(a <= s < b for a, b in blobs)
    own = [(s, 0 if inside or not blobs else SILENT)]
    return own + [(a, a - s) for a, _ in blobs if s < a and (a <= s + AHEAD or a < e - 100)]


def best_starts(options: Sequence[Sequence[tuple[int, int]]]) -> list[int]:
    """One start of each word's options, each at least ``APART`` after the one before, at the least total cost; a word that
    cannot be is put right after the one before, at the cost of silence.  Ties go to earlier starts."""
    paths = FIRST
    for own in options:
        paths = _step(paths, own)
    return _chain(paths)


#: Last start -> (cost, chain of starts); before the first word.
FIRST: dict[int, tuple[int, tuple]] = {-APART * 10**9: (0, ())}


def _step(paths: dict[int, tuple[int, tuple]], own: Sequence[tuple[int, int]]) -> dict[int, tuple[int, tuple]]:
    """``paths`` with one word more."""
    now: dict[int, tuple[int, tuple]] = {}
    for last, (cost, chain) in paths.items():
        free = [(s, c) for s, c in own if s >= last + APART] or [(last + APART, SILENT)]
        for s, c in free:
            if s not in now or (cost + c, s) < (now[s][0], s):
                now[s] = (cost + c, (chain, s))
    # a later last start that is no cheaper can lead to nothing better
    kept, least = {}, None
    for s in sorted(now):
        if least is None or now[s][0] < least:
            kept[s], least = now[s], now[s][0]
    return kept


def _chain(paths: dict[int, tuple[int, tuple]]) -> list[int]:
    chain = min(paths.items(), key=lambda x: (x[1][0], x[0]))[1][1]
    out = []
    while chain:
        chain, s = chain
        out.append(s)
    return out[::-1]


def aligned(words: Sequence[tuple[int, int, str]], blobs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of each word (s, e, w), in order, for the blobs (a, b) in order.

    A start in silence goes to the next blob, if one begins soon or within the word; starts keep their order.  A moved
    word is at least ``LEAST`` long, as long as it was up to ``MOST``.  A word with no time for its letters takes the blob it
    is in, up to its neighbours.  No word ends after the next one begins."""
    if not len(words):
        return []
    s, e = (np.array([w[k] for w in words], np.int64) for k in (0, 1))
    size = np.array([max(1, len(w[2])) for w in words], np.int64)
    a, b = (np.array([x[k] for x in blobs], np.int64) for k in (0, 1))
    ahead = np.searchsorted(a, s, side="right")  # the first blob that begins after a word does
    upto = np.append(np.iinfo(np.int64).min, b)[ahead]  # end of the one before
    inside = s < upto
    starts = _starts(words, blobs, s, e, inside, np.append(a, np.iinfo(np.int64).max)[ahead])
    moved = np.maximum(e, starts + np.clip(e - s, LEAST, MOST))
    end = np.where(starts != s, moved, np.where((e - s < LETTER * size) & inside, np.maximum(e, upto), e))
    bound = np.append(starts[1:], np.iinfo(np.int64).max)
    end = np.maximum(np.minimum(end, bound), np.minimum(starts + APART, bound))
    return list(zip(starts.tolist(), end.tolist()))


def _starts(words, blobs, s: np.ndarray, e: np.ndarray, inside: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """:func:`best_starts` of words.  A word that begins ``APART`` after all that those before it may take is free of them: in
    sound it stays, in silence it goes to the next blob if that costs less.  Only words that are not free, and the one before
    such words, are gone through."""
    near = (ahead <= s + AHEAD) | (ahead < e - 100)
    starts = np.where(~inside & near & (ahead < s + SILENT), ahead, s)
    tight = np.flatnonzero(starts[:-1] > s[1:] - APART)
    done = 0
    for first in tight.tolist():
        if first < done:
            continue
        paths, done = _step(FIRST, _own(words[first], blobs)), first + 1
        while done < len(words) and max(paths) > s[done] - APART:
            paths = _step(paths, _own(words[done], blobs))
            done += 1
        starts[first:done] = _chain(paths)
    return starts


def _own(word: tuple[int, int, str], blobs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """:func:`choices` of a word among the blobs about it."""
    s, e, _ = word
    near = blobs[bisect_right(blobs, s, key=lambda x: x[1]) : bisect_right(blobs, max(s + AHEAD, e), key=lambda x: x[0])]
    # whether there is sound at all decides if silence is dear
    return choices(s, e, near) if near else [(s, SILENT if blobs else 0)]


def _options(words: Sequence[tuple[int, int, str]], blobs: Sequence[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    return [_own(word, blobs) for word in words]


def align_to_sound(words: DataFrame, blobs: DataFrame) -> DataFrame:
    """key, at, s, e, w with the times of :func:`aligned`, and ``moved``.

    Each stretch is worked on with the words and blobs ``HALO`` before and after it; words crammed together for longer than
    that are seen anew by each stretch.  Words without a time are left out; a recording without blobs stays as it is, but
    for words that begin at once or overlap."""
    spread = lambda lo, hi: F.explode(F.sequence(F.floor((lo - HALO) / STRETCH), F.floor((hi + HALO) / STRETCH))).alias("part")
    s, e, a, b = (F.col(c).cast("long") for c in "seab")
    spoken = words.where("s is not null and e is not null").select("key", spread(s, s), "at", s.alias("s"), e.alias("e"), F.coalesce("w", F.lit("")).alias("w"))
    sound = blobs.where("a < b").select("key", spread(a, b), F.lit(None).cast("long").alias("at"), a.alias("s"), b.alias("e"), F.lit(None).cast("string").alias("w"))

    def run(rows: dict) -> tuple:
        word = np.array([w is not None for w in rows["w"]])
        own, mine = np.flatnonzero(word), (rows["s"] // STRETCH == rows["part"]) & word
        if not mine.any():
            return own[:0], {}
        spans: list[tuple[int, int]] = []
        for lo, hi in zip(rows["s"][~word].tolist(), rows["e"][~word].tolist()):  # blobs that touch are one
            if spans and lo <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
            else:
                spans.append((lo, hi))
        s, e = rows["s"][own], rows["e"][own]
        times = np.array(aligned(list(zip(s.tolist(), e.tolist(), rows["w"][own].tolist())), spans), np.int64)
        stay = mine[own]
        moved = (times[:, 0] != s) | (times[:, 1] != e)
        return own[stay], {"s": times[stay, 0], "e": times[stay, 1], "moved": moved[stay]}

    kind = words.schema["key"].dataType.simpleString()
    return over_groups(spoken.unionByName(sound), ["key", "part"], ["s", "at", "e"], f"key {kind}, at long, s long, e long, w string, moved boolean", run)

"""Corrected texts that keep their words' times: edit scripts per segment, and a dictionary of corrections.

A segment's words are an array of structs (w, s, e, p); segments are rows, worked on side by side in Spark tasks, and a
helper sees one segment at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequential import common
from .transcript import PARTICLES

WORDS = "array<struct<w: string, s: double, e: double, p: double>>"
#: Least likeness of a correction's letters, most growth in letters.
LEAST_ALIKE, MOST_GROWTH, FREE_LETTERS = 0.6, 0.35, 4
_LETTERS = re.compile("[^0-9A-Za-z가-힣]")


def letters(text: str | None) -> str:
    return _LETTERS.sub("", text or "")


def kept_pairs(old: Sequence[str], new: Sequence[str]) -> list[tuple[int, int]]:
    """Places (old, new) of the words that a shortest edit script keeps.  The search widens diagonal by diagonal with the
    number of edits, so it looks at a band no wider than the two differ."""
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    a, b = old[head:], new[head:]
    reach, trail = {1: 0}, []
    for edits in range(len(a) + len(b) + 1):
        trail.append({k: reach[k] for k in range(-edits - 1, edits + 2) if k in reach})
        for k in range(-edits, edits + 1, 2):
            down = k == -edits or (k != edits and reach[k - 1] < reach[k + 1])
            x = reach[k + 1] if down else reach[k - 1] + 1
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= len(a) and x - k >= len(b):
                return [(i, i) for i in range(head)] + [(i + head, j + head) for i, j in _walk_back(trail, len(a), len(b))]
    raise AssertionError("no script")


def _walk_back(trail: list[dict[int, int]], x: int, y: int) -> list[tuple[int, int]]:
    kept = []
    for edits in range(len(trail) - 1, -1, -1):
        reach, k = trail[edits], x - y
        down = k == -edits or (k != edits and reach[k - 1] < reach[k + 1])
        px = reach[k + 1] if down else reach[k - 1]
        py = px - (k + 1 if down else k - 1)
        while x > max(px, 0) and y > max(py, 0):
            x, y = x - 1, y - 1
            kept.append((x, y))
        x, y = px, py
    return kept[::-1]


def realigned(words: Sequence[dict], text: str) -> list[dict]:
    """The words of ``text`` with times of ``words``: kept words keep theirs; a stretch of others shares what the words in
    its place had, by letters (and one for the gap) each, with their least confidence.  Inserted words share with the
    kept word before them, or the one after them where there is none."""
    fresh = text.split()
    if not words or not fresh:
        return []
    old, new = [letters(w["w"]) for w in words], [letters(t) for t in fresh]
    kept = kept_pairs(old, new)
    # stretches [i0, i1) x [j0, j1), kept ones of one word each
    spans, i, j = [], 0, 0
    for x, y in [*kept, (len(old), len(new))]:
        if x > i or y > j:
            spans.append([False, i, x, j, y])
        if x < len(old) and (x, y) != (len(old), len(new)):
            spans.append([True, x, x + 1, y, y + 1])
        i, j = x + 1, y + 1
    n = 0
    while n < len(spans):
        same, i0, i1, j0, j1 = spans[n]
        if not same and i0 == i1:  # nothing was there: join the stretch before, else the one after
            at = n - 1 if n else n
            a, b = spans[at], spans[at + 1]
            spans[at : at + 2] = [[False, a[1], b[2], a[3], b[4]]]
            n = max(at, 0)
            continue
        n += 1
    out = []
    for same, i0, i1, j0, j1 in spans:
        if same:
            out.append(dict(words[i0], w=fresh[j0]))
            continue
        start, stop = words[i0]["s"], words[i1 - 1]["e"]
        sure = min((w["p"] for w in words[i0:i1] if w["p"] is not None), default=None)
        out += _shared(fresh[j0:j1], [len(t) + 1 for t in new[j0:j1]], start, stop, sure)
    return out


def _shared(texts: Sequence[str], weights: Sequence[int], start: float, stop: float, sure: float | None) -> list[dict]:
    whole, at, out = sum(weights), start, []
    for t, weight in zip(texts, weights):
        to = at + (stop - start) * weight / whole
        out.append({"w": t, "s": round(at, 2), "e": round(to, 2), "p": sure})
        at = to
    return out


def acceptable(old: str | None, new: str | None) -> bool:
    """Whether a correction may be taken: it changes something, enough of its letters are in a longest common subsequence
    with the old one's (which is as much as matching blocks find, or more), and there are not many more or fewer."""
    a, b = letters(old), letters(new)
    if not a or not b or (a == b and (old or "").strip() == (new or "").strip()):
        return False
    return abs(len(b) - len(a)) <= MOST_GROWTH * len(a) + FREE_LETTERS and 2 * common(a, b) >= LEAST_ALIKE * (len(a) + len(b))


_ARROW = pa.list_(pa.struct([("w", pa.string()), ("s", pa.float64()), ("e", pa.float64()), ("p", pa.float64())]))
_SLICE = 256


def _rewritten(rows: DataFrame, uses: Sequence[str], drops: Sequence[str], f: Callable[..., tuple], added: str, added_type: pa.DataType) -> DataFrame:
    """``rows`` with ``text``, ``words`` and the column ``added`` as f(text, words, uses...) gives them, a few rows at a time."""
    others = [c for c in rows.columns if c not in ("text", "words", added, *drops)]
    fields = [f"`{x.name}` {x.dataType.simpleString()}" for x in rows.select(*others).schema]
    kind = {pa.bool_(): "boolean", pa.int64(): "long"}[added_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top in range(0, batch.num_rows, _SLICE):
                piece = batch.slice(top, _SLICE)
                cells = zip(*[piece.column(c).to_pylist() for c in ("text", "words", *uses)])
                texts, words, marks = zip(*[f(t, None if w is None else [x for x in w if x is not None], *rest) for t, w, *rest in cells])
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in others], pa.array(texts, pa.string()), pa.array(words, _ARROW), pa.array(marks, added_type)], names=[*others, "text", "words", added])

    words = F.col("words").cast(WORDS).alias("words")
    return rows.select(*others, "text", words, *[u for u in uses if u not in others]).mapInArrow(run, ", ".join([*fields, f"text string, words {WORDS}, {added} {kind}"]))


def corrected(text: str | None, words: list[dict] | None, fixed: str | None) -> tuple[str | None, list[dict] | None, bool]:
    """A segment with its correction, if that may be taken: text, words, whether it was."""
    if fixed is None or not acceptable(text, fixed):
        return text, words, False
    fresh = realigned(words, fixed) if words else []
    return (" ".join(w["w"] for w in fresh), fresh, True) if fresh else (fixed, words, True)


def apply_corrections(segments: DataFrame, corrections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``segments`` (keys, text, words) with the texts of ``corrections`` (keys, fixed; one row a key) that may be taken:
    ``text`` and ``words`` are the corrected ones, ``corrected`` says so.  Segments without words get the text alone."""
    rows = segments.join(corrections.select(*keys, F.col("fixed").cast("string").alias("_fixed")), list(keys), "left")
    return _rewritten(rows, ["_fixed"], ["_fixed"], corrected, "corrected", pa.bool_())


class Dictionary:
    """Corrections {wrong: right} at word bounds only, with particles after them in the form that the right word asks for."""

    def __init__(self, fixes: dict[str, str]):
        self.fixes = {" ".join(k.split()): " ".join(v.split()) for k, v in fixes.items() if k.split() and v.split() and k.split() != v.split()}
        self.long = sorted((k for k in self.fixes if " " in k), key=lambda k: (-len(k.split()), k))
        self.pattern = self._compiled(self.fixes)
        self.single = {k: self._compiled([k]) for k in self.long}

    @staticmethod
    def _compiled(keys) -> re.Pattern | None:
        either = "|".join(r"\s+".join(map(re.escape, k.split())) for k in sorted(keys, key=lambda k: (-len(k), k)))
        return re.compile(rf"(?<!\w)(?P<k>{either})(?P<j>(?:{'|'.join(_ENDINGS)}){{0,2}})(?!\w)") if either else None

    def text(self, text: str | None, pattern: re.Pattern | None = None) -> str | None:
        pattern = pattern or self.pattern
        if not pattern or not text:
            return text

        def right(m: re.Match) -> str:
            key = " ".join(m["k"].split())
            if m["j"] and len(letters(key)) < 2:  # a word of one letter only by itself
                return m.group(0)
            return self.fixes[key] + fitted(self.fixes[key], m["j"])

        return pattern.sub(right, text)

    def words(self, words: Sequence[dict]) -> list[dict]:
        """Words corrected: a wrong phrase of several becomes one from its first start to its last end (word by word, if
        the right one has as many), a word that gains spaces is shared out by letters."""
        rows = [dict(w, w=self.text(w["w"] or "")) for w in words]
        for key in self.long:
            size, at = len(key.split()), 0
            while at + size <= len(rows):
                part = rows[at : at + size]
                seen = " ".join(w["w"] for w in part)
                now = self.text(seen, self.single[key])
                if now == seen:
                    at += 1
                elif len(now.split()) == size:
                    rows[at : at + size] = [dict(w, w=t) for w, t in zip(part, now.split())]
                    at += size
                else:
                    sure = min((w["p"] for w in part if w["p"] is not None), default=None)
                    rows[at : at + size] = [{"w": now, "s": part[0]["s"], "e": part[-1]["e"], "p": sure}]
                    at += 1
        out = []
        for w in rows:
            parts = w["w"].split()
            some = [w] if len(parts) < 2 else _shared(parts, [max(1, len(t)) for t in parts], w["s"], w["e"], w["p"])
            some[-1]["e"] = w["e"]
            out += some
        return out


#: Endings that may follow a word of the dictionary.
_ENDINGS = ["에서", "에게", "까지", "부터", "처럼", "보다", "이랑", "랑", "으로", "로", "은", "는", "이", "가", "을", "를", "과", "와", "도", "만", "에", "의"]


def fitted(word: str, ending: str) -> str:
    """The ending in the form that the word's last syllable asks for; as it is after other than Korean letters."""
    last = ord(word[-1]) - 0xAC00 if word else -1
    if not ending or not 0 <= last < 11172:
        return ending
    for closed, open_ in sorted({**PARTICLES, "이랑": "랑"}.items(), key=lambda x: -len(x[0])):
        for given in (closed, open_):
            if ending.startswith(given):
                bare = last % 28 == 0 or (closed == "으로" and last % 28 == 8)
                return (open_ if bare else closed) + ending[len(given) :]
    return ending


def correct_words(segments: DataFrame, dictionary: DataFrame, most: int = 200) -> DataFrame:
    """``segments`` (text, words) corrected by ``dictionary`` (wrong, right); ``fixes`` counts the words that changed.

    A dictionary is a list that people keep: ``most`` entries are read, by ``wrong``, and more are an error."""
    entries = dictionary.where("wrong is not null and right is not null").groupBy("wrong").agg(F.min("right").alias("right")).orderBy("wrong").limit(most + 1).collect()
    if len(entries) > most:
        raise ValueError(f"a dictionary of more than {most} entries")
    book = Dictionary({r.wrong: r.right for r in entries})

    def fixed(text: str | None, words: list[dict] | None) -> tuple[str | None, list[dict] | None, int]:
        if words is None:
            return book.text(text), None, 0
        fresh, known = book.words(words), {(w["w"], w["s"]) for w in words}
        return book.text(text), fresh, sum((w["w"], w["s"]) not in known for w in fresh)

    return _rewritten(segments, [], [], fixed, "fixes", pa.int64())

import hashlib

import numpy as np
import pytest

from spindrift.llm import suffix_dedup as sd
from spindrift.llm.suffix_array import suffix_arrays


def test_suffix_arrays_of_many_texts():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lanes = []
        for _ in range(int(rng.integers(1, 6))):
            x = rng.integers(1, rng.integers(2, 6), int(rng.integers(0, 40))).tolist()
            lanes.append((x[:3] * 20 if rng.random() < 0.3 else x) + [0])
        flat = np.array(sum(lanes, []))
        got, at = suffix_arrays(flat, [len(x) for x in lanes]), 0
        for x in lanes:
            assert (got[at : at + len(x)] - at).tolist() == sorted(range(len(x)), key=lambda i: x[i:])
            at += len(x)


def _texts():
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdé"), int(rng.integers(1, 7))))
    passage = [" ".join(word() for _ in range(int(n))) for n in (30, 60, 45, 25)]
    texts = ["", None, "short", passage[0] * 2, "x" * 700, "x" * 350, "ab" * 300]
    for i in range(60):
        own = [word() for _ in range(int(rng.integers(0, 60)))]
        cut = passage[i % 4][int(rng.integers(0, 40)) :][: int(rng.integers(90, 300))]
        texts.append(" ".join(own) + cut + " ".join(word() for _ in range(int(rng.integers(0, 40)))))
    return texts + texts[-8:] + [texts[-1][:150], texts[-2] + "tail"]


def _held_to_brute_force(spark, texts, ids=None):
    ids = ids or [3 * i for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], "doc_id long, text string, spans int").repartition(5)
    got = {r.doc_id: r for r in sd.remove_repeats(docs).collect()}
    want = sd.brute_force({i: (t or "").encode() for i, t in zip(ids, texts)})
    assert {d: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for d, r in got.items()} == want
    return sum(r.n_removed for r in got.values())


def _with(monkeypatch, name, made=None, **constants):
    """Python workers import the module anew: set its constants there, too, while the function ``name`` runs."""
    plain = made or getattr(sd, name)

    def setting(batches):
        before = {k: getattr(sd, k) for k in constants}
        for k, v in constants.items():
            setattr(sd, k, v)
        try:
            yield from plain(batches)
        finally:
            for k, v in before.items():
                setattr(sd, k, v)

    if made:
        return setting
    monkeypatch.setattr(sd, name, setting)


@pytest.mark.parametrize("hot", [2048, 3])
def test_removal_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    _with(monkeypatch, "_match", HOT=hot)
    assert _held_to_brute_force(spark, _texts()) > 5000


def test_one_line_in_many_texts(spark, monkeypatch):
    """An anchor with more segments than go together, whose windows differ or recur in other groups only."""
    monkeypatch.setattr(sd, "HOT", 4)
    _with(monkeypatch, "_match", HOT=4)
    line = "the same line stands in every text, and it is long enough to hold an anchor, whatever stands beside it; "
    texts = [f"{i % 7} {'abc' * (i % 7)} own words of text {i % 23} " + line + f"and more {i % 11}, " * 4 for i in range(90)]
    assert _held_to_brute_force(spark, texts) > 10_000


def test_every_removal_comes_from_suffix_arrays(spark, monkeypatch):
    """Without the construction nothing is removed: hashes only tell which segments meet."""
    for name in ("_find_segments", "_settle"):
        make = getattr(sd, name)
        monkeypatch.setattr(sd, name, lambda buckets, make=make, name=name: _with(monkeypatch, name, make(buckets), suffix_arrays=lambda text, lengths: np.zeros(0, np.int64)))
    docs = spark.createDataFrame(list(enumerate(_texts())), "doc_id long, text string")
    assert sum(r.n_removed for r in sd.remove_repeats(docs).collect()) == 0


@pytest.mark.parametrize("lane", [2, 8])
def test_windows_of_segments(monkeypatch, lane):
    """Segments of one key against a plain comparison of all windows, in large and small groups."""
    monkeypatch.setattr(sd, "LANE", lane)
    rng = np.random.default_rng(3)
    anchor = bytes(rng.integers(97, 123, sd.GRAM, dtype=np.uint8))
    sides = [bytes(rng.integers(97, 99, 50, dtype=np.uint8)) for _ in range(6)]
    for _ in range(15):
        n = int(rng.integers(2, 60))
        left, right = rng.integers(0, 51, n), rng.integers(0, 51, n)
        raw, at, place = [], [], 0
        for a, b in zip(left.tolist(), right.tolist()):
            raw.append(sides[rng.integers(6)][50 - a :] + anchor + sides[rng.integers(6)][:b])
            at.append(place + a)
            place += len(raw[-1])
        key, rank = rng.integers(0, 2, n), rng.permutation(n)
        got = sd.repeated_windows(np.frombuffer(b"".join(raw), np.uint8), np.array(at), left, right, key, rank)
        least = {}
        windows = {(i, o): (key[i], raw[i][left[i] - o :][:100], o) for i in range(n) for o in range(50 - right[i], left[i] + 1)}
        for (i, o), w in windows.items():
            least[w] = min(least.get(w, n), rank[i])
        want = np.zeros((n, 51), bool)
        for (i, o), w in windows.items():
            want[i, o] = rank[i] > least[w]
        assert (got == want).all()


@pytest.mark.parametrize("lane", [2, 8])
def test_starts_of_stretches(monkeypatch, lane):
    """Stretches of one key, some of them periodic, against a plain comparison of all windows."""
    monkeypatch.setattr(sd, "LANE", lane)
    rng = np.random.default_rng(6)
    base = [bytes(rng.integers(97, 123, 400, dtype=np.uint8)) for _ in range(3)] + [b"xy" * 200]
    for _ in range(20):
        n = int(rng.integers(1, 40))
        count = rng.integers(1, 150, n)
        raw = [base[rng.integers(4)][(a := int(rng.integers(0, 100))) : a + c + 99] if rng.random() < 0.5 else base[rng.integers(4)][: c + 99] for c in count.tolist()]
        begin = np.cumsum([0] + [len(x) for x in raw])[:-1]
        key, rank = rng.integers(0, 2, n), rng.permutation(n)
        got = sd.repeated_starts(np.frombuffer(b"".join(raw), np.uint8), begin, count, key, rank)
        windows = {(rank[i], o): (key[i], raw[i][o : o + 100]) for i in range(n) for o in range(count[i])}
        least = {}
        for place in sorted(windows):
            least.setdefault(windows[place], place)
        want = np.zeros(len(got), bool)
        for i in range(n):
            for o in range(count[i]):
                want[begin[i] + o] = least[windows[rank[i], o]] < (rank[i], o)
        assert (got == want).all()


def test_equal_hashes_of_other_anchors_are_told_apart():
    raw = b"a" * 100 + b"b" * 100 + b"a" * 100
    got = sd.repeated_windows(np.frombuffer(raw, np.uint8), np.array([0, 100, 200]), np.zeros(3, int), np.full(3, 50), np.full(3, 7), np.arange(3))
    assert np.flatnonzero(got.any(axis=1)).tolist() == [2]


def test_odd_rows(spark):
    """Rows are documents of their own: a shared id does not pass removals on, rows without an id come last."""
    rng = np.random.default_rng(4)
    p, tail, other = ("".join(chr(c) for c in rng.integers(97, 123, n)) for n in (400, 200, 600))
    rows = [(None, p, "n", "s1"), (None, p, "n", "s2"), (None, None, None, None), (1, p, "a", None), (2, p + tail, "b", "x"), (2, other, "c", "y"), (3, "z" * 50, None, None), (3, "z" * 50, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sd.remove_repeats(docs, carry=("lang", "source")).collect()
    assert sorted((str(r.doc_id), str(r.lang), str(r.source), r.n_bytes, r.n_removed) for r in got) == sorted(
        [("None", "n", "s1", 400, 400), ("None", "n", "s2", 400, 400), ("None", "None", "None", 0, 0), ("1", "a", "None", 400, 0), ("2", "b", "x", 600, 400), ("2", "c", "y", 600, 0), ("3", "None", "None", 50, 0), ("3", "None", "None", 50, 0)]
    )
    assert sd.remove_repeats(docs.limit(0)).count() == 0


def test_on_table(spark):
    rows = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.op1_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == sd.brute_force(rows)

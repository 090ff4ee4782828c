import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.operators import forecast, sequential
from spindrift.operators.relational import asof
from spindrift.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows


def test_peaks_keep_apart():
    got = sequential.pick_peaks([0, 1, 2, 10, 11], [5, 9, 8, 7, 7], 1.5, 6, 10)
    assert got == [1, 4]  # of equal levels the latest


def test_diverse_top_and_slots():
    assert sequential.diverse_top([5, 4, 3, 2], ["a", "a", "a", "b"], 3, 2) == [0, 1, 3]
    assert sequential.match_slots([10, 20], [21, 9]) == [(0, 1), (1, 0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 20), st.floats(0, 20), st.floats(1, 5), st.floats(1, 5)), max_size=12))
def test_suppression_leaves_no_overlap(boxes):
    kept = sequential.suppress(boxes, list(range(len(boxes))), 0.3)
    assert all(sequential.iou(boxes[a], boxes[b]) <= 0.3 for a in kept for b in kept if a != b)
    assert all(i in kept or any(sequential.iou(boxes[i], boxes[k]) > 0.3 for k in kept) for i in range(len(boxes)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=9), max_size=14))
def test_lines_hold_all_words_within_width(words):
    cuts = [*sequential.split_lines(words, 10), len(words)]
    lines = [words[a:b] for a, b in zip(cuts, cuts[1:])]
    assert sum(lines, []) == words and all(len(" ".join(x)) <= 10 for x in lines)


def test_first_fit_tries_later_items():
    assert sequential.first_fit(["aaaa", "bbbbbbbb", "cc", "AAAA"], 8) == ["aaaa", "cc"]


def test_theil_sen_finds_the_line():
    x = np.arange(30.0)
    y = 3 + 0.5 * x
    y[4] += 90
    assert np.allclose(sequential.theil_sen(x, y), (3, 0.5))


def test_paths_grow_with_the_rate_and_repeat():
    draws = np.random.default_rng(1).normal(size=(52, 40))
    run = lambda rate: forecast.paths(1.0, 0.6, 0.3, 0.5, subs=100, rate=rate, conv=0.01, keep=0.5, draws=draws, shift=0.1)
    assert (run(2)[-1] >= run(1)[-1]).all() and (np.diff(run(1), axis=0) >= 0).all() and (run(1) == run(1)).all()


def test_bootstrap_recovers_the_slope_and_its_spread(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=2000) + 5
    y = 1 + 0.7 * x + rng.normal(size=2000) * 0.5
    rows = [("v", float(p), float(q)) for p, q in zip(x, y)] + [("one", 1.0, 2.0), ("v", None, 1.0)]
    got = forecast.bootstrap(spark.createDataFrame(rows, "fmt string, x double, y double"), 60).collect()
    fits = {r["sample"]: r for r in got if r.fmt == "v"}
    assert set(fits) == set(range(60)) and abs(fits[0].b - np.polyfit(x, y, 1)[0]) < 1e-9 and abs(fits[0].a - np.polyfit(x, y, 1)[1]) < 1e-8 and abs(fits[0].tau - 0.5) < 0.05
    slopes = np.array([fits[i].b for i in range(1, 60)])
    expected = 0.5 / np.sqrt(((x - x.mean()) ** 2).sum())
    assert abs(slopes.mean() - fits[0].b) < 3 * expected and 0.6 * expected < slopes.std() < 1.6 * expected and len(set(slopes.tolist())) == 59
    assert all((r.a, r.b, r.tau) == (2.0, 0.0, 0.2) for r in got if r.fmt == "one")


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 50)), max_size=25), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 50), st.integers(0, 9)), max_size=25))
def test_asof_equals_brute_force(spark, left, right):
    a = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(left)] + [(-1, None, 3), (-2, 1, None)], "id long, k long, t long")
    b = spark.createDataFrame([*right, (None, 1, 1), (1, None, 1)], "k long, t long, v long")
    for forward in (False, True):
        got = {r.id: r.v for r in asof(a, b, key="k", time="t", value="v", bucket=7, forward=forward).collect()}
        for i, (k, t) in enumerate(left):
            near = [(x, v) for o, x, v in right if o == k and (x >= t if forward else x <= t)]
            best = max(near, key=lambda p: (-p[0] if forward else p[0], p[1]))[1] if near else None
            assert got[i] == best
        assert got[-1] is None and got[-2] is None

"""Plans that a key with a third of all rows does not stop."""

import random

import numpy as np

from spindrift.operators import forecast
from spindrift.operators.relational import with_previous
from spindrift.operators.stats import exact_quantiles
from spindrift.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_newest_titles_are_limited_before_they_meet(spark):
    for name in ("p4_formula_hits", "a9_formula_lift", "a10_topic_lift", "a11_series"):
        assert "WindowGroupLimit" in plan(QUERIES[name](spark, SF)), name


def test_no_window_takes_a_whole_channel(spark):
    """Windows over rows go by channel and time bucket; those by channel alone see one row a bucket."""
    for name in ("a6_cadence", "w2_resumed", "o1_by_views", "e1_token_sets"):
        windows = [line for line in plan(QUERIES[name](spark, SF)).split("\n") if "Window [" in line]
        assert windows
        for line in windows:
            assert "_b#" in line, name


def test_previous_times_over_buckets(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(300)) for k in [1] * 200 + [2] * 20 + [None] * 9]
    got = sorted((str(r.k), r.t, -1 if r.previous is None else r.previous) for r in with_previous(spark.createDataFrame(rows, "k long, t long"), ["k"], "t", 10).collect())
    want = []
    for k in (1, 2, None):
        own = sorted(t for key, t in rows if key == k)
        want += [(str(k), t, own[i - 1] if i else -1) for i, t in enumerate(own)]
    assert got == sorted(want)


def test_quantiles_equal_numpy(spark):
    rng = random.Random(7)
    rows = [("a", rng.gauss(0, 1) ** 3) for _ in range(3000)] + [("b", float(rng.randrange(3))) for _ in range(500)] + [("c", 5.0)] * 4 + [("d", 1.0), ("e", None), ("f", float("nan")), (None, 2.0), (None, 4.0)]
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.k, r.share): r.quantile for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", shares, bins=64).collect()}
    want = {}
    for k in ("a", "b", "c", "d", None):
        own = [v for key, v in rows if key == k]
        want |= {(k, p): float(q) for p, q in zip(shares, np.quantile(own, shares))}
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_draws_of_the_bootstrap_meet_their_peers_in_parts(spark, monkeypatch):
    """No step keeps a count for each peer and sample, and a task's share of the draws does not grow with the peers."""
    monkeypatch.setattr(forecast, "DRAWS", 1000)
    rows = [(fmt, float(i % 9), float(i % 7)) for fmt in ("a", None) for i in range(100)]
    fits = forecast.bootstrap(spark.createDataFrame(rows, "fmt string, x double, y double"), samples=11)
    assert {(r.fmt, r.sample) for r in fits.collect()} == {(f, s) for f in ("a", None) for s in range(11)}
    assert "RepartitionByExpression [_f" in plan(fits)

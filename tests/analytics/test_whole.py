"""Queries on made-up tables with more rows in a group, and longer texts, than the given tables have."""

import random
from difflib import SequenceMatcher
from functools import partial

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.operators import forecast, sequential
from spindrift.plans import channel_plans
from spindrift.plans.catalogue import QUERIES, SQL
from spindrift.sources.tables import HOUR


@pytest.fixture(scope="module")
def long_titles(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("titles"))
    line = F.concat(F.lpad("id", 5, "0"), F.lit(" plain" * 30), F.lit(" endword"))
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(line, F.lit("\nrest")).alias("text"), F.lit("one").alias("source"), (F.col("id") + 1).alias("n_chars"))
    rows.write.parquet(f"{home}/documents.parquet")
    return home


@pytest.mark.parametrize("name", ["f1_clean_title_whole", "f2_title_key_whole"])
def test_titles_are_whole_and_all_there(spark, long_titles, name):
    rows = QUERIES[name](spark, long_titles).collect()
    assert {r.id for r in rows} == set(range(300))
    assert all(r[1].endswith("endword") for r in rows)


@pytest.mark.parametrize("name,of_each", [("a10_topic_lift", 60), ("a12_fixed_tags", 150)])
def test_mined_titles_are_the_newest_120_and_counted_ones_all(spark, long_titles, name, of_each):
    rows = spark.createDataFrame([(i, "x" * 130 + (" late" if i % 2 else " early"), "one", i + 1) for i in range(300)], "doc_id long, text string, source string, n_chars long")
    home = f"{long_titles}/{name}"
    rows.write.parquet(f"{home}/documents.parquet")
    got = {r[1]: r.n for r in QUERIES[name](spark, home).collect()}
    assert got["late"] == got["early"] == of_each


@pytest.fixture(scope="module")
def busy(spark, tmp_path_factory):
    """Two channels of 1,500 and 40 events in 60 days with equal times and values among them, and a brand of 500 names."""
    rng, home, rows = random.Random(3), str(tmp_path_factory.mktemp("busy")), []
    for channel, n in ((1, 1500), (2, 40)):
        for i in range(n):
            at = rng.randrange(60 * 24 * 12) * 5 if rng.random() < 0.7 else rng.choice((100, 900, 20_000)) + rng.randrange(300)
            rows.append((channel * 10_000 + i, channel, rng.choice(["view", "click", "error"]), float(rng.choice([rng.randrange(90), rng.randrange(20)])), at))
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, at long").withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("at") * 60).cast("timestamp_ntz")).drop("at").write.parquet(f"{home}/events.parquet")
    parts = [(i, "one", f"{i:03d}" + "n" * (58 if i < 400 else rng.randrange(8))) for i in range(500)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string").write.parquet(f"{home}/part.parquet")
    return home, sorted((c, 1_704_067_200_000_000 + a * 60_000_000, i, k, v) for i, c, k, v, a in rows), parts


def test_peaks_and_best_of_all_events(spark, busy):
    home, rows, _ = busy
    for name, f in (
        ("w6_peak_picking", lambda r: sorted(sequential.pick_peaks([x[1] for x in r], [x[4] for x in r], 5 * HOUR, sorted(x[4] for x in r)[len(r) // 2] + 6, 10))),
        ("o6_diverse_top", lambda r: sequential.diverse_top([x[4] for x in r], [x[3] for x in r], 5, 2)),
    ):
        got = [[x.id for x in sorted(QUERIES[name](spark, home).where(F.col("channel") == c).collect(), key=lambda x: x.place)] for c in (1, 2)]
        order = (lambda x: (x[2],)) if name[0] == "o" else (lambda x: (x[1], x[2]))
        each = [sorted((x for x in rows if x[0] == c), key=order) for c in (1, 2)]
        assert got == [[r[i][2] for i in f(r)] for r in each]


def test_chapters_of_all_events(spark, busy):
    home, rows, _ = busy
    got = [[x.start for x in sorted(QUERIES["w15_pause_chapters"](spark, home).where(F.col("channel") == c).collect(), key=lambda x: x.chapter)] for c in (1, 2)]
    for c, starts in zip((1, 2), got):
        at = [x[1] for x in rows if x[0] == c]
        assert starts == [at[i] for i in sequential.cut_at_pauses(at, [t + 60_000_000 for t in at], 24 * HOUR, 72 * HOUR)]


def test_first_fit_reaches_late_short_names(spark, busy):
    home, _, parts = busy
    assert [r.tags for r in QUERIES["f11_first_fit_tags"](spark, home).collect()] == [",".join(sequential.first_fit([p[2] for p in parts], 60))]


def test_numbers_and_smoothing_of_all_events(spark, busy, monkeypatch):
    home, rows, _ = busy
    monkeypatch.setattr(channel_plans, "in_blocks", partial(channel_plans.in_blocks, size=64))
    got = {r.id: r.number for r in QUERIES["w14_sequence_numbers_whole"](spark, home).collect()}
    assert got == {x[2]: i for c in (1, 2) for i, x in enumerate((x for x in rows if x[0] == c), 1)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{home}/events.parquet/*.parquet'")
    for name in ("w3_trailing_minimum_whole", "w16_rolling_median_whole", "w11_moving_average_whole"):
        want = sorted(con.execute(SQL[name]).fetchall(), key=lambda x: x[2])
        found = sorted(map(tuple, QUERIES[name](spark, home).collect()), key=lambda x: x[2])
        assert [x[:3] for x in found] == [x[:3] for x in want] and [x[3] for x in found] == pytest.approx([x[3] for x in want], nan_ok=True)


def _share(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=30), st.text("abc", max_size=30))
def test_alike_is_the_matching_share(a, b):
    assert all(sequential.alike(a, b, share) == (_share(a, b) >= share) for share in (0.5, 0.7, 0.8, 1.0))


def test_turns_are_compared_whole(spark, tmp_path):
    """Equal openings, equal ends, copies with slips, and a conversation of more turns than a block."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    opening = text(250)
    turns = {(1, 0): opening + "a" * 500, (1, 1): opening + "b" * 500, (2, 0): text(250) + "end " * 300, (2, 1): text(250) + "end " * 300}
    recent = [text(40)]
    for t in range(600):
        old = rng.choice(recent[-4:])
        recent.append(rng.choice([old, old[:20] + text(3) + old[23:], text(40)]))
        turns[3, t] = recent[-1]
    spark.createDataFrame([(c, t, s) for (c, t), s in turns.items()], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {(c, t): next((u for u in range(t - 1, max(-1, t - 6), -1) if _share(turns[c, u], s) >= 0.7), None) for (c, t), s in turns.items()}
    got = {(r.conv_id, r.turn // 100_000): r.earlier // 100_000 for r in QUERIES["j16_retakes"](spark, str(tmp_path)).collect()}
    assert got == {k: v for k, v in want.items() if v is not None}
    assert (1, 1) not in got and got[2, 1] == 0
    got = {(r.conv_id, r.turn): r.event for r in QUERIES["j21_line_coalescing"](spark, str(tmp_path)).collect()}
    for c in (1, 2, 3):
        lines = [turns[k] for k in sorted(turns) if k[0] == c]
        assert [got[c, t] for t in range(len(lines))] == sequential.coalesce_lines(range(len(lines)), lambda i, j: _share(lines[j], lines[i]) >= 0.8, 2.5)  # noqa: B023
    assert got[1, 1] == 1 and got[2, 1] == 0


def test_forecast_calibrates_every_format_with_100_samples_of_60_paths(spark, monkeypatch):
    home, paths = "/root/testdata/sf0.001", []
    simulate = forecast.simulate
    monkeypatch.setattr(forecast, "simulate", lambda *a, **k: paths.append(k["sims"]) or simulate(*a, **k))
    formats = {r.fmt: r.n for r in QUERIES["a21_line_fit"](spark, home).collect()}
    fits = QUERIES["t1_bootstrap"](spark, home).collect()
    assert len(formats) > 1 and sorted((r.fmt, r.sample) for r in fits) == [(f, b) for f in sorted(formats) for b in range(100)]
    for r in QUERIES["a21_line_fit"](spark, home).collect():
        own = next(x for x in fits if x.fmt == r.fmt and x.sample == 0)
        assert (own.a, own.b, own.tau) == pytest.approx((r.intercept, r.slope, r.tau), abs=1e-5)
    assert {(r.fmt, r.week) for r in QUERIES["t4_forecast_bands"](spark, home).collect()} == {(f, w) for f in formats for w in range(1, 53)}
    assert len(QUERIES["t4_milestones"](spark, home).columns) == 6
    assert {(r.fmt, r.plan) for r in QUERIES["t5_plan_variants"](spark, home).collect()} == {(f, p) for f in formats for p in ("less", "same", "more")}
    assert paths == [60] * 5


def test_coalescing_makes_no_frame_a_conversation(spark):
    assert "FlatMapGroups" not in QUERIES["j21_line_coalescing"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()

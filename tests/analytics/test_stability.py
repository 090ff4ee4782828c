"""File stability over micro-batches and restarts, against a plain walk through each file's listings."""

import random

import pytest

from spindrift.streaming.stability import run_to_end, settled_files, state_session

SCHEMA = "path string, seen timestamp, size long, mtime long"


def plain(listings, stable, forget, now):
    """Events of all listings (path, second, size, mtime), with all that is due at ``now`` reported."""
    out, files = [], {}
    for p, t, size, mtime in sorted(listings):
        files.setdefault(p, []).append((t, (size, mtime)))
    for p, seen in files.items():
        known, since, last, done = None, 0, None, True
        for t, key in [*seen, (now, None)]:
            if known is not None and not done and t >= since + stable:
                out.append((p, since + stable, "ready", *known))
                done = True
            if key is None:
                break
            if known is None or t - last > forget:
                out.append((p, t, "ready", *key))
                known, since, done = key, t, True
            elif key != known:
                out.append((p, t, "copying", *key))
                known, since, done = key, t, False
            last = t
    return sorted(out)


def run(spark, home, batches, stable, forget):
    """One call of the stream for each batch, each from the checkpoint that the one before left."""
    own = state_session(spark)
    for batch in batches:
        rows = spark.createDataFrame(batch, "path string, t long, size long, mtime long").selectExpr("path", "timestamp_seconds(t + 1000) AS seen", "size", "mtime")
        rows.coalesce(1).write.mode("append").parquet(f"{home}/in")
        stream = own.readStream.schema(SCHEMA).parquet(f"{home}/in")
        run_to_end(settled_files(stream, stable=stable, forget=forget), f"{home}/out", f"{home}/state")
    got = spark.read.schema("path string, at long, event string, size long, mtime long").parquet(f"{home}/out").collect()
    return sorted((r.path, r.at // 1000 - 1000, r.event, r.size, r.mtime) for r in got)


def test_growth_resets_and_a_whole_file_is_reported_once(spark, tmp_path):
    batches = [
        [("a", 0, 10, 0), ("b", 1, 5, 0), (None, 1, 1, 1)],  # first sight: whole
        [("a", 2, 12, 0), ("a", 4, 14, 0), ("b", 4, 5, 0)],  # growing
        [("a", 8, 14, 0)],  # four seconds: not yet
        [("a", 10, 14, 0), ("a", 11, 14, 0)],  # whole, once
        [("b", 20, 6, 0), ("c", 40, 1, 0)],  # b changed and is not listed again: the timer reports it
    ]
    got = run(spark, tmp_path, batches, 5, 1000)
    assert got == [("a", 0, "ready", 10, 0), ("a", 2, "copying", 12, 0), ("a", 4, "copying", 14, 0), ("a", 9, "ready", 14, 0), ("b", 1, "ready", 5, 0), ("b", 20, "copying", 6, 0), ("b", 25, "ready", 6, 0), ("c", 40, "ready", 1, 0)]


@pytest.mark.parametrize("cuts", [1, 3])
def test_any_cut_into_batches_gives_the_plain_events(spark, tmp_path, cuts):
    rng = random.Random(3)
    rows = sorted({(f"f{rng.randrange(12)}", t, rng.randrange(3), 0) for t in range(0, 300) for _ in range(2) if rng.random() < 0.4}, key=lambda r: r[1])
    rows = list({(p, t): (p, t, s, m) for p, t, s, m in rows}.values())
    step = 300 // cuts  # a listing at the time of the watermark would be late
    got = run(spark, tmp_path, [[r for r in rows if r[1] // step == i] for i in range(cuts)], 8, 40)
    now = max(t for _, t, _, _ in rows)
    assert got == plain(rows, 8, 40, now) and len(got) > 100

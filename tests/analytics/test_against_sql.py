"""Queries against their SQL on tables made for a case that the driver's small tables do not hold."""

import datetime
import random

import duckdb

from spindrift.plans.catalogue import QUERIES, SQL


def both(spark, home, name, tables):
    """(rows of the query, rows of its SQL) over ``tables``: name -> (schema, rows)."""
    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{home}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{home}/{t}.parquet/*.parquet')")
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    return order(QUERIES[name](spark, str(home)).collect()), order(con.execute(SQL[name]).fetchall())


def test_boxes_of_a_long_order_and_of_nulls(spark, tmp_path):
    rng = random.Random(5)
    cell = lambda values: None if rng.random() < 0.1 else float(rng.choice(values))
    line = lambda k, n: (k, n, cell(range(1, 51)), cell([i / 100 for i in range(11)]), None if n % 7 == 0 else 1000.0 + rng.randrange(400))
    rows = [line(1, n) for n in range(1, 2000)] + [line(k, n) for k in range(2, 60) for n in range(1, 8)] + [line(None, n) for n in range(1, 4)]
    tables = {"lineitem": ("l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_extendedprice double", rows)}
    got, want = both(spark, tmp_path, "j19_box_suppression", tables)
    assert got == want and len(want) > 100


def test_a_segment_just_long_enough_counts_late_as_well(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 else "assistant", "x" * n) for c in range(40) for t, n in enumerate((40, 16, 15, 16 + c))]
    got, want = both(spark, tmp_path, "a34_speaker_seconds", {"conversations": ("conv_id long, turn int, role string, text string", rows)})
    assert got == want and {r[1] for r in want} == {"user", "assistant"}


def test_profiles_round_by_the_value_itself(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    at = lambda h: start + datetime.timedelta(hours=h)
    rows = [(8 * u + i, at(3 * i + u % 5), u, kind, v) for u in range(60) for i, (kind, v) in enumerate([("view", 9.0), ("click", 50 + u / 4), ("click", 50 + u / 4), ("purchase", 45.0), ("signup", 44.0 + u / 5), ("view", 2.0), ("purchase", 1.0)])]
    got, want = both(spark, tmp_path, "g5_timeline_profiles", {"events": ("event_id long, ts timestamp_ntz, user_id long, event_type string, value double", rows)})
    assert got == want and {r[8] for r in want} >= {1.02, 1.06}  # of 1.025 and 1.065

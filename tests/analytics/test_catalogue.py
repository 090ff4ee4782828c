"""Every catalogue query that has SQL gives the same rows as DuckDB does."""

import math

import duckdb
import pytest

from spindrift.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(rows):
    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 4) + 0.0
        return x

    return sorted(tuple(cell(x) for x in r) for r in rows) if not any(None in r for r in rows) else sorted((tuple(cell(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    names = [d[0] for d in want.description]
    a, b = _plain([tuple(r) for r in got.select(*names).collect()]), _plain(want.fetchall())
    assert len(a) == len(b) > 0
    bad = [(x, y) for x, y in zip(a, b) if x != y and not all(p == q or isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-6, abs_tol=2e-4) for p, q in zip(x, y))]
    assert not bad, bad[:3]

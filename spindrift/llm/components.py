"""Connected components of an undirected graph given as a DataFrame of links.

Large-star and small-star steps: each node's neighbours are hung on the least node that it knows of, first the
greater ones, then the lesser ones.  A step is one pre-aggregated minimum per node and one join back, whose inputs
are tables in the shared folder, so that Spark may split a node with very many links.  First, each task contracts
the links that it holds to a spanning forest.  No links or components come to the driver, only two totals a round.  A
round's tables are written by as many tasks as its links need, so that few links in very many partitions cost little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, released, stage_table

LINKS_A_TASK = 20_000


class UnionFind:
    """Least member as root, over keys of any kind that can be compared."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True

    def edges(self) -> list[tuple]:
        return [(self.find(x), x) for x in list(self.parent) if self.find(x) != x]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forest of a task's links, in blocks of a bounded number of links."""
    links, n = UnionFind(), 0
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            links.union(a, b)
        n += batch.num_rows
        if n >= 250_000:
            yield _batch(links.edges())
            links, n = UnionFind(), 0
    yield _batch(links.edges())


def _batch(pairs: list[tuple]) -> pa.RecordBatch:
    both = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _totals(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, component): each linked node and the least node it is connected with."""
    rows = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    edges = stage_table(rows.mapInArrow(released(_forest), "a long, b long"), "links")  # a < b: a is the lesser node
    before = _totals(edges)
    while before[0]:
        tasks = -(-before[0] // LINKS_A_TASK)
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = stage_table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks), "least")
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        large = stage_table(large.coalesce(tasks), "large")
        drop_tables(least)
        least = stage_table(large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")).coalesce(tasks), "least")
        small = large.withColumnRenamed("b", "u").join(least, "u")
        small = small.select(F.col("m"), F.explode(F.array("u", "a")).alias("b")).where("m <> b").select(F.col("m").alias("a"), "b").distinct()
        done, edges = edges, stage_table(small.coalesce(tasks), "links")
        drop_tables(done, large, least)
        after = _totals(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())

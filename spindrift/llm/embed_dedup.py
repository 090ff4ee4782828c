"""Near-duplicates among embeddings: int8 tile products with rigorous error bounds.

Unit vectors x are stored as s*q with integers q in -127..127; e = |x - s*q| bounds what was lost, so
|<x,y> - s_x s_y <q_x,q_y>| <= e_x + (1 + e_x) e_y.  Vectors are dealt into blocks; each pair of blocks is a tile
whose integer products tell, for each pair, whether the cosine is surely at or above the threshold, surely below
it, or open.  Only open pairs are computed again in double precision.  A tile returns link counts and a spanning
forest of its links, never the links themselves, so a group of copies costs no more than its members.

The work is quadratic in the number of vectors, as any exact comparison of all pairs; memory per task is not.  A block
travels once per block that it meets, so its size (what a task may hold) sets the traffic: bytes^2 / BLOCK_BYTES.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, stage_table
from .components import UnionFind, connected_components

THRESHOLD = 0.9
BLOCK_BYTES = 16 << 20
LEAST_ROWS = 512
STRIP = 128
_EXACT = 1040  # 1040 * 127^2 < 2^24
#: Rounding after the exact integer products: two scales and two multiplications, each within 2^-24 of at most 1.1, and
#: the bound itself, come to less than 4e-7 whatever the width; the same goes for the double steps around them.
_SLACK = 1e-6


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows -> (int8 rows, scales, error bounds)."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / np.maximum(scale, 1e-300)[:, None])
    error = np.linalg.norm(unit - scale[:, None] * q, axis=1)
    return q.astype(np.int8), scale, error + 1e-12


class Block:
    """ids, unit vectors in double precision and their quantised form."""

    def __init__(self, ids: bytes, vectors: bytes, kind: str = "<f4"):
        self.ids = np.frombuffer(ids, "<i8")
        x = np.frombuffer(vectors, kind).reshape(len(self.ids), -1).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
        self.unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        q, self.scale, self.error = quantise(self.unit)
        self.q = q.astype(np.float32)


def integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows of integers -127..127, exact: sums of up to ``_EXACT`` terms stay below 2^24, where single
    precision is exact; wider rows are taken in pieces and added up in double precision."""
    if a.shape[1] <= _EXACT:
        return a @ b.T
    return sum((a[:, k : k + _EXACT] @ b[:, k : k + _EXACT].T).astype(np.float64) for k in range(0, a.shape[1], _EXACT))


def tile_links(a: Block, b: Block, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, UnionFind, int]:
    """(links of each row of a, of each row of b, forest of row numbers with b's after a's, pairs computed again)."""
    count_a, count_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    forest, offset, again = UnionFind(), 0 if same else len(a.ids), 0
    for top in range(0, len(a.ids), STRIP):
        rows = slice(top, top + STRIP)
        about = integer_products(a.q[rows], b.q)
        about *= a.scale[rows, None].astype(np.float32)
        about *= b.scale.astype(np.float32)
        bound = (a.error[rows, None] + (1 + a.error[rows, None]) * b.error.max(initial=0) + _SLACK).astype(np.float32)
        i, j = np.nonzero(about >= np.float32(threshold) - bound)
        if same:
            keep = j > i + top
            i, j = i[keep], j[keep]
        ea = a.error[top + i]
        low = about[i, j] - (ea + (1 + ea) * b.error[j] + _SLACK)
        linked = low >= threshold
        for at in np.array_split(np.flatnonzero(~linked), max(1, int((~linked).sum()) // 50_000)):
            exact = np.einsum("ij,ij->i", a.unit[top + i[at]], b.unit[j[at]])
            linked[at] = exact >= threshold
            again += len(at)
        i, j = i[linked] + top, j[linked]
        count_a += np.bincount(i, minlength=len(a.ids))
        count_b += np.bincount(j, minlength=len(b.ids))
        _join(forest, i, j + offset)
    return count_a, count_b, forest, again


def _join(forest: UnionFind, i: np.ndarray, j: np.ndarray) -> None:
    while len(i):
        names = np.unique(np.concatenate([i, j]))
        root = np.array([forest.find(int(x)) for x in names])
        i, j = root[np.searchsorted(names, i)], root[np.searchsorted(names, j)]
        apart = i != j
        i, j = i[apart], j[apart]
        if not len(i):
            return
        # one link of each root at a time: the rest mostly falls away with it
        _, first = np.unique(i, return_index=True)
        for x, y in zip(i[first].tolist(), j[first].tolist()):
            forest.union(x, y)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors in order of (width, block) -> one row per block, as bytes."""
    key, ids, vectors = None, [], []

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([b"".join(ids)], pa.binary()), pa.array([b"".join(vectors)], pa.binary())], names=["width", "block", "ids", "vectors"])

    for batch in batches:
        width, block = (batch.column(k).to_numpy() for k in ("width", "block"))
        flat, vec_id = batch.column("embedding").flatten().to_numpy(), batch.column("vec_id").to_numpy()
        ends = np.cumsum(width)
        cuts = np.append(np.flatnonzero(np.append(True, (width[1:] != width[:-1]) | (block[1:] != block[:-1]))), len(width))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = (int(width[x]), int(block[x]))
            if key is not None and own != key:
                yield close()
                ids, vectors = [], []
            key = own
            ids.append(vec_id[x:y].astype("<i8").tobytes())
            vectors.append(flat[ends[x] - width[x] : ends[y - 1]].tobytes())
    if ids:
        yield close()


def link_embeddings(vectors: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, empty or zero, or hold a null or non-finite component, link with nothing; so do vectors of
    different widths.  Rows are vectors of their own: those that share an id are compared like any others, and a row
    without an id counts as the largest one (its component's id is null where none of it has one).  ``kept`` says that the
    row's id is the component's.  Components of type double keep their precision.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    form, kind = ("float", "<f4") if single else ("double", "<f8")
    rows = vectors.select(F.monotonically_increasing_id().alias("vec_id"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{form}>").alias("embedding"))
    rows = stage_table(rows, "vectors")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = rows.where((F.size("embedding") > 0) & ~F.exists("embedding", bad)).where(F.exists("embedding", lambda x: x != 0)).withColumn("width", F.size("embedding").cast("long"))
    total, parts = good.agg(F.count(F.lit(1)).alias("n"), F.sum("width").alias("w")).first(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    # blocks as large as a task may hold, but enough of them for all tasks to have tiles
    blocks = max(-(-(total.w or 0) * int(kind[-1]) // BLOCK_BYTES), min(-(-total.n // LEAST_ROWS), int((2 * parts) ** 0.5) + 1), 1)
    dealt = good.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("long"))
    dealt = dealt.repartition("width", "block").sortWithinPartitions("width", "block")
    packed = stage_table(dealt.mapInArrow(released(_pack), "width long, block long, ids binary, vectors binary"), "blocks")

    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    tiles = packed.withColumn("other", other).select("width", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "ids", "vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple, tuple[int, Block]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                key, block = (r["width"], r["i"], r["j"]), Block(r["ids"], r["vectors"], kind)
                same = r["i"] == r["j"]
                if not same and key not in waiting:
                    waiting[key] = (r["block"], block)
                    continue
                a = block if same else waiting.pop(key)[1]
                count_a, count_b, forest, _ = tile_links(a, block, threshold, same)
                ids = a.ids if same else np.concatenate([a.ids, block.ids])
                count = count_a + count_b if same else np.concatenate([count_a, count_b])
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(np.full(len(some), -1)), pa.array(count[some])], names=["a", "b", "n"])
                pairs = np.array(forest.edges(), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]]), pa.array(np.zeros(len(pairs), np.int64))], names=["a", "b", "n"])

    found = stage_table(tiles.repartition("width", "i", "j").sortWithinPartitions("width", "i", "j").mapInArrow(released(run), "a long, b long, n long"), "tiles")
    counts = found.where("n > 0").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    comps = connected_components(found.where("n = 0").select("a", "b")).withColumnRenamed("node", "vec_id")
    out = rows.select("vec_id", "id").join(counts, "vec_id", "left").join(comps, "vec_id", "left").withColumn("component", F.coalesce("component", "vec_id"))
    least = out.groupBy("component").agg(F.min("id").alias("component_id"))
    out = out.join(least, "component")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id").withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: all embeddings against each other."""
    return link_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

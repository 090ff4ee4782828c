"""Whitening of embeddings: upper-triangle column aggregates in Spark, eigenvectors by LAPACK on the driver.

Entries become whole numbers x = floor(scale * c) + offset, so that counts, sums and deviations are exact.  The fit
list is each distinct x vector once.  One aggregation sums the centred products of every pair of dimensions i <= j, one
generated SQL expression a pair; the driver assembles the covariance (width^2 numbers, whatever the number of rows) and
decomposes it.  Each row is then centred, projected on the components and divided by the root of their eigenvalues in
one pass without a shuffle.

The number of expressions goes with the square of the width: meant for widths up to a few hundred.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, released, stage_table

COMPONENTS = 16
SCALE = 64
OFFSET = 1_000_000
#: Entries from here on have no x that fits a long.
_LARGEST = float(1 << 62)
_LONG = (1 << 63) - 1


@dataclass
class Whitening:
    width: int
    n: int  # vectors of the fit list
    sums: list[int]  # exact
    values: np.ndarray  # falling eigenvalues, one per component
    vectors: np.ndarray  # components x width, unit rows
    trace: float = 0.0
    identity_error: float | None = None

    def shifts(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as Python's whole numbers where a long may not hold them."""
        long = 2 * self.n * _largest(x) < _LONG and max(map(abs, self.sums)) < _LONG // 2
        return x * self.n - np.array(self.sums, np.int64) if long else x.astype(object) * self.n - np.array(self.sums, object)

    def deviations(self, shifts: np.ndarray) -> list[int | None]:
        """Sum of squares of each row, exact; None beyond a long."""
        if shifts.dtype != object and self.width * int(np.abs(shifts).max(initial=0)) ** 2 <= _LONG:
            return (shifts * shifts).sum(axis=1).tolist()
        wide = shifts.astype(object)
        return [int(v) if v <= _LONG else None for v in (wide * wide).sum(axis=1)]

    def project(self, shifts: np.ndarray) -> np.ndarray:
        """(x - S/n) on the components over sqrt(e); nan along components of eigenvalue 0."""
        with np.errstate(divide="ignore", invalid="ignore"):
            root = np.where(self.values > 0, np.sqrt(self.values), np.nan)
            return (shifts / self.n).astype(float) @ self.vectors.T / root


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def whole_numbers(vectors: DataFrame, *, scale: int = SCALE, offset: int = OFFSET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: rows whose vector is not null and has neither null nor non-finite entries.

    Rows with an entry so large that x would not fit a long have no x and go as well; empty vectors have no dimension to
    speak of and go."""
    c = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), c.alias("c")).where("c is not null and size(c) > 0")
    fine = F.forall("c", lambda v: F.coalesce((F.abs(v) * scale < _LARGEST) & ~F.isnan(v), F.lit(False)))
    return rows.where(fine).select("vec_id", F.transform("c", lambda v: F.floor(v * scale).cast("long") + F.lit(offset).cast("long")).alias("x"))


def centred(width: int, n: int, sums: list[int], exact: str) -> list[str]:
    """SQL of x[i] - S[i] / n as doubles: rounded once, after the exact difference n * x - S in the type ``exact``."""
    whole = lambda v: f"cast('{v}' as {exact})"
    return [f"coalesce(cast(cast(x[{i}] as {exact}) * {whole(n)} - {whole(s)} as double) / {n}D, 0D) AS c{i}" for i, s in enumerate(sums)]


def covariance(fit: DataFrame, columns: list[str], n: int) -> np.ndarray:
    """Covariance (divisor n) of the centred columns: one aggregation, one sum for each pair of columns."""
    width = len(columns)
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    sums = fit.selectExpr(*columns).selectExpr(*[f"sum(c{i} * c{j})" for i, j in pairs]).first()
    out = np.zeros((width, width))
    for (i, j), s in zip(pairs, sums):
        out[i, j] = out[j, i] = s / n
    return out


def fit_whitening(numbers: DataFrame, *, components: int = COMPONENTS) -> Whitening | None:
    """From ``x`` of :func:`whole_numbers`; None without rows.

    All vectors of one fit have one width: where widths differ, the one with the most distinct vectors (ties: the
    widest) is fitted."""
    fit = stage_table(numbers.select("x").distinct(), "fit_list")
    common = fit.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if common is None:
        return None
    width, n = common.width, common.n
    fit = fit.where(F.size("x") == width)
    # halves of 31 bits, so that no sum of a long column can overflow
    cells = fit.select(F.posexplode("x").alias("i", "x"))
    got = cells.groupBy("i").agg(F.expr("sum(x >> 31)").alias("high"), F.expr("sum(x & 2147483647L)").alias("low"), F.max("x").alias("most"), F.min("x").alias("least")).collect()
    sums = [(r.high << 31) + r.low for r in sorted(got, key=lambda r: r.i)]
    reach = n * max(max(abs(r.most), abs(r.least)) for r in got)
    columns = centred(width, n, sums, "long" if 2 * reach <= _LONG else "decimal(38,0)")
    found = covariance(fit, columns, n)
    value, vector = np.linalg.eigh(found)
    order = np.argsort(-value, kind="stable")[:components]
    value, vector = value[order], vector[:, order].T
    # what is not above the rounding of the decomposition is 0: there is nothing along such a component
    value = np.where(value > max(value.max(), 0.0) * width * np.finfo(float).eps, value, 0.0)
    largest = np.abs(vector).argmax(axis=1)
    model = Whitening(width, n, sums, value, vector * np.sign(vector[np.arange(len(vector)), largest])[:, None], float(np.trace(found)))
    model.identity_error = _identity_error(fit, model)
    return model


def _identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the fit list's whitened vectors minus the identity, as measured from
    them (components of eigenvalue 0 have none)."""
    some = int((model.values > 0).sum())
    if not some:
        return None
    white = whiten(fit.withColumn("vec_id", F.lit(0)), model)
    pairs = [(i, j) for i in range(some) for j in range(i, some)]
    got = white.selectExpr(*[f"covar_pop(whitened[{i}], whitened[{j}])" for i, j in pairs]).first()
    return float(max(abs(v - (i == j)) for (i, j), v in zip(pairs, got)))


def whiten(numbers: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id, deviation, whitened`` of each row of the model's width.

    ``deviation`` is the sum over dimensions of (n*x - S)^2, exact, null where it does not fit a long; ``whitened`` an
    array with an entry for each component, null for one of eigenvalue 0."""
    kind = numbers.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shifts = model.shifts(batch.column("x").flatten().to_numpy().reshape(-1, model.width))
            white = model.project(shifts)
            flat = pa.array(white.ravel(), from_pandas=True)
            ends = pa.array(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(model.deviations(shifts), pa.int64()), pa.ListArray.from_arrays(ends, flat)], names=["vec_id", "deviation", "whitened"])

    rows = numbers.where(F.size("x") == model.width).select("vec_id", "x")
    return bounded_batches(rows).mapInArrow(released(run), f"vec_id {kind}, deviation long, whitened array<double>")


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """Contract query: each vector and component of ``embeddings``."""
    numbers = whole_numbers(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    model = fit_whitening(numbers)
    if model is None:
        return numbers.selectExpr("vec_id", "0 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error").limit(0)
    explained = "array(" + ", ".join(f"{float(e / model.trace)!r}D" if model.trace > 0 else "cast(null as double)" for e in model.values) + ")"
    error = "cast(null as double)" if model.identity_error is None else f"{model.identity_error!r}D"
    rows = whiten(numbers, model).selectExpr("vec_id", "deviation", "posexplode(whitened) AS (place, whitened)")
    return rows.selectExpr("vec_id", "place + 1 AS component", f"{model.n}L AS n", "deviation", "whitened", f"{explained}[place] AS explained", f"{error} AS identity_error")

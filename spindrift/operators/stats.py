"""Statistics per group, out of Spark's own aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relational import joined


def median(col: str | Column) -> Column:
    """Mean of the two middle values."""
    return F.percentile(col, F.lit(0.5))


def array_median(values: Column) -> Column:
    """Mean of the two middle values of an array; null if it is empty."""
    s, n = F.sort_array(values), F.size(values)
    at = lambda i: F.element_at(s, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)


def index_quantile(values: Column, p: float) -> Column:
    """The entry number floor(n p) of the sorted values, without interpolation (p = 0.5: the upper median)."""
    return F.element_at(F.sort_array(values), (F.floor(F.size(values) * p) + 1).cast("int"))


def valid(col: str) -> Column:
    """Known, positive and finite."""
    c = F.col(col)
    return c.isNotNull() & (c > 0) & ~F.isnan(c) & (c < float("inf"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], bins: int = 1024) -> DataFrame:
    """keys, share, quantile: linearly interpolated quantiles, as ``percentile`` gives, for keys that hold very many rows.

    A first pass counts each key's values in ``bins`` cells between its least and greatest one; running sums of these counts
    tell in which cells the wanted ranks lie, and a second pass sorts only the rows of these cells, cell by cell.  Null and
    NaN values do not count."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("_v"))
    ends = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    cell = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))).otherwise(0).cast("long")
    rows = joined(rows, ends, keys).select(*keys, "_v", cell.alias("_cell"))
    upto = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    asked = ends.select(*keys, F.explode(F.array(*[F.lit(float(p)) for p in shares])).alias("share"), "_n").withColumn("_at", F.col("share") * (F.col("_n") - 1))
    asked = asked.select(*keys, "share", "_at", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank"))
    placed = joined(asked, counts, keys).where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
    few = placed.select(*keys, "_cell", "_before").distinct()
    near = joined(rows, few, [*keys, "_cell"]).withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy("_v")) - 1)
    found = joined(placed.select(*keys, "share", "_at", "_rank"), near.select(*keys, "_rank", "_v"), [*keys, "_rank"])
    low, high = F.min("_v"), F.max("_v")
    return found.groupBy(*keys, "share", "_at").agg((low + (high - low) * (F.col("_at") - F.floor("_at"))).alias("quantile")).drop("_at")


def robust_z(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``z`` = (value - median) / (1.4826 MAD + 0.001) within each key; medians by counts of cells, then joined."""
    middle = lambda rows, c, name: exact_quantiles(rows, keys, c, [0.5]).select(*keys, F.col("quantile").alias(name))
    near = joined(df, middle(df, value, "_med"), keys).withColumn("_off", F.abs(F.col(value) - F.col("_med")))
    out = joined(near, middle(near, "_off", "_mad"), keys).withColumn("z", (F.col(value) - F.col("_med")) / (1.4826 * F.col("_mad") + 1e-3))
    return out.drop("_med", "_mad", "_off")


def neighbour_residual(df: DataFrame, *, keys: Sequence[str], order: Sequence, value: str, reach: int = 5) -> DataFrame:
    """``resid``: ln(value) minus the median ln of the ``reach`` rows before and after it in ``order`` (0 if alone)."""
    order_ = Window.partitionBy(*keys).orderBy(*order)
    logs = F.log(value)
    near = F.concat(F.collect_list(logs).over(order_.rowsBetween(-reach, -1)), F.collect_list(logs).over(order_.rowsBetween(1, reach)))
    return df.withColumn("_near", near).withColumn("resid", F.when(F.size("_near") == 0, 0.0).otherwise(logs - array_median(F.col("_near")))).drop("_near")


def line_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, slope_range: tuple[float, float] = (0.0, 1.0), least: int = 3) -> DataFrame:
    """keys, n, slope, intercept, tau: least squares with the slope held in a range (the line still goes through the
    means) and the residuals' spread with two degrees of freedom less, 0.2 at least.  Nulls below ``least`` points."""
    raw = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("_b"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"))
    usable = (F.col("n") >= least) & (F.col("_sxx") > 1e-12)
    raw = raw.withColumn("slope", F.when(usable, F.least(F.greatest(F.col("_b"), F.lit(slope_range[0])), F.lit(slope_range[1]))))
    sse = F.col("_syy") - 2 * F.col("slope") * F.col("_sxy") + F.col("slope") ** 2 * F.col("_sxx")
    tau = F.when(usable & (F.col("n") > 2), F.greatest(F.lit(0.2), F.sqrt(F.greatest(sse, F.lit(0.0)) / (F.col("n") - 2))))
    return raw.select(*keys, "n", "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"), tau.alias("tau"))


def leave_one_out(df: DataFrame, keys: Sequence[str], x: str, y: str, z: float = 1.2816) -> DataFrame:
    """keys, hit, n: how many rows lie within z spreads of the line fitted to all the others.  The others' sums are the
    group's centred sums with the row taken out, so there is no loop and no refit."""
    tot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"))
    c = F.col
    dx, dy, f = c(x) - c("_mx"), c(y) - c("_my"), c("_n") / (c("_n") - 1)
    rows = df.join(tot, list(keys)).where("_n >= 4").withColumns({"_dx": dx, "_dy": dy, "_f": f})
    rows = rows.withColumns({"_sx": c("_sxx") - c("_f") * c("_dx") ** 2, "_sy": c("_syy") - c("_f") * c("_dy") ** 2, "_sp": c("_sxy") - c("_f") * c("_dx") * c("_dy")}).where("_sx > 1e-12")
    slope = c("_sp") / c("_sx")
    tau = F.sqrt(F.greatest(c("_sy") - slope * c("_sp"), F.lit(0.0)) / (c("_n") - 3))
    error = c("_f") * (c("_dy") - slope * c("_dx"))
    return rows.withColumns({"_tau": tau, "_e": error}).where("_tau > 0").groupBy(*keys).agg(F.sum((F.abs("_e") <= z * c("_tau")).cast("long")).alias("hit"), F.count(F.lit(1)).alias("n"))


def weighted_vote(df: DataFrame, keys: Sequence[str], value: str, weight: str, order: str) -> DataFrame:
    """keys, value, share, runner_up: the value with most weight; ties go to the one that ``order`` has first."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"), F.min(order).alias("_first"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_w"), "_first"))
    ranked = sums.withColumn("_place", place)
    best = lambda k: F.max(F.when(F.col("_place") == k, F.col(value)))
    share = F.max(F.when(F.col("_place") == 1, F.col("_w"))) / F.sum("_w")
    return ranked.groupBy(*keys).agg(best(1).alias(value), share.alias("share"), best(2).alias("runner_up"))

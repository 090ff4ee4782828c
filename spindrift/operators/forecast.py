"""Growth forecast: bootstrap calibration, and weekly Monte-Carlo paths, one Spark group per bootstrap sample.

Random numbers come from seeds of (seed, sample), so a rerun of a lost task gives the same rows, and all plan variants
see the same draws.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import joined, numbered

WEEKS, SEED = 52, 7
SLOPE = (0.0, 1.0)
DRAWS = 2_000_000  # that one task joins with their peers, about


def bootstrap(peers: DataFrame, samples: int = 100, seed: int = SEED) -> DataFrame:
    """peers (fmt, x, y) -> fmt, sample, a, b, tau.  Each format is calibrated by itself; sample 0 is its peers themselves, the
    others as many draws with replacement.

    The k-th draw of a sample is the peer whose number a hash of (seed, format, sample, k) gives, so draws are joined with the
    peers in parts of bounded size and summed up: no format's peers ever meet in one row, and no task counts draws by peer."""
    known = peers.where("x is not null and y is not null").select("fmt", "x", "y")
    middle = known.groupBy("fmt").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    rows = joined(numbered(known, ["fmt"], "x", ["x", "y"], 1, number="k"), middle, ["fmt"])
    rows = rows.select("fmt", "k", "n", "mx", "my", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    # draws of a part meet its peers: as many parts as hold DRAWS each, whatever the size of the formats
    parts = max(1, -(-known.count() * max(samples - 1, 1) // DRAWS))
    spread = rows.withColumn("_f", F.coalesce(F.concat(F.lit("="), "fmt"), F.lit(""))).repartition(parts, "_f", "k")  # null is a format as well
    drawn = spread.select("fmt", "_f", "n", "k", F.explode(F.sequence(F.lit(1), F.lit(samples - 1))).alias("sample")) if samples > 1 else spread.select("fmt", "_f", "n", "k", F.lit(1).alias("sample")).limit(0)
    name = F.concat_ws("/", F.lit(str(seed)), "fmt", F.col("sample").cast("string"), F.col("k").cast("string"))
    pick = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % F.col("n") + 1
    drawn = drawn.select("_f", "sample", pick.alias("k")).repartition(parts, "_f", "k")
    met = drawn.hint("merge").join(spread, ["_f", "k"]).drop("_f").withColumn("w", F.lit(1).cast("long"))
    every = met.unionByName(rows.withColumns({"sample": F.lit(0), "w": F.lit(1).cast("long")}))
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    sums = every.groupBy("fmt", "sample", "mx", "my").agg(F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.sum(w * y * y).alias("syy"))
    n = F.col("n")
    sums = sums.withColumns({"sxx": F.col("sxx") - F.col("sx") * F.col("sx") / n, "sxy": F.col("sxy") - F.col("sx") * F.col("sy") / n, "syy": F.col("syy") - F.col("sy") * F.col("sy") / n})
    slope = F.when(F.col("sxx") > 1e-12, F.greatest(F.lit(SLOPE[0]), F.least(F.lit(SLOPE[1]), F.col("sxy") / F.col("sxx")))).otherwise(0.0)
    sums = sums.withColumn("b", slope)
    b = F.col("b")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - 2 * b * F.col("sxy") + b * b * F.col("sxx")) / F.greatest(n - 2, F.lit(1)))
    level = F.col("my") + F.col("sy") / n - b * (F.col("mx") + F.col("sx") / n)
    return sums.select("fmt", F.col("sample").cast("long").alias("sample"), level.alias("a"), "b", F.greatest(F.lit(0.2), spread).alias("tau"))


def paths(a: float, b: float, tau: float, sigma: float, *, subs: float, rate: float, conv: float, keep: float, draws: np.ndarray, shift: float) -> np.ndarray:
    """weeks x sims subscribers: views are lognormal on the subscribers of the week, of which ``conv`` subscribe;
    a video's views accrue over weeks, ``1 - keep`` of what is left each week."""
    weeks, sims = draws.shape
    s, pending = np.full(sims, float(subs)), np.zeros(sims)
    out = np.empty((weeks, sims))
    for w in range(weeks):
        level = a + b * np.log(np.maximum(s, 1)) + tau * shift + sigma * draws[w]
        pending = pending + rate * np.exp(level)
        seen = (1 - keep) * pending
        pending = pending - seen
        s = s + conv * seen
        out[w] = s
    return out


def simulate(calibration: DataFrame, *, subs: float, rate: float, sigma: float = 0.8, conv: float = 0.002, keep: float = 0.6, sims: int = 200, weeks: int = WEEKS, seed: int = SEED) -> DataFrame:
    """fmt, sample, week (from 1), sim, subs."""

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                rng = np.random.default_rng([seed, 1, int(r.sample)])
                shift, draws = rng.normal(), rng.normal(size=(weeks, sims))
                got = paths(r.a, r.b, r.tau, sigma, subs=subs, rate=rate, conv=conv, keep=keep, draws=draws, shift=shift)
                yield pd.DataFrame({"fmt": r.fmt, "sample": int(r.sample), "week": np.repeat(np.arange(1, weeks + 1), sims), "sim": np.tile(np.arange(sims), weeks), "subs": got.ravel()})

    return calibration.mapInPandas(run, "fmt string, sample long, week long, sim long, subs double")


def bands(simulated: DataFrame) -> DataFrame:
    """fmt, week, p10, p50, p90."""
    return simulated.groupBy("fmt", "week").agg(*[F.percentile("subs", F.lit(q / 100)).alias(f"p{q}") for q in (10, 50, 90)])


def milestones(simulated: DataFrame, goals: list[float]) -> DataFrame:
    """fmt, goal, week, chance, low, high: share of paths that have reached a goal, and its spread over the samples."""
    goal = F.explode(F.array(*[F.lit(float(g)) for g in goals]))
    each = simulated.withColumn("goal", goal).groupBy("fmt", "goal", "week", "sample").agg(F.avg((F.col("subs") >= F.col("goal")).cast("double")).alias("p"))
    return each.groupBy("fmt", "goal", "week").agg(F.avg("p").alias("chance"), F.percentile("p", F.lit(0.1)).alias("low"), F.percentile("p", F.lit(0.9)).alias("high"))

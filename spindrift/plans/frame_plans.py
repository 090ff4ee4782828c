"""Structural events, over the driver's embeddings as frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames
from ..sources.tables import table
from .registry import query

BINS = 8


def pictures(spark, sf_dir):
    """Forty vectors in a row are a recording, one a second: signs are the fingerprint, sixteenth powers by eights the colours."""
    x = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").where("vec_id is not null")
    placed = rows.select(F.floor(F.col("vec_id") / 40).alias("video"), (F.col("vec_id") % 40).alias("t"), x.alias("x"))
    power = [F.aggregate(F.slice("x", 8 * k + 1, 8), F.lit(0.0), lambda a, v: a + F.pow(v, F.lit(16.0))) for k in range(BINS)]
    bit = lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long"))
    sign = F.aggregate(F.transform("x", bit), F.lit(0).cast("long"), lambda a, v: a.bitwiseOR(v))
    out = placed.withColumn("_p", F.array(*power)).withColumn("_all", F.aggregate("_p", F.lit(0.0), lambda a, v: a + v))
    return out.select(
        "video", "t", sign.alias("hash"), F.transform("_p", lambda v: v / F.col("_all")).alias("hist"),
        (F.abs(F.get("x", F.lit(0))) / 16).alias("flat"), (F.abs(F.get("x", F.lit(1))) * 16).alias("sat"),
    )


_PICTURES = """e AS (SELECT vec_id // 40 AS video, vec_id % 40 AS t, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
  g AS (SELECT video, t, x, list_transform(range(8), lambda k: list_sum(list_transform(x[8 * k + 1 : 8 * k + 8], lambda v: pow(v, 16)))) AS p FROM e),
  f AS (SELECT video, t, list_transform(x, lambda v: v > 0) AS bits, list_transform(p, lambda v: v / list_sum(p)) AS hist, abs(x[1]) / 16 AS flat, abs(x[2]) * 16 AS sat FROM g)"""


@query(
    "j27_g3_inserts",
    f"""WITH {_PICTURES}, d AS (SELECT video, max(t) + 1.0 AS dur, least(60, greatest(20, 0.15 * (max(t) + 1.0)))::DOUBLE AS w, list_transform(range(8), lambda k: 0) AS z FROM f GROUP BY 1),
    m AS (SELECT video, list(v ORDER BY k) AS mean FROM (SELECT video, k, avg(v) AS v FROM (SELECT video, unnest(range(8)) AS k, unnest(hist) AS v FROM f) GROUP BY 1, 2) GROUP BY 1),
    c AS (SELECT video, 3 * (t // 3) + (video % 2) * 0.5 AS at_ FROM f UNION SELECT video, 0.0 FROM d UNION SELECT video, dur FROM d), c1 AS (SELECT DISTINCT c.video, at_ FROM c JOIN d ON d.video = c.video WHERE at_ BETWEEN 0 AND dur),
    s AS (SELECT * FROM (SELECT video, at_ AS a, lead(at_) OVER (PARTITION BY video ORDER BY at_) AS b FROM c1) WHERE b - a BETWEEN 0.4 AND 4),
    i AS (SELECT s.video, s.a, s.b, f.t, f.bits, f.flat, f.sat, 0.5 * list_sum(list_transform(list_zip(f.hist, m.mean), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / (z[1] + z[2] + 1e-6))) AS chi FROM s JOIN f ON f.video = s.video AND f.t >= s.a AND f.t < s.b JOIN m ON m.video = s.video),
    far AS (SELECT i.video, i.t FROM i JOIN f ON f.video = i.video AND (f.t < floor(i.a) - 2 OR f.t >= floor(i.b) + 3) WHERE i.chi > 0.5 AND i.flat < 0.06 AND i.sat > 0.35
      GROUP BY i.video, i.t HAVING min(len(list_filter(list_zip(i.bits, f.bits), lambda z: z[1] <> z[2]))) >= 24),
    n AS (SELECT i.video, i.a, i.b, count(*) AS seconds, count(far.t) AS odd FROM i LEFT JOIN far ON far.video = i.video AND far.t = i.t GROUP BY 1, 2, 3),
    card AS (SELECT f.video, f.t FROM f JOIN d ON d.video = f.video WHERE f.t < floor(d.w) AND f.flat < 0.04 AND f.sat > 0.35)
    SELECT n.video, n.a, n.b, n.seconds, n.odd FROM n JOIN d ON d.video = n.video WHERE 2 * odd >= seconds AND NOT EXISTS (SELECT 1 FROM card k WHERE k.video = n.video AND n.a < floor(d.w) AND n.a >= k.t AND n.a < k.t + 1)""",
)
def j27(spark, sf_dir):
    rows = pictures(spark, sf_dir)
    cuts = rows.select("video", (F.floor(F.col("t") / 3) * 3 + F.col("video") % 2 * 0.5).alias("at"))
    return frames.inserts(rows, cuts, BINS).select("video", "a", "b", "seconds", "odd")

"""Style distances, over the driver's embeddings as profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import style
from ..sources.tables import VIDEOS, table, videos
from .registry import query

#: Eight vectors in a row are a style: the first is the target, three are its references, the others candidates.
_FIELDS = {
    "duration": "60 + 600 * abs({2})", "cuts_per_min": "20 * abs({1})", "avg_shot": "10 * abs({14})", "median_shot": "10 * abs({15})", "zooms_per_min": "5 * abs({16})", "avg_zoom": "1 + 2 * abs({17})",
    "pauses": "floor(20 * abs({18}))", "pause_p75": "abs({30})", "silence": "abs({31})", "captions": "2 * abs({32})", "lufs": "CASE WHEN {36} > -0.15 THEN -14 - 20 * abs({35}) END",
    "caption_pos": "CASE WHEN {34} > 0 THEN 'top' ELSE 'bottom' END",
}


def _fields(cell: str) -> dict[str, str]:
    cells = [cell.format(i) for i in range(64)]
    return {k: v.format(*cells) for k, v in _FIELDS.items()}


def profiles(spark, sf_dir):
    x = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").where("vec_id is not null").select((F.floor(F.col("vec_id") / 8)).alias("key"), F.col("vec_id").alias("id"), (F.col("vec_id") % 8).alias("role"), x.alias("x"))
    ten = lambda first, test: F.when(F.get("x", F.lit(test)) > -0.1, F.array_sort(F.transform(F.slice("x", first + 1, 10), lambda v: 10 * F.abs(v))))
    fields = {k: F.expr(v).cast("string" if k == "caption_pos" else "double") for k, v in _fields("x[{}]").items()}
    fields |= {"shot_deciles": ten(3, 13), "pause_deciles": ten(19, 29), "caption_color": F.concat(F.lit("#"), F.lpad(F.hex(F.floor(F.abs(F.get("x", F.lit(33))) * 16000000).cast("long")), 6, "0"))}
    names = [f.split()[0] for f in style.PROFILE.split(", ")]
    return rows.select("key", "id", "role", F.struct(*[fields[n].alias(n) for n in names]).alias("profile"))


def _parts_sql(a: str, b: str) -> list[str]:
    x, y = (lambda k: f"{a}.{k}"), (lambda k: f"{b}.{k}")
    lr = lambda p, q, floor=0.05: f"abs(ln(greatest({p}, {floor}) / greatest({q}, {floor})))"
    rel = lambda p, q, floor: f"least(1.0, abs({p} - {q}) / greatest(abs({p}), abs({q}), {floor}))"
    once, ten = f"(60 / {y('duration')})", lambda k: f"list_sum(list_transform(list_zip({x(k)}, {y(k)}), lambda z: {lr('z[1]', 'z[2]')})) / 10"
    ra, rb = x("cuts_per_min"), y("cuts_per_min")
    near = f"CASE WHEN abs({rb} - {ra}) <= {once} THEN {ra} ELSE {rb} - sign({rb} - {ra}) * {once} END"
    rhythm = f"CASE WHEN least({ra} * {x('duration')}, {rb} * {y('duration')}) / 60 < 3 THEN {lr(ra, near, 0.5)} WHEN {x('shot_deciles')} IS NOT NULL AND {y('shot_deciles')} IS NOT NULL THEN {ten('shot_deciles')} ELSE ({lr(x('avg_shot'), y('avg_shot'))} + {lr(x('median_shot'), y('median_shot'))}) / 2 END"
    za, zb = x("zooms_per_min"), y("zooms_per_min")
    often = f"least(1.0, greatest(0.0, abs({za} - {zb}) - {once}) / greatest({za}, {zb}, 0.5))"
    zoom = f"CASE WHEN {za} >= 0.3 AND {zb} >= 0.3 THEN 0.7 * {often} + 0.3 * {rel(x('avg_zoom') + ' - 1', y('avg_zoom') + ' - 1', 0.1)} ELSE {often} END".replace("abs(a.avg_zoom - 1 - b.avg_zoom - 1)", "abs(a.avg_zoom - b.avg_zoom)")
    na, nb = x("pauses"), y("pauses")
    gaps = f"CASE WHEN {na} <= 0 AND {nb} <= 0 THEN 0.0 WHEN {na} <= 0 OR {nb} <= 0 THEN 1.0 WHEN {x('pause_deciles')} IS NOT NULL AND {y('pause_deciles')} IS NOT NULL THEN {ten('pause_deciles')} ELSE {lr(x('pause_p75'), y('pause_p75'))} END"
    pauses = f"0.7 * least(1.0, {gaps}) + 0.3 * {rel(x('silence'), y('silence'), 0.05)}"
    ca, cb, amount = x("captions"), y("captions"), rel(x("captions"), y("captions"), 0.1)
    color = f"least(1.0, sqrt(pow(({x('c')} >> 16) - ({y('c')} >> 16), 2) + pow((({x('c')} >> 8) & 255) - (({y('c')} >> 8) & 255), 2) + pow(({x('c')} & 255) - ({y('c')} & 255), 2)) / 255)"
    captions = f"CASE WHEN {ca} >= 0.1 AND {cb} >= 0.1 THEN 0.5 * {amount} + 0.25 * ({x('caption_pos')} <> {y('caption_pos')})::INT + 0.25 * {color} ELSE {amount} END"
    sound = f"abs({x('lufs')} - {y('lufs')}) / 10"
    return [f"CASE WHEN ({d}) IS NULL THEN NULL ELSE least(1.0, greatest(0.0, {d})) END" for d in (rhythm, zoom, pauses, captions, sound)]


def _rounds(n: int) -> str:
    """Water-filling of weights w under cap: full parts keep the cap, what is left goes to the others; n rounds."""
    share = "list_transform(range(1, 6), lambda i: CASE WHEN NOT u[i] THEN 0.0 WHEN full_[i] THEN cap WHEN lw > 0 THEN w[i] / lw * l ELSE 0.0 END)"
    step = lambda k: f"""r{k} AS (SELECT * REPLACE ({share} AS o) FROM (SELECT *, 1 - cap * len(list_filter(full_, lambda f: f)) AS l, list_sum(list_transform(range(1, 6), lambda i: CASE WHEN u[i] AND NOT full_[i] THEN w[i] ELSE 0.0 END)) AS lw
      FROM (SELECT * EXCLUDE (l, lw) REPLACE (list_transform(range(1, 6), lambda i: full_[i] OR (u[i] AND o[i] > cap + 1e-9)) AS full_) FROM r{k - 1})))"""  # noqa: E731
    return ",\n    ".join(step(k) for k in range(1, n + 1))


_S = "list_sort(list_transform(embedding[{}:{}], lambda v: 10 * abs(v::DOUBLE)))"
_SHIFTED = {k: v.format(*[f"embedding[{i + 1}]::DOUBLE" for i in range(64)]) for k, v in _FIELDS.items()}
_PROFILES = f"""p AS (SELECT vec_id // 8 AS key, vec_id AS id, vec_id % 8 AS role, {', '.join(f'{v} AS {k}' for k, v in _SHIFTED.items())}, floor(abs(embedding[34]::DOUBLE) * 16000000)::BIGINT AS c,
  CASE WHEN embedding[14] > -0.1::FLOAT THEN {_S.format(4, 13)} END AS shot_deciles, CASE WHEN embedding[30] > -0.1::FLOAT THEN {_S.format(20, 29)} END AS pause_deciles FROM embeddings)"""


@query(
    "n11_style_distance",
    f"""WITH {_PROFILES}, t AS (SELECT * FROM p WHERE role = 0),
    m AS (SELECT a.key, count(*) AS n, {', '.join(f'avg(pow({d}, 2)) AS m{i}' for i, d in enumerate(_parts_sql('a', 'b')))} FROM t a JOIN p b ON a.key = b.key AND b.role BETWEEN 1 AND 3 GROUP BY 1),
    s AS (SELECT key, n, list_transform([m0, m1, m2, m3, m4], lambda v: CASE WHEN v IS NOT NULL THEN 1 / greatest(0.08, sqrt(v)) END) AS s FROM m),
    v AS (SELECT t.key, CASE WHEN n >= 2 THEN list_transform(s, lambda x: coalesce(x, list_avg(s))) ELSE [0.3, 0.2, 0.2, 0.2, 0.1] END AS w FROM t LEFT JOIN s ON s.key = t.key),
    q AS (SELECT a.key, b.id, [{', '.join(_parts_sql('a', 'b'))}] AS d FROM t a JOIN p b ON a.key = b.key AND b.role >= 4),
    r0 AS (SELECT q.*, w, [x IS NOT NULL for x in d] AS u, greatest(0.35, 1.0 / len(list_filter(d, lambda x: x IS NOT NULL))) AS cap, [false, false, false, false, false] AS full_, [0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS o, 0.0::DOUBLE AS l, 0.0::DOUBLE AS lw FROM q JOIN v ON v.key = q.key),
    {_rounds(6)}
    SELECT key, id, round(list_sum(list_transform(list_zip(o, d), lambda z: z[1] * coalesce(z[2], 0.0))), 5) AS distance, round(o[1], 5) AS rhythm_share, round(o[5], 5) AS sound_share, round(d[1], 5) AS rhythm, round(d[4], 5) AS captions FROM r6""",
)
def n11(spark, sf_dir):
    rows = profiles(spark, sf_dir)
    got = style.style_distance(rows.where("role = 0"), rows.where("role between 1 and 3"), rows.where("role >= 4"))
    cell = lambda c, i: F.round(F.get(c, F.lit(i)), 5)
    return got.select("key", "id", F.round("distance", 5).alias("distance"), cell("shares", 0).alias("rhythm_share"), cell("shares", 4).alias("sound_share"), cell("parts", 0).alias("rhythm"), cell("parts", 3).alias("captions"))


_HOURS = "(pub - 1704067200000000) / 3600e6"


@query(
    "g5_timeline_profiles",
    f"""WITH {VIDEOS}, e AS (SELECT channel AS video, fmt, views, {_HOURS} AS at_ FROM v), l AS (SELECT video, max(at_) + 1 AS dur FROM e GROUP BY 1), m AS (SELECT DISTINCT e.video, at_ FROM e JOIN l ON l.video = e.video WHERE fmt = 'view' AND at_ > 0 AND at_ < dur UNION ALL SELECT video, 0.0 FROM l UNION ALL SELECT video, dur FROM l),
    s AS (SELECT video, lead(at_) OVER (PARTITION BY video ORDER BY at_) - at_ AS n FROM m QUALIFY n IS NOT NULL), p AS (SELECT video, views / 50 AS n FROM e WHERE fmt = 'click'), c AS (SELECT video, at_ AS a, at_ + 5 AS b, CASE WHEN views > 40 THEN 'red' ELSE 'white' END AS color FROM e WHERE fmt = 'purchase'),
    c0 AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY video ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM c), c1 AS (SELECT *, sum(new) OVER (PARTITION BY video ORDER BY a ROWS UNBOUNDED PRECEDING) AS g FROM c0), c2 AS (SELECT video, sum(t) AS shown FROM (SELECT video, max(b) - min(a) AS t FROM c1 GROUP BY video, g) GROUP BY 1),
    cc AS (SELECT video, arg_max(color, [t, CASE color WHEN 'white' THEN 1 ELSE 0 END]) AS color FROM (SELECT video, color, sum(b - a) AS t FROM c GROUP BY 1, 2) GROUP BY 1),
    sa AS (SELECT video, avg(n) AS avg_shot, median(n) AS med, count(*) - 1 AS cuts FROM s GROUP BY 1), pa AS (SELECT video, count(*) AS pauses, sum(n) AS silent, list_sort(list(n))[(floor(count(*) * 0.75) + 1)::INT] AS p75 FROM p GROUP BY 1),
    z AS (SELECT video, count(*) AS zooms, avg(CASE WHEN views / 40 > 1 THEN views / 40 END) AS scale FROM e WHERE fmt = 'signup' GROUP BY 1)
    SELECT l.video, round(cuts * 60 / dur, 2) AS cuts_per_min, round(avg_shot, 2) AS avg_shot, round(med, 2) AS median_shot, 10 AS shot_deciles, round(coalesce(zooms, 0) * 60 / dur, 2) AS zooms_per_min, round(coalesce(scale, 1.2), 2) AS avg_zoom, coalesce(pauses, 0)::DOUBLE AS pauses, round(coalesce(p75, 0.4), 2) AS pause_p75,
    round(coalesce(silent, 0) / dur, 3) AS silence, round(coalesce(shown, 0) / dur, 2) AS captions, color AS caption_color FROM l LEFT JOIN sa ON sa.video = l.video LEFT JOIN pa ON pa.video = l.video LEFT JOIN z ON z.video = l.video LEFT JOIN c2 ON c2.video = l.video LEFT JOIN cc ON cc.video = l.video""",
)
def g5(spark, sf_dir):
    """A user's events as a timeline in hours: views are cuts, clicks pauses, purchases captions of five hours, signups zooms."""
    at = (F.col("pub") - 1704067200000000) / 3600e6
    rows = videos(spark, sf_dir).select(F.col("channel").alias("video"), "fmt", "views", at.alias("at"))
    lengths = rows.groupBy("video").agg((F.max("at") + 1).alias("dur")).withColumn("lufs", F.lit(None).cast("double"))
    pauses = rows.where("fmt = 'click'").select("video", F.lit(0.0).alias("a"), (F.col("views") / 50).alias("b"))
    captions = rows.where("fmt = 'purchase'").select("video", F.col("at").alias("a"), (F.col("at") + 5).alias("b"), F.when(F.col("views") > 40, "red").otherwise("white").alias("color"), F.lit("bottom").alias("pos"))
    zooms = rows.where("fmt = 'signup'").select("video", "at", (F.col("views") / 40).alias("scale"))
    got = style.timeline_profiles(lengths, rows.where("fmt = 'view'").select("video", "at"), zooms, pauses, captions).select("video", "profile.*")
    return got.select("video", "cuts_per_min", "avg_shot", "median_shot", F.size("shot_deciles").alias("shot_deciles"), "zooms_per_min", "avg_zoom", "pauses", "pause_p75", "silence", "captions", "caption_color")

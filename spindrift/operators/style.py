"""How alike two style profiles are: distances by part, weighted by how steady each part is among the references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import decile_distance, log_ratio, relative, rounded
from .intervals import merge_intervals
from .relational import in_blocks, joined, numbered
from .stats import exact_quantiles

#: The parts, their weights with a single reference, the least spread, the greatest share of a part.
PARTS = ["rhythm", "zoom", "pauses", "captions", "sound"]
BASE = [0.3, 0.2, 0.2, 0.2, 0.1]
LEAST_SPREAD, MOST_SHARE = 0.08, 0.35
FEW_CUTS, LEAST_RATE, LEAST_LENGTH, QUANTILES = 3, 0.5, 0.05, 10
PROFILE = (
    "duration double, cuts_per_min double, shot_deciles array<double>, avg_shot double, median_shot double, zooms_per_min double, avg_zoom double, "
    "pauses double, pause_deciles array<double>, pause_p75 double, silence double, captions double, caption_color string, caption_pos string, lufs double"
)


def _or(c: Column, other: float) -> Column:
    return F.coalesce(c, F.lit(other))


def _share(a: Column, b: Column, floor: float) -> Column:
    return F.least(F.lit(1.0), relative(_or(a, 0.0), _or(b, 0.0), floor))


def _rgb(c: Column) -> Column:
    hexes = F.regexp_extract(F.coalesce(c, F.lit("")), "^#?([0-9A-Fa-f]{6})$", 1)
    parts = F.array(*[F.conv(F.substring(hexes, 2 * k + 1, 2), 16, 10).cast("double") for k in range(3)])
    return F.when(hexes != "", parts)


def part_distances(a: str, b: str, *, no_zooms: bool = False, no_captions: bool = False) -> Column:
    """Distances of profiles ``a`` and ``b`` (struct columns as ``PROFILE``) by part, an array in the order of ``PARTS``: 0 the
    same, 1 quite another, null where they cannot be compared.  Quantiles are compared where both have them, else means.
    With ``no_zooms`` or ``no_captions``, a style without them is not missed in ``b``."""
    x, y = (lambda k: F.col(f"{a}.{k}")), (lambda k: F.col(f"{b}.{k}"))
    once = F.when(_or(y("duration"), 0.0) > 0, 60 / y("duration")).otherwise(0.0)  # one event more or less is let pass
    deciles = lambda k: (F.size(x(k)) == QUANTILES) & (F.size(y(k)) == QUANTILES)
    ra, rb = _or(x("cuts_per_min"), 0.0), _or(y("cuts_per_min"), 0.0)
    near = F.when(F.abs(rb - ra) <= once, ra).otherwise(rb - F.signum(rb - ra) * once)
    few = F.least(ra * _or(x("duration"), 0.0) / 60, rb * _or(y("duration"), 0.0) / 60) < FEW_CUTS
    means = (F.abs(log_ratio(_or(x("avg_shot"), 1.0), _or(y("avg_shot"), 1.0), LEAST_LENGTH)) + F.abs(log_ratio(_or(x("median_shot"), 1.0), _or(y("median_shot"), 1.0), LEAST_LENGTH))) / 2
    rhythm = F.when(few, F.abs(log_ratio(ra, near, LEAST_RATE))).when(deciles("shot_deciles"), decile_distance(x("shot_deciles"), y("shot_deciles"), LEAST_LENGTH)).otherwise(means)
    za, zb = _or(x("zooms_per_min"), 0.0), _or(y("zooms_per_min"), 0.0)
    often = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.abs(za - zb) - once) / F.greatest(F.abs(za), F.abs(zb), F.lit(0.5)))
    often = F.when(zb <= 0, 0.0).otherwise(often) if no_zooms else often
    zoom = F.when((za >= 0.3) & (zb >= 0.3), 0.7 * often + 0.3 * _share(_or(x("avg_zoom"), 1.2) - 1, _or(y("avg_zoom"), 1.2) - 1, 0.1)).otherwise(often)
    na, nb = _or(x("pauses"), 0.0), _or(y("pauses"), 0.0)
    gaps = F.when((na <= 0) & (nb <= 0), 0.0).when((na <= 0) | (nb <= 0), 1.0).when(deciles("pause_deciles"), decile_distance(x("pause_deciles"), y("pause_deciles"), LEAST_LENGTH))
    gaps = gaps.otherwise(F.abs(log_ratio(_or(x("pause_p75"), 0.4), _or(y("pause_p75"), 0.4), LEAST_LENGTH)))
    pauses = 0.7 * F.least(F.lit(1.0), gaps) + 0.3 * _share(x("silence"), y("silence"), 0.05)
    ca, cb = _or(x("captions"), 0.0), _or(y("captions"), 0.0)
    amount = _share(ca, cb, 0.1)
    squares = F.aggregate(F.zip_with(_rgb(x("caption_color")), _rgb(y("caption_color")), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    color = F.when(squares.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.sqrt(squares) / 255))
    place = F.when(x("caption_pos").eqNullSafe(y("caption_pos")), 0.0).otherwise(1.0)
    plain = F.when(cb < 0.1, 0.0).otherwise(amount) if no_captions else amount
    captions = F.when((ca >= 0.1) & (cb >= 0.1), 0.5 * amount + 0.25 * place + 0.25 * color).otherwise(plain)
    sound = F.abs(x("lufs") - y("lufs")) / 10
    within = lambda d: F.when(d.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), d)))
    return F.array(*[within(d) for d in (rhythm, zoom, pauses, captions, sound)])


def capped(weights: Column, use: Column, most: float = MOST_SHARE) -> Column:
    """Weights of the parts in ``use`` (array of booleans) that sum to 1, none above ``most`` (or an even share, if that is
    more): what is over goes to the others in proportion, again and again until none is over; 0 for the others.

    Each round caps one part at least, so as many rounds as there are parts reach the fixpoint."""
    some = F.size(F.filter(use, lambda u: u)).cast("double")
    cap = F.greatest(F.lit(most), 1 / some)
    total = lambda cells, f: F.aggregate(F.transform(cells, f), F.lit(0.0), lambda s, v: s + v)
    whole = total(F.zip_with(weights, use, lambda w, u: F.when(u, w).otherwise(0.0)), lambda v: v)
    cells = F.zip_with(weights, use, lambda w, u: F.struct(F.when(whole > 0, w).otherwise(1.0).alias("w"), u.alias("u"), F.lit(False).alias("full"), F.lit(0.0).alias("out")))

    def shared(cells: Column) -> Column:
        rest = lambda c: c["u"] & ~c["full"]
        left = 1 - total(cells, lambda c: F.when(c["full"], cap).otherwise(0.0))
        weight = total(cells, lambda c: F.when(rest(c), c["w"]).otherwise(0.0))
        count = total(cells, lambda c: F.when(rest(c), 1.0).otherwise(0.0))
        out = lambda c: F.when(c["full"], cap).when(rest(c), F.when(weight > 0, c["w"] / F.nullif(weight, F.lit(0.0)) * left).otherwise(left / F.nullif(count, F.lit(0.0)))).otherwise(0.0)
        return F.transform(cells, lambda c: F.struct(c["w"].alias("w"), c["u"].alias("u"), c["full"].alias("full"), F.coalesce(out(c), F.lit(0.0)).alias("out")))

    def round_(cells: Column, _: Column) -> Column:
        return shared(F.transform(cells, lambda c: F.struct(c["w"].alias("w"), c["u"].alias("u"), (c["full"] | (c["u"] & (c["out"] > cap + 1e-9))).alias("full"), c["out"].alias("out"))))

    done = F.aggregate(F.sequence(F.lit(1), F.size(weights)), shared(cells), round_)
    return F.transform(done, lambda c: c["out"])


def weights(targets: DataFrame, references: DataFrame) -> DataFrame:
    """key, weights: of each target (key, profile) from its references (key, profile): a part's is 1 over its spread among them
    (root of the mean square distance to the target); the base weights with fewer than two."""
    pairs = targets.select("key", F.col("profile").alias("_a")).join(references.select("key", F.col("profile").alias("_b")), "key").withColumn("_d", part_distances("_a", "_b"))
    squares = [F.avg(F.pow(F.get("_d", F.lit(i)), 2)).alias(f"m{i}") for i in range(len(PARTS))]
    spread = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *squares).where("n >= 2")
    steady = F.array(*[1 / F.greatest(F.lit(LEAST_SPREAD), F.sqrt(f"m{i}")) for i in range(len(PARTS))])
    steady = F.array(*[F.when(F.col(f"m{i}").isNotNull(), F.get(steady, F.lit(i))) for i in range(len(PARTS))])
    known = F.filter("_s", lambda v: v.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.size(known)).otherwise(1.0)
    found = spread.withColumn("_s", steady).select("key", F.transform("_s", lambda v: F.coalesce(v, mean)).alias("weights"))
    base = F.array(*[F.lit(b) for b in BASE])
    return targets.select("key").join(found, "key", "left").select("key", F.coalesce("weights", base).alias("weights"))


def style_distance(targets: DataFrame, references: DataFrame, candidates: DataFrame, *, fixed: Sequence[str] = (), no_zooms: bool = False, no_captions: bool = False) -> DataFrame:
    """Candidates (key, id, profile) against their key's target (key, profile; one each): ``key, id, score`` (0 to 100), ``distance``,
    ``parts`` (0 to 1, null unknown) and ``shares`` (the weights used).  Parts in ``fixed`` count for nothing."""
    aims = targets.select("key", F.col("profile").alias("_a")).join(weights(targets, references), "key")
    rows = candidates.select("key", "id", F.col("profile").alias("_b")).join(aims, "key")
    rows = rows.withColumn("parts", part_distances("_a", "_b", no_zooms=no_zooms, no_captions=no_captions))
    free = F.array(*[F.lit(p not in fixed) for p in PARTS])
    rows = rows.withColumn("shares", capped(F.col("weights"), F.zip_with("parts", free, lambda d, f: d.isNotNull() & f)))
    total = F.aggregate(F.zip_with("shares", "parts", lambda w, d: w * F.coalesce(d, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    return rows.withColumn("distance", total).select("key", "id", F.bround(100 * (1 - F.col("distance"))).cast("long").alias("score"), "distance", "parts", "shares")


def habits(pictures: DataFrame, key: str, least_text: float = 0.0) -> DataFrame:
    """What a channel's pictures (key, text_h, lines, pos, accent, mode, face) usually look like, one row each.

    ``n`` pictures, ``with_text`` of them (taller than ``least_text``); of those the median height and number of lines, the most
    frequent place (ties: from the top), accent (black is none; ties: white) and mode (ties: the last letter); of
    pictures with a face its median size.  Values are counted before they are compared, so a channel's pictures never
    meet in one row but for the medians' counts."""
    some = F.col("text_h") > least_text
    # the counts of each value are what an exact median needs
    cells = lambda value, test: pictures.where(test & F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c")).groupBy(key).agg(F.percentile("v", F.lit(0.5), F.col("c")).alias(value))
    most = lambda value, test, order: pictures.where(test).groupBy(key, value).agg(F.count(F.lit(1)).alias("c")).groupBy(key).agg(F.max_by(value, F.struct("c", order)).alias(value))
    out = pictures.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(some).alias("with_text"))
    top_first = F.when(F.col("pos") == "top", 3).when(F.col("pos") == "middle", 2).otherwise(1)
    parts = [
        cells("text_h", some).withColumn("text_h", F.round("text_h", 3)), cells("lines", some & (F.col("lines") > 0)).withColumn("lines", F.round("lines", 1)), cells("face", F.col("face") > 0).withColumn("face", F.round("face", 3)),
        most("pos", some, top_first), most("accent", some & (F.col("accent") != "black"), F.when(F.col("accent") == "white", 2).otherwise(1)), most("mode", some, F.ascii("mode")),
    ]
    for part in parts:
        out = out.join(part, key, "left")
    return out


#: The shares at which lengths are compared, what stands in where a profile has none of its kind.
TENTHS = [round(0.05 + 0.1 * k, 2) for k in range(QUANTILES)]
NO_PAUSE, NO_ZOOM = 0.4, 1.2


def _lengths(rows: DataFrame, key: str, name: str) -> DataFrame:
    """key, <name>_deciles of ``length``, and how many."""
    found = exact_quantiles(rows, [key], "length", TENTHS)
    cells = F.transform(F.array_sort(F.collect_list(F.struct("share", rounded("quantile", 2).alias("q")))), lambda x: x["q"])
    return found.groupBy(key).agg(cells.alias(f"{name}_deciles"))


def timeline_profiles(lengths: DataFrame, cuts: DataFrame, zooms: DataFrame, silences: DataFrame, captions: DataFrame, *, key: str = "video", bucket: float = 600.0) -> DataFrame:
    """key, profile (as ``PROFILE``): a style profile of each recording's timeline.

    ``lengths``: key, dur, lufs.  ``cuts``: key, at.  ``zooms``: key, at, scale.  ``silences``: key, a, b.  ``captions``: key, a, b, color, pos.
    Shots lie between 0, the cuts and the end; captions cover what their spans do together; colour and place are those that
    stand longest (ties: by name).  Lengths' quantiles come by counts of cells, so long recordings are dealt out."""
    base = lengths.where("dur > 0").select(key, F.col("dur").cast("double").alias("duration"), "lufs")
    marks = joined(cuts.select(key, F.col("at").cast("double").alias("at")).distinct(), base, [key]).where((F.col("at") > 0) & (F.col("at") < F.col("duration"))).select(key, "at")
    every = marks.unionByName(base.select(key, F.explode(F.array(F.lit(0.0), F.col("duration"))).alias("at")))
    rows = in_blocks(numbered(every, [key], "at", ["at"], bucket, number="num"), "num", back=0, ahead=1)
    shots = rows.withColumn("length", F.lead("at").over(Window.partitionBy(key, "_block").orderBy("num")) - F.col("at")).where("_mine and length is not null").select(key, "length")
    pauses = silences.select(key, F.greatest(F.lit(0.0), (F.col("b") - F.col("a")).cast("double")).alias("length"))
    shot = shots.groupBy(key).agg(F.avg("length").alias("avg_shot"), (F.count(F.lit(1)) - 1).alias("_cuts"))
    middle = exact_quantiles(shots, [key], "length", [0.5]).select(key, F.col("quantile").alias("median_shot"))
    zoom = zooms.groupBy(key).agg(F.count(F.lit(1)).alias("_zooms"), F.avg(F.when(F.col("scale") > 1, F.col("scale"))).alias("avg_zoom"))
    many = pauses.groupBy(key).agg(F.count(F.lit(1)).alias("pauses"), F.sum("length").alias("_silent"))
    ranked = joined(numbered(pauses, [key], "length", ["length"], 0.5, number="_k"), many, [key])
    upper = ranked.where(F.col("_k") == F.floor(F.col("pauses") * 0.75) + 1).select(key, F.col("length").alias("pause_p75"))
    shown = merge_intervals(captions, keys=[key], start="a", stop="b", bucket=bucket).groupBy(key).agg(F.sum(F.col("stop") - F.col("start")).alias("_shown"))
    stands = lambda c: captions.where(F.col(c).isNotNull()).groupBy(key, c).agg(F.sum(F.col("b") - F.col("a")).alias("_t")).groupBy(key).agg(F.max_by(c, F.struct("_t", c)).alias(f"caption_{c}"))
    out = base
    for part in (shot, middle, _lengths(shots, key, "shot"), zoom, many, upper, _lengths(pauses, key, "pause"), shown, stands("color"), stands("pos")):
        out = out.join(part, key, "left")
    rate = lambda c: rounded(F.coalesce(c, F.lit(0)) * 60 / F.col("duration"), 2)
    cells = {
        "duration": rounded("duration", 1), "cuts_per_min": rate("_cuts"), "shot_deciles": F.col("shot_deciles"), "avg_shot": rounded("avg_shot", 2), "median_shot": rounded("median_shot", 2), "zooms_per_min": rate("_zooms"), "avg_zoom": rounded(F.coalesce("avg_zoom", F.lit(NO_ZOOM)), 2),
        "pauses": F.coalesce("pauses", F.lit(0)).cast("double"), "pause_deciles": F.coalesce("pause_deciles", F.array().cast("array<double>")), "pause_p75": rounded(F.coalesce("pause_p75", F.lit(NO_PAUSE)), 2), "silence": rounded(F.coalesce("_silent", F.lit(0.0)) / F.col("duration"), 3),
        "captions": rounded(F.coalesce("_shown", F.lit(0.0)) / F.col("duration"), 2), "caption_color": F.col("caption_color"), "caption_pos": F.col("caption_pos"), "lufs": F.col("lufs").cast("double"),
    }
    return out.select(key, F.struct(*[cells[f.split()[0]].alias(f.split()[0]) for f in PROFILE.split(", ")]).alias("profile"))

"""How good a frame is for a picture, from the people and the ball found in it.

People are an array of boxes (x, y, w, h: shares of the picture), in the order in which they were found; the ball is such a
box or null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multipliers by number of people, by height of the tallest, of a ball, of a duel.
BY_NUMBER, MORE, NOBODY = {1: 1.06, 2: 1.12, 3: 1.1, 4: 1.04, 5: 0.98, 6: 0.94}, 0.9, 0.85
FIT, TALL, SHORT = 1.15, 1.05, 0.9
BALL, AT_FEET, FEET_NEAR, DUEL, LEVEL = 1.25, 0.15, 0.15, 1.08, 0.35
LARGE = 0.6


def _feet(p: Column, ball: Column) -> Column:
    """Squared distance of a person's feet from the middle of the ball."""
    dx, dy = p["x"] + p["w"] / 2 - (ball["x"] + ball["w"] / 2), p["y"] + p["h"] - (ball["y"] + ball["h"] / 2)
    return dx * dx + dy * dy


def action(people: Column, ball: Column) -> Column:
    """Multiplier of a scene with action: two people, of fitting size, a ball, near someone's feet, two who vie for it.  1 if
    nobody looked for people (null)."""
    n = F.size(people)
    number = F.coalesce(*[F.when(n == k, v) for k, v in BY_NUMBER.items()], F.lit(MORE))
    tallest = F.array_max(F.transform(people, lambda p: p["h"]))
    size = F.when(tallest.between(0.15, LARGE), FIT).when(tallest > LARGE, TALL).otherwise(SHORT)
    near = F.sqrt(F.array_min(F.transform(people, lambda p: _feet(p, ball))))
    with_ball = F.when(ball.isNotNull(), BALL * (1 + AT_FEET * F.greatest(F.lit(0.0), 1 - near / FEET_NEAR))).otherwise(1.0)
    vie = lambda a, b: (F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]) > 0) & (F.abs(a["y"] + a["h"] - b["y"] - b["h"]) < F.greatest(a["h"], b["h"]) * LEVEL)
    numbered = F.transform(people, lambda p, i: F.struct(i.alias("i"), p["x"].alias("x"), p["y"].alias("y"), p["w"].alias("w"), p["h"].alias("h")))
    duel = F.exists(numbered, lambda a: F.exists(numbered, lambda b: (b["i"] > a["i"]) & vie(a, b)))
    return F.when(people.isNull(), 1.0).when(n == 0, NOBODY).otherwise(F.round(number * size * with_ball * F.when(duel, DUEL).otherwise(1.0), 4))


def main_person(people: Column, ball: Column) -> Column:
    """Place (from 0) of the one that the picture is of: the tallest if very large, else whose feet are nearest to the ball,
    without one the tallest; of equal ones the first.  -1 without people."""
    tallest = F.array_max(F.transform(people, lambda p: p["h"]))
    first = lambda found: F.array_position(found, True).cast("int") - 1
    big = first(F.transform(people, lambda p: p["h"] == tallest))
    nearest = F.array_min(F.transform(people, lambda p: _feet(p, ball)))
    feet = first(F.transform(people, lambda p: _feet(p, ball) == nearest))
    return F.when(F.coalesce(F.size(people), F.lit(0)) <= 0, -1).when((tallest >= LARGE) | ball.isNull(), big).otherwise(feet)


def protagonist(people: Column, main: Column) -> Column:
    """Multiplier of a picture that is clearly of one person: up to 1.25 by their height, a tenth less for each other of at
    least 0.7 of it, 0.75 of that at the least; 1 without one."""
    h = F.get(people, main)["h"]
    rivals = F.size(F.filter(people, lambda p, i: (i != main) & (p["h"] >= 0.7 * h)))
    return F.when(main < 0, 1.0).otherwise(F.round((1 + 0.25 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (h - 0.3) / 0.4))) * F.greatest(F.lit(0.75), F.pow(F.lit(0.9), rivals)), 4))

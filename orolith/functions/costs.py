"""Travel-cost models as column expressions, directed, at a scale of 30 m a pixel.

A model's step cost takes the columns x1, y1, z1, lc1 (source) and x2, y2, z2 (target), in pixels and metres; lc is the
landcover class of the source. Joined to lines, step costs are summed per edge.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = 30.0
GRADE_LIMIT = 35.0
BARRIER = 1e6

#: Fixed values by landcover class 0 to 19: friction, roughness; by class 1 to 18: terrain factor.
FRICTION = (0.0, 0.504, 0.446, 0.395, 0.453, 0.498, 0.506, 0.547, 0.595, 0.404, 0.447, 0.356, 0.297, 0.344, 0.254, 0.495, 0.705, 0.796, 0.156, 0.147)
ROUGHNESS = (0.0, 66.5142, 40.3429, 109.6633, 66.5142, 40.3429, 66.5142, 24.4692, 14.8413, 5.4598, 3.3115, 9.0017, 2.0086, 109.6633, 1.2182, 0.7389, 298.0958, 0.4482, 0.1649, 0.2718)
TERRAIN = (3.0, 3.0, 3.0, 3.0, 3.0, 3.0, 1.2, 1.5, 1.1, 1.1, 1.2, 1.2, 1.2, 1.8, 1.8, 1.0, 10.0, 5.0)


def material(spark: SparkSession) -> DataFrame:
    """(landcover, mu, rough, terrain_factor): 20 rows; class 0 and 19 have no terrain factor."""
    rows = [(i, FRICTION[i], ROUGHNESS[i], TERRAIN[i - 1] if 1 <= i <= len(TERRAIN) else None) for i in range(len(FRICTION))]
    return spark.createDataFrame(rows, "landcover int, mu double, rough double, terrain_factor double")


def by_class(values: tuple[float, ...], landcover: Column, first: int = 0) -> Column:
    """values[landcover - first], null outside."""
    return F.get(F.array(*map(F.lit, values)), landcover - first)


def distance_2d(scale: float = SCALE) -> Column:
    return scale * F.sqrt((F.col("x2") - F.col("x1")).cast("double") ** 2 + (F.col("y2") - F.col("y1")).cast("double") ** 2)


def _rise() -> Column:
    return F.col("z2").cast("double") - F.col("z1").cast("double")


def vehicle(scale: float = SCALE, limit: float = GRADE_LIMIT, barrier: float = BARRIER) -> Column:
    """Climb, friction, distance, alignment and roughness. Infinite for classes without friction or roughness, the
    barrier above the grade limit, 0 for a step in place. Alignment compares the compass heading with the angle of
    inclination, as the published cost does."""
    d, mu, rough = distance_2d(scale), by_class(FRICTION, F.col("lc1")), by_class(ROUGHNESS, F.col("lc1"))
    run = F.nullif(d, F.lit(0.0))
    slope = _rise() / run
    friction = F.nullif(mu, F.lit(0.0))
    heading = F.pmod(F.degrees(F.atan2((F.col("y2") - F.col("y1")).cast("double"), (F.col("x2") - F.col("x1")).cast("double"))) + 360, F.lit(360.0))
    incline = F.pmod(F.degrees(F.atan2(_rise(), d)) + 360, F.lit(360.0))
    apart = F.pmod(F.abs(heading - incline), F.lit(360.0))
    turn = F.least(apart, 360 - apart)
    climb = F.when(slope > 0, (F.exp(5 * F.abs(slope) / friction) - 1) / 10).otherwise(0.0)
    cost = climb + (1 / friction - 1) / 2 + d + (1 - F.cos(F.radians(turn))) + 0.1 * rough
    return F.when(d == 0, 0.0).when(F.coalesce(mu, F.lit(0.0)) <= 0, float("inf")).when(F.coalesce(rough, F.lit(0.0)) <= 0, float("inf")).when(F.abs(100 * slope) > limit, barrier).otherwise(cost)


def walking_power(terrain: Column, grade: Column, body: float = 85.0, load: float = 8.0, speed: float = 1.8) -> Column:
    """The five-parameter load-carriage power of Pandolf and Santee, with its downhill correction, over four."""
    mass = body + load
    level = 1.5 * body + 2 * mass * (load / body) ** 2
    moving = terrain * mass * (1.5 * speed**2 + 0.35 * speed * grade)
    down = terrain * (speed * grade * mass / 3.5 - mass * (grade + 6) ** 2 / body + 25 * speed**2)
    return (level + moving - F.when(grade < 0, down).otherwise(0.0)) / 4


def grade(scale: float = SCALE) -> Column:
    """Per cent, with a centimetre added to the run so that a step in place is finite."""
    return 100 * _rise() / (distance_2d(scale) + 0.01)


def human(scale: float = SCALE, check: bool = False, most: float = 10.0) -> Column:
    """Walking power at the grade and the source's terrain factor; with check, infinite above `most` per cent. Infinite
    for classes without a terrain factor."""
    power = F.coalesce(walking_power(by_class(TERRAIN, F.col("lc1"), 1), grade(scale)), F.lit(float("inf")))
    return F.when(F.abs(grade(scale)) > most, float("inf")).otherwise(power) if check else power


def euclid_2d(scale: float = SCALE) -> Column:
    return distance_2d(scale)


def euclid_3d(scale: float = SCALE) -> Column:
    return F.sqrt(distance_2d(scale) ** 2 + _rise() ** 2)


def linear_energy(scale: float = SCALE) -> Column:
    """Linear in the grade of the step; classes without a terrain factor cost infinity. The reference's block of
    segments of over 10 per cent from end to end is left out."""
    return F.coalesce(105.765 + by_class(TERRAIN, F.col("lc1"), 1) * 75 * (2.16 + 0.42 * grade(scale)), F.lit(float("inf")))


def legacy_vehicle(scale: float = SCALE) -> Column:
    """An earlier vehicle cost: climbs count both ways, slopes over 0.6 cost a billion."""
    d = distance_2d(scale)
    slope = F.abs(_rise()) / F.nullif(d, F.lit(0.0))
    return F.when(d == 0, 0.0).when(slope > 0.6, 1e9).otherwise(d + F.abs(_rise()))


@dataclass(frozen=True)
class CostModel:
    """A step cost and how lines are walked: swapped lines break ties along the other axis's sign order."""

    name: str
    step: Callable[[], Column]


MODELS = {m.name: m for m in (CostModel("vehicle", vehicle), CostModel("human", human), CostModel("euclid2d", euclid_2d), CostModel("euclid3d", euclid_3d), CostModel("linear", linear_energy), CostModel("legacy", legacy_vehicle))}


def linear_power_fit(spark: SparkSession, run: float = 30.0, terrain: float = 3.0, body: float = 85.0, load: float = 8.0, speed: float = 0.5, n: int = 100) -> DataFrame:
    """(a, b, c): the least-squares quadratic of exact walking power over rises of -10 to 10 m. The exact power is linear
    in the rise, so a is 0 and b, c come from a linear regression."""
    mass = body + load
    rises = spark.range(n).select((-10 + F.col("id") * F.lit(20.0) / (n - 1)).alias("dz"))
    power = 1.5 * body + 2 * mass * (load / body) ** 2 + terrain * mass * (1.5 * speed**2 + 0.35 * speed * F.col("dz") / run * 100)
    return rises.select("dz", power.alias("p")).agg(F.lit(0.0).alias("a"), F.regr_slope("p", "dz").alias("b"), F.regr_intercept("p", "dz").alias("c"))

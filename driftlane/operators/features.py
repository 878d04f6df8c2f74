"""Kinematic and rolling features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane.functions import scalar as S
from driftlane.params import Params
from driftlane.sources.events import SESSION


def kinematics(events: DataFrame, digits: bool = True) -> DataFrame:
    """Adds release_distance, spin axis cosine and sine, flight_time, vaa and haa."""
    d = lambda n: n if digits else None
    c = F.col
    cos, sin = S.circle(c("spin_axis"), d(4))
    return events.withColumns(
        {
            "release_distance": S.distance2(c("release_pos_x"), c("release_pos_z"), d(4)),
            "spin_axis_cos": cos,
            "spin_axis_sin": sin,
            "flight_time": S.flight_time(c("vy0"), c("ay")),
            "vaa": S.approach_angle(c("vz0"), c("az"), c("vy0"), c("ay"), d(3)),
            "haa": S.approach_angle(c("vx0"), c("ax"), c("vy0"), c("ay"), d(3)),
        }
    )


def _last(n: int, partition: list[str]):
    return Window.partitionBy(*partition).orderBy("event_no").rowsBetween(-(n - 1), 0)


def rolling_std(x: Column, n: int, least: int, digits: int | None = None, partition: list[str] = SESSION) -> Column:
    w = _last(n, partition)
    return F.when(F.count(x).over(w) >= least, S.rounded(F.stddev_samp(x).over(w), digits))


def rolling_mean(x: Column, n: int, least: int, digits: int | None = None, partition: list[str] = SESSION) -> Column:
    w = _last(n, partition)
    return F.when(F.count(x).over(w) >= least, S.rounded(F.avg(x).over(w), digits))


def rolling_circular_std(x: Column, n: int, least: int, digits: int | None = None, partition: list[str] = SESSION) -> Column:
    w = _last(n, partition)
    value = S.circular_std(F.avg(F.sin(F.radians(x))).over(w), F.avg(F.cos(F.radians(x))).over(w))
    return F.when(F.count(x).over(w) >= least, S.rounded(value, digits))


def rolling(events: DataFrame) -> DataFrame:
    """Rolling spreads of speed, release point (with their drift) and spin axis over 5 and 10 events."""
    c = F.col
    out = events.withColumns(
        {f"{name}_std_{n}": rolling_std(c(col), n, least, digits) for n, least in ((5, 2), (10, 3)) for name, col, digits in (("speed", "release_speed", 3), ("x", "release_pos_x", 4), ("z", "release_pos_z", 4))}
        | {f"axis_std_{n}": rolling_circular_std(c("spin_axis"), n, least, 3) for n, least in ((5, 2), (10, 3))}
    )
    return out.withColumns({f"drift_{n}": S.distance2(c(f"x_std_{n}"), c(f"z_std_{n}")) for n in (5, 10)})


def value_drop(x: Column, kinds: list[str], p: Params, n: int = 5, least: int = 3, least_early: int = 2) -> Column:
    """How far the rolling mean of a kind lies below its mean early in the session; other kinds get null."""
    part = [*SESSION, "kind"]
    early = F.when(F.col("event_no") <= p.calibration, x)
    w = Window.partitionBy(*part)
    base = F.when(F.count(early).over(w) >= least_early, F.avg(early).over(w))
    return F.when(F.col("kind").isin(kinds) & (F.col("event_no") > p.calibration), base - rolling_mean(x, n, least, partition=part))


def log_trend(events: DataFrame, distance: str, zs: tuple[str, str, str], n: int = 5) -> DataFrame:
    """Causal features: log distance, its rolling mean by kind, the change of that over n appearances, and the size of three z scores."""
    part = [*SESSION, "kind"]
    order = Window.partitionBy(*part).orderBy("event_no")
    out = events.withColumn("log_distance", F.log1p(distance)).withColumn("log_level", rolling_mean(F.col("log_distance"), n, 1, partition=part))
    out = out.withColumn("log_change", F.coalesce(F.col("log_level") - F.lag("log_level", n).over(order), F.lit(0.0)))
    return out.withColumn("z_size", S.rms3(*map(F.col, zs)))


def context(events: DataFrame) -> DataFrame:
    """Features that need no measurement; missing ones are 0."""
    zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    return events.withColumns({"c_event": zero(F.col("event_no")), "c_turn": zero(F.floor((F.col("group_no") - 1) / 9) + 1), "c_third": zero(F.floor((F.col("group_no") - 1) / 3) + 1)})

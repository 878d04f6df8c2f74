"""Scalar column functions. `digits=None` leaves values unrounded; rounding is half-even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Outcome weights of events without a measured value (fixed values).
OUTCOME_WEIGHTS = {
    "walk": 0.69, "hit_by_pitch": 0.72, "single": 0.88, "double": 1.25, "triple": 1.58, "home_run": 2.03,
    "strikeout": 0.0, "field_out": 0.0, "force_out": 0.0, "grounded_into_double_play": 0.0, "sac_fly": 0.0, "sac_bunt": 0.0,
}


def rounded(x: Column, digits: int | None) -> Column:
    return x if digits is None else F.bround(x, digits)


def clean(x: Column) -> Column:
    """NaN and infinities become null."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def is_true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or missing."""
    return F.try_divide(a.cast("double"), F.when(b != 0, b.cast("double")))


def risk_ratio(exposed: Column, other: Column) -> tuple[Column, Column]:
    """Ratio of two risks, and its status."""
    value = F.when((other == 0) & (exposed > 0), float("inf")).otherwise(ratio(exposed, other))
    status = (
        F.when(exposed.isNull() | other.isNull(), "missing_exposure_group")
        .when((other == 0) & (exposed == 0), "zero_over_zero")
        .when(other == 0, "infinite")
        .otherwise("defined")
    )
    return value, status


def distance2(x: Column, z: Column, digits: int | None = 4) -> Column:
    return rounded(F.sqrt(x * x + z * z), digits)


def circle(degrees: Column, digits: int | None = 4) -> tuple[Column, Column]:
    return rounded(F.cos(F.radians(degrees)), digits), rounded(F.sin(F.radians(degrees)), digits)


def circular_difference(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.when(d.isNotNull(), F.least(d, 360.0 - d))


def circular_std(mean_sin: Column, mean_cos: Column) -> Column:
    """Degrees, at most 180, from mean sine and cosine."""
    r = F.sqrt(mean_sin * mean_sin + mean_cos * mean_cos)
    r = F.when(r.isNotNull(), F.greatest(F.lit(1e-12), F.least(F.lit(1.0), r)))
    d = F.degrees(F.sqrt(-2 * F.ln(r)))
    return F.when(d.isNotNull(), F.least(d, F.lit(180.0)))


def flight_time(vy: Column, ay: Column, start: float = 50.0, plate: float = 17 / 12) -> Column:
    """Seconds from the start to the plate; null where the path never gets there."""
    gap = F.lit(plate - start)
    disc = vy * vy + 2 * ay * gap
    curved = ratio(-vy - F.sqrt(F.when(disc >= 0, disc)), ay)
    return F.when(F.abs(ay) < 1e-4, ratio(gap, vy)).otherwise(curved)


def approach_angle(v0: Column, a: Column, vy: Column, ay: Column, digits: int | None = 3) -> Column:
    """Angle in degrees of the path at the plate in the plane of v0."""
    t = flight_time(vy, ay)
    return rounded(F.degrees(F.atan(ratio(v0 + a * t, -(vy + ay * t)))), digits)


def outcome_value(measured: Column, event: Column, weights: dict[str, float] = OUTCOME_WEIGHTS) -> Column:
    """The measured value, else the event's weight, else 0."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(clean(measured), F.try_element_at(table, F.lower(event)), F.lit(0.0))


def strong_contact(speed: Column, angle: Column) -> Column:
    over = speed - 98
    return is_true((speed >= 98) & (angle >= 26 - over) & (angle <= 30 + over))


def stability_index(distance: Column, decay: float = 0.45, floor: float = 5.0, digits: int | None = 1) -> Column:
    x = 100 * F.exp(-decay * F.greatest(F.lit(0.0), distance))
    return F.when(distance.isNotNull(), rounded(F.greatest(F.lit(floor), F.least(F.lit(100.0), x)), digits))


def shrunk_scale(n: Column, prior: Column, raw: Column) -> Column:
    """raw pulled to 1 by n / (n + prior)."""
    w = ratio(n, n + prior)
    return w * raw + (1 - w)


def first_largest(names: list[str], values: list[Column]) -> Column:
    """Name of the first largest value; null if any is missing."""
    array = F.array(*values)
    at = F.array_position(array, F.array_max(array)).cast("int")
    known = F.forall(array, lambda v: v.isNotNull())
    return F.when(known, F.element_at(F.array(*map(F.lit, names)), F.when(at > 0, at).otherwise(1)))


def join_reasons(**parts: Column) -> Column:
    text = F.concat_ws("+", *[F.when(is_true(c), F.lit(n)) for n, c in parts.items()])
    return F.when(text != "", text)


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


def rms3(a: Column, b: Column, c: Column) -> Column:
    return F.sqrt((a * a + b * b + c * c) / 3)


def rank_hash(seed: int, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def safe_name(name: str) -> str:
    """A column name of letters, digits and underscores that a warehouse takes."""
    import re

    out = re.sub(r"[^0-9a-zA-Z_]", "_", name)
    return f"_{out}" if out[:1].isdigit() else out

"""Sequential detectors in closed form, and the warnings they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane.functions import scalar as S
from driftlane.params import Params
from driftlane.sources.events import SESSION, ContractError


def _so_far(by: list[str]):
    return Window.partitionBy(*by, *SESSION).orderBy("event_no").rowsBetween(Window.unboundedPreceding, 0)


def with_cusum(events: DataFrame, x: Column, p: Params, mean: Column | None = None, std: Column | None = None, name: str = "cusum", by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Adds max(0, S + (x - mean) / std - k) per session, rounded, and `name`_alert (unrounded S at or over h) and level.

    Missing x keeps S and gets null. S equals C - min(0, min C) with C the
    running sum, so two windows do what a fold would.
    """
    by = by or []
    inc = S.ratio(x - (mean if mean is not None else F.lit(p.mean)), std if std is not None else F.lit(p.std)) - p.cusum_k
    out = events.withColumn("__inc", inc).withColumn("__c", F.when(F.col("__inc").isNotNull(), F.sum("__inc").over(_so_far(by))))
    out = out.withColumn("__s", F.col("__c") - F.least(F.lit(0.0), F.min("__c").over(_so_far(by))))
    s = F.when(F.col("__c").isNotNull(), F.col("__s"))
    level = F.when(s >= 1.3 * p.cusum_h, "RED").when(s >= p.cusum_h, "YELLOW").otherwise("GREEN")
    return out.withColumn(f"{name}_alert", S.is_true(s >= p.cusum_h)).withColumn(f"{name}_level", level).withColumn(name, S.rounded(s, digits)).drop("__inc", "__c", "__s")


#: Beyond so many eligible events in a session, the closed form's powers would overflow.
_CLOSED = 2000


def with_ewma(events: DataFrame, x: Column, p: Params, mean: float | None = None, std: float | None = None, name: str = "ewma", digits: int | None = None) -> DataFrame:
    """Adds lambda * x + (1 - lambda) * S (S0 = mean) and `name`_alert against the exact-variance limit."""
    mean, std, lam = p.mean if mean is None else mean, p.std if std is None else std, p.ewma_lambda
    w = _so_far([])
    out = events.withColumn("__x", x.cast("double")).withColumn("__n", F.count("__x").over(w))
    keep = F.pow(F.lit(1 - lam), F.col("__n"))
    closed = keep * (mean + F.sum(F.when(F.col("__n") <= _CLOSED, lam * F.col("__x") * F.pow(F.lit(1 - lam), -F.col("__n")))).over(w))
    # older values weigh less than 1e-16 of the last 200
    recent = F.collect_list("__x").over(w)
    folded = F.aggregate(F.slice(recent, -F.least(F.lit(200), F.size(recent)), F.lit(200)), F.lit(mean), lambda s, v: (1 - lam) * s + lam * v)
    long = events.groupBy(*SESSION).count().filter(F.col("count") > _CLOSED).isEmpty()
    s = F.when(F.col("__x").isNotNull(), closed if long else F.when(F.col("__n") <= _CLOSED, closed).otherwise(folded))
    limit = mean + p.ewma_sigma * std * F.sqrt(F.lit(lam / (2 - lam)) * (1 - F.pow(F.lit(1 - lam), 2 * F.col("__n"))))
    out = out.withColumn("__s", s).withColumn(f"{name}_limit", F.when(F.col("__x").isNotNull(), limit))
    return out.withColumn(f"{name}_alert", S.is_true(F.col("__s") >= F.col(f"{name}_limit"))).withColumn(name, S.rounded(F.col("__s"), digits)).drop("__x", "__n", "__s")


def with_entity_std(events: DataFrame, scales: DataFrame, column: str = "std") -> DataFrame:
    """Events with their entity's reference spread; a missing or invalid one is refused."""
    if not scales.filter(F.col(column).isNull() | F.isnan(column) | (F.col(column) <= 0)).isEmpty():
        raise ContractError("a reference spread is invalid")
    if not events.select("entity_id").distinct().join(scales, "entity_id", "left_anti").isEmpty():
        raise ContractError("an entity has no reference spread")
    return events.join(scales.select("entity_id", F.col(column).alias("reference_std")), "entity_id")


def opportunity(split: str | None = None) -> Column:
    """Events at which a warning may count: in the split, after calibration, with follow-up (missing flags count as set)."""
    ok = ~F.coalesce("is_calibration", F.lit(True)) & ~F.coalesce("is_censored", F.lit(True))
    return ok & (F.col("split") == split) if split else ok


def warning_starts(events: DataFrame, flag: Column, available: Column, by: list[str] | None = None) -> DataFrame:
    """Flagged, available events after calibration whose direct predecessor isn't one: the first of each run."""
    by = by or []
    w = Window.partitionBy(*by, *SESSION).orderBy("event_no")
    on = S.is_true(flag) & S.is_true(available) & ~F.coalesce("is_calibration", F.lit(True))
    marked = events.withColumn("__on", on).withColumn("__prev", F.lag("__on").over(w)).withColumn("__prev_no", F.lag("event_no").over(w))
    runs_on = S.is_true(F.col("__prev")) & S.is_true(F.col("__prev_no") == F.col("event_no") - 1)
    return marked.filter(F.col("__on") & ~runs_on).withColumnRenamed("event_no", "warning_no").drop("__on", "__prev", "__prev_no")

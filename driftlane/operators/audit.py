"""Cross-table checks before anything is published."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.sources.events import ContractError


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one frame only (with multiplicity); empty if they are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def missing_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of left that right lacks."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def segment_gaps(entities: DataFrame, seasons: DataFrame, observed: DataFrame) -> DataFrame:
    """Pairs of entity and season without rows; seasons are a short list."""
    return entities.distinct().crossJoin(F.broadcast(seasons.distinct())).join(observed.distinct(), [*entities.columns, *seasons.columns], "left_anti")


def checks(raw: DataFrame, qualified: DataFrame, scores: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """One row per check: name, violations, status."""
    dup = lambda df: df.groupBy(*key).count().filter("count > 1")
    found = {
        "raw_unique": dup(raw), "qualified_unique": dup(qualified), "scores_unique": dup(scores), "labels_unique": dup(labels),
        "qualified_within_raw": missing_keys(qualified, raw, key), "scores_within_qualified": missing_keys(scores, qualified, key),
        "scores_equal_labels": same_rows(scores.select(*key), labels.select(*key)),
    }
    rows = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("violations")).select(F.lit(n).alias("check"), "violations") for n, df in found.items()])
    return rows.withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def assert_passed(report: DataFrame) -> None:
    if failed := [r.check for r in report.filter("status <> 'PASS'").collect()]:
        raise ContractError(f"checks failed: {failed}")


def parity(a: DataFrame, b: DataFrame, key: list[str], column: str, tolerance: float = 1e-12) -> DataFrame:
    """Rows whose values differ by more than the tolerance, or of which one side lacks a value."""
    both = a.select(*key, F.col(column).alias("a")).join(b.select(*key, F.col(column).alias("b")), key, "full")
    return both.filter((F.col("a").isNull() != F.col("b").isNull()) | (F.abs(F.col("a") - F.col("b")) > tolerance))


def thresholds_agree(manifest: dict, published: dict, tolerance: float = 5e-5) -> None:
    """Each model's threshold is the frozen one; `no_alert` stands for an infinite one."""
    for model, frozen in manifest.items():
        shown = published.get(model)
        a, b = (math.inf if v in ("no_alert", None) else float(v) for v in (frozen, shown))
        if not (a == b or abs(a - b) <= tolerance):
            raise ContractError(f"threshold of {model} changed: {frozen} and {shown}")

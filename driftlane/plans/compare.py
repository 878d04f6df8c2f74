"""The comparison of several scores under one protocol."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.operators import evaluate, features, models
from driftlane.params import Params
from driftlane.sources.events import EVENT
from driftlane.sources.sinks import materialise


def compare(events: DataFrame, episodes: DataFrame, p: Params, kinds: tuple[str, ...] = ("N", "R"), freeze: Callable[[dict[str, float]], None] | None = None, buckets: int | None = None) -> DataFrame:
    """Metrics on test of four scores: proposed (cusum), contextual, value drop, and event count.

    Thresholds come from validation; `freeze` gets them before any test metric is computed. buckets: how many events and
    episodes lie in by entity, if they do.
    """
    evaluate.validate_events(events)
    ev = features.context(events).withColumn("drop", features.value_drop(F.col("f1"), list(kinds), p)).withColumn("count", F.col("event_no").cast("double"))
    ev = models.logistic_scores(ev, ["c_event", "c_turn", "c_third"], "target", "contextual")
    ev = ev.select(*EVENT, "split", "is_calibration", "is_censored", "target", "cusum", "contextual", "drop", "count")
    ev = materialise(ev, "entity_id", buckets)  # read eight times below
    scores = {"proposed": "cusum", "contextual": "contextual", "value_drop": "drop", "event_count": "count"}
    frozen: dict[str, float] = {}
    for name, column in scores.items():
        frozen[name] = evaluate.operating_threshold(evaluate.threshold_curve(ev, episodes, column, "validation", p), p).first().threshold
    if freeze:
        freeze(frozen)
    out = []
    for name, column in scores.items():
        m = evaluate.evaluate(ev, episodes, F.col(column) >= F.lit(frozen[name]), F.col(column).isNotNull(), "test", p)
        auc = evaluate.pr_auc(ev.filter(evaluate.opportunity("test")), column, F.col("target"))
        out.append(m.crossJoin(auc.select("pr_auc")).select(F.lit(name).alias("model"), F.lit(frozen[name]).alias("threshold"), "recall", "precision", "false_per_session", "clean_alarm_rate", "pr_auc", "risk_ratio", "event_coverage", "sessions", "episodes"))
    return reduce(DataFrame.unionByName, out)

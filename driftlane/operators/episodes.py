"""Outcome episodes: runs of bad groups, and what they mean for each event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane.functions import scalar as S
from driftlane.params import Params
from driftlane.sources.events import SESSION


def groups(events: DataFrame, outcome: Column, strong: Column, free: Column) -> DataFrame:
    """One row per group: outcome, strong and free of its last event, first_no and last_no."""
    last = lambda c: F.max_by(c, "event_no")
    return events.groupBy(*SESSION, "group_no").agg(
        last(outcome).alias("outcome"), last(S.is_true(strong).cast("int")).alias("strong"), last(S.is_true(free).cast("int")).alias("free"), F.min("event_no").alias("first_no"), F.max("event_no").alias("last_no")
    )


def flagged(groups: DataFrame, p: Params, by: list[str] | None = None) -> DataFrame:
    """Adds the rolling sums, bad and reason; the first group of a session is never bad."""
    w = Window.partitionBy(*(by or []), *SESSION).orderBy("group_no").rowsBetween(-(p.label_groups - 1), 0)
    enough = F.count("*").over(w) >= 2
    out = groups.withColumns({"roll_outcome": F.when(enough, F.round(F.avg("outcome").over(w), 3)), "roll_strong": F.when(enough, F.sum("strong").over(w)), "roll_free": F.when(enough, F.sum("free").over(w))})
    bad = {"OUTCOME": F.col("roll_outcome") >= p.label_threshold, "STRONG": F.col("roll_strong") >= p.label_strong, "FREE": F.col("roll_free") >= p.label_free}
    return out.withColumn("reason", S.join_reasons(**bad)).withColumn("bad", F.col("reason").isNotNull())


def runs(rows: DataFrame, flag: str, order: str, by: list[str]) -> DataFrame:
    """Adds run_id to flagged rows (others are dropped): 1, 2, ... per partition, a run being consecutive rows."""
    w = Window.partitionBy(*by).orderBy(order)
    start = S.is_true(F.col(flag)) & ~S.is_true(F.lag(flag).over(w))
    return rows.withColumn("__start", start.cast("int")).withColumn("run_id", F.sum("__start").over(w)).filter(S.is_true(F.col(flag))).drop("__start")


def episodes(flagged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per run of bad groups: onset_no, end_no, onset_group, groups, reason of the first."""
    by = by or []
    found = runs(flagged, "bad", "group_no", [*by, *SESSION])
    return found.groupBy(*by, *SESSION, F.col("run_id").alias("episode_id")).agg(
        F.min("first_no").alias("onset_no"), F.max("last_no").alias("end_no"), F.min("group_no").alias("onset_group"), F.count("*").alias("n_groups"), F.min_by("reason", "group_no").alias("reason")
    )


def labelled(events: DataFrame, flagged: DataFrame, p: Params) -> DataFrame:
    """Events with target (an onset within the horizon), active (inside an episode) and is_censored."""
    bad = runs(flagged, "bad", "group_no", SESSION).select(*SESSION, "group_no", "run_id")
    onset = bad.groupBy(*SESSION, "run_id").agg(F.min("group_no").alias("group_no")).select(*SESSION, "group_no", F.lit(True).alias("__first"))
    marks = bad.join(onset, [*SESSION, "group_no"], "left")
    out = events.join(marks, [*SESSION, "group_no"], "left")
    own = Window.partitionBy(*SESSION, "group_no")
    start = F.when(F.col("__first"), F.min("event_no").over(own))
    out = out.withColumn("__onset", F.when(F.col("event_no") == start, F.col("event_no")))
    ahead = Window.partitionBy(*SESSION).orderBy("event_no").rowsBetween(1, Window.unboundedFollowing)
    out = out.withColumn("next_onset", F.min("__onset").over(ahead))
    left = F.max("event_no").over(Window.partitionBy(*SESSION)) - F.col("event_no")
    out = out.withColumn("target", S.is_true(F.col("next_onset") <= F.col("event_no") + p.horizon)).withColumn("active", F.col("run_id").isNotNull())
    return out.withColumn("remaining", left).withColumn("is_censored", (left < p.horizon) & ~F.col("target") & ~F.col("active")).drop("__first", "__onset", "run_id")


def rebuilt(labelled: DataFrame) -> DataFrame:
    """Episodes from the events' active flags: first and last event of each run."""
    found = runs(labelled.select(*SESSION, "event_no", "active"), "active", "event_no", SESSION)
    return found.groupBy(*SESSION, F.col("run_id").alias("episode_id")).agg(F.min("event_no").alias("onset_no"), F.max("event_no").alias("end_no"), F.count("*").alias("events"))

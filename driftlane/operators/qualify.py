"""Which entities, sessions and events are studied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane.functions.scalar import rank_hash
from driftlane.params import Params
from driftlane.sources.events import SESSION, ContractError, assert_unique


def with_counters(events: DataFrame, order: list[str], partition: list[str] = SESSION) -> DataFrame:
    """Adds event_no from the given order."""
    return events.withColumn("event_no", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("long"))


def factorized(events: DataFrame, key: str, name: str = "group_no", partition: list[str] = SESSION) -> DataFrame:
    """Numbers the values of key by first appearance (event_no) within the session."""
    w = Window.partitionBy(*partition)
    first = events.withColumn("__first", F.min("event_no").over(w.partitionBy(*partition, key)))
    return first.withColumn(name, F.dense_rank().over(w.orderBy("__first")).cast("long")).drop("__first")


def starters(events: DataFrame, game: list[str], side: Column, order: list[str], opening: Column | None = None) -> DataFrame:
    """The first entity of each game and side, among the events of the opening part if one is told (none there: no starter)."""
    rows = events.withColumn("side", side)
    rows = rows if opening is None else rows.filter(opening)
    return rows.groupBy(*game, "side").agg(F.min_by("entity_id", F.struct(*order)).alias("entity_id"))


def started(events: DataFrame, opened: DataFrame, game: list[str]) -> DataFrame:
    """The events of entities that started in their game, on either side."""
    return events.join(opened.select(*game, "entity_id").distinct(), [*game, "entity_id"], "left_semi")


def outing_reasons(events: DataFrame, shape: Column, spin: Column, p: Params, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per session: size, missing shares, and why it stays or goes (spin before shape before size).

    Carried columns (provenance) have their first known value in the session.
    """
    stats = events.groupBy(*SESSION).agg(
        F.first("session_date", ignorenulls=True).alias("session_date"), F.max("event_no").alias("events"),
        F.avg(shape.isNull().cast("double")).alias("shape_missing"), F.avg(spin.isNull().cast("double")).alias("spin_missing"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("event_no"))).alias(c) for c in carried],
    )
    reason = (
        F.when(F.col("spin_missing") > p.max_missing, "MISSING_SPIN")
        .when(F.col("shape_missing") > p.max_missing, "MISSING_SHAPE")
        .when(F.col("events") < p.min_events, "TOO_FEW_EVENTS")
        .otherwise("INCLUDED")
    )
    return stats.withColumn("reason", reason)


def cohort_eligibility(entities: DataFrame, sessions: DataFrame, p: Params, until: str) -> DataFrame:
    """Entities with the number of their included sessions up to a day, and whether that suffices."""
    counts = sessions.filter((F.col("reason") == "INCLUDED") & (F.col("session_date") <= F.lit(until).cast("date"))).groupBy("entity_id").agg(F.count("*").alias("n"))
    out = entities.join(counts, "entity_id", "left").withColumn("sessions", F.coalesce("n", F.lit(0))).drop("n")
    return out.withColumn("eligible", F.col("sessions") >= p.min_sessions)


def top_kinds(events: DataFrame, p: Params) -> DataFrame:
    """The most used kinds of each entity; ties go to the smaller kind."""
    counts = events.filter(F.col("kind").isNotNull()).groupBy("entity_id", "kind").agg(F.count("*").alias("n"))
    w = Window.partitionBy("entity_id").orderBy(F.desc("n"), "kind")
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= p.top_kinds)


def exclusions(sessions: DataFrame, eligible: DataFrame) -> DataFrame:
    """Sessions that aren't studied, each with one reason: its own, else its entity's."""
    own = sessions.filter("reason <> 'INCLUDED'").select(*SESSION, "reason")
    other = sessions.filter("reason = 'INCLUDED'").join(eligible.filter("eligible").select("entity_id"), "entity_id", "left_anti")
    return own.unionByName(other.select(*SESSION, F.lit("ENTITY_TOO_FEW_SESSIONS").alias("reason")))


def qualify(events: DataFrame, shape: Column, spin: Column, p: Params, until: str) -> dict[str, DataFrame]:
    """events (with is_primary, groups_left, followup_short), sessions, entities, excluded."""
    sessions = outing_reasons(events, shape, spin, p)
    entities = cohort_eligibility(events.select("entity_id").distinct(), sessions, p, until)
    kept = sessions.filter("reason = 'INCLUDED'").join(entities.filter("eligible").select("entity_id"), "entity_id", "left_semi")
    primary = top_kinds(events, p).select("entity_id", "kind", F.lit(True).alias("__primary"))
    out = events.join(kept.select(*SESSION), SESSION, "left_semi").join(primary, ["entity_id", "kind"], "left")
    left = F.max("group_no").over(Window.partitionBy(*SESSION)) - F.col("group_no")
    out = out.withColumn("is_primary", F.col("__primary").isNotNull()).withColumn("groups_left", left).withColumn("followup_short", F.col("groups_left") < p.label_groups).drop("__primary")
    return {"events": out, "sessions": kept, "entities": entities, "excluded": exclusions(sessions, entities)}


def select_cohort(records: DataFrame, retained: DataFrame, target: int, least_starts: int, cutoff_season: int, seed: int) -> DataFrame:
    """The pool of entities with enough starts, who of it is selected (retained, then the rest in the order of a seeded hash), and why.

    Repeated (entity, season) records, retained entities outside the pool, and a target that doesn't fit are refused.
    """
    past = records.filter(F.col("season") <= cutoff_season)
    assert_unique(past, ["entity_id", "season"], "records")
    pool = past.groupBy("entity_id").agg(F.min_by("name", "season").alias("name"), F.sum("starts").alias("starts")).filter(F.col("starts") >= least_starts)
    keep = retained.select("entity_id").distinct()
    if not keep.join(pool, "entity_id", "left_anti").isEmpty():
        raise ContractError("retained entities lack starts")
    old, size = keep.count(), pool.count()
    if not old <= target <= size:
        raise ContractError(f"a target of {target} doesn't fit {old} retained entities and a pool of {size}")
    pool = pool.withColumn("rank_hash", rank_hash(seed, F.col("entity_id")))
    # at most target rows
    fresh = pool.join(keep, "entity_id", "left_anti").orderBy("rank_hash").limit(target - old).select("entity_id", F.lit("SEEDED_SAMPLE").alias("why"))
    why = fresh.unionByName(keep.select("entity_id", F.lit("RETAINED").alias("why")))
    out = pool.join(why, "entity_id", "left")
    return out.select("entity_id", "name", "starts", "rank_hash", F.col("why").isNotNull().alias("selected"), F.coalesce("why", F.lit("NOT_SAMPLED")).alias("selection_reason"), F.lit(f"{cutoff_season}-12-31").alias("selection_cutoff"), F.lit(seed).cast("long").alias("selection_seed"))

"""A seeded season of sessions with known drift, drawn on executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds with their shares and usual speeds.
KINDS = (("FF", 0.6, 94.0), ("SL", 0.3, 85.0), ("CH", 0.1, 86.0))


def uniform(seed: int, name: str, *key: str) -> Column:
    """A number in [0, 1) that only seed, name and key decide, so a lost task draws it again."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *map(F.col, key)), F.lit(1 << 40)) / float(1 << 40)


def normal(seed: int, name: str, *key: str) -> Column:
    """A standard normal number by Box and Muller."""
    return F.sqrt(-2 * F.ln(1 - uniform(seed, name, *key))) * F.cos(F.lit(6.283185307179586) * uniform(seed, name + "'", *key))


def season(spark: SparkSession, entities: int = 5, sessions: int = 15, seed: int = 42, start: str = "2023-04-01") -> DataFrame:
    """Events of sessions five days apart: 80 to 101 each; in every fourth session speed and release drift from event 62 to 74 on."""
    s = spark.range(entities * sessions).select((F.col("id") % entities + 1).cast("long").alias("entity_id"), F.floor(F.col("id") / entities).cast("int").alias("round"))
    s = s.select("entity_id", (F.col("round") * 1000 + F.col("entity_id")).cast("long").alias("session_id"), F.date_add(F.lit(start).cast("date"), F.col("round") * 5).alias("session_date"), (F.col("round") % 4 == 3).alias("has_drift"))
    own = ("entity_id", "session_id")
    s = s.withColumn("n", (80 + F.floor(uniform(seed, "n", *own) * 22)).cast("int")).withColumn("drift_from", F.when(F.col("has_drift"), (62 + F.floor(uniform(seed, "drift", *own) * 13)).cast("long")))
    e = s.withColumn("event_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))))
    key = (*own, "event_no")
    u, kind, speed = uniform(seed, "kind", *key), F.lit(KINDS[-1][0]), F.lit(KINDS[-1][2])
    for i, (name, _, usual) in reversed(list(enumerate(KINDS[:-1]))):
        total = sum(x[1] for x in KINDS[: i + 1])
        kind, speed = F.when(u < total, F.lit(name)).otherwise(kind), F.when(u < total, F.lit(usual)).otherwise(speed)
    late = F.coalesce(F.greatest(F.lit(0), F.col("event_no") - F.col("drift_from") + 1), F.lit(0))
    late = F.when(F.col("drift_from").isNull(), F.lit(0)).otherwise(late)
    return e.select(
        *key, "session_date", "has_drift", "drift_from", kind.alias("kind"), F.ceil(F.col("event_no") / 4).cast("long").alias("group_no"),
        (speed + 0.8 * normal(seed, "speed", *key) - 0.08 * late).alias("release_speed"), (-1.8 + 0.06 * normal(seed, "x", *key) + 0.01 * late).alias("release_pos_x"),
        (5.9 + 0.06 * normal(seed, "z", *key) - 0.01 * late).alias("release_pos_z"), F.pmod(210 + 8 * normal(seed, "axis", *key), F.lit(360.0)).alias("spin_axis"),
    )

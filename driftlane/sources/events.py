"""Scans, and the contract that raw events must meet before anything is computed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlane.functions.scalar import clean
from driftlane.params import Params

SESSION = ["entity_id", "session_id"]
EVENT = [*SESSION, "event_no"]


class ContractError(ValueError):
    """The data breaks a contract."""


def scan(spark: SparkSession, path: str, schema=None, columns: list[str] | None = None, predicate: Column | None = None) -> DataFrame:
    """Parquet with pushed projection and filter."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    df = df.filter(predicate) if predicate is not None else df
    return df.select(*columns) if columns else df


def load_table(spark: SparkSession, name: str, lake: str, layer: str, layers=("raw", "silver", "gold")) -> DataFrame | None:
    """A catalog table, else the layer's Parquet, else that of any layer, else None."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    for one in (layer, *[x for x in layers if x != layer]):
        path = f"{lake.rstrip('/')}/{one}/{name}"
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
            return spark.read.parquet(path)
    return None


def query(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """SQL over the given frames."""
    return spark.sql(text, **tables)


def combine(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def season_totals(raw: DataFrame) -> DataFrame:
    """Rows per entity and season from nested totals (stats[0].splits); an aggregate row wins, two rivals are refused."""
    rows = raw.select(F.explode(F.get("stats", 0)["splits"]).alias("s")).select("s.*")
    ranked = rows.groupBy("entity_id", "season").agg(
        F.max_by(F.struct("starts", "appearances", "events"), F.coalesce("aggregate", F.lit(False)).cast("int")).alias("best"),
        F.count_if(F.coalesce("aggregate", F.lit(False))).alias("aggregates"),
        F.count("*").alias("n"),
    )
    if not ranked.filter("aggregates > 1 or (aggregates = 0 and n > 1)").isEmpty():
        raise ContractError("ambiguous season totals")
    return ranked.select("entity_id", "season", "best.*")


def segment_audit(cohort: DataFrame, seasons: DataFrame, loaded: DataFrame, verified_empty: DataFrame) -> DataFrame:
    """One row per entity and season: rows loaded, and loaded, verified_empty or missing."""
    wanted = cohort.select("entity_id").distinct().crossJoin(F.broadcast(seasons.select("season").distinct()))
    counts = loaded.groupBy("entity_id", "season").agg(F.count("*").alias("rows"))
    empty = verified_empty.select("entity_id", "season", F.lit(True).alias("empty")).distinct()
    out = wanted.join(counts, ["entity_id", "season"], "left").join(empty, ["entity_id", "season"], "left")
    return out.select("entity_id", "season", F.coalesce("rows", F.lit(0)).alias("rows"), F.when(F.col("rows") > 0, "loaded").when(F.col("empty"), "verified_empty").otherwise("missing").alias("status"))


def temporal_split(day: Column, p: Params) -> Column:
    return F.when(day <= F.lit(p.train_end).cast("date"), "train").when(day <= F.lit(p.validation_end).cast("date"), "validation").when(day >= F.lit(p.test_start).cast("date"), "test").otherwise("unassigned")


def historical_split(day: Column, train_end: str, validation_end: str, test_start: str, test_end: str) -> Column:
    """As temporal_split, with an end to the test period."""
    d = lambda s: F.lit(s).cast("date")
    return F.when(day <= d(train_end), "train").when(day <= d(validation_end), "validation").when(day.between(d(test_start), d(test_end)), "test").otherwise("unassigned")


def development_roles(events: DataFrame, selection_end: str) -> DataFrame:
    """Validation rows become selection or assessment; test rows are refused."""
    if not events.filter("split = 'test'").isEmpty():
        raise ContractError("test rows have no place in development")
    late = F.col("session_date") > F.lit(selection_end).cast("date")
    return events.withColumn("role", F.when(F.col("split") == "validation", F.when(late, "assessment").otherwise("selection")).otherwise(F.col("split")))


def conflicting(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys of more than one row."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, key: list[str], name: str = "frame") -> None:
    if found := conflicting(df, key).limit(5).collect():
        raise ContractError(f"{name} repeats keys: {[tuple(r)[:-1] for r in found]}")


def prepare_raw(raw: DataFrame, key: list[str], measures: list[str], source: str | None = None, start: str | None = None, end: str | None = None, years: set[int] | None = None, regular: str | None = "R") -> DataFrame:
    """Regular rows with clean numbers and dates, without repeated rows; broken contracts raise ContractError."""
    if missing := [c for c in [*key, *measures, "session_date"] if c not in raw.columns]:
        raise ContractError(f"columns are missing: {missing}")
    if regular is not None and "game_type" in raw.columns:
        raw = raw.filter(F.col("game_type") == regular)
    parsed = F.try_to_date(F.col("session_date").cast("string").substr(1, 10))
    df = raw.withColumns({"session_date": parsed} | {m: clean(F.col(m)) for m in measures}).dropDuplicates()
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    has_source = "source" in raw.columns
    seen = df.agg(
        F.count("*").alias("n"), F.count_if(null_key).alias("nulls"), F.count_if(F.col("session_date").isNull()).alias("undated"),
        F.min("session_date").cast("string").alias("lo"), F.max("session_date").cast("string").alias("hi"), F.collect_set(F.year("session_date")).alias("years"),
        (F.collect_set("source") if has_source else F.array().cast("array<string>")).alias("sources"),
    ).first()
    for wrong, why in (
        (not seen.n, "no rows"), (seen.nulls, "null keys"), (seen.undated, "dates that can't be read"),
        (start and seen.lo and seen.lo < start or end and seen.hi and seen.hi > end, "dates out of range"),
        (source and has_source and seen.sources != [source], "mixed sources"), (years and not years <= set(seen.years), "missing years"),
    ):
        if wrong:
            raise ContractError(why)
    assert_unique(df, key, "raw events")
    return df


def missingness(df: DataFrame, columns: list[str], by: str = "season") -> DataFrame:
    """Missing rows and share per group and column."""
    counts = df.groupBy(by).agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([by, "rows"], columns, "column", "missing").withColumn("share", F.col("missing") / F.col("rows"))


def sequence_view(lineitem: DataFrame, p: Params, groups: int = 3) -> DataFrame:
    """Order lines as event sequences: supplier by quarter, in shipping order."""
    day = F.col("l_shipdate")
    session = (F.year(day) * 10 + F.quarter(day)).cast("long")
    order = Window.partitionBy("entity_id", "session_id").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    df = lineitem.select(
        F.col("l_suppkey").alias("entity_id"), session.alias("session_id"), F.trunc(day, "quarter").alias("session_date"), "l_orderkey", "l_linenumber", "l_partkey",
        "l_shipdate", "l_quantity", "l_extendedprice", F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("line_status"),
        F.col("l_quantity").alias("f1"), (F.col("l_extendedprice") / 1000).alias("f2"), (F.col("l_discount") * 100).alias("f3"), (F.col("l_tax") * 100).alias("f4"), (F.col("l_discount") * 10).alias("raw_outcome"),
    )
    df = df.withColumn("event_no", F.row_number().over(order).cast("long"))
    return df.select(
        *EVENT, "session_date", "kind", "line_status", "f1", "f2", "f3", "f4", "raw_outcome", "l_orderkey",
        F.ceil(F.col("event_no") / groups).cast("long").alias("group_no"), temporal_split(F.col("session_date"), p).alias("split"), (F.col("event_no") <= p.calibration).alias("is_calibration"),
    )

"""Reading published artifacts and configurations back, and the checks they must pass."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.operators import audit
from driftlane.params import Params
from driftlane.sources.events import ContractError
from driftlane.sources.sinks import manifest


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.json(path, multiLine=True)


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def load_params(spark: SparkSession, path: str) -> Params:
    """Settings from a JSON object; unknown keys and values out of range are refused."""
    return Params.from_mapping(json.loads(_text(spark, path)))


def load_manifest(spark: SparkSession, path: str) -> dict:
    """A manifest whose digest fits its content; another schema version or a changed content is refused."""
    found = json.loads(_text(spark, path))
    if found.get("schema_version") != 2:
        raise ContractError("a manifest of another schema version")
    body = {k: v for k, v in found.items() if k not in ("schema_version", "settings", "run_id", "protocol_sha256")}
    if manifest(found["run_id"], found["settings"], **body) != found:
        raise ContractError("the manifest's digest doesn't fit its content")
    return found


def provenance(df: DataFrame, run: dict, sources: set[str] | None = None) -> None:
    """Every row must carry the manifest's run_id and protocol_sha256, and one of the sources; splits must follow the dates."""
    wrong = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.lit(run[c])) for c in ("run_id", "protocol_sha256")])
    if not df.filter(wrong).isEmpty():
        raise ContractError("rows of another run")
    if sources is not None and not df.filter(~F.coalesce(F.col("source").isin(*sources), F.lit(False))).isEmpty():
        raise ContractError("rows of another source")
    order = {r.split: (r.lo, r.hi) for r in df.groupBy("split").agg(F.min("session_date").alias("lo"), F.max("session_date").alias("hi")).collect()}
    known = [order[s] for s in ("train", "validation", "test") if s in order]
    if any(a[1] >= b[0] for a, b in zip(known, known[1:], strict=False)):
        raise ContractError("splits overlap in time")


def reload_audit(spark: SparkSession, root: str, key: list[str], names=("raw", "qualified", "scores", "labels")) -> DataFrame:
    """The cross-table checks on tables read back from where they were published."""
    return audit.checks(*[spark.read.parquet(f"{root}/{n}") for n in names], key)


def release(spark: SparkSession, metrics: DataFrame, run: dict) -> None:
    """Published metrics must agree with their counts, and thresholds with the manifest's."""
    c = F.col
    ratios = (("recall", c("matched"), c("episodes")), ("precision", c("matched"), c("evaluable")), ("false_per_session", c("evaluable") - c("matched"), c("sessions")))
    off = [F.when(d > 0, F.abs(c(n) - a / d) > 5e-5).otherwise(c(n).isNotNull()) for n, a, d in ratios]
    impossible = (c("matched") > c("evaluable")) | (c("matched") > c("episodes")) | (c("evaluable") > c("raw_warnings"))
    if not metrics.filter(reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(True)) for x in (*off, impossible)])).isEmpty():
        raise ContractError("metrics don't follow from their counts")
    audit.thresholds_agree(run["settings"]["thresholds"], {r.model: r.threshold for r in metrics.select("model", "threshold").collect()})

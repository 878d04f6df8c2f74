"""Sinks: tables, staged publishing, exports, manifests and reports."""

from __future__ import annotations

import hashlib
import json
import math
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.functions.scalar import safe_name


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> bool:
    """Replaces the table at path; an empty frame leaves it as it is."""
    if df.isEmpty():
        return False
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return True


def publish(tables: dict[str, DataFrame], root: str, run_id: str | None = None, check=None) -> str:
    """Writes all tables beside root, checks them, and moves them in as one folder; on failure the old ones stay."""
    spark = next(iter(tables.values())).sparkSession
    run_id = run_id or uuid.uuid4().hex
    stage, backup = f"{root}.stage-{run_id}", f"{root}.old-{run_id}"
    fs, target = _fs(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    try:
        for name, df in tables.items():
            df.write.parquet(f"{stage}/{name}")
        if check:
            check({name: spark.read.parquet(f"{stage}/{name}") for name in tables})
    except Exception:
        fs.delete(path(stage), True)
        raise
    had = fs.exists(target)
    if had and not fs.rename(target, path(backup)):
        raise OSError(f"can't move {root}")
    if not fs.rename(path(stage), target):
        if had:
            fs.rename(path(backup), target)
        raise OSError(f"can't publish {root}")
    if had:
        fs.delete(path(backup), True)
    return run_id


def export_csv(df: DataFrame, path: str, **stamp: str) -> None:
    """One CSV with header, stamped with constant columns."""
    df.withColumns({k: F.lit(v) for k, v in stamp.items()}).coalesce(1).write.mode("overwrite").csv(path, header=True)


#: Shuffle files of a write go as soon as it ends, not when the driver happens to collect its garbage.
_BRIEF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Rows that lie together by one of a join's keys aren't shuffled for the others, nor parted by a broadcast of the side that they come from.
_IN_BUCKETS = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


@contextmanager
def _settings(spark: SparkSession, **settings: str):
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, by: str | None = None, buckets: int | None = None) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the folder named in spark.checkpoint.dir and reads it back; the files go when Spark ends.

    With by and buckets, files are bucketed by that column: windows, groups and joins whose keys hold it need no shuffle.
    Only in local mode, where all is one machine, a folder of its own stands in for a missing setting.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"{tempfile.gettempdir()}/driftlane-{spark.sparkContext.applicationId}"
    path = f"{base.rstrip('/')}/step-{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    writer = df.write.option("compression", "zstd")
    with _settings(spark, **_BRIEF, **(_IN_BUCKETS if buckets else {})):
        if not (by and buckets):
            writer.parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        # only a table can tell its buckets; once it is read, the catalog needn't know it
        name = f"driftlane_{uuid.uuid4().hex}"
        writer.format("parquet").bucketBy(buckets, by).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def discard(*steps: DataFrame) -> None:
    """Deletes the files of materialised frames; nothing may read them, or what is lazily built on them, afterwards."""
    for df in steps:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if re.fullmatch(r"step-[0-9a-f]{32}", folder.rsplit("/", 1)[1]):
                fs, p = _fs(df.sparkSession, folder)
                fs.delete(p, True)


def stamped(df: DataFrame, **stamp: str) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in stamp.items()})


def warehouse_ready(df: DataFrame) -> DataFrame:
    """With column names that a warehouse takes."""
    return df.toDF(*map(safe_name, df.columns))


def json_ready(value):
    """NaN and infinities become None, throughout."""
    if isinstance(value, dict):
        return {str(k): json_ready(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_ready(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def manifest(run_id: str, settings: dict, **more) -> dict:
    """A protocol record with the digest of its canonical JSON."""
    body = json_ready({"schema_version": 2, "settings": settings, **more})
    text = json.dumps(body, sort_keys=True, separators=(",", ":"))
    return body | {"run_id": run_id, "protocol_sha256": hashlib.sha256(text.encode()).hexdigest()}


def markdown(df: DataFrame, rows: int = 50, digits: int = 4) -> str:
    """A small frame as a Markdown table."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in df.limit(rows).collect()])


def table_ddl(name: str, df: DataFrame, partition: str | None = None, cluster: list[str] | None = None, buckets: int = 32) -> str:
    """CREATE TABLE with partition and cluster keys."""
    cols = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    text = f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING PARQUET"
    text += f" PARTITIONED BY ({partition})" if partition else ""
    return text + (f" CLUSTERED BY ({', '.join(cluster)}) INTO {buckets} BUCKETS" if cluster else "")

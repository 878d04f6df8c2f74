"""Sources, sinks, contracts and the smaller operators, each held against values worked out by hand."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlane.functions import scalar as S
from driftlane.operators import audit, detect, evaluate, features, studies
from driftlane.params import Params
from driftlane.sources import artifacts, sinks, synthetic
from driftlane.sources import events as E

EVENT = "entity_id long, session_id long, event_no long"


def test_synthetic_season(spark):
    df = synthetic.season(spark, 4, 8).cache()
    per = df.groupBy("entity_id", "session_id", "has_drift").agg(F.count("*").alias("n"), F.max("event_no").alias("last"), F.max("drift_from").alias("at")).collect()
    assert len(per) == 32 and all(80 <= r.n == r.last <= 101 for r in per)
    assert sum(r.has_drift for r in per) == 8 and all((r.at is not None) == r.has_drift and (r.at is None or 62 <= r.at <= 74) for r in per)
    share = {r.kind: r["count"] / df.count() for r in df.groupBy("kind").count().collect()}
    assert abs(share["FF"] - 0.6) < 0.05 and abs(share["SL"] - 0.3) < 0.05
    speed = df.filter("kind = 'FF'").groupBy((F.col("event_no") >= F.coalesce("drift_from", F.lit(999))).alias("late")).agg(F.avg("release_speed").alias("v"), F.stddev("release_speed").alias("s")).collect()
    got = {r.late: (r.v, r.s) for r in speed}
    assert abs(got[False][0] - 94) < 0.15 and abs(got[False][1] - 0.8) < 0.1 and got[True][0] < 93.3
    assert df.exceptAll(synthetic.season(spark, 4, 8).repartition(5)).isEmpty()


def test_outcomes(spark):
    rows = [("Single", None, 98.0, 26.0), ("balk", None, 97.9, 28.0), (None, 0.4, 100.0, 24.0), ("HOME_RUN", float("nan"), 100.0, 32.1), ("walk", None, None, 28.0)]
    df = spark.createDataFrame(rows, "e string, x double, v double, a double")
    got = df.select(S.outcome_value(F.col("x"), F.col("e")).alias("o"), S.strong_contact(F.col("v"), F.col("a")).alias("s")).collect()
    assert [r.o for r in got] == [0.88, 0.0, 0.4, 2.03, 0.69] and [r.s for r in got] == [True, False, True, False, False]


def test_circular_difference_and_rolling(spark):
    one = spark.range(1).select(S.circular_difference(F.lit(359.0), F.lit(1.0)).alias("d"), S.circular_difference(F.lit(10.0), F.lit(200.0)).alias("e")).first()
    assert one.d == pytest.approx(2.0) and one.e == pytest.approx(170.0)
    rows = [(1, 1, i, 90.0 + i, 0.1 * i, 5.0, 359.0 if i % 2 else 1.0) for i in range(1, 5)]
    out = features.rolling(spark.createDataFrame(rows, EVENT + ", release_speed double, release_pos_x double, release_pos_z double, spin_axis double")).orderBy("event_no").collect()
    assert out[0].speed_std_5 is None and out[0].axis_std_5 is None and out[1].axis_std_5 < 2 and out[1].speed_std_10 is None
    assert out[3].speed_std_5 == round(float(np.std([91, 92, 93, 94], ddof=1)), 3) and out[3].drift_5 == out[3].x_std_5


def test_segments_totals_and_roles(spark, tmp_path):
    splits = [{"entity_id": 1, "season": 2023, "starts": 3, "appearances": 4, "events": 9, "aggregate": False}, {"entity_id": 1, "season": 2023, "starts": 5, "appearances": 6, "events": 20, "aggregate": True}]
    (tmp_path / "a.json").write_text(json.dumps({"stats": [{"splits": splits}]}))
    raw = artifacts.read_json(spark, str(tmp_path / "a.json"))
    assert [r.starts for r in E.season_totals(raw).collect()] == [5]
    (tmp_path / "b.json").write_text(json.dumps({"stats": [{"splits": [splits[0], splits[0]]}]}))
    with pytest.raises(E.ContractError):
        E.season_totals(artifacts.read_json(spark, str(tmp_path / "b.json")))
    a, b = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3,)], "a int")
    assert sorted(map(tuple, E.combine([a, b]).collect()), key=str) == [(1, 2), (3, None)]
    days = spark.createDataFrame([("validation", "2024-06-30"), ("validation", "2024-07-01"), ("train", "2023-01-01")], "split string, session_date string").withColumn("session_date", F.to_date("session_date"))
    assert [r.role for r in E.development_roles(days, "2024-06-30").collect()] == ["selection", "assessment", "train"]
    with pytest.raises(E.ContractError):
        E.development_roles(days.withColumn("split", F.lit("test")), "2024-06-30")


def test_sinks_and_reads(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "a int, `b c` double")
    path = f"{tmp_path}/lake/silver/t"
    assert sinks.write_table(df.toDF("a", "b"), path) and not sinks.write_table(df.toDF("a", "b").filter("a > 5"), path)
    assert E.load_table(spark, "t", f"{tmp_path}/lake", "gold").count() == 2 and E.load_table(spark, "none", f"{tmp_path}/lake", "gold") is None
    assert E.scan(spark, path, columns=["b"], predicate=F.col("a") == 1).collect()[0].b == 0.5
    sinks.export_csv(df.toDF("a", "b"), f"{tmp_path}/c", run_id="r1")
    assert {r.run_id for r in artifacts.read_csv(spark, f"{tmp_path}/c").collect()} == {"r1"}
    ready = sinks.warehouse_ready(df)
    assert ready.columns == ["a", "b_c"] and sinks.markdown(ready).splitlines()[-2:] == ["| 1 | 0.5000 |", "| 2 |  |"]
    assert sinks.table_ddl("t", ready, "a", ["b_c"], 4) == "CREATE TABLE IF NOT EXISTS t (a int, b_c double) USING PARQUET PARTITIONED BY (a) CLUSTERED BY (b_c) INTO 4 BUCKETS"
    run = sinks.manifest("r1", {"thresholds": {"m": math.inf}, "k": 0.5}, note=float("nan"))
    (tmp_path / "m.json").write_text(json.dumps(run))
    assert artifacts.load_manifest(spark, str(tmp_path / "m.json")) == run and run["note"] is None
    (tmp_path / "m.json").write_text(json.dumps(run | {"settings": {"k": 0.6}}))
    with pytest.raises(E.ContractError):
        artifacts.load_manifest(spark, str(tmp_path / "m.json"))
    (tmp_path / "p.json").write_text(json.dumps({"horizon": 9, "horizons": [4, 9]}))
    assert artifacts.load_params(spark, str(tmp_path / "p.json")) == Params(horizon=9, horizons=(4, 9))
    (tmp_path / "p.json").write_text(json.dumps({"old_key": 9}))
    with pytest.raises(ValueError, match="old_key"):
        artifacts.load_params(spark, str(tmp_path / "p.json"))


def test_release_and_provenance(spark, tmp_path):
    run = sinks.manifest("r1", {"thresholds": {"m": 2.0, "n": "no_alert"}})
    cols = "model string, threshold double, sessions long, episodes long, raw_warnings long, evaluable long, matched long, recall double, precision double, false_per_session double"
    good = [("m", 2.0, 10, 4, 6, 5, 2, 0.5, 0.4, 0.3), ("n", math.inf, 10, 4, 0, 0, 0, 0.0, None, 0.0)]
    artifacts.release(spark, spark.createDataFrame(good, cols), run)
    for i, wrong in ((7, 0.6), (6, 6), (1, 2.1), (8, None)):
        row = list(good[0])
        row[i] = wrong
        with pytest.raises(E.ContractError):
            artifacts.release(spark, spark.createDataFrame([tuple(row), good[1]], cols), run)
    rows = spark.createDataFrame([("train", "2023-01-01"), ("test", "2025-01-01")], "split string, d string").select("split", F.to_date("d").alias("session_date"), F.lit("s").alias("source"), F.lit(run["run_id"]).alias("run_id"), F.lit(run["protocol_sha256"]).alias("protocol_sha256"))
    artifacts.provenance(rows, run, {"s"})
    for bad in (rows.withColumn("run_id", F.lit(None).cast("string")), rows.withColumn("source", F.lit("x")), rows.withColumn("session_date", F.lit("2024-01-01").cast("date"))):
        with pytest.raises(E.ContractError):
            artifacts.provenance(bad, run, {"s"})
    key = spark.createDataFrame([(1,), (2,)], "k int")
    for name, df in (("raw", key), ("qualified", key), ("scores", key.filter("k = 1")), ("labels", key.filter("k = 1"))):
        df.write.parquet(f"{tmp_path}/{name}")
    audit.assert_passed(artifacts.reload_audit(spark, str(tmp_path), ["k"]))


def test_event_identity_parity_and_thresholds(spark):
    ev = spark.createDataFrame([(1, 1, 1), (1, 1, 2)], EVENT)
    evaluate.validate_events(ev)
    for bad in (ev.union(ev), spark.createDataFrame([(1, 1, 0)], EVENT), spark.createDataFrame([(None, 1, 1)], EVENT)):
        with pytest.raises(E.ContractError):
            evaluate.validate_events(bad)
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-13), (2, None), (3, 2.1)], "k int, v double")
    assert [r.k for r in audit.parity(a, b, ["k"], "v").collect()] == [3]
    audit.thresholds_agree({"m": 1.0, "n": None}, {"m": 1.00004, "n": "no_alert"})
    with pytest.raises(E.ContractError):
        audit.thresholds_agree({"m": 1.0}, {"m": 1.1})


def test_reference_spread_review_and_replay(spark):
    ev = spark.createDataFrame([(e, 1, n) for e in (1, 2) for n in range(1, 6)], EVENT)
    std = lambda *rows: spark.createDataFrame(list(rows), "entity_id long, std double")
    assert {r.reference_std for r in detect.with_entity_std(ev, std((1, 0.5), (2, 0.7))).collect()} == {0.5, 0.7}
    for bad in (std((1, 0.5)), std((1, 0.5), (2, 0.0)), std((1, 0.5), (2, float("nan")))):
        with pytest.raises(E.ContractError):
            detect.with_entity_std(ev, bad)
    sample = studies.review_sample(ev, ["entity_id"], ["session_id", "event_no"], 2, 7)
    assert sorted(r["count"] for r in sample.groupBy("entity_id").count().collect()) == [2, 2]
    assert sample.exceptAll(studies.review_sample(ev.orderBy(F.desc("event_no")), ["entity_id"], ["session_id", "event_no"], 2, 7)).isEmpty()
    labels = ev.withColumn("is_warning", F.col("event_no").isin(2, 4))
    assert [r.last_warning for r in studies.replay(ev.filter("entity_id = 1"), labels).orderBy("event_no").collect()] == [None, 2, 2, 4, 4]


def test_sweep_equals_one_evaluation_a_threshold(spark):
    rng = np.random.default_rng(5)
    rows = [(e, s, n, None if rng.random() < 0.1 else float(rng.integers(0, 6)), n <= 3, n > 27, "validation", bool(rng.random() < 0.2)) for e in (1, 2) for s in (1, 2, 3) for n in range(1, 31) if rng.random() < 0.95]
    ev = spark.createDataFrame(rows, EVENT + ", x double, is_calibration boolean, is_censored boolean, split string, target boolean")
    eps = spark.createDataFrame([(1, 1, 9), (1, 1, 20), (2, 3, 15), (2, 3, 16)], "entity_id long, session_id long, onset_no long")
    p = Params(horizon=5)
    curve = {r.threshold: r.asDict() for r in evaluate.threshold_curve(ev, eps, "x", "validation", p).collect()}
    assert len(curve) > 4
    for t, got in list(curve.items())[::2]:
        one = evaluate.evaluate(ev, eps, F.col("x") >= F.lit(t), F.col("x").isNotNull(), "validation", p).first().asDict()
        assert {k: pytest.approx(v) if isinstance(v, float) else v for k, v in one.items()} == {k: got[k] for k in one}

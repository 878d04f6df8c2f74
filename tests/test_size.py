"""What the sequence queries write, shuffle and hold on the driver."""

import tracemalloc
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlane.operators import baseline, evaluate, studies
from driftlane.params import small_sessions as P
from driftlane.plans import compare as C
from driftlane.plans import scoring
from driftlane.sources import sinks

SF = "/root/testdata/sf0.001"


class Stop(Exception):
    pass


def plan(df):
    with sinks._settings(df.sparkSession, **sinks._IN_BUCKETS):
        return df._jdf.queryExecution().executedPlan().toString()


def events(spark, n=400):
    i = F.col("id")
    return spark.range(n).select(
        (i % 5).alias("entity_id"), (i / 20).cast("long").alias("session_id"), (i + 1).alias("event_no"), F.lit("1996-01-01").cast("date").alias("session_date"), F.lit("N").alias("kind"),
        (i % 7).cast("double").alias("f1"), (i % 11).cast("double").alias("f2"), ((i - i % 3) / 3).cast("long").alias("group_no"),
        F.when(i % 3 == 0, "train").when(i % 3 == 1, "validation").otherwise("test").alias("split"), F.lit(False).alias("is_calibration"), F.lit(False).alias("is_censored"), (i % 4 == 0).alias("target"), (i % 9).cast("double").alias("cusum"), i.alias("unused"),
    )


def test_f4_scores_within_buckets_without_a_shuffle(spark):
    ev = sinks.materialise(events(spark), "entity_id", 4)
    assert "Exchange" not in plan(baseline.scored(ev, ["f1", "f2"], P))
    assert sorted(map(tuple, ev.collect())) == sorted(map(tuple, events(spark).collect()))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("driftlane_")]
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    files = ev.inputFiles()
    sinks.discard(ev, spark.range(1))
    assert files and not any(sinks._fs(spark, f)[0].exists(sinks._fs(spark, f)[1]) for f in files)


def test_f3_full_writes_the_columns_named_only(spark, monkeypatch):
    written = []
    monkeypatch.setattr(scoring, "materialise", lambda df, *how: written.append((df, how)) or df)
    monkeypatch.setattr(scoring, "discard", lambda *steps: None)
    with pytest.raises(Stop):
        monkeypatch.setattr(scoring.models, "matched_models", lambda *a: (_ for _ in ()).throw(Stop))
        scoring.matched_models(spark, SF)
    ev, how = written[0]
    assert set(ev.columns) == {"entity_id", "session_id", "event_no", "split", "is_calibration", "is_censored", "target", "cusum", "group_no", "log_level", "log_change", "z_size"}
    assert how[0] == "entity_id" and "Exchange" not in plan(ev)


def test_f1_compare_writes_the_columns_read_only(spark, monkeypatch):
    def stop(df, *how):
        raise Stop(df.columns, how)

    monkeypatch.setattr(C, "materialise", stop)
    with pytest.raises(Stop) as stopped:
        C.compare(events(spark), None, P, buckets=3)
    columns, how = stopped.value.args
    assert how == ("entity_id", 3) and set(columns) == {"entity_id", "session_id", "event_no", "split", "is_calibration", "is_censored", "target", "cusum", "contextual", "drop", "count"}


def test_f5_ablation_deletes_the_rows_of_a_variant(spark, monkeypatch):
    kept, gone, ev = [], [], events(spark).withColumn("split", F.lit("test"))
    monkeypatch.setattr(studies, "materialise", lambda df, *how: kept.append(df.columns) or df)
    monkeypatch.setattr(studies, "discard", lambda *steps: gone.extend(d.columns for d in steps))
    monkeypatch.setattr(studies.evaluate, "threshold_curve", lambda *a: None)
    monkeypatch.setattr(studies.evaluate, "operating_threshold", lambda *a: spark.createDataFrame([(1.0,)], "threshold double"))
    monkeypatch.setattr(studies.evaluate, "evaluate", lambda rows, *a: rows.groupBy("threshold").count())
    studies.ablation(ev, ["f1"], {"a": ["f1"], "b": ["f2"]}, None, ev, P, {"f1": 0.0, "f2": 0.0}, reference=(1.0, 0.5), buckets=2)
    assert len(kept) == 6 and gone == [c for c in kept if "event_no" in c]


def test_f2_bootstrap_draws_in_blocks(spark):
    n, b = 20_000, 100
    i = F.col("id")
    stats = spark.range(2 * n).select(F.when(i < n, "x").otherwise("y").alias("model"), (i % n).alias("entity_id"), F.lit(1).cast("long").alias("session_id"), (i % 3).alias("matched"), (i % 4 + 2).alias("episodes"), (i % 5 + 2).alias("evaluable"))
    tracemalloc.start()
    got = {(r.model, r.metric): r for r in evaluate.bootstrap(stats, "session", replace(P, bootstrap=b), baseline="x").collect()}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6  # a matrix of draws would take 16 MB
    ids = np.array(sorted(range(n), key=lambda e: f"1:{e}"))
    draws = np.random.default_rng(P.seed).integers(0, n, size=(b, n))
    of = {m: (lambda at: (at % 3, at % 4 + 2))(ids + shift) for m, shift in (("x", 0), ("y", n))}
    recall = {m: np.array([h[d].sum() / e[d].sum() for d in draws]) for m, (h, e) in of.items()}
    for name, values in (("x", recall["x"]), ("y", recall["y"]), ("x-y", recall["x"] - recall["y"])):
        assert (got[name, "recall"].low, got[name, "recall"].high) == pytest.approx(tuple(np.quantile(values, [0.025, 0.975])), abs=1e-12)

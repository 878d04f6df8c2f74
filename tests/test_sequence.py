"""The sequence operators on small hand-built frames."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlane.functions import scalar as S
from driftlane.operators import audit, baseline, detect, episodes, evaluate, features, qualify, studies
from driftlane.params import Params, small_sessions
from driftlane.sources import events as E
from driftlane.sources import sinks

P = Params()


def frame(spark, scores, entity=1, session=1):
    rows = [(entity, session, i + 20, s, False, False, "test") for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "entity_id long, session_id long, event_no long, x double, is_calibration boolean, is_censored boolean, split string")


def test_cusum_keeps_state_over_missing_and_resets(spark):
    df = frame(spark, [2.0, None, 2.0]).unionByName(frame(spark, [2.0], session=2))
    out = detect.with_cusum(df, F.col("x"), P, digits=3).orderBy("session_id", "event_no").collect()
    assert [r.cusum for r in out] == [1.5, None, 3.0, 1.5]


def test_cusum_second_vector(spark):
    df = frame(spark, [None, 2.0, 2.5, None, 1.0])
    out = detect.with_cusum(df, F.col("x"), P, digits=3).orderBy("event_no").collect()
    assert [r.cusum for r in out] == [None, 1.5, 4.0, None, 3.5]


def test_ewma_equals_fold(spark):
    rng = np.random.default_rng(3)
    xs = [None if rng.random() < 0.2 else float(rng.normal(1.5, 1)) for _ in range(60)]
    out = detect.with_ewma(frame(spark, xs), F.col("x"), P).orderBy("event_no").collect()
    s = P.mean
    for x, r in zip(xs, out):
        if x is None:
            assert r.ewma is None
        else:
            s = P.ewma_lambda * x + (1 - P.ewma_lambda) * s
            assert r.ewma == pytest.approx(s, abs=1e-12)


def flagged(spark, flags, onsets, n=60, horizon=15):
    rows = [(1, 1, i, i in flags, i <= 20, False, True, "test", any(i < o <= i + horizon for o in onsets)) for i in range(1, n + 1)]
    ev = spark.createDataFrame(rows, "entity_id long, session_id long, event_no long, on boolean, is_calibration boolean, is_censored boolean, ok boolean, split string, target boolean")
    eps = spark.createDataFrame([(1, 1, k + 1, o) for k, o in enumerate(onsets)], "entity_id long, session_id long, episode_id long, onset_no long")
    return ev, eps


def test_evaluator_counts(spark):
    ev, eps = flagged(spark, {25, 26, 40}, [30])
    m = evaluate.evaluate(ev, eps, F.col("on"), F.col("ok"), "test", P).first()
    assert (m.raw_warnings, m.matched, m.recall, m.precision, m.false_per_session) == (2, 1, 1.0, 0.5, 1.0)


@pytest.mark.parametrize("horizon,expected", [(1, []), (2, [(21, 23), (23, 25)]), (15, [(21, 23), (23, 25), (30, 44)])])
def test_matching_is_strictly_future_and_one_to_one(spark, horizon, expected):
    ev, eps = flagged(spark, {21, 23, 30}, [23, 25, 44])
    starts = detect.warning_starts(ev, F.col("on"), F.col("ok"))
    found = evaluate.match(starts, eps, F.lit(horizon), []).orderBy("warning_no").collect()
    assert [(r.warning_no, r.onset_no) for r in found] == expected


def test_scoreless_session_stays_in_the_denominator(spark):
    ev, eps = flagged(spark, {25}, [])
    other, eps2 = flagged(spark, set(), [30])
    other, eps2 = (d.withColumn("session_id", F.lit(2).cast("long")) for d in (other.withColumn("ok", F.lit(False)), eps2))
    m = evaluate.evaluate(ev.unionByName(other), eps.unionByName(eps2), F.col("on"), F.col("ok"), "test", P).first()
    assert (m.recall, m.false_per_session, m.session_coverage) == (0.0, 0.5, 0.5)


def test_threshold_choice(spark):
    curve = spark.createDataFrame([(1.0, 0.5, 0.5, 0.4), (2.0, 0.5, 0.5, 0.4), (0.5, 0.9, 0.5, 0.6)], "threshold double, recall double, precision double, false_per_session double")
    assert evaluate.operating_threshold(curve, P).first().threshold == 2.0
    assert evaluate.operating_threshold(curve, replace(P, allowance=0.0)).first().threshold == float("inf")


def test_bootstrap_point_equals_evaluator(spark):
    ev, eps = flagged(spark, {25, 40}, [30])
    rows = ev.withColumn("model", F.lit("a"))
    stats = evaluate.session_statistics(rows, eps, F.col("on"), F.col("ok"), "test", P, ["model"])
    out = {r.metric: r for r in evaluate.bootstrap(stats, "session", replace(P, bootstrap=50)).collect()}
    assert out["recall"].estimate == 1.0 and out["precision"].estimate == 0.5 and out["precision"].low == 0.5


def test_pr_auc_equals_trapezoid(spark):
    rng = np.random.default_rng(1)
    s, y = rng.integers(0, 20, 400) / 10, rng.random(400) < 0.3
    got = evaluate.pr_auc(spark.createDataFrame(list(zip(s.tolist(), y.tolist())), "s double, y boolean"), "s", F.col("y")).first().pr_auc
    r, p = [0.0], [1.0]
    for t in sorted(set(s), reverse=True):
        r.append(y[s >= t].sum() / y.sum())
        p.append(y[s >= t].mean())
    assert got == pytest.approx(np.trapezoid(p, r), abs=1e-12)


def test_sums_before_over_partitions_and_groups(spark):
    rng = np.random.default_rng(7)
    rows = [(g, float(x), int(rng.integers(1, 9))) for g in ("a", "b", None) for x in rng.permutation(60)[:40]]
    df = spark.createDataFrame(rows, "g string, x double, n long").repartition(7)
    for descending in (False, True):
        for r in evaluate.sums_before(df, "x", ["n"], ["g"], descending).collect():
            own = [(x, n) for g, x, n in rows if g == r.g]
            assert r.before_n == sum(n for x, n in own if (x > r.x if descending else x < r.x))
            assert r.all_n == sum(n for _, n in own)


def test_pr_auc_of_nothing(spark):
    empty = spark.createDataFrame([], "s double, y boolean")
    assert evaluate.pr_auc(empty, "s", F.col("y")).first().pr_auc is None
    assert evaluate.pr_auc(spark.createDataFrame([(0.5, False)], "s double, y boolean"), "s", F.col("y")).first().pr_auc is None


def test_rank_correlations_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [("test", 1, s, i, float(rng.integers(0, 12))) for s in range(4) for i in range(12)] + [("test", 1, 9, i, float(i)) for i in range(12)] + [("test", 1, 10, i, 1.0) for i in range(9)]
    got = studies.rank_correlations(spark.createDataFrame(rows, "split string, entity_id long, session_id long, event_no long, x double"), "x", "event_no", ["split"]).first()

    def rank(v):
        return [sum(o < x for o in v) + (sum(o == x for o in v) + 1) / 2 for x in v]

    rho = lambda part: np.corrcoef(rank([r[4] for r in part]), rank([r[3] for r in part]))[0, 1]
    within = [rho([r for r in rows if r[2] == s]) for s in (0, 1, 2, 3, 9)]
    assert got.pooled_rho == pytest.approx(rho(rows)) and got.n == len(rows)
    assert (got.sessions, got.excluded_sessions) == (5, 1) and got.share_above_0_9 == pytest.approx(np.mean(np.array(within) > 0.9))
    assert [got.p25, got.median_rho, got.p75] == pytest.approx(np.quantile(within, [0.25, 0.5, 0.75]).tolist())


def test_starters_need_the_opening_part(spark):
    rows = [(1, "top", 2, 1, 7), (1, "top", 1, 2, 8), (1, "top", 1, 1, 9), (1, "bottom", 2, 1, 5), (2, "top", 1, 1, 7)]
    df = spark.createDataFrame(rows, "game long, half string, part long, no long, entity_id long")
    opened = qualify.starters(df, ["game"], F.col("half"), ["part", "no"], F.col("part") == 1)
    assert {(r.game, r.side, r.entity_id) for r in opened.collect()} == {(1, "top", 9), (2, "top", 7)}
    assert {(r.game, r.entity_id) for r in qualify.started(df, opened, ["game"]).collect()} == {(1, 9), (2, 7)}


def test_excess_interval_equals_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(int(e), "positive" if rng.random() < 0.6 else "negative", float(rng.random())) for e in rng.integers(0, 30, 200)]
    df = spark.createDataFrame([*rows, (1, "neutral", 0.5), (2, "positive", None)], "entity_id long, sign_status string, background double")
    got = studies.excess_interval(df, 70_000, 3).first()
    ids = sorted({r[0] for r in rows})
    total = np.array([sum((s == "positive") - b for e, s, b in rows if e == i) for i in ids])
    n = np.array([sum(e == i for e, _, _ in rows) for i in ids])
    draws = np.random.default_rng(3).integers(0, len(ids), size=(70_000, len(ids)))
    low, high = np.quantile(total[draws].sum(axis=1) / n[draws].sum(axis=1), [0.025, 0.975])
    assert (got.estimate, got.low, got.high) == pytest.approx((total.sum() / n.sum(), low, high)) and (got.entities, got.warnings) == (len(ids), 200)
    one = studies.excess_interval(df.filter("entity_id = 1"), 10, 3).first()
    assert one.low is None and one.replicates == 0 and studies.excess_interval(df.limit(0), 10, 3).first().estimate is None


def test_rolling_circle_over_the_wrap(spark):
    df = frame(spark, [359.0, 1.0])
    out = df.withColumn("sd", features.rolling_circular_std(F.col("x"), 5, 2)).orderBy("event_no").collect()
    assert out[0].sd is None and out[1].sd < 2.0


def test_kinematics_keep_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0, 359.0, -130.0, 25.0, -5.0, -20.0, 4.0, 3.0), (None,) * 9], "release_pos_x double, release_pos_z double, spin_axis double, vy0 double, ay double, vz0 double, az double, vx0 double, ax double")
    a, b = features.kinematics(df).collect()
    assert a.vaa is not None and a.release_distance == 2.2361
    assert all(b[c] is None for c in ("release_distance", "spin_axis_cos", "flight_time", "vaa", "haa"))


def sequence(spark, seed=0, sessions=16, n=24):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(sessions):
        for i in range(1, n + 1):
            x = rng.normal(0, 1, 4)
            rows.append((1, s, f"2020-01-{s + 1:02d}", i, "A" if i % 3 else "B", *map(float, x)))
    return spark.createDataFrame(rows, "entity_id long, session_id long, d string, event_no long, kind string, f1 double, f2 double, f3 double, f4 double").withColumn("session_date", F.to_date("d")).drop("d")


def test_full_distance_equals_numpy_and_ignores_the_future(spark):
    p = replace(small_sessions, min_prior=3, min_observations=20, window_sessions=4)
    names = ["f1", "f2", "f3", "f4"]
    ev = sequence(spark)
    got = {(r.session_id, r.event_no): r for r in baseline.scored(ev, names, p).collect()}
    pdf = ev.toPandas()
    now = pdf[(pdf.session_id == 9) & (pdf.kind == "A")]
    past = pdf[pdf.session_id.between(5, 8) & (pdf.kind == "A")][names]
    early = now[now.event_no <= p.calibration][names]
    mean = past.mean() * (1 - p.shrinkage) + early.mean() * p.shrinkage if len(early) >= 3 else past.mean()
    inverse = np.linalg.inv(past.cov().to_numpy() + p.ridge * np.eye(4))
    for r in now[now.event_no > p.calibration].itertuples():
        gap = np.array([getattr(r, f) for f in names]) - mean.to_numpy()
        assert got[9, r.event_no].distance == pytest.approx(np.sqrt(gap @ inverse @ gap), abs=1e-9)
    changed = ev.withColumn("f1", F.when(F.col("session_id") > 9, F.col("f1") + 100).otherwise(F.col("f1")))
    again = {(r.session_id, r.event_no): r.distance for r in baseline.scored(changed, names, p).collect()}
    assert all(again[k] == pytest.approx(r.distance, abs=1e-12) for k, r in got.items() if k[0] <= 9 and r.distance is not None)


def test_same_date_sessions_do_not_see_each_other(spark):
    ev = sequence(spark, sessions=6).withColumn("session_date", F.lit("2020-01-01").cast("date"))
    assert baseline.session_order(ev).agg(F.max("k")).first()[0] == 0


def test_episode_runs_and_reconstruction(spark):
    rows = [(1, 1, g, 4 <= g <= 10 or 40 <= g <= 44, g, g) for g in range(1, 61)]
    df = spark.createDataFrame(rows, "entity_id long, session_id long, group_no long, bad boolean, first_no long, last_no long").withColumn("reason", F.lit("x"))
    assert [(r.onset_no, r.end_no) for r in episodes.episodes(df).orderBy("onset_no").collect()] == [(4, 10), (40, 44)]
    lab = df.select("entity_id", "session_id", F.col("group_no").alias("event_no"), F.col("bad").alias("active"))
    assert [(r.onset_no, r.end_no) for r in episodes.rebuilt(lab).orderBy("onset_no").collect()] == [(4, 10), (40, 44)]


def test_contracts(spark):
    raw = spark.createDataFrame([(1, 1, "2024-01-01", 1.0, "R"), (1, 1, "2024-01-01", 1.0, "R"), (1, 2, "2024-01-02", float("nan"), "R"), (1, 3, "2024-01-02", 1.0, "P")], "a long, b long, session_date string, v double, game_type string")
    out = E.prepare_raw(raw, ["a", "b"], ["v"], years={2024})
    assert out.count() == 2 and out.filter("v is null").count() == 1
    with pytest.raises(E.ContractError):
        E.prepare_raw(raw.unionByName(raw.withColumn("v", F.lit(9.0))), ["a", "b"], ["v"])
    with pytest.raises(ValueError):
        Params.from_mapping({"old_key": 1})


def test_cohort_is_order_independent(spark):
    rec = spark.createDataFrame([(i, f"n{i}", s, 20) for i in range(8) for s in (2023, 2024)], "entity_id long, name string, season int, starts int")
    keep = spark.createDataFrame([(0,)], "entity_id long")
    a = qualify.select_cohort(rec, keep, 4, 30, 2024, 5)
    b = qualify.select_cohort(rec.orderBy(F.desc("entity_id")), keep, 4, 30, 2024, 5)
    assert a.count() == 8 and a.filter("selected").count() == 4 and a.exceptAll(b).isEmpty()
    assert {r.selection_reason for r in a.filter("entity_id = 0").collect()} == {"RETAINED"}
    for wrong in ((rec.union(rec), keep, 4), (rec, spark.createDataFrame([(99,)], "entity_id long"), 4), (rec, keep, 9)):
        with pytest.raises(E.ContractError):
            qualify.select_cohort(*wrong, 30, 2024, 5)


def test_publish_keeps_the_old_on_failure(spark, tmp_path):
    root = str(tmp_path / "out")
    sinks.publish({"t": spark.range(3)}, root)

    def no(_):
        raise ValueError("refused")

    with pytest.raises(ValueError):
        sinks.publish({"t": spark.range(9)}, root, check=no)
    assert spark.read.parquet(f"{root}/t").count() == 3
    sinks.publish({"t": spark.range(9)}, root)
    assert spark.read.parquet(f"{root}/t").count() == 9


def test_checks_and_ratio(spark):
    df = spark.range(5)
    audit.assert_passed(audit.checks(df, df, df, df, ["id"]))
    with pytest.raises(E.ContractError):
        audit.assert_passed(audit.checks(df, df, df, spark.range(4), ["id"]))
    v, s = S.risk_ratio(F.lit(0.5), F.lit(0.0))
    assert tuple(spark.range(1).select(v, s).first()) == (float("inf"), "infinite")


def test_signs(spark):
    df = spark.createDataFrame([("f1", 1.0, 21), ("f1", -1.0, 22), ("zz", 1.0, 23), ("f1", 0.0, 24), ("f1", None, 25)], "dominant string, delta_0 double, event_no long")
    got = [r.sign_status for r in studies.hypothesis_signs(df, ["f1"]).orderBy("event_no").collect()]
    assert got == ["positive", "negative", "unclassified", "neutral", "missing_delta"]


def test_embedding_distance_equals_numpy(spark, tmp_path):
    from driftlane import catalog
    from driftlane.plans import scoring

    rng = np.random.default_rng(3)
    v, label = (rng.normal(size=(240, 64)) @ rng.normal(size=(64, 64))).astype(np.float32), np.arange(240) % 2
    spark.createDataFrame([(i, v[i].tolist(), int(label[i])) for i in range(240)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.distance for r in catalog.QUERIES["embedding_distance"](spark, str(tmp_path)).collect()}
    for k in (0, 1):
        x = v[label == k].astype(float)
        gap, inverse = x - x.mean(0), np.linalg.inv(np.cov(x.T) + scoring.P.ridge * np.eye(64))
        assert np.allclose([got[i] for i in np.flatnonzero(label == k)], np.sqrt(np.einsum("ni,ij,nj->n", gap, inverse, gap)), atol=1e-5)

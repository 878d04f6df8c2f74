"""Evaluation of warnings against episodes under one protocol.

All functions take `by`: further keys (model, threshold, horizon, entity ...), so
a sweep over settings is one job, not a loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane.functions import scalar as S
from driftlane.operators.detect import opportunity, warning_starts
from driftlane.params import Params
from driftlane.sources.events import EVENT, SESSION, ContractError
from driftlane.sources.sinks import materialise


def validate_events(events: DataFrame) -> None:
    """Event keys are unique, positive and not null."""
    seen = events.agg(F.count("*").alias("n"), F.count_if((F.col("event_no") < 1) | F.col("event_no").isNull() | F.col("entity_id").isNull() | F.col("session_id").isNull()).alias("bad")).first()
    if seen.bad or not events.groupBy(*EVENT).count().filter("count > 1").isEmpty():
        raise ContractError("event keys must be unique, positive and not null")


def universe(events: DataFrame, split: str) -> DataFrame:
    """Distinct sessions of a split; a session in two splits is refused."""
    sessions = events.groupBy(*SESSION).agg(F.count_distinct(F.coalesce("split", F.lit(""))).alias("n"), F.min("split").alias("split"))
    if not sessions.filter("n > 1").isEmpty():
        raise ContractError("a session lies in two splits")
    return sessions.filter(F.col("split") == split).select(*SESSION)


def match(warnings: DataFrame, onsets: DataFrame, horizon: Column, by: list[str]) -> DataFrame:
    """One-to-one matches (warning_no, onset_no): each warning in turn takes the first free onset in (w, w + horizon].

    Both sides are lists of one session, so what is gathered is bounded by a session's length.
    """
    key = [*by, *SESSION]
    w = warnings.groupBy(*key).agg(F.array_sort(F.collect_list("warning_no")).alias("ws"), F.first(horizon).alias("h"))
    o = onsets.groupBy(*[c for c in key if c in onsets.columns]).agg(F.array_sort(F.collect_list("onset_no")).alias("os"))
    both = w.join(o, [c for c in key if c in o.columns])
    free = lambda acc, v: F.get(F.filter("os", lambda x: (x > v) & (x > acc["last"]) & (x <= v + F.col("h"))), 0)
    start = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<struct<warning_no:bigint,onset_no:bigint>>").alias("found"))

    def step(acc, v):
        onset = free(acc, v)
        return F.struct(F.coalesce(onset, acc["last"]).alias("last"), F.when(onset.isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(F.struct(v.alias("warning_no"), onset.alias("onset_no"))))).alias("found"))

    return both.select(*key, F.explode(F.aggregate("ws", start, step, lambda acc: acc["found"])).alias("m")).select(*key, "m.*")


def session_statistics(events: DataFrame, episodes: DataFrame, flag: Column, available: Column, split: str, p: Params, by: list[str] | None = None) -> DataFrame:
    """Sufficient statistics of each session (and by): counts that metrics are ratios of sums of."""
    by = by or []
    key = [*by, *SESSION]
    own = events.filter(F.col("split") == split)
    starts = warning_starts(own, flag, available, by).select(*key, "warning_no", F.coalesce("is_censored", F.lit(True)).alias("censored"))
    eps = episodes.join(universe(events, split), SESSION, "left_semi").select(*[c for c in by if c in episodes.columns], *SESSION, "onset_no")
    found = match(starts.filter("not censored"), eps, F.lit(p.horizon), by)
    per_warning = starts.groupBy(*key).agg(F.count("*").alias("raw_warnings"), F.count_if(~F.col("censored")).alias("evaluable"))
    per_match = found.groupBy(*key).agg(F.count("*").alias("matched"), F.sum(F.col("onset_no") - F.col("warning_no")).alias("lead_sum"), F.array_sort(F.collect_list(F.col("onset_no") - F.col("warning_no"))).alias("leads"))
    per_episode = eps.groupBy(*eps.columns[:-1]).agg(F.count("*").alias("episodes"))
    chance, seen, on = opportunity(), S.is_true(available), S.is_true(flag)
    t = S.is_true(F.col("target"))
    scope = own.groupBy(*key).agg(
        F.count_if(chance).alias("opportunities"), F.count_if(chance & seen).alias("available"),
        F.count_if(chance & seen & on).alias("alert_events"), F.count_if(chance & seen & on & t).alias("alert_targets"),
        F.count_if(chance & seen & ~on).alias("quiet_events"), F.count_if(chance & seen & ~on & t).alias("quiet_targets"),
    )
    out = scope.join(per_warning, key, "left").join(per_match, key, "left").join(per_episode, [c for c in key if c in per_episode.columns], "left")
    counts = ["raw_warnings", "evaluable", "matched", "lead_sum", "episodes"]
    return out.fillna(0, counts).withColumn("clean", F.col("episodes") == 0)


_SUMS = ("raw_warnings", "evaluable", "matched", "episodes", "opportunities", "available", "alert_events", "alert_targets", "quiet_events", "quiet_targets", "lead_sum")


def metrics(stats: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """All metrics from session statistics; weight multiplies sessions (bootstrap)."""
    by, w = by or [], F.col(weight) if weight else F.lit(1)
    total = lambda c: F.sum(w * c).cast("long")
    clean = F.col("clean").cast("int")
    sums = stats.groupBy(*by).agg(
        total(F.lit(1)).alias("sessions"), total(clean).alias("clean_sessions"), total(clean * (F.col("evaluable") > 0).cast("int")).alias("clean_warned"), total((F.col("available") > 0).cast("int")).alias("covered_sessions"),
        *[total(F.col(c)).alias(c) for c in _SUMS],
    )
    # percentile counts by value, and leads are no longer than the horizon, so no list of all leads is gathered
    leads = stats.select(*by, w.alias("__w"), F.explode("leads").alias("lead")).groupBy(*by).agg(F.percentile("lead", F.lit(0.5), F.col("__w").cast("long")).alias("lead_median"))
    return ratios(sums.join(leads, by, "left") if by else sums.crossJoin(F.broadcast(leads)))


def ratios(sums: DataFrame) -> DataFrame:
    """The metrics that are ratios of sums."""
    c = F.col
    rr, status = S.risk_ratio(S.ratio(c("alert_targets"), c("alert_events")), S.ratio(c("quiet_targets"), c("quiet_events")))
    return sums.withColumns(
        {
            "censored": c("raw_warnings") - c("evaluable"), "false_warnings": c("evaluable") - c("matched"),
            "recall": S.ratio(c("matched"), c("episodes")), "precision": S.ratio(c("matched"), c("evaluable")),
            "false_per_session": S.ratio(c("evaluable") - c("matched"), c("sessions")), "clean_alarm_rate": S.ratio(c("clean_warned"), c("clean_sessions")),
            "event_coverage": S.ratio(c("available"), c("opportunities")), "session_coverage": S.ratio(c("covered_sessions"), c("sessions")),
            "lead_mean": S.ratio(c("lead_sum"), c("matched")), "risk_ratio": rr, "risk_status": status,
        }
    ).drop("lead_sum")


def evaluate(events: DataFrame, episodes: DataFrame, flag: Column, available: Column, split: str, p: Params, by: list[str] | None = None) -> DataFrame:
    return metrics(session_statistics(events, episodes, flag, available, split, p, by), by)


def candidates(events: DataFrame, score: str, split: str, steps: int = 31) -> DataFrame:
    """Distinct exact quantiles of the score in the split, and infinity (never alert)."""
    grid = [i / (steps - 1) for i in range(steps)]
    own = events.filter(opportunity(split) & F.col(score).isNotNull())
    found = own.agg(F.percentile(score, F.array(*map(F.lit, grid))).alias("q")).select(F.explode("q").alias("threshold"))
    return found.filter("threshold is not null").union(events.sparkSession.range(1).select(F.lit(float("inf")))).distinct()


def sweep_starts(events: DataFrame, score: str, grid: list[float]) -> DataFrame:
    """Warning starts at every threshold of the (short) grid.

    An event starts a warning at the thresholds over its direct predecessor's score and not over its own. So each event
    is looked at once, and only starts are multiplied.
    """
    w = Window.partitionBy(*SESSION).orderBy("event_no")
    seen = F.when(~F.coalesce("is_calibration", F.lit(True)), F.col(score))
    before = F.when(F.lag("event_no").over(w) == F.col("event_no") - 1, F.lag(seen).over(w))
    rows = events.select(*SESSION, "event_no", F.coalesce("is_censored", F.lit(True)).alias("censored"), seen.alias("__s"), before.alias("__b")).filter(F.col("__s").isNotNull() & (F.col("__b").isNull() | (F.col("__b") < F.col("__s"))))
    own = F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: (g <= F.col("__s")) & (F.col("__b").isNull() | (g > F.col("__b"))))
    return rows.select(*SESSION, F.col("event_no").alias("warning_no"), "censored", F.explode(own).alias("threshold"))


def threshold_curve(events: DataFrame, episodes: DataFrame, score: str, split: str, p: Params, steps: int = 31, thresholds: DataFrame | None = None) -> DataFrame:
    """Metrics at every candidate threshold (at most steps + 1); no row of events is multiplied by the grid."""
    grid = sorted(r.threshold for r in (thresholds if thresholds is not None else candidates(events, score, split, steps)).collect())
    spark, own = events.sparkSession, events.filter(F.col("split") == split)
    eps = episodes.join(universe(events, split), SESSION, "left_semi").select(*SESSION, "onset_no")
    starts = sweep_starts(own, score, grid)
    found = match(starts.filter("not censored"), eps, F.lit(p.horizon), ["threshold"]).withColumn("lead", F.col("onset_no") - F.col("warning_no"))
    chance, s, target = opportunity(), F.col(score), S.is_true(F.col("target"))
    # events by the number of thresholds that they reach
    reached = F.size(F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: g <= s))
    levels = own.filter(chance & s.isNotNull()).groupBy(reached.alias("reached")).agg(F.count("*").alias("n"), F.count_if(target).alias("hits"))
    every = spark.createDataFrame(list(enumerate(grid, 1)), "place int, threshold double")
    over = F.col("reached") >= F.col("place")
    alerts = every.crossJoin(F.broadcast(levels)).groupBy("threshold").agg(*[F.sum(F.when(c, F.col(v))).alias(n) for n, c, v in (("alert_events", over, "n"), ("alert_targets", over, "hits"), ("quiet_events", ~over, "n"), ("quiet_targets", ~over, "hits"))])
    sick = eps.groupBy(*SESSION).agg(F.count("*").alias("episodes"))
    scope = own.groupBy(*SESSION).agg(F.count_if(chance).alias("opportunities"), F.count_if(chance & s.isNotNull()).alias("available")).join(sick, SESSION, "left")
    whole = scope.agg(F.count("*").alias("sessions"), F.count_if(F.col("episodes").isNull()).alias("clean_sessions"), F.count_if(F.col("available") > 0).alias("covered_sessions"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("episodes", "opportunities", "available")])
    warned = starts.groupBy("threshold", *SESSION).agg(F.count("*").alias("raw"), F.count_if(~F.col("censored")).alias("ev")).join(sick, SESSION, "left")
    warned = warned.groupBy("threshold").agg(F.sum("raw").alias("raw_warnings"), F.sum("ev").alias("evaluable"), F.count_if(F.col("episodes").isNull() & (F.col("ev") > 0)).alias("clean_warned"))
    hits = found.groupBy("threshold").agg(F.count("*").alias("matched"), F.sum("lead").alias("lead_sum"), F.percentile("lead", F.lit(0.5)).alias("lead_median"))
    out = every.select("threshold").crossJoin(F.broadcast(whole)).join(warned, "threshold", "left").join(hits, "threshold", "left").join(alerts, "threshold", "left")
    return ratios(out.fillna(0, [*_SUMS, "clean_warned"]))


def operating_threshold(curve: DataFrame, p: Params) -> DataFrame:
    """The best row within the allowance: recall, then precision, then fewer false warnings, then the larger threshold."""
    ok = F.col("false_per_session") <= p.allowance + 1e-12
    rank = F.struct(F.coalesce("recall", F.lit(-1.0)), F.coalesce("precision", F.lit(-1.0)), -F.coalesce("false_per_session", F.lit(0.0)), F.col("threshold"))
    best = curve.agg(F.max_by(F.struct("threshold", "recall", "precision", "false_per_session"), F.when(ok, rank)).alias("b"))
    return best.select(F.coalesce("b.threshold", F.lit(float("inf"))).alias("threshold"), "b.recall", "b.precision", "b.false_per_session")


def sums_before(levels: DataFrame, key: str, sums: list[str], by: list[str], descending: bool = False) -> DataFrame:
    """Adds before_<c> (the sum over all rows that come before in the order of key) and all_<c>, within by.

    The rows lie in range partitions; only their totals, a row per partition and by, are summed in one place.
    """
    order, same = (F.desc if descending else F.asc)(key), [*by, "__part"]
    spread = materialise(levels.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()))
    totals, w = spread.groupBy(*same).agg(*[F.sum(c).alias(f"__{c}") for c in sums]), Window.partitionBy(*by)
    ahead = w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = totals.select(*[F.col(c).alias(f"__of_{c}") for c in same], *[F.coalesce(F.sum(f"__{c}").over(ahead), F.lit(0)).alias(f"__ahead_{c}") for c in sums], *[F.sum(f"__{c}").over(w).alias(f"all_{c}") for c in sums])
    inside = Window.partitionBy(*same).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = spread.withColumns({f"__in_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    out = run.join(ends, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in same]))
    return out.select(*levels.columns, *[(F.col(f"__ahead_{c}") + F.col(f"__in_{c}")).alias(f"before_{c}") for c in sums], *[f"all_{c}" for c in sums])


def pr_auc(rows: DataFrame, score: str, label: Column, by: list[str] | None = None) -> DataFrame:
    """Area under the precision-recall line through all score levels, from (0, 1), by trapezoids."""
    by = by or []
    levels = rows.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("n"), F.count_if(S.is_true(label)).alias("pos"))
    run, c = sums_before(levels, score, ["n", "pos"], by, descending=True), F.col
    tp, seen = c("before_pos") + c("pos"), c("before_n") + c("n")
    before_r, before_p = S.ratio(c("before_pos"), c("all_pos")), F.coalesce(S.ratio(c("before_pos"), c("before_n")), F.lit(1.0))
    run = run.withColumn("area", (S.ratio(tp, c("all_pos")) - before_r) * (tp / seen + before_p) / 2)
    return run.groupBy(*by).agg(F.sum("area").alias("pr_auc"), F.max("all_pos").alias("positives"), F.sum("n").alias("rows"))


def lead_time(events: DataFrame, episodes: DataFrame, flag: Column, available: Column, split: str, p: Params) -> tuple[DataFrame, DataFrame]:
    """Metrics per horizon for fixed warnings with complete follow-up, all and common, and the matches behind them."""
    own = events.filter(F.col("split") == split)
    length = own.groupBy(*SESSION).agg(F.max("event_no").alias("length"))
    starts = warning_starts(own, flag, available).select(*SESSION, "warning_no").join(length, SESSION).withColumn("left", F.col("length") - F.col("warning_no"))
    eps = episodes.join(universe(events, split), SESSION, "left_semi")
    cases = events.sparkSession.createDataFrame([(h, q) for h in p.horizons for q in ("complete", "common")], "horizon long, population string")
    wide = starts.crossJoin(F.broadcast(cases)).filter(F.col("left") >= F.when(F.col("population") == "common", max(p.horizons)).otherwise(F.col("horizon")))
    by = ["horizon", "population"]
    found = match(wide, eps.select(*SESSION, "onset_no"), F.col("horizon"), by).withColumn("lead", F.col("onset_no") - F.col("warning_no"))
    n = cases.join(wide.groupBy(*by).agg(F.count("*").alias("warnings")), by, "left").join(found.groupBy(*by).agg(F.count("*").alias("matched"), F.avg("lead").alias("lead_mean"), F.percentile("lead", F.lit(0.5)).alias("lead_median")), by, "left").fillna(0, ["warnings", "matched"])
    out = n.crossJoin(eps.agg(F.count("*").alias("episodes"))).withColumn("recall", S.ratio(F.col("matched"), F.col("episodes"))).withColumn("precision", S.ratio(F.col("matched"), F.col("warnings")))
    return out, found


def lead_histogram(matches: DataFrame) -> DataFrame:
    return matches.groupBy("horizon", "population", "lead").agg(F.count("*").alias("n"))


def bootstrap(stats: DataFrame, unit: str, p: Params, models: str = "model", baseline: str | None = None) -> DataFrame:
    """Percentile intervals of recall, precision and false_per_session, with the same draws for every model.

    Draws are numpy's on the driver, over sorted units. Units of equal sums count as one kind: the driver holds the number of
    each unit's kind (4 bytes), the kinds, and a block of draws; what it adds up are counts of kinds.
    `unit` is `session` or `entity`. With a baseline model, differences baseline minus other come too.
    """
    import json

    import numpy as np

    spark = stats.sparkSession
    name = F.col("entity_id") if unit == "entity" else F.concat_ws(":", F.col("session_id").cast("string"), F.col("entity_id").cast("string"))
    sums = ["matched", "episodes", "evaluable", "sessions"]
    per_unit = materialise(stats.withColumn("u", name).groupBy(models, "u").agg(*[F.sum(c).alias(c) for c in sums[:3]], F.count("*").alias("sessions")))
    kinds = materialise(per_unit.groupBy("u").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col(models).alias("model"), *sums)))).alias("kind")))
    every = sorted(r.kind for r in kinds.select("kind").distinct().collect())
    if not every:
        raise ContractError("no sessions to resample")
    numbered = spark.createDataFrame(list(enumerate(every)), "number int, kind string")
    batches = kinds.join(numbered, "kind").orderBy("u").select("number").toArrow().column(0)
    of_unit = batches.to_numpy()  # kinds of the units, which are sorted
    n, names = len(of_unit), sorted({x["model"] for k in every for x in json.loads(k)}, key=str)
    value = np.zeros((len(every), len(names), len(sums)), np.int64)
    for i, k in enumerate(every):
        for x in json.loads(k):
            value[i, names.index(x["model"])] = [x[c] for c in sums]
    rng, rows = np.random.default_rng(p.seed), []
    for replicate in range(p.bootstrap):
        times = np.zeros(len(every), np.int64)
        for at in range(0, n, 1_000_000):  # blocks give the same draws as one matrix
            times += np.bincount(of_unit[rng.integers(0, n, size=min(1_000_000, n - at))], minlength=len(every))
        total = np.tensordot(times, value, 1)
        rows += [(m, replicate, *map(int, total[j])) for j, m in enumerate(names) if total[j, 3]]
    totals = spark.createDataFrame(rows, f"{models} {dict(stats.dtypes)[models]}, replicate int, {', '.join(f'{c} long' for c in sums)}")
    point = per_unit.groupBy(models).agg(*[F.sum(c).alias(c) for c in sums]).withColumn("replicate", F.lit(-1))
    c = F.col
    values = {"recall": S.ratio(c("matched"), c("episodes")), "precision": S.ratio(c("matched"), c("evaluable")), "false_per_session": S.ratio(c("evaluable") - c("matched"), c("sessions"))}
    long = totals.unionByName(point).withColumns(values).unpivot([models, "replicate"], list(values), "metric", "value")
    if baseline:
        base = long.filter(c(models) == baseline).select("replicate", "metric", c("value").alias("base"))
        other = long.filter(c(models) != baseline).join(base, ["replicate", "metric"]).select(F.concat(F.lit(f"{baseline}-"), c(models)).alias(models), "replicate", "metric", (c("base") - c("value")).alias("value"))
        long = long.unionByName(other)
    drawn_value = F.when(c("replicate") >= 0, c("value"))
    out = long.groupBy(models, "metric").agg(F.max(F.when(c("replicate") < 0, c("value"))).alias("estimate"), F.percentile(drawn_value, F.array(F.lit(0.025), F.lit(0.975))).alias("ci"), F.count(drawn_value).alias("finite"))
    enough = c("finite") >= 20
    return out.select(models, "metric", "estimate", F.when(enough, F.get("ci", 0)).alias("low"), F.when(enough, F.get("ci", 1)).alias("high"), "finite")

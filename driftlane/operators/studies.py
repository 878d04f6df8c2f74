"""Studies around the main evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane.functions import scalar as S
from driftlane.operators import baseline, detect, episodes, evaluate
from driftlane.params import Params
from driftlane.sources.events import EVENT, SESSION, ContractError
from driftlane.sources.sinks import discard, materialise


def dispersion_scales(train: DataFrame, score: str, p: Params, least_sessions: int = 5, least_events: int = 30, prior: float | None = None) -> DataFrame:
    """Spread of each entity's clean training scores, shrunk to 1 with a prior count (the median count by default)."""
    rows = train.filter(F.col(score).isNotNull())
    per = rows.groupBy("entity_id").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"), F.stddev_samp(score).alias("std"))
    fit = (F.col("sessions") >= least_sessions) & (F.col("n") >= least_events) & (F.col("std") > 0)
    whole = per.agg(F.percentile(F.when(fit, F.col("n")), F.lit(0.5)).alias("median_n"), F.percentile(F.when(fit, F.col("std")), F.lit(0.5)).alias("median_std"))
    out = per.crossJoin(F.broadcast(whole)).withColumn("prior", F.lit(prior) if prior is not None else F.col("median_n"))
    raw = S.ratio(F.col("std"), F.col("median_std"))
    out = out.withColumn("weight", F.when(fit, S.ratio(F.col("n"), F.col("n") + F.col("prior")))).withColumn("scale", F.when(fit, S.shrunk_scale(F.col("n"), F.col("prior"), raw)).otherwise(1.0))
    return out.withColumn("group", F.when(~S.is_true(fit), "fallback").when(F.col("std") < F.col("median_std"), "low").otherwise("high"))


def dispersion_summary(scales: DataFrame) -> DataFrame:
    q = F.percentile("std", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    one = scales.filter("std is not null").agg(F.count("*").alias("entities"), F.sum("n").alias("events"), q.alias("q"))
    g = lambda i: F.get("q", i)
    return one.select("entities", "events", g(0).alias("min"), g(1).alias("q1"), g(2).alias("median"), g(3).alias("q3"), g(4).alias("max"), (g(3) - g(1)).alias("iqr"), S.ratio(g(4), g(0)).alias("max_to_min"))


def reference_from_train(events: DataFrame, score: str, least: int = 30) -> tuple[float, float]:
    """Mean and spread of the detector's input over train rows."""
    mean, std, n = events.filter(detect_input(score) & (F.col("split") == "train")).agg(F.avg(score), F.stddev_samp(score), F.count("*")).first()
    if n < least or not std or std <= 1e-6:
        raise ContractError("too little to estimate a reference from")
    return mean, std


def detect_input(score: str) -> Column:
    """Rows that the detector may see: scored, after calibration; censoring doesn't matter here."""
    return F.col(score).isNotNull() & ~F.coalesce("is_calibration", F.lit(True))


def average_rank(x: str, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    ties = F.count("*").over(Window.partitionBy(*by, x))
    return F.rank().over(w.orderBy(x)) + (ties - 1) / 2


def _corr(a: str, b: str) -> Column:
    """The correlation; null where one side is constant (the built-in one fails there)."""
    return S.ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def spearman(rows: DataFrame, a: str, b: str, by: list[str], least: int = 10, distinct: int = 3) -> DataFrame:
    """Rank correlation per group of enough rows and distinct values."""
    rows = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = rows.withColumn("__ra", average_rank(a, by)).withColumn("__rb", average_rank(b, by))
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(a).alias("da"), F.count_distinct(b).alias("db"), _corr("__ra", "__rb").alias("rho"))
    return out.filter((F.col("n") >= least) & (F.col("da") >= distinct) & (F.col("db") >= distinct)).select(*by, "n", "rho")


def average_ranks(rows: DataFrame, x: str, by: list[str], name: str) -> DataFrame:
    """The average rank of each value of x within by, without a window over all rows."""
    levels = evaluate.sums_before(rows.groupBy(*by, x).agg(F.count("*").alias("n")), x, ["n"], by)
    return levels.select(*by, x, (F.col("before_n") + (F.col("n") + 1) / 2).alias(name))


def rank_correlations(rows: DataFrame, a: str, b: str, by: list[str], least: int = 10, distinct: int = 3) -> DataFrame:
    """Per by (no nulls): rank correlation over all rows, and median, quartiles and share above 0.9 of that within sessions."""
    rows = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = rows.join(average_ranks(rows, a, by, "__ra"), [*by, a]).join(average_ranks(rows, b, by, "__rb"), [*by, b])
    pooled = ranked.groupBy(*by).agg(F.count("*").alias("n"), _corr("__ra", "__rb").alias("rho")).withColumn("pooled_rho", F.when(F.col("n") >= least, F.col("rho"))).drop("rho")
    within = rows.select(*by, *SESSION).distinct().join(spearman(rows, a, b, [*by, *SESSION], least, distinct), [*by, *SESSION], "left").withColumn("rho", F.nanvl("rho", F.lit(None).cast("double")))
    share = F.avg(F.when(F.col("rho").isNotNull(), (F.col("rho") > 0.9).cast("double")))
    spread = within.groupBy(*by).agg(F.count("rho").alias("sessions"), F.count_if(F.col("rho").isNull()).alias("excluded_sessions"), F.percentile("rho", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"), share.alias("share_above_0_9"))
    q = lambda i, name: F.get("q", i).alias(name)
    return pooled.join(spread, by).select(*by, "n", "pooled_rho", "sessions", "excluded_sessions", q(0, "p25"), q(1, "median_rho"), q(2, "p75"), "share_above_0_9")


def subgroup_metrics(stats: DataFrame, scales: DataFrame) -> DataFrame:
    """Metrics by the entity's spread group; entities without training scores are in the fallback group."""
    grouped = stats.join(scales.select("entity_id", "group"), "entity_id", "left")
    return evaluate.metrics(grouped.withColumn("group", F.coalesce("group", F.lit("fallback"))), ["group"])


def hypothesis_signs(rows: DataFrame, features: list[str], dominant: str = "dominant", tolerance: float = 5e-5) -> DataFrame:
    """Adds sign_status (direction of the dominant feature's delta) and the workload band."""
    delta = reduce(lambda acc, f: acc.when(F.col(dominant) == f[1], F.col(f"delta_{f[0]}")), enumerate(features), F.when(F.lit(False), F.lit(0.0)))
    known = F.col(dominant).isin(features)
    status = F.when(~S.is_true(known), "unclassified").when(delta.isNull(), "missing_delta").when(F.abs(delta) <= tolerance, "neutral").when(delta > 0, "positive").otherwise("negative")
    return rows.withColumn("sign_status", status).withColumn("band", F.floor((F.col("event_no") - 1) / 10))


def sign_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    known = F.col("sign_status").isin("positive", "negative")
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(known).alias("classified"), F.count_if(F.col("sign_status") == "positive").alias("positive"), F.count_if(F.col("sign_status") == "negative").alias("negative"))
    return out.withColumn("positive_share", S.ratio(F.col("positive"), F.col("classified")))


def matched_background(warnings: DataFrame, eligible: DataFrame, keys: list[str]) -> DataFrame:
    """Warnings with the positive share and size of their background stratum (null keys match null keys)."""
    known = F.col("sign_status").isin("positive", "negative")
    back = eligible.groupBy(*[F.col(k).alias(f"b_{k}") for k in keys]).agg(F.avg(F.when(known, (F.col("sign_status") == "positive").cast("double"))).alias("background"), F.count_if(known).alias("background_n"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys])
    return warnings.join(back, on, "left").drop(*[f"b_{k}" for k in keys])


def excess_interval(rows: DataFrame, samples: int, seed: int) -> DataFrame:
    """How much oftener warnings are positive than their background, with a percentile interval over resampled entities.

    rows come from `matched_background`. Only one sum and count an entity go to the driver; draws are made in blocks.
    With fewer than two entities there is no interval.
    """
    import numpy as np

    known = rows.filter(F.col("sign_status").isin("positive", "negative") & F.col("background").isNotNull())
    excess = (F.col("sign_status") == "positive").cast("double") - F.col("background")
    found = known.groupBy("entity_id").agg(F.sum(excess).alias("total"), F.count("*").alias("n")).orderBy("entity_id").collect()
    total, n = np.array([r.total for r in found]), np.array([r.n for r in found], np.int64)
    low = high = None
    if len(found) > 1:
        rng, block, drawn = np.random.default_rng(seed), max(1, 1_000_000 // len(found)), []
        for at in range(0, samples, block):
            who = rng.integers(0, len(found), size=(min(block, samples - at), len(found)))
            drawn.append(total[who].sum(axis=1) / n[who].sum(axis=1))
        low, high = (float(x) for x in np.quantile(np.concatenate(drawn), [0.025, 0.975]))
    row = (float(total.sum() / n.sum()) if found else None, low, high, len(found), int(n.sum()), samples if len(found) > 1 else 0)
    return rows.sparkSession.createDataFrame([row], "estimate double, low double, high double, entities long, warnings long, replicates long")


def shuffled(events: DataFrame, score: str, strata: list[str], seed: int, name: str = "shuffled") -> DataFrame:
    """Permutes the eligible scores within strata, by pairing two orders of the same rows."""
    ok = events.filter(detect_input(score))
    by_place = ok.withColumn("__i", F.row_number().over(Window.partitionBy(*strata).orderBy(*EVENT)))
    by_chance = ok.select(*strata, score, F.row_number().over(Window.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), *EVENT), *EVENT)).alias("__i")).withColumnRenamed(score, name)
    return events.join(by_place.join(by_chance, [*strata, "__i"]).select(*EVENT, name), EVENT, "left")


def ablation(events: DataFrame, features: list[str], subsets: dict[str, list[str]], eps: DataFrame, labelled: DataFrame, p: Params, pivots: dict[str, float], reference: tuple[float, float] | None = None, buckets: int | None = None) -> DataFrame:
    """Metrics on test for detectors on feature subsets, each with its own re-inverted covariance and validation threshold.

    A variant's rows are deleted once its metrics are written. buckets: how many labelled events and episodes lie in by entity, if they do.
    """
    out = []
    for name, subset in subsets.items():
        scored = baseline.scored(labelled, subset, p, [pivots[f] for f in subset])
        scored = materialise(scored.select(*EVENT, "split", "is_calibration", "is_censored", "target", "distance"), "entity_id", buckets)
        mean, std = reference or reference_from_train(scored, "distance")
        found = detect.with_cusum(scored, F.col("distance"), p, F.lit(mean), F.lit(std))
        found = materialise(found.select(*EVENT, "split", "is_calibration", "is_censored", "target", "cusum"), "entity_id", buckets)
        chosen = evaluate.operating_threshold(evaluate.threshold_curve(found, eps, "cusum", "validation", p), p).select("threshold")
        tested = found.crossJoin(F.broadcast(chosen))
        result = evaluate.evaluate(tested, eps, F.col("cusum") >= F.col("threshold"), F.col("cusum").isNotNull(), "test", p, ["threshold"]).withColumn("variant", F.lit(name))
        out.append(materialise(result))
        discard(scored, found)
    return reduce(DataFrame.unionByName, out)


def label_sensitivity(scored: DataFrame, groups: DataFrame, settings: list[tuple[float, int, int]], score: str, p: Params) -> DataFrame:
    """For each (threshold, window, horizon): labels made anew, an operating threshold chosen on validation, warnings evaluated on test.

    scored has events (with group_no, split, is_calibration and the score); labels never reach the score, so it's computed once.
    """
    from dataclasses import replace

    out = []
    for threshold, window, horizon in settings:
        q = replace(p, label_threshold=threshold, label_groups=window, horizon=horizon)
        flags = episodes.flagged(groups, q)
        ev = materialise(episodes.labelled(scored, flags, q).select(*EVENT, "split", "is_calibration", "is_censored", "target", score))
        eps = materialise(episodes.episodes(flags))
        chosen = evaluate.operating_threshold(evaluate.threshold_curve(ev, eps, score, "validation", q), q).first()
        found = evaluate.evaluate(ev, eps, F.col(score) >= F.lit(chosen.threshold), F.col(score).isNotNull(), "test", q)
        named = [F.lit(float(threshold)).alias("threshold"), F.lit(window).cast("long").alias("window"), F.lit(horizon).cast("long").alias("horizon")]
        out.append(found.select(*named, "episodes", "evaluable", "matched", "recall", "precision", "false_per_session", F.lit(chosen.threshold).alias("chosen"), F.lit(chosen.false_per_session).cast("double").alias("validation_false")))
    return reduce(DataFrame.unionByName, out)


def label_audit(labelled: DataFrame, eps: DataFrame, p: Params) -> DataFrame:
    """Per split: episodes, their length, opportunities within the horizon before onset, and those without any."""
    chance = labelled.filter(~F.coalesce("is_calibration", F.lit(True))).select(*SESSION, "event_no")
    split = labelled.groupBy(*SESSION).agg(F.min("split").alias("split"))
    near = eps.join(chance, SESSION, "left").groupBy(*SESSION, "episode_id", "onset_no", "end_no").agg(F.count_if((F.col("event_no") >= F.col("onset_no") - p.horizon) & (F.col("event_no") < F.col("onset_no"))).alias("before"))
    return near.join(split, SESSION).groupBy("split").agg(
        F.count("*").alias("episodes"), F.percentile(F.col("end_no") - F.col("onset_no") + 1, F.lit(0.5)).alias("median_length"),
        F.percentile("before", F.lit(0.5)).alias("median_before"), F.count_if(F.col("before") == 0).alias("undetectable"), F.count_if(F.col("onset_no") <= p.calibration).alias("in_calibration"),
    )


def review_sample(rows: DataFrame, strata: list[str], key: list[str], n: int, seed: int) -> DataFrame:
    """At most n rows per stratum in the order of a seeded hash (a sampling operator)."""
    w = Window.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), *key), *key)
    return rows.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def case_sessions(stats: DataFrame) -> DataFrame:
    """One session per outcome category: hit, false alarm, miss, quiet."""
    cat = F.when((F.col("matched") > 0), "TP").when((F.col("evaluable") > F.col("matched")) & (F.col("episodes") == 0), "FP").when((F.col("episodes") > 0) & (F.col("matched") == 0), "FN").when((F.col("episodes") == 0) & (F.col("raw_warnings") == 0), "TN")
    w = Window.partitionBy("category").orderBy(*SESSION)
    return stats.withColumn("category", cat).filter("category is not null").withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").select("category", *SESSION, "episodes", "raw_warnings", "matched")


def warning_categories(warnings: DataFrame, matches: DataFrame, eps: DataFrame) -> DataFrame:
    """Adds category: censored, matched, false_clean or false_with_episode."""
    hit = matches.select(*SESSION, "warning_no", F.lit(True).alias("__hit"))
    sick = eps.select(*SESSION).distinct().withColumn("__sick", F.lit(True))
    out = warnings.join(hit, [*SESSION, "warning_no"], "left").join(sick, SESSION, "left")
    cat = F.when(F.coalesce("is_censored", F.lit(True)), "censored").when(F.col("__hit"), "matched").when(F.col("__sick"), "false_with_episode").otherwise("false_clean")
    return out.withColumn("category", cat).drop("__hit", "__sick")


def replay(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Events with their labels and the start of the last warning before them."""
    w = Window.partitionBy(*SESSION).orderBy("event_no").rowsBetween(Window.unboundedPreceding, 0)
    out = events.join(labels, EVENT, "left")
    return out.withColumn("last_warning", F.last(F.when(F.col("is_warning"), F.col("event_no")), ignorenulls=True).over(w))

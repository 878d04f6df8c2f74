"""Queries on evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlane.operators import detect, evaluate, studies
from driftlane.params import small_sessions as P
from driftlane.plans.registry import ALL, CUSUM, EV, GROUPS, SCORED, bucketed_events, buckets, events, r6, register, table
from driftlane.plans.scoring import _FIT, F4, detected, flagged_groups, full, scored
from driftlane.sources.events import EVENT, SESSION
from driftlane.sources.sinks import discard, materialise

LEVEL = 4.0


def _flag():
    return F.col("cusum") >= LEVEL, F.col("cusum").isNotNull()


def _starts(rows: str, flag: str, key: str) -> str:
    """SQL for warning starts of rows, by key."""
    return f"""on_ AS (SELECT *, coalesce({flag}, false) AND NOT is_calibration AS f FROM {rows}
), lagged AS (SELECT *, lag(f) OVER (PARTITION BY {key} ORDER BY event_no) AS pf FROM on_
), ws AS (SELECT *, event_no AS warning_no FROM lagged WHERE f AND NOT coalesce(pf, false))"""


def _match(key: str, warnings: str, horizon: str, extra: str = "") -> str:
    """SQL for greedy one-to-one matches: a fold over each session's lists."""
    return f"""wl AS (SELECT {key}, {extra} list(warning_no::BIGINT ORDER BY warning_no) AS w FROM {warnings} GROUP BY ALL
), ol AS (SELECT entity_id, session_id, list(onset_no::BIGINT ORDER BY onset_no) AS o FROM epi GROUP BY 1, 2
), folded AS (
  SELECT wl.*, list_reduce(list_prepend([0::BIGINT], list_transform(w, lambda x: [x])), lambda acc, x: list_append(acc, coalesce(list_min(list_filter(o, lambda v: v > x[1] AND v > list_max(acc) AND v <= x[1] + {horizon})), 0::BIGINT))) AS m
  FROM wl JOIN ol USING (entity_id, session_id)
), found AS (SELECT * FROM (SELECT {key}, {extra} unnest(w) AS warning_no, unnest(m[2:]) AS onset_no FROM folded) WHERE onset_no > 0)"""


_TEST = f"{ALL}, own AS (SELECT * FROM full_ev WHERE split = 'test'), {_starts('own', f'cusum >= {LEVEL}', 'entity_id, session_id')}"
_FOUND = f"{_TEST}, evaluable AS (SELECT * FROM ws WHERE NOT is_censored), {_match('entity_id, session_id', 'evaluable', P.horizon)}"
_STATS = f"""{_FOUND}, scope AS (
  SELECT entity_id, session_id, count(*) FILTER (NOT is_calibration AND NOT is_censored) AS opportunities, count(*) FILTER (NOT is_calibration AND NOT is_censored AND cusum IS NOT NULL) AS available,
    count(*) FILTER (NOT is_calibration AND NOT is_censored AND cusum >= {LEVEL}) AS alert_events, count(*) FILTER (NOT is_calibration AND NOT is_censored AND cusum >= {LEVEL} AND target) AS alert_targets,
    count(*) FILTER (NOT is_calibration AND NOT is_censored AND cusum < {LEVEL}) AS quiet_events, count(*) FILTER (NOT is_calibration AND NOT is_censored AND cusum < {LEVEL} AND target) AS quiet_targets
  FROM own GROUP BY 1, 2
), st AS (
  SELECT scope.*, coalesce(raw_warnings, 0) AS raw_warnings, coalesce(evaluable, 0) AS evaluable, coalesce(matched, 0) AS matched, coalesce(lead_sum, 0)::BIGINT AS lead_sum, coalesce(episodes, 0) AS episodes
  FROM scope LEFT JOIN (SELECT entity_id, session_id, count(*) AS raw_warnings, count(*) FILTER (NOT is_censored) AS evaluable FROM ws GROUP BY 1, 2) a USING (entity_id, session_id)
  LEFT JOIN (SELECT entity_id, session_id, count(*) AS matched, sum(onset_no - warning_no) AS lead_sum FROM found GROUP BY 1, 2) b USING (entity_id, session_id)
  LEFT JOIN (SELECT entity_id, session_id, count(*) AS episodes FROM epi GROUP BY 1, 2) c USING (entity_id, session_id))"""


def _stats(spark, sf):
    ev, eps = full(spark, sf)
    return evaluate.session_statistics(ev, eps, *_flag(), "test", P)


@register(f"WITH {_FOUND} SELECT entity_id, session_id, warning_no, onset_no FROM found")
def interval_match(spark, sf):
    ev, eps = full(spark, sf)
    starts = detect.warning_starts(ev.filter("split = 'test'"), *_flag()).filter("not is_censored")
    return evaluate.match(starts, eps, F.lit(P.horizon), [])


@register(f"WITH {_STATS} SELECT entity_id, session_id, opportunities, available, raw_warnings, evaluable, matched, lead_sum, episodes, alert_events, alert_targets, quiet_events, quiet_targets FROM st")
def bootstrap_sufficient_stats(spark, sf):
    return _stats(spark, sf).drop("leads", "clean")


@register(f"""WITH {_STATS} SELECT count(*) AS sessions, sum(episodes)::BIGINT AS episodes, sum(raw_warnings)::BIGINT AS raw_warnings, sum(evaluable)::BIGINT AS evaluable, sum(matched)::BIGINT AS matched, sum(raw_warnings - evaluable)::BIGINT AS censored,
  round(sum(matched) / sum(episodes), 6) AS recall, round(sum(matched) / sum(evaluable), 6) AS precision, round(sum(evaluable - matched) / count(*), 6) AS false_per_session, round(sum(available) / sum(opportunities), 6) AS event_coverage,
  round(count(*) FILTER (available > 0) / count(*), 6) AS session_coverage, round(sum(lead_sum) / sum(matched), 6) AS lead_mean, (SELECT round(median(onset_no - warning_no), 6) FROM found) AS lead_median FROM st""")
def warning_metrics(spark, sf):
    m = evaluate.metrics(_stats(spark, sf))
    rounded = ("recall", "precision", "false_per_session", "event_coverage", "session_coverage", "lead_mean", "lead_median")
    return m.select("sessions", "episodes", "raw_warnings", "evaluable", "matched", "censored", *[F.round(c, 6).alias(c) for c in rounded])


@register(f"WITH {_STATS} SELECT count(*) AS clean_sessions, count(*) FILTER (evaluable > 0) AS clean_warned, round(count(*) FILTER (evaluable > 0) / count(*), 6) AS clean_alarm_rate FROM st WHERE episodes = 0")
def clean_outing_far(spark, sf):
    return evaluate.metrics(_stats(spark, sf)).select("clean_sessions", "clean_warned", F.round("clean_alarm_rate", 6).alias("clean_alarm_rate"))


@register(f"WITH {_STATS} SELECT sum(alert_events)::BIGINT AS alert_events, sum(alert_targets)::BIGINT AS alert_targets, round((sum(alert_targets) / sum(alert_events)) / (sum(quiet_targets) / sum(quiet_events)), 6) AS risk_ratio, 'defined' AS risk_status FROM st")
def risk_ratio(spark, sf):
    return evaluate.metrics(_stats(spark, sf)).select("alert_events", "alert_targets", F.round("risk_ratio", 6).alias("risk_ratio"), "risk_status")


@register("""WITH l AS (SELECT n_chars, quality = 0 AS y FROM labels JOIN documents USING (doc_id)), v AS (SELECT n_chars, count(*) AS n, count(*) FILTER (y) AS p FROM l GROUP BY 1),
c AS (SELECT n_chars, sum(p) OVER w AS tp, sum(n) OVER w AS seen, sum(p) OVER () AS every, n FROM v WINDOW w AS (ORDER BY n_chars DESC)),
r AS (SELECT *, tp / every AS r, tp / seen AS pr, coalesce(lag(tp / every) OVER (ORDER BY n_chars DESC), 0) AS r0, coalesce(lag(tp / seen) OVER (ORDER BY n_chars DESC), 1) AS p0 FROM c)
SELECT round(sum((r - r0) * (pr + p0) / 2), 6) AS pr_auc, max(every)::BIGINT AS positives, sum(n)::BIGINT AS rows FROM r""")
def pr_auc(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluate.pr_auc(rows, "n_chars", F.col("quality") == 0).withColumn("pr_auc", F.round("pr_auc", 6))


_GRID = ", ".join(str(i / 30) for i in range(31))
_VALID = f"""{ALL}, own0 AS (SELECT * FROM full_ev WHERE split = 'validation'
), grid AS (SELECT DISTINCT threshold FROM (SELECT unnest(quantile_cont(cusum, [{_GRID}])) AS threshold FROM own0 WHERE NOT is_calibration AND NOT is_censored) UNION SELECT 'inf'::DOUBLE
), own AS (SELECT * FROM own0, grid), {_starts("own", "cusum >= threshold", "threshold, entity_id, session_id")}, evaluable AS (SELECT * FROM ws WHERE NOT is_censored), {_match("threshold, entity_id, session_id", "evaluable", P.horizon)}
, uni AS (SELECT DISTINCT entity_id, session_id FROM own0), ne AS (SELECT count(*) AS e FROM epi JOIN uni USING (entity_id, session_id)), ns AS (SELECT count(*) AS s FROM uni)
, curve AS (
  SELECT threshold, s AS sessions, e AS episodes, coalesce(raw, 0) AS raw_warnings, coalesce(ev, 0) AS evaluable, coalesce(m, 0) AS matched, coalesce(m, 0) / e AS recall, CASE WHEN ev > 0 THEN coalesce(m, 0) / ev END AS precision, (coalesce(ev, 0) - coalesce(m, 0)) / s AS fps
  FROM grid CROSS JOIN ne CROSS JOIN ns LEFT JOIN (SELECT threshold, count(*) AS raw, count(*) FILTER (NOT is_censored) AS ev FROM ws GROUP BY 1) a USING (threshold) LEFT JOIN (SELECT threshold, count(*) AS m FROM found GROUP BY 1) b USING (threshold))"""


def _curve(spark, sf):
    ev, eps = full(spark, sf)
    return evaluate.threshold_curve(ev, eps, "cusum", "validation", P)


def _finite(c):
    return F.when(F.col(c) != float("inf"), F.round(c, 6)).otherwise(-1.0).alias(c)


@register(f"WITH {_VALID} SELECT CASE WHEN threshold = 'inf'::DOUBLE THEN -1.0 ELSE round(threshold, 6) END AS threshold, sessions, episodes, raw_warnings, evaluable, matched, round(recall, 6) AS recall, round(precision, 6) AS precision, round(fps, 6) AS false_per_session FROM curve")
def threshold_curve(spark, sf):
    return _curve(spark, sf).select(_finite("threshold"), "sessions", "episodes", "raw_warnings", "evaluable", "matched", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "false_per_session")])


@register(f"WITH {_VALID} SELECT round(threshold, 6) AS threshold, round(recall, 6) AS recall, round(precision, 6) AS precision, round(fps, 6) AS false_per_session FROM curve WHERE fps <= {P.allowance} ORDER BY coalesce(curve.recall, -1) DESC, coalesce(curve.precision, -1) DESC, fps, curve.threshold DESC LIMIT 1")
def operating_threshold(spark, sf):
    return evaluate.operating_threshold(_curve(spark, sf), P).select(*[F.round(c, 6).alias(c) for c in ("threshold", "recall", "precision", "false_per_session")])


_LEAD = f"""{_TEST}, cases AS (SELECT h AS horizon, q AS population FROM (SELECT unnest([{", ".join(f"{h}::BIGINT" for h in P.horizons)}]) AS h), (SELECT unnest(['complete', 'common']) AS q)
), wide AS (SELECT entity_id, session_id, warning_no, horizon, population FROM ws CROSS JOIN cases WHERE remaining >= CASE WHEN population = 'common' THEN {max(P.horizons)} ELSE horizon END), {_match("entity_id, session_id", "wide", "horizon", "horizon, population,")}"""


@register(f"""WITH {_LEAD}, ne AS (SELECT count(*) AS episodes FROM epi WHERE (entity_id, session_id) IN (SELECT entity_id, session_id FROM own))
SELECT horizon, population, coalesce(n, 0) AS warnings, coalesce(m, 0) AS matched, episodes, round(lead_mean, 6) AS lead_mean, round(lead_median, 6) AS lead_median, round(coalesce(m, 0) / episodes, 6) AS recall, CASE WHEN n > 0 THEN round(coalesce(m, 0) / n, 6) END AS precision
FROM cases CROSS JOIN ne LEFT JOIN (SELECT horizon, population, count(*) AS n FROM wide GROUP BY 1, 2) a USING (horizon, population)
LEFT JOIN (SELECT horizon, population, count(*) AS m, avg(onset_no - warning_no) AS lead_mean, median(onset_no - warning_no) AS lead_median FROM found GROUP BY 1, 2) b USING (horizon, population)""")
def lead_time_sensitivity(spark, sf):
    ev, eps = full(spark, sf)
    out, _ = evaluate.lead_time(ev, eps, *_flag(), "test", P)
    return out.select("horizon", "population", "warnings", "matched", "episodes", *[F.round(c, 6).alias(c) for c in ("lead_mean", "lead_median", "recall", "precision")])


@register(f"WITH {_LEAD} SELECT horizon, population, onset_no - warning_no AS lead, count(*) AS n FROM found GROUP BY ALL")
def lead_time_histogram(spark, sf):
    ev, eps = full(spark, sf)
    _, found = evaluate.lead_time(ev, eps, *_flag(), "test", P)
    return evaluate.lead_histogram(found)


_SETTINGS = [(0.55, 3, 6), (0.65, 3, 6), (0.75, 3, 6), (0.65, 2, 6), (0.65, 3, 4), (0.65, 3, 8), (0.65, 3, 10)]


def _sensitivity_sql(threshold: float, window: int, horizon: int) -> str:
    """Labels, choice on validation, evaluation on test, of one setting; `cu` comes from outside."""
    groups = GROUPS.replace(f"ROWS {P.label_groups - 1} PRECEDING", f"ROWS {window - 1} PRECEDING").replace(f"ro >= {P.label_threshold}", f"ro >= {threshold}").replace(f"event_no + {P.horizon}", f"event_no + {horizon}").replace(f"event_no < {P.horizon}", f"event_no < {horizon}")
    labels = f"{groups}, full_ev AS (SELECT cu.*, target, active, remaining, is_censored FROM cu JOIN lab USING (entity_id, session_id, event_no))"
    curve = _VALID.removeprefix(f"{ALL}, ").replace(f"<= x[1] + {P.horizon})", f"<= x[1] + {horizon})")
    test = f"own AS (SELECT * FROM full_ev WHERE split = 'test'), {_starts('own', 'cusum >= (SELECT threshold FROM best)', 'entity_id, session_id')}, evaluable AS (SELECT * FROM ws WHERE NOT is_censored), {_match('entity_id, session_id', 'evaluable', horizon)}"
    return f"""(WITH {labels}, best AS (WITH {curve} SELECT threshold, fps FROM curve WHERE fps <= {P.allowance} ORDER BY coalesce(curve.recall, -1) DESC, coalesce(curve.precision, -1) DESC, fps, curve.threshold DESC LIMIT 1), {test},
c AS (SELECT (SELECT count(DISTINCT (entity_id, session_id)) FROM own) AS s, (SELECT count(*) FROM epi WHERE (entity_id, session_id) IN (SELECT (entity_id, session_id) FROM own)) AS e, (SELECT count(*) FROM evaluable) AS ev, (SELECT count(*) FROM found) AS m)
SELECT {threshold}::DOUBLE AS threshold, {window}::BIGINT AS "window", {horizon}::BIGINT AS horizon, e AS episodes, ev AS evaluable, m AS matched, round(m / e, 6) AS recall, CASE WHEN ev > 0 THEN round(m / ev, 6) END AS precision, round((ev - m) / s, 6) AS false_per_session, round(threshold, 6) AS chosen, round(fps, 6) AS validation_false FROM c, best)"""


@register(f"WITH {CUSUM} " + " UNION ALL ".join(_sensitivity_sql(*s) for s in _SETTINGS))
def label_sensitivity(spark, sf):
    from driftlane.operators import episodes

    scores = materialise(detected(spark, sf).select(*EVENT, "group_no", "split", "is_calibration", "cusum"))
    groups = materialise(episodes.groups(events(spark, sf), F.col("raw_outcome"), F.col("f1") >= 45, F.col("f4") >= 8))
    out = studies.label_sensitivity(scores, groups, _SETTINGS, "cusum", P)
    return out.select("threshold", "window", "horizon", "episodes", "evaluable", "matched", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "false_per_session", "chosen", "validation_false")])


@register(f"""WITH {SCORED}, x AS (SELECT entity_id, session_id, event_no, distance FROM sc WHERE distance IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY entity_id, session_id ORDER BY distance) + (count(*) OVER (PARTITION BY entity_id, session_id, distance) - 1) / 2 AS a, rank() OVER (PARTITION BY entity_id, session_id ORDER BY event_no)::DOUBLE AS b FROM x)
SELECT entity_id, session_id, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1, 2 HAVING count(*) >= 10 AND count(DISTINCT a) >= 3""")
def spearman_by_session(spark, sf):
    return studies.spearman(scored(spark, sf), "distance", "event_no", SESSION).withColumn("rho", F.round("rho", 6))


@register(f"""WITH {SCORED}, x AS (SELECT entity_id, session_id, split, event_no, distance FROM sc WHERE distance IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY distance) + (count(*) OVER (PARTITION BY split, distance) - 1) / 2 AS a, rank() OVER (PARTITION BY split ORDER BY event_no) + (count(*) OVER (PARTITION BY split, event_no) - 1) / 2 AS b,
  rank() OVER (PARTITION BY entity_id, session_id ORDER BY distance) + (count(*) OVER (PARTITION BY entity_id, session_id, distance) - 1) / 2 AS sa, rank() OVER (PARTITION BY entity_id, session_id ORDER BY event_no) AS sb FROM x),
pooled AS (SELECT split, count(*) AS n, CASE WHEN count(*) >= 10 THEN round(corr(a, b), 6) END AS pooled_rho FROM r GROUP BY 1),
per AS (SELECT split, CASE WHEN count(*) >= 10 AND count(DISTINCT distance) >= 3 THEN corr(sa, sb) END AS rho FROM r GROUP BY split, entity_id, session_id)
SELECT split, any_value(n) AS n, any_value(pooled_rho) AS pooled_rho, count(rho) AS sessions, count(*) FILTER (rho IS NULL) AS excluded_sessions, round(quantile_cont(rho, 0.25), 6) AS p25, round(median(rho), 6) AS median_rho, round(quantile_cont(rho, 0.75), 6) AS p75,
  round(avg((rho > 0.9)::INT), 6) AS share_above_0_9 FROM per JOIN pooled USING (split) GROUP BY 1""")
def rank_correlations(spark, sf):
    rows = materialise(scored(spark, sf).select(*SESSION, "split", "event_no", "distance"))
    out = studies.rank_correlations(rows, "distance", "event_no", ["split"])
    return out.select("split", "n", "sessions", "excluded_sessions", *[F.round(c, 6).alias(c) for c in ("pooled_rho", "p25", "median_rho", "p75", "share_above_0_9")])


_SIGNS = f"""{SCORED}, q AS (SELECT *, (f1 - cm0)**2 * a1 >= (f2 - cm1)**2 * a0 AS first_ FROM sc WHERE availability = 'AVAILABLE'), dl AS (SELECT *, CASE WHEN first_ THEN f1 - cm0 ELSE f2 - cm1 END AS dd FROM q),
sg AS (SELECT *, CASE WHEN abs(dd) <= 5e-5 THEN 'neutral' WHEN dd > 0 THEN 'positive' ELSE 'negative' END AS sign, (event_no - 1) // 10 AS band, CASE WHEN first_ THEN 'f1' ELSE 'f2' END AS dom FROM dl)"""


def _signed(spark, sf):
    return studies.hypothesis_signs(scored(spark, sf).filter("distance is not null"), ["f1", "f2"])


@register(f"WITH {_SIGNS} SELECT split, kind, dom AS dominant, count(*) AS n, count(*) FILTER (sign IN ('positive', 'negative')) AS classified, count(*) FILTER (sign = 'positive') AS positive, count(*) FILTER (sign = 'negative') AS negative, round(count(*) FILTER (sign = 'positive') / count(*) FILTER (sign IN ('positive', 'negative')), 6) AS positive_share FROM sg GROUP BY 1, 2, 3")
def sign_summary(spark, sf):
    return studies.sign_summary(_signed(spark, sf), ["split", "kind", "dominant"]).withColumn("positive_share", F.round("positive_share", 6))


@register(f"""WITH {_SIGNS}, back AS (SELECT split, kind, band, dom, avg((sign = 'positive')::INT) FILTER (sign IN ('positive', 'negative')) AS background, count(*) FILTER (sign IN ('positive', 'negative')) AS background_n FROM sg GROUP BY 1, 2, 3, 4)
SELECT entity_id, session_id, event_no, sign AS sign_status, round(background, 6) AS background, background_n FROM sg JOIN back USING (split, kind, band, dom) WHERE distance >= 3""")
def matched_background(spark, sf):
    rows = _signed(spark, sf)
    out = studies.matched_background(rows.filter("distance >= 3"), rows, ["split", "kind", "band", "dominant"])
    return out.select(*EVENT, "sign_status", F.round("background", 6).alias("background"), "background_n")


@register()
def excess_interval(spark, sf):
    rows = materialise(_signed(spark, sf).select(*EVENT, "split", "kind", "band", "dominant", "sign_status", "distance"))
    found = studies.matched_background(rows.filter("distance >= 3"), rows, ["split", "kind", "band", "dominant"])
    return studies.excess_interval(found, P.bootstrap, P.seed)


@register(f"""WITH {EV}, {GROUPS}, ch AS (SELECT epi.entity_id, epi.session_id, episode_id, onset_no, end_no, count(*) FILTER (event_no > {P.calibration} AND event_no >= onset_no - {P.horizon} AND event_no < onset_no) AS b, min(split) AS split FROM epi JOIN ev USING (entity_id, session_id) GROUP BY 1, 2, 3, 4, 5)
SELECT split, count(*) AS episodes, median(end_no - onset_no + 1) AS median_length, median(b) AS median_before, count(*) FILTER (b = 0) AS undetectable, count(*) FILTER (onset_no <= {P.calibration}) AS in_calibration FROM ch GROUP BY 1""")
def label_audit(spark, sf):
    from driftlane.operators import episodes

    ev = events(spark, sf)
    flags = flagged_groups(ev)
    return studies.label_audit(episodes.labelled(ev, flags, P), episodes.episodes(flags), P)


@register(f"""WITH {_STATS} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY entity_id, session_id) AS rn FROM (
  SELECT CASE WHEN matched > 0 THEN 'TP' WHEN evaluable > matched AND episodes = 0 THEN 'FP' WHEN episodes > 0 THEN 'FN' WHEN raw_warnings = 0 THEN 'TN' END AS category, entity_id, session_id, episodes, raw_warnings, matched FROM st) WHERE category IS NOT NULL) WHERE rn = 1""")
def case_sessions(spark, sf):
    return studies.case_sessions(_stats(spark, sf))


@register(f"""WITH {_FOUND} SELECT CASE WHEN is_censored THEN 'censored' WHEN onset_no IS NOT NULL THEN 'matched' WHEN (ws.entity_id, ws.session_id) IN (SELECT entity_id, session_id FROM epi) THEN 'false_with_episode' ELSE 'false_clean' END AS category, count(*) AS n
FROM ws LEFT JOIN found ON found.entity_id = ws.entity_id AND found.session_id = ws.session_id AND found.warning_no = ws.warning_no GROUP BY 1""")
def warning_categories(spark, sf):
    ev, eps = full(spark, sf)
    starts = detect.warning_starts(ev.filter("split = 'test'"), *_flag())
    found = evaluate.match(starts.filter("not is_censored"), eps, F.lit(P.horizon), [])
    return studies.warning_categories(starts, found, eps).groupBy("category").agg(F.count("*").alias("n"))


@register(f"""WITH {_STATS} SELECT entity_id, count(*) AS sessions, sum(episodes)::BIGINT AS episodes, sum(evaluable)::BIGINT AS evaluable, sum(matched)::BIGINT AS matched, CASE WHEN sum(episodes) > 0 THEN round(sum(matched) / sum(episodes), 6) END AS recall FROM st GROUP BY 1""")
def entity_metrics(spark, sf):
    return evaluate.metrics(_stats(spark, sf), ["entity_id"]).select("entity_id", "sessions", "episodes", "evaluable", "matched", F.round("recall", 6).alias("recall"))


@register(f"""WITH {_STATS}, {_FIT}, g AS (SELECT entity_id, CASE WHEN weight IS NULL THEN 'fallback' WHEN std < ms THEN 'low' ELSE 'high' END AS grp FROM scale, (SELECT ms FROM med))
SELECT coalesce(grp, 'fallback') AS "group", count(*) AS sessions, sum(episodes)::BIGINT AS episodes, sum(evaluable)::BIGINT AS evaluable, sum(matched)::BIGINT AS matched, CASE WHEN sum(episodes) > 0 THEN round(sum(matched) / sum(episodes), 6) END AS recall,
  CASE WHEN sum(evaluable) > 0 THEN round(sum(matched) / sum(evaluable), 6) END AS precision, round(sum(evaluable - matched) / count(*), 6) AS false_per_session FROM st LEFT JOIN g USING (entity_id) GROUP BY 1""")
def subgroup_metrics(spark, sf):
    ev, eps = full(spark, sf, "distance")
    stats = evaluate.session_statistics(ev, eps, *_flag(), "test", P)
    out = studies.subgroup_metrics(stats, studies.dispersion_scales(ev.filter("split = 'train'"), "distance", P))
    return out.select("group", "sessions", "episodes", "evaluable", "matched", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "false_per_session")])


@register()
def bootstrap_ci(spark, sf):
    ev, eps = full(spark, sf)
    own = ev.filter("split = 'test'")
    models = [("cusum", F.col("cusum") >= LEVEL), ("count", F.col("event_no") >= 15)]
    rows = own.withColumn("model", F.explode(F.array(*[F.lit(m) for m, _ in models])))
    flag = F.when(F.col("model") == "cusum", models[0][1]).otherwise(models[1][1])
    available = F.when(F.col("model") == "cusum", F.col("cusum").isNotNull()).otherwise(True)
    stats = evaluate.session_statistics(rows, eps, flag, available, "test", P, ["model"])
    return evaluate.bootstrap(stats, "session", P, "model", "cusum")


@register()
def feature_ablation(spark, sf):
    from driftlane.operators import episodes

    n, ev = buckets(spark, sf), bucketed_events(spark, sf, *EVENT, "session_date", "kind", *F4, "raw_outcome", "group_no", "split", "is_calibration")
    flags = flagged_groups(ev)
    base = materialise(episodes.labelled(ev, flags, P).select(*EVENT, "session_date", "kind", *F4, "split", "is_calibration", "target", "is_censored"), "entity_id", n)
    eps = materialise(episodes.episodes(flags), "entity_id", n)
    discard(ev)
    subsets = {"full": F4, "first": ["f1"], "money": ["f2"], "rates": ["f3", "f4"]}
    return studies.ablation(base, F4, subsets, eps, base, P, dict(zip(F4, [25.0, 38.0, 5.0, 4.0], strict=True)), buckets=n).select("variant", "threshold", "recall", "precision", "false_per_session", "matched", "evaluable")


@register()
def model_comparison(spark, sf):
    """Four scores on identical sessions, thresholds frozen on validation before test is looked at."""
    from driftlane.plans.compare import compare

    return compare(*full(spark, sf, "kind", "group_no", "f1"), P, buckets=buckets(spark, sf))


_ = r6

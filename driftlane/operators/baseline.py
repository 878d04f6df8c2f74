"""As-of baselines, calibration and multivariate distance.

A baseline of (entity, session, kind) uses the last `window_sessions` sessions of
the entity with a strictly earlier date. Sessions are reduced to sufficient
statistics first; only these are copied to the sessions that look back at them,
by an equi-join on the entity's session number, so events are never exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from driftlane.functions import scalar as S
from driftlane.params import Params
from driftlane.sources.events import SESSION

KEY = [*SESSION, "kind"]
QUALIFIED, SHORT, FEW = "QUALIFIED", "INSUFFICIENT_HISTORY", "INSUFFICIENT_KIND_OBSERVATIONS"


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def session_order(events: DataFrame) -> DataFrame:
    """Sessions with ord (1.. by date, then id) and k, the number of sessions with a strictly earlier date."""
    s = events.groupBy(*SESSION).agg(F.min("session_date").alias("session_date"))
    w = Window.partitionBy("entity_id")
    before = w.orderBy(F.unix_date("session_date")).rangeBetween(Window.unboundedPreceding, -1)
    return s.withColumn("ord", F.row_number().over(w.orderBy("session_date", "session_id"))).withColumn("k", F.count("*").over(before).cast("int"))


def baselines(events: DataFrame, features: list[str], p: Params, pivots: list[float] | None = None) -> DataFrame:
    """One row per (entity, session, kind): k, n, status, mean_i, sd_i, cov_i_j of the complete rows looked back at.

    Pivots are fixed constants taken off the features, to keep sums small.
    """
    d, pivots = len(features), pivots or [0.0] * len(features)
    x = [F.col(f) - F.lit(float(v)) for f, v in zip(features, pivots, strict=True)]
    complete = x[0].isNotNull()
    for one in x[1:]:
        complete = complete & one.isNotNull()
    whole = lambda c: F.sum(F.when(complete, c))
    sums = [whole(x[i]).alias(f"s{i}") for i in range(d)] + [whole(x[i] * x[j]).alias(f"q{i}_{j}") for i, j in _pairs(d)]
    stats = events.filter(F.col("kind").isNotNull()).groupBy(*KEY).agg(F.count_if(complete).alias("n"), *sums)
    order = session_order(events)
    seen = order.select("entity_id", F.col("session_id").alias("past_session"), F.col("ord").alias("past"))
    past = stats.withColumnRenamed("session_id", "past_session").join(seen, ["entity_id", "past_session"])
    now = stats.select(*KEY).join(order.select(*SESSION, "k"), SESSION)
    # only the few session numbers looked back at are exploded
    look = now.filter("k > 0").withColumn("past", F.explode(F.sequence(F.greatest(F.lit(1), F.col("k") - (p.window_sessions - 1)), F.col("k"))))
    total = look.join(past, ["entity_id", "kind", "past"]).groupBy(*KEY).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in (*[f"s{i}" for i in range(d)], *[f"q{i}_{j}" for i, j in _pairs(d)])])
    out = now.join(total, KEY, "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(F.col("k") < p.min_prior, SHORT).when(n < p.min_observations, FEW).otherwise(QUALIFIED)
    mean = [F.col(f"s{i}") / F.col("n") for i in range(d)]
    cov = {(i, j): S.ratio(F.col(f"q{i}_{j}") - F.col("n") * mean[i] * mean[j], F.col("n") - 1) for i, j in _pairs(d)}
    columns = {f"mean_{i}": mean[i] + F.lit(float(pivots[i])) for i in range(d)} | {f"cov_{i}_{j}": cov[i, j] for i, j in _pairs(d)}
    out = out.withColumns(columns | {"n": n, "status": status})
    sd = {f"sd_{i}": F.when(F.col(f"cov_{i}_{i}").isNotNull(), F.greatest(F.lit(1e-4), F.sqrt(F.greatest(F.lit(0.0), F.col(f"cov_{i}_{i}"))))) for i in range(d)}
    return out.withColumns(sd).select(*KEY, "k", "n", "status", *columns, *sd)


def precision(matrix: Column, d: int, ridge: float) -> Column:
    """Inverse of a flattened d x d matrix plus ridge * I; a pseudo-inverse where it is singular."""

    @pandas_udf("array<double>")
    def invert(flat):
        import numpy as np
        import pandas as pd

        good = flat.map(lambda v: v is not None and len(v) == d * d and all(x is not None and np.isfinite(x) for x in v)).to_numpy(bool) if len(flat) else np.zeros(0, bool)
        out = np.empty(len(flat), object)
        out[:] = None
        if good.any():
            m = np.stack([np.asarray(v, float) for v in flat[good]]).reshape(-1, d, d) + ridge * np.eye(d)
            try:
                inverse = np.linalg.inv(m)
            except np.linalg.LinAlgError:
                inverse = np.stack([np.linalg.pinv(x) for x in m])
            for i, x in zip(np.flatnonzero(good), inverse, strict=True):
                out[i] = x.ravel()
        return pd.Series(out)

    return invert(matrix)


def covariance_array(d: int) -> Column:
    return F.array(*[F.col(f"cov_{min(i, j)}_{max(i, j)}") for i in range(d) for j in range(d)])


def _quadratic(x: list[Column], d: int) -> Column:
    """x' P x with P in the column `precision`."""
    return sum((x[i] * x[j] * F.get("precision", F.lit(i * d + j)) for i in range(d) for j in range(d)), F.lit(0.0))


def inverse_columns(b: DataFrame, d: int, p: Params) -> DataFrame:
    """Adds `precision`: in closed form up to two features, by batched inversion beyond."""
    if d == 1:
        return b.withColumn("precision", F.array(S.ratio(F.lit(1.0), F.col("cov_0_0") + p.ridge)))
    if d == 2:
        a, c, e = F.col("cov_0_0") + p.ridge, F.col("cov_0_1"), F.col("cov_1_1") + p.ridge
        det = a * e - c * c
        return b.withColumn("precision", F.array(S.ratio(e, det), S.ratio(-c, det), S.ratio(-c, det), S.ratio(a, det)))
    return b.withColumn("precision", precision(F.when(F.col("status") == QUALIFIED, covariance_array(d)), d, p.ridge))


def calibrate(events: DataFrame, baselines: DataFrame, features: list[str], p: Params) -> DataFrame:
    """Events with their baseline, calibrated means cm_i, z_i against history, delta_i against the calibrated mean (after calibration)."""
    d = len(features)
    w = Window.partitionBy(*KEY)
    early = F.col("event_no") <= p.calibration
    out = events.withColumn("is_calibration", early).withColumn("early_n", F.count_if(early).over(w))
    out = out.withColumns({f"early_{i}": F.avg(F.when(early, F.col(f))).over(w) for i, f in enumerate(features)})
    out = out.join(baselines, KEY, "left")
    known = F.col("status") == QUALIFIED
    mixed = {f"cm_{i}": F.when(known, F.when(F.col("early_n") >= 3, (1 - p.shrinkage) * F.col(f"mean_{i}") + p.shrinkage * F.col(f"early_{i}")).otherwise(F.col(f"mean_{i}"))) for i in range(d)}
    out = out.withColumns(mixed)
    return out.withColumns(
        {f"z_{i}": F.when(known, S.ratio(F.col(f) - F.col(f"mean_{i}"), F.col(f"sd_{i}"))) for i, f in enumerate(features)}
        | {f"delta_{i}": F.when(~early, F.col(f) - F.col(f"cm_{i}")) for i, f in enumerate(features)}
    )


def score(calibrated: DataFrame, features: list[str], p: Params, digits: int | None = None) -> DataFrame:
    """Adds availability, distance (to the calibrated mean), distance_raw (to history), index, shares and dominant feature."""
    d = len(features)
    complete = ~F.exists(F.array(*features), lambda v: v.isNull())
    status = (
        F.when(F.col("is_calibration"), "CALIBRATION")
        .when(F.col("status").isNull(), SHORT)
        .when(F.col("status") != QUALIFIED, F.col("status"))
        .when(~complete, "MISSING_FEATURES")
        .otherwise("AVAILABLE")
    )
    out = inverse_columns(calibrated, d, p).withColumn("availability", status)
    ok = F.col("availability") == "AVAILABLE"
    cal = [F.col(f) - F.col(f"cm_{i}") for i, f in enumerate(features)]
    raw = [F.col(f) - F.col(f"mean_{i}") for i, f in enumerate(features)]
    dist = lambda x: S.rounded(F.sqrt(F.greatest(F.lit(0.0), _quadratic(x, d))), digits)
    out = out.withColumn("distance", F.when(ok, dist(cal))).withColumn("distance_raw", F.when(ok, dist(raw)))
    parts = [x * x * F.get("precision", F.lit(i * d + i)) for i, x in enumerate(cal)]
    total = sum(parts, F.lit(0.0))
    out = out.withColumns({f"share_{i}": F.when(ok, S.ratio(100 * c, total)) for i, c in enumerate(parts)})
    return out.withColumn("dominant", F.when(ok, S.first_largest(features, parts))).withColumn("index", S.stability_index(F.col("distance"), p.index_decay, p.index_floor, digits))


def scored(events: DataFrame, features: list[str], p: Params, pivots: list[float] | None = None, digits: int | None = None) -> DataFrame:
    """The whole chain from events to distances."""
    return score(calibrate(events, baselines(events, features, p, pivots), features, p), features, p, digits)

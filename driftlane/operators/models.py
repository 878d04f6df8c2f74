"""Fitted scores: balanced logistic regression and reconstruction error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane.functions import scalar as S
from driftlane.operators.detect import opportunity


def standardised(rows: DataFrame, fit_on: DataFrame, columns: list[str]) -> DataFrame:
    """Adds s_<column>: (x - mean) / population std of fit_on; a constant column is only centred."""
    stats = fit_on.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"d_{c}") for c in columns])
    out = rows.crossJoin(F.broadcast(stats))
    scaled = {f"s_{c}": (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"d_{c}") > 0, F.col(f"d_{c}")).otherwise(1.0) for c in columns}
    return out.withColumns(scaled).drop(*stats.columns)


def logistic_scores(events: DataFrame, columns: list[str], target: str, name: str, c: float = 1.0, train: Column | None = None) -> DataFrame:
    """Adds the probability of a class-balanced, L2-regularised logistic regression fitted on train rows only.

    With one class among the train rows, the score is its constant label.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    train = opportunity("train") if train is None else train
    fit_on = events.filter(train)
    n, pos = fit_on.agg(F.count("*"), F.count_if(S.is_true(F.col(target)))).first()
    if not n or pos in (0, n):
        return events.withColumn(name, F.lit(float(bool(n and pos))))
    label = S.is_true(F.col(target)).cast("double")
    rows = standardised(events, fit_on, columns).withColumn("__y", label).withColumn("__w", F.when(F.col("__y") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))))
    rows = VectorAssembler(inputCols=[f"s_{x}" for x in columns], outputCol="__x", handleInvalid="keep").transform(rows)
    model = LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, tol=1e-10, maxIter=200, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__q").fit(rows.filter(train))
    return model.transform(rows).withColumn(name, vector_to_array("__p")[1]).select(*events.columns, name)


def clipped(events: DataFrame, columns: list[str], train: Column, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Columns clipped to quantiles of the train rows."""
    bounds = events.filter(train).agg(*[F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(f"b_{c}") for c in columns])
    out = events.crossJoin(F.broadcast(bounds))
    return out.withColumns({c: S.clip(F.col(c), F.get(f"b_{c}", 0), F.get(f"b_{c}", 1)) for c in columns}).drop(*bounds.columns)


def matched_models(events: DataFrame, context: list[str], extra: list[str], target: str) -> DataFrame:
    """Two scores on identical rows: context alone, and context with the extra features."""
    complete = ~F.exists(F.array(*[F.col(c).cast("double") for c in (*context, *extra)]), lambda v: v.isNull())
    rows = events.filter(complete)
    rows = clipped(rows, extra, opportunity("train"))
    return logistic_scores(logistic_scores(rows, context, target, "score_context"), [*context, *extra], target, "score_extended")


def reconstruction_error(events: DataFrame, columns: list[str], name: str = "reconstruction", k: int = 3, train: Column | None = None, least: int = 50) -> DataFrame:
    """Adds the mean squared error of a rank-k linear reconstruction fitted on complete train rows; missing scores as 0."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    complete = ~F.exists(F.array(*columns), lambda v: v.isNull())
    fit_on = events.filter(complete & (opportunity("train") if train is None else train))
    if fit_on.limit(least).count() < least:
        return events.withColumn(name, F.lit(None).cast("double"))
    rows = standardised(events, fit_on, columns).fillna(0.0, [f"s_{c}" for c in columns])
    vec = VectorAssembler(inputCols=[f"s_{c}" for c in columns], outputCol="__x")
    fitted = PCA(k=k, inputCol="__x", outputCol="__z").fit(vec.transform(standardised(fit_on, fit_on, columns)))
    pc = fitted.pc.toArray()
    z = vector_to_array("__z")
    error = sum((F.pow(F.col(f"s_{c}") - sum((z[j] * float(pc[i, j]) for j in range(k)), F.lit(0.0)), F.lit(2.0)) for i, c in enumerate(columns)), F.lit(0.0)) / len(columns)
    return fitted.transform(vec.transform(rows)).withColumn(name, error).select(*events.columns, name)

"""Price models: exact ridge, logistic labels, boosted trees under a robust loss, out-of-fold predictions and stacking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import HistogramBooster


class Scorer(Protocol):
    """A model that lives outside Spark (a language or image model): texts in, answers out, batch by batch."""

    def __call__(self, batch: pd.Series) -> pd.Series: ...


def score(df: DataFrame, column: str, out: str, scorer: Callable[[], Scorer]) -> DataFrame:
    """Answers of a scorer that every worker makes for itself once, on Arrow batches."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = scorer()
        for part in parts:
            yield own(part)

    return df.withColumn(out, run(F.col(column)))


# ridge


def fit_ridge(df: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> tuple[list[float], float]:
    """Exact coefficients and intercept: one aggregate of centred sums of squares and products, solved on the driver."""
    names = [*features, target]
    pairs = [F.covar_pop(a, b).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *pairs).first()
    p, n = len(features), row["n"]
    cov = np.array([[row[f"{min(i, j)}_{max(i, j)}"] * n for j in range(p + 1)] for i in range(p + 1)])
    w = np.linalg.solve(cov[:p, :p] + alpha * np.eye(p), cov[:p, p])
    return [float(x) for x in w], float(row[f"m{p}"] - sum(w[i] * row[f"m{i}"] for i in range(p)))


def linear(features: list[str], weights: list[float], intercept: float) -> Column:
    return sum((F.col(c) * F.lit(w) for c, w in zip(features, weights, strict=True)), F.lit(intercept))


def ridge_two(df: DataFrame, x1: str, x2: str, y: str, alpha: float = 1.0) -> DataFrame:
    """Coefficients for two features as one row (w1, w2, intercept), all inside the plan."""
    n = F.count(F.lit(1))
    s = df.agg(*[(F.covar_pop(a, b) * n).alias(k) for k, a, b in (("s11", x1, x1), ("s12", x1, x2), ("s22", x2, x2), ("t1", x1, y), ("t2", x2, y))], F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"))
    det = (F.col("s11") + alpha) * (F.col("s22") + alpha) - F.col("s12") * F.col("s12")
    w1 = ((F.col("s22") + alpha) * F.col("t1") - F.col("s12") * F.col("t2")) / det
    w2 = ((F.col("s11") + alpha) * F.col("t2") - F.col("s12") * F.col("t1")) / det
    return s.select(w1.alias("w1"), w2.alias("w2"), (F.col("my") - w1 * F.col("m1") - w2 * F.col("m2")).alias("intercept"))


# labels


def fit_labels(df: DataFrame, vector: str, label: str, least_rows: int = 200, iterations: int = 100):
    """Multinomial logistic regression on array vectors, or None where rows are too few."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import array_to_vector

    if df.limit(least_rows).count() < least_rows:
        return None
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("string").alias("label_name"))
    index = StringIndexer(inputCol="label_name", outputCol="label", stringOrderType="alphabetAsc")
    return Pipeline(stages=[index, LogisticRegression(family="multinomial", maxIter=iterations)]).fit(rows)


def predict_labels(model, df: DataFrame, vector: str) -> DataFrame:
    """df with label_name and confidence: the greatest class probability."""
    from pyspark.ml.functions import array_to_vector

    made = model.stages[1].transform(df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))))
    names = IndexToString(inputCol="prediction", outputCol="label_name", labels=model.stages[0].labels)
    return names.transform(made).withColumn("confidence", F.array_max(vector_to_array("probability"))).drop("features", "rawPrediction", "probability", "prediction")


def confident(current: Column, learned: Column, confidence: Column, fallback: str) -> Column:
    """The learned label over the fallback from 0.50 on, over another from 0.72 on."""
    return F.when((current == fallback) & (confidence >= 0.50), learned).when((current != learned) & (confidence >= 0.72), learned).otherwise(current)


# folds and stacks


def out_of_fold(df: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], folds: int) -> DataFrame:
    """Every row predicted by the model of the folds that it isn't in. fit(training rows) gives a function that adds predictions."""
    out = None
    for k in range(folds):
        own = fit(df.where(F.col("fold") != k))(df.where(F.col("fold") == k))
        out = own if out is None else out.unionByName(own)
    return out


def fit_stack(df: DataFrame, features: list[str], target: str, held: DataFrame, rounds: int = 500, patience: int = 50, **settings) -> HistogramBooster:
    """Boosted trees over base predictions under the squared loss, stopped after `patience` rounds without a lower mean absolute error of the held rows."""
    return HistogramBooster(features, "squared", "mae", rounds=rounds, patience=patience, **settings).fit(df, target, held)


def blended(columns: list[str], floor: float = 0.01) -> Column:
    """Mean of predictions, not under the floor."""
    return F.greatest(sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns), F.lit(floor))

"""Parameter search as data: a table of settings, met by every page, ranked by one aggregate."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """(trial, name...): every combination. A search space is a few hundred rows by nature."""
    names = list(values)
    rows = [(i, *map(float, c)) for i, c in enumerate(itertools.product(*values.values()))]
    return spark.createDataFrame(rows, "trial int, " + ", ".join(f"{n} double" for n in names))


def with_settings(rows: DataFrame, trials: list[dict]) -> DataFrame:
    """Each row once per setting. The settings are literals, so nothing is joined."""
    structs = [F.struct(F.lit(i).alias("trial"), *[F.lit(float(v)).alias(k) for k, v in t.items()]) for i, t in enumerate(trials)]
    return rows.withColumn("s", F.explode(F.array(*structs))).select(*rows.columns, "s.*")


def best_trial(scores: DataFrame, score: str = "hmean") -> DataFrame:
    """The trial of greatest score, the first on a tie."""
    best = F.max_by(F.struct(*scores.columns), F.struct(F.col(score), -F.col("trial"))).alias("b")
    return scores.agg(best).select("b.*")


def best_by_page(scores: DataFrame, score: str, key: str = "page_id") -> DataFrame:
    """Each page's own best trial, the first on a tie."""
    rest = F.struct(*[c for c in scores.columns if c != key])
    return scores.groupBy(key).agg(F.max_by(rest, F.struct(F.col(score), -F.col("trial"))).alias("b")).select(key, "b.*")


def clamped(value: Column, low: float, high: float, whole: bool = False) -> Column:
    x = F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))
    return F.rint(x).cast("int") if whole else x


def repaired(low: Column, high: Column) -> tuple[Column, Column]:
    """A range whose ends may have come in the wrong order."""
    return F.least(low, high), F.greatest(low, high)


def fit_regressors(rows: DataFrame, features: str, targets: list[str], rounds: int = 100, depth: int = 6, rate: float = 0.03) -> dict:
    """A boosted-tree regressor per target over an array<float> column, by Spark's own library."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    data = rows.withColumn("__v", array_to_vector(F.col(features).cast("array<double>")))
    return {t: GBTRegressor(featuresCol="__v", labelCol=t, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=42).fit(data) for t in targets}


def predict_settings(rows: DataFrame, features: str, models: dict, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """The models' settings for each row, inside their bounds."""
    from pyspark.ml.functions import array_to_vector

    data = rows.withColumn("__v", array_to_vector(F.col(features).cast("array<double>")))
    for name, model in models.items():
        data = model.setPredictionCol(f"__p_{name}").transform(data).withColumn(name, clamped(F.col(f"__p_{name}"), *bounds[name])).drop(f"__p_{name}")
    return data.drop("__v")

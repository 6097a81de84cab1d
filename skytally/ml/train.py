"""Boosted-tree regression and temperature classification with MLlib.

Feature matrices stay distributed. Missing values are imputed per column with a missing flag left to the
trees through the assembler's NaN handling; lineage of boosting rounds is cut in the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from skytally.ml.splits import TARGET, VARIANT_DROPS, feature_columns
from skytally.operators.evaluate import fit_measures
from skytally.session import checkpoint_dir


@dataclass
class Trained:
    variant: str
    features: list[str]
    model: PipelineModel
    train: dict
    validation: dict


def as_float(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric matrix columns; text that is not a number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("float") for c in columns})


def _usable(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least one value; an all-null column cannot be imputed."""
    seen = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if seen[c] > 0]


def regressor(features: Sequence[str], target: str = TARGET, rounds: int = 20, depth: int = 5, seed: int = 42) -> Pipeline:
    filled = [f"{c}__f" for c in features]
    return Pipeline(stages=[
        Imputer(inputCols=list(features), outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep"),
        GBTRegressor(featuresCol="features", labelCol=target, predictionCol="predicted_high_f", maxIter=rounds, maxDepth=depth,
                     seed=seed, validationIndicatorCol="is_validation", checkpointInterval=10, cacheNodeIds=True),
    ])


def train_variant(df: DataFrame, variant: str, features: Sequence[str], target: str = TARGET, **options) -> Trained:
    """Fit on ``split = 'train'`` with early stopping on ``validation``; report both."""
    checkpoint_dir(df.sparkSession)
    cols = _usable(df.filter("split = 'train'"), list(features))
    rows = as_float(df.filter("split IS NOT NULL"), cols).withColumn("is_validation", F.col("split") == "validation")
    rows = rows.filter(F.col(target).isNotNull()).withColumn(target, F.col(target).cast("double"))
    model = regressor(cols, target, **options).fit(rows)
    fit = fit_measures(model.transform(rows), target, "predicted_high_f", ["split"]).collect()
    by = {r["split"]: {k: r[k] for k in ("rmse", "mae", "r2")} for r in fit}
    return Trained(variant, cols, model, by.get("train", {}), by.get("validation", {}))


def best_variant(df: DataFrame, columns: Sequence[str], weekly: bool = False, variants=tuple(VARIANT_DROPS), **options) -> tuple[Trained, list[Trained]]:
    """Train every calendar variant and pick the lowest validation RMSE."""
    runs = [train_variant(df, v, feature_columns(columns, v, weekly), **options) for v in variants]
    return min(runs, key=lambda t: t.validation["rmse"]), runs


def train_by_hour(df: DataFrame, features: Sequence[str], hours: Sequence[int] = range(24), **options) -> dict[int, Trained]:
    """One model per local hour; hours without train or validation rows are skipped."""
    counts = {(r["local_hour"], r["split"]): r["n"] for r in df.groupBy("local_hour", "split").agg(F.count("*").alias("n")).collect()}
    return {
        h: train_variant(df.filter(F.col("local_hour") == h), f"hour_{h}", features, **options)
        for h in hours if counts.get((h, "train")) and counts.get((h, "validation"))
    }


def importances(spark, trained: Trained) -> DataFrame:
    gbt = trained.model.stages[-1]
    rows = [(f, float(w)) for f, w in zip(trained.features, gbt.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def score(df: DataFrame, model: PipelineModel, features: Sequence[str], observed: str | None = None, celsius: bool = False) -> DataFrame:
    """Predictions in °F; Celsius models are converted; never below the high already observed."""
    out = model.transform(as_float(df, features))
    p = F.col("predicted_high_f")
    p = p * 9.0 / 5.0 + 32.0 if celsius else p
    if observed:
        p = F.greatest(p, F.col(observed))
    hidden = [c for c in out.columns if c.endswith("__f")] + ["features"]
    return out.withColumn("predicted_high_f", p).drop(*hidden)


def score_by_hour(df: DataFrame, runs: dict[int, Trained], **options) -> DataFrame:
    """Each hour's rows through its own model, as one table. Rows of hours without a model are left out."""
    parts = [score(df.filter(F.col("local_hour") == h), t.model, t.features, **options) for h, t in sorted(runs.items())]
    return reduce(DataFrame.unionByName, parts)


def train_classifier(df: DataFrame, features: Sequence[str], target: str = TARGET, trees: int = 20, depth: int = 6, seed: int = 42):
    """Classes are whole degrees; labels count from the lowest one. Returns (model, lowest, features)."""
    checkpoint_dir(df.sparkSession)
    cols = _usable(df, list(features))
    whole = F.floor(F.col(target) + 0.5)
    rows = as_float(df.filter(F.col(target).isNotNull()), cols)
    low = int(rows.agg(F.min(whole)).first()[0])
    rows = rows.withColumn("label", (whole - low).cast("double"))
    filled = [f"{c}__f" for c in cols]
    model = Pipeline(stages=[
        Imputer(inputCols=cols, outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep"),
        RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed),
    ]).fit(rows)
    return model, low, cols


def class_probabilities(df: DataFrame, model: PipelineModel, low: int, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per (row, whole degree) with its probability."""
    out = model.transform(as_float(df, features))
    rows = out.select(*keys, F.posexplode(vector_to_array("probability")).alias("_i", "p"))
    return rows.select(*keys, (F.col("_i") + low).alias("temp_f"), "p").filter("p > 0")


def live_rows(features: DataFrame, schedule: DataFrame, start_hour: int, end_hour: int, near_minutes: int = 10) -> DataFrame:
    """Latest regular report per station within buy hours and close to its expected minute: the same feature
    columns as in training."""
    rows = features.filter(~F.col("is_extra") & F.col("local_hour").between(start_hour, end_hour))
    rows = rows.join(schedule.select("station", "scheduled_minutes"), "station")
    gap = F.array_min(F.transform(F.split("scheduled_minutes", ","), lambda m: F.least(
        F.abs(F.col("local_minute") - m.cast("int")), 60 - F.abs(F.col("local_minute") - m.cast("int")))))
    rows = rows.filter(gap <= near_minutes)
    latest = F.max_by(F.struct(*[c for c in rows.columns if c != "station"]), F.struct("epoch", "seq")).alias("r")
    return rows.groupBy("station").agg(latest).select("station", "r.*")

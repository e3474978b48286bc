"""Train three classifiers, compare them on validation, report them on test."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.functions.features import add_features, fill_missing_features
from ticketloom.operators.evaluation import binary_metrics, compare_models
from ticketloom.operators.ranking import stratified_split
from ticketloom.schemas import require_columns
from ticketloom.sources.models import detached, save_model
from ticketloom.sources.tables import staged, write_document

TARGET = "is_urgent"


@dataclass
class Trained:
    models: dict[str, PipelineModel]
    best: str
    split: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    comparison: DataFrame


def candidates(train_rows: int, trees: int = 100, depth: int = 30,
               iterations: int = 1000, seed: int = 42) -> dict[str, Estimator]:
    """The three classifiers in selection order.

    The penalty 1/n is the unit inverse strength of a summed loss. Forest depth is capped at 30,
    the most Spark allows.
    """
    common = {"featuresCol": "features_vector", "labelCol": TARGET}
    return {
        "logistic_regression": LogisticRegression(
            maxIter=iterations, regParam=1.0 / max(train_rows, 1), standardization=False, **common
        ),
        "random_forest": RandomForestClassifier(
            numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed, **common
        ),
        "gradient_boosting": GBTClassifier(
            maxIter=trees, maxDepth=3, stepSize=0.1, seed=seed, **common
        ),
    }


def assembler(features: Sequence[str] = fv.FEATURES) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features_vector")


def predictions_of(model: PipelineModel, name: str, rows: DataFrame,
                   key: str = "tweet_id") -> DataFrame:
    return model.transform(rows).select(
        F.lit(name).alias("model"), "split", key, F.col(TARGET).alias("label"),
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("score"),
    )


def train(features: DataFrame, key: str = "tweet_id", trees: int = 100, depth: int = 30,
          iterations: int = 1000, seed: int = 42,
          columns: Sequence[str] = fv.FEATURES) -> Trained:
    """Split 60/20/20, fit every candidate on train, select by validation F1.

    The split and the predictions are written to the shared scratch folder: training makes
    many passes and must not recompute them when an executor is lost.
    """
    require_columns(features, (*columns, TARGET, key), "feature table")
    filled = fill_missing_features(features) if columns is fv.FEATURES else features.fillna(
        0, subset=list(columns))
    split = staged(
        stratified_split(filled.select(key, TARGET, *columns), TARGET, key, seed), "split"
    )
    train_rows = split.filter(F.col("split") == "train").drop("split")
    held_out = split.filter(F.col("split") != "train")
    estimators = candidates(train_rows.count(), trees, depth, iterations, seed)
    models, scored = {}, None
    for name, estimator in estimators.items():
        fitted = Pipeline(stages=[assembler(columns), estimator]).fit(train_rows)
        models[name] = detached(fitted, split.sparkSession)
        part = predictions_of(models[name], name, held_out, key)
        scored = part if scored is None else scored.unionByName(part)
    predictions = staged(scored, "predictions")
    metrics = binary_metrics(predictions)
    comparison = compare_models(metrics, list(estimators))
    best = comparison.filter("is_best").first()["model"]
    return Trained(models, best, split, predictions, metrics, comparison)


def metrics_document(trained: Trained, columns: Sequence[str] = fv.FEATURES) -> DataFrame:
    """One row: sizes, class counts, feature names and the rounded metrics of every model."""
    split = trained.split
    sizes = split.agg(
        F.count("*").alias("dataset_size"),
        *[F.count_if(F.col("split") == s).alias(f"{a}_size")
          for s, a in (("train", "train"), ("validation", "val"), ("test", "test"))],
        F.map_from_arrays(
            F.array(F.lit("0"), F.lit("1")),
            F.array(F.count_if(F.col(TARGET) == 0), F.count_if(F.col(TARGET) == 1)),
        ).alias("class_distribution"),
    )
    names = [f"{s}_{m}" for s in ("val", "test") for m in ("accuracy", "f1", "roc_auc")]
    models = trained.comparison.agg(F.map_from_entries(F.collect_list(F.struct(
        "model", F.struct(*[F.round(n, 4).alias(n) for n in names])
    ))).alias("models"))
    # both sides are one row
    joined = sizes.withColumn("_k", F.lit(1)).join(
        F.broadcast(models.withColumn("_k", F.lit(1))), "_k"
    )
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                          "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return joined.select(
        stamp.alias("trained_at"), F.lit(trained.best).alias("best_model"), "dataset_size",
        "train_size", "val_size", "test_size", "class_distribution",
        F.array(*[F.lit(c) for c in columns]).alias("features"), "models",
    )


def save_trained(trained: Trained, out: str) -> None:
    """The selected model and the metrics of all."""
    save_model(trained.models[trained.best], fv.FEATURES, out, trained.split.sparkSession)
    write_document(metrics_document(trained), f"{out}/metrics")


def train_and_save(features: DataFrame, out: str, **options) -> Trained:
    trained = train(features, **options)
    save_trained(trained, out)
    return trained


def score_texts(model: PipelineModel | None, tickets: DataFrame, text_column: str = "text",
                features: Sequence[str] = fv.FEATURES) -> DataFrame:
    """Add label, confidence (four digits) and cost; UNAVAILABLE rows without a model."""
    if model is None:
        return tickets.withColumns({
            "label": F.lit("UNAVAILABLE"),
            "confidence": F.lit(None).cast("double"),
            "cost_usd": F.lit(0.0),
        })
    kept = [c for c in tickets.columns if c not in features]
    scored = model.transform(add_features(tickets, text_column))
    return scored.select(
        *kept,
        F.when(F.col("prediction") == 1, "URGENT").otherwise("NORMAL").alias("label"),
        F.round(F.array_max(vector_to_array("probability")), 4).alias("confidence"),
        F.lit(0.0).alias("cost_usd"),
    )

"""Saved classifiers: a Spark ML pipeline and the feature list it was trained on."""

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from ticketloom.session import scratch_path
from ticketloom.sources import files
from ticketloom.sources.tables import path_exists


def save_model(model: PipelineModel, features, path: str, spark: SparkSession) -> None:
    model.write().overwrite().save(f"{path}/model")
    names = [(i, name) for i, name in enumerate(features)]
    spark.createDataFrame(names, "position int, feature string").coalesce(1).write.mode(
        "overwrite"
    ).json(f"{path}/features")


def detached(model: PipelineModel, spark: SparkSession) -> PipelineModel:
    """The model as read back from the shared scratch folder, without its training summary.

    A fitted logistic regression or forest keeps its summary, and that the Spark session. Scoring sends the
    model to the tasks, which fails as soon as the session holds anything that cannot be sent, such as the
    listener of an observed metric.
    """
    path = scratch_path(spark, "fitted")
    model.write().save(path)
    return PipelineModel.load(path)


def load_model(spark: SparkSession, path: str):
    """The model and its feature list, or (None, ()) when nothing was trained."""
    if not path_exists(spark, f"{path}/model"):
        return None, ()
    names = spark.read.json(f"{path}/features").orderBy("position").collect()
    return PipelineModel.load(f"{path}/model"), tuple(row["feature"] for row in names)


def publish(model: PipelineModel, features, path: str, spark: SparkSession) -> int:
    """Save a new version beside the others and move the pointer to it; returns its number.

    The pointer moves by one committed file, so a reader finds the old version or the whole new one.
    """
    folder = uuid.uuid4().hex
    save_model(model, features, f"{path}/saved/{folder}", spark)
    while True:
        number = len(versions(spark, path)) + 1
        try:
            files.commit_json(spark, f"{path}/versions/{number:09d}.json", folder)
            return number
        except files.Taken:  # another publisher came first
            continue


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(name[:-5]) for name in files.names(spark, f"{path}/versions") if name[0] != "."]


def load_version(spark: SparkSession, path: str, number: int):
    folder = files.read_json(spark, f"{path}/versions/{number:09d}.json")
    return load_model(spark, f"{path}/saved/{folder}")

"""Ask a completion service each different prompt once, over as many runs as it takes.

Answers are stored under the SHA-256 of their prompt. A run takes the prompts without an answer in waves
by hash, asks one wave at a time, and commits the wave by one log file. A run that is killed loses the wave
it was in and no other; the next one asks only what no committed wave has answered. Failed calls are tried
again, in later passes or runs, until `tries` calls are spent, and then stand in the table of failures.
"""

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.functions import prompts as pr
from ticketloom.sources import files
from ticketloom.sources.tables import staged

CALLS = T.StructType([
    T.StructField("prompt_hash", T.StringType()), T.StructField("completion", T.StringType()),
    T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType()),
    T.StructField("provider", T.StringType()), T.StructField("failed", T.BooleanType()),
])
WAVES = 16
TRIES = 3


def prompt_hash(prompt: F.Column) -> F.Column:
    return F.sha2(prompt, 256)


def calls(spark: SparkSession, path: str) -> DataFrame:
    """Every committed call, failed ones included."""
    log = [n for n in files.names(spark, f"{path}/log") if n[0] != "."]
    folders = [f"{path}/calls/{files.read_json(spark, f'{path}/log/{name}')}" for name in log]
    return spark.read.schema(CALLS).parquet(*folders) if folders else spark.createDataFrame([], CALLS)


def answers(spark: SparkSession, path: str) -> DataFrame:
    """One row per answered prompt."""
    rest = [f.name for f in CALLS.fields[1:-1]]
    good = calls(spark, path).filter(~F.col("failed"))
    return good.groupBy("prompt_hash").agg(F.min(F.struct(*rest)).alias("_row")).select(
        "prompt_hash", *[F.col(f"_row.{c}").alias(c) for c in rest])


def failures(spark: SparkSession, path: str, tries: int = TRIES) -> DataFrame:
    """Prompts without an answer after `tries` calls, with the last message in order of text."""
    return calls(spark, path).groupBy("prompt_hash").agg(
        F.count("*").alias("calls"), F.bool_and("failed").alias("failed"), F.max("completion").alias("message")
    ).filter(F.col("failed") & (F.col("calls") >= tries)).drop("failed")


def _commit(spark: SparkSession, path: str, folder: str) -> None:
    while True:
        number = len([n for n in files.names(spark, f"{path}/log") if n[0] != "."])
        try:
            return files.commit_json(spark, f"{path}/log/{number:09d}.json", folder)
        except files.Taken:
            continue


def complete_all(prompts: DataFrame, completer: Callable[[pd.Series], pd.DataFrame], path: str,
                 prompt: str = "prompt", waves: int = WAVES, tries: int = TRIES) -> None:
    """Ask what is not answered yet; see `prompts.completed` for the completer. Null prompts are left out.

    A task that Spark repeats asks its part of the wave again: choose more waves for smaller parts.
    """
    spark = prompts.sparkSession
    wanted = staged(prompts.filter(F.col(prompt).isNotNull()).select(
        prompt_hash(F.col(prompt)).alias("prompt_hash"), F.col(prompt).alias("prompt")).groupBy(
        "prompt_hash").agg(F.min("prompt").alias("prompt")).withColumn(
        "wave", F.pmod(F.xxhash64("prompt_hash"), F.lit(waves))), "prompts")
    for _ in range(tries):
        done = calls(spark, path).groupBy("prompt_hash").agg(
            F.count("*").alias("calls"), F.bool_and("failed").alias("failed")).filter(
            ~F.col("failed") | (F.col("calls") >= tries)).select("prompt_hash")
        todo = staged(wanted.join(done, "prompt_hash", "left_anti"), "todo")
        left = sorted(r["wave"] for r in todo.select("wave").distinct().collect())
        for wave in left:
            folder = uuid.uuid4().hex
            asked = pr.completed(todo.filter(F.col("wave") == wave).select("prompt_hash", "prompt"), completer)
            asked.withColumn("failed", pr.is_error(F.col("completion"))).select(*CALLS.names).write.parquet(
                f"{path}/calls/{folder}")
            _commit(spark, path, folder)
        if not left:
            return


def with_answers(prompts: DataFrame, path: str, prompt: str = "prompt") -> DataFrame:
    """Every row with its answer, null where there is none. Spark splits a prompt that many rows share."""
    stored = answers(prompts.sparkSession, path).withColumnRenamed("prompt_hash", "_hash")
    return prompts.join(stored, prompt_hash(F.col(prompt)) == F.col("_hash"), "left").drop("_hash")

"""Small files in any store Spark reaches: written whole, made visible by one rename."""

import json
import uuid

from pyspark.sql import SparkSession


class Taken(Exception):
    """A file of that name is there already."""


def _store(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none when it does not exist."""
    folder, store = _store(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(folder)) if store.exists(folder) else []


def read_json(spark: SparkSession, path: str):
    file, store = _store(spark, path)
    stream = store.open(file)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def commit_json(spark: SparkSession, path: str, value) -> None:
    """Write a new file: readers see all of it or nothing. Taken when another writer came first.

    The rename never replaces a file; on HDFS that is one atomic step of the name node.
    """
    folder, name = path.rsplit("/", 1)
    draft, store = _store(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = store.create(draft, False)
    stream.write(bytearray(json.dumps(value).encode()))
    stream.close()
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        draft.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(),
        spark.sparkContext._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(
        jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, target, plain)
    except Exception as failed:
        if store.exists(target):
            store.delete(draft, False)
            raise Taken(path) from failed
        raise

"""The vector table: points with a vector and a payload, in Parquet, sharded by id.

Dense ids fill one shard after the other; from MOST_SHARDS shards on they go round again, so ids of
any kind, hashed ones too, use a bounded number of folders. An upsert rewrites only the shards its points fall in, so its cost follows the batch and not the
table. Each shard is replaced whole through Spark's commit protocol; a lost task is retried and
leaves no partial file behind.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.session import scratch_path
from ticketloom.sources.tables import path_exists

SHARD_POINTS = 250_000
MOST_SHARDS = 4_096
BASE = T.StructType([
    T.StructField("point_id", T.LongType()),
    T.StructField("vector", T.ArrayType(T.FloatType())),
])


def shard_of(point_id: Column, shard_points: int = SHARD_POINTS) -> Column:
    return F.pmod(F.floor(point_id / F.lit(shard_points)), F.lit(MOST_SHARDS)).cast("long")


def create(spark: SparkSession, path: str, schema: T.StructType = BASE,
           recreate: bool = False) -> bool:
    """Create an empty table. An existing one is kept unless `recreate`; True when created."""
    if path_exists(spark, path) and not recreate:
        return False
    empty = spark.createDataFrame([], schema).withColumn("shard", F.lit(0).cast("long"))
    empty.write.mode("overwrite").parquet(path)
    return True


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def count(spark: SparkSession, path: str) -> int:
    return read(spark, path).count()


def is_empty(spark: SparkSession, path: str) -> bool:
    return not path_exists(spark, path) or read(spark, path).limit(1).count() == 0


def latest_per_id(points: DataFrame, version: str | None = None) -> DataFrame:
    """One row per point id: the one with the highest version.

    A maximum is combined before the shuffle, so many copies of one id do not gather. Without a
    version there is no last one: ids that repeat are refused.
    """
    if version is None:
        twice = points.groupBy("point_id").count().filter(F.col("count") > 1)
        if twice.limit(1).count():
            raise ValueError("point ids repeat: name a version column")
        return points
    rest = [c for c in points.columns if c not in ("point_id", version)]
    newest = F.max(F.struct(version, *rest)).alias("_row")
    return points.groupBy("point_id").agg(newest).select(
        "point_id", *[F.col(f"_row.{c}").alias(c) for c in rest]
    )


def merged(existing: DataFrame, points: DataFrame) -> DataFrame:
    """Existing rows that are not replaced, plus the new ones."""
    kept = existing.join(points.select("point_id"), "point_id", "left_anti")
    return kept.select(*points.columns).unionByName(points)


def write_all(points: DataFrame, path: str, shard_points: int = SHARD_POINTS) -> None:
    """Write a whole table. Rows of one shard are grouped so a shard is not scattered in files."""
    sharded = points.withColumn("shard", shard_of(F.col("point_id"), shard_points))
    sharded.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def upsert(spark: SparkSession, path: str, points: DataFrame, version: str | None = None,
           shard_points: int = SHARD_POINTS) -> None:
    """Insert points, replacing those with the same id; the last version wins."""
    # The batch is read several times below and may come from an encoder: cut its lineage once.
    given = scratch_path(spark, "upsert")
    points.write.parquet(given)
    fresh = latest_per_id(spark.read.schema(points.schema).parquet(given), version)
    if is_empty(spark, path):
        return write_all(fresh, path, shard_points)
    batch = fresh.withColumn("shard", shard_of(F.col("point_id"), shard_points))
    touched = batch.select("shard").distinct()  # at most MOST_SHARDS rows
    stored = read(spark, path).withColumn("shard", F.col("shard").cast("long"))
    existing = stored.join(F.broadcast(touched), "shard", "left_semi")
    # Spark will not overwrite files it is reading, so the merged shards are staged as well.
    result = scratch_path(spark, "merged")
    merged(existing, batch).repartition("shard").write.partitionBy("shard").parquet(result)
    (
        spark.read.parquet(result)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("shard")
        .parquet(path)
    )

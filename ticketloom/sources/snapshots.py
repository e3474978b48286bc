"""A vector table with snapshots: every change is visible at once or not at all.

`data/<change>/` holds Parquet files, never changed once written; `log/<number>.json` is a snapshot: its
parent and, per shard of ids, the folder that holds it and its rows. A change writes the shards it touches
to a folder of its own and then commits one small log file by a rename that fails if the number is taken.
So a reader keeps the snapshot it opened, a crash before the commit leaves the old one, and older
snapshots stay readable. A log file lists at most MOST_SHARDS shards, whatever the table's size.
"""

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.session import scratch_path
from ticketloom.sources import files
from ticketloom.sources.vector_table import BASE, MOST_SHARDS, SHARD_POINTS, latest_per_id, shard_of

FOLDER = "in_shard"


class Conflict(Exception):
    """Other changes kept coming first."""


@dataclass(frozen=True)
class Snapshot:
    number: int
    parent: int | None
    schema: dict
    #: shard -> (folder, rows)
    shards: dict[int, tuple[str, int]]

    @property
    def points(self) -> int:
        return sum(rows for _, rows in self.shards.values())

    def as_json(self) -> dict:
        return {"parent": self.parent, "schema": self.schema,
                "shards": {str(k): list(v) for k, v in self.shards.items()}}


def _log(path: str, number: int) -> str:
    return f"{path}/log/{number:012d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(name[:-5]) for name in files.names(spark, f"{path}/log") if name[0] != "."]


def snapshot(spark: SparkSession, path: str, number: int | None = None) -> Snapshot:
    """A snapshot, the newest unless its number is given."""
    number = versions(spark, path)[-1] if number is None else number
    found = files.read_json(spark, _log(path, number))
    return Snapshot(number, found["parent"], found["schema"],
                    {int(k): (v[0], v[1]) for k, v in found["shards"].items()})


def create(spark: SparkSession, path: str, schema: T.StructType = BASE) -> bool:
    """An empty table; False when there is one."""
    if versions(spark, path):
        return False
    try:
        files.commit_json(spark, _log(path, 0), Snapshot(0, None, schema.jsonValue(), {}).as_json())
    except files.Taken:
        return False
    return True


def load(spark: SparkSession, path: str, at: Snapshot, shards=None) -> DataFrame:
    """The rows of a snapshot, of some shards only if given; no file that it does not name is read."""
    schema = T.StructType.fromJson(at.schema).add("shard", T.LongType())
    wanted = [f"{path}/data/{at.shards[s][0]}" for s in sorted(at.shards) if shards is None or s in shards]
    return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    return load(spark, path, snapshot(spark, path, number))


def _write(rows: DataFrame, path: str, points: int, shard_points: int) -> dict[int, tuple[str, int]]:
    """Write shards to a new folder; from MOST_SHARDS full shards on, several tasks write one."""
    change = uuid.uuid4().hex
    salts = max(1, -(-points // (MOST_SHARDS * shard_points)))
    dealt = rows.withColumn(FOLDER, F.col("shard")).repartition(
        FOLDER, F.pmod(F.xxhash64("point_id"), F.lit(salts)))
    dealt.write.partitionBy(FOLDER).parquet(f"{path}/data/{change}")
    written = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/data/{change}")
    counts = written.groupBy("shard").count().collect()  # at most MOST_SHARDS rows
    return {r["shard"]: (f"{change}/{FOLDER}={r['shard']}", r["count"]) for r in counts}


def change(spark: SparkSession, path: str, points: DataFrame | None = None, gone: DataFrame | None = None,
           version: str | None = None, shard_points: int = SHARD_POINTS, tries: int = 5) -> Snapshot:
    """Insert or replace `points` and delete the ids in `gone`, in one new snapshot.

    Ids that repeat in `points` need a `version` column, the last wins; an id in both is kept. When another
    change commits first, this one goes on top of it: as written if the two touch different shards, else
    merged anew.
    """
    base = snapshot(spark, path)
    schema = T.StructType.fromJson(base.schema)
    batch, dropped = scratch_path(spark, "points"), scratch_path(spark, "gone")
    if points is not None:
        latest_per_id(points, version).select(*schema.names).withColumn(
            "shard", shard_of(F.col("point_id"), shard_points)).write.parquet(batch)
    if gone is not None:
        gone.select("point_id").distinct().withColumn(
            "shard", shard_of(F.col("point_id"), shard_points)).write.parquet(dropped)
    whole = T.StructType.fromJson(base.schema).add("shard", T.LongType())
    ids = T.StructType([T.StructField("point_id", T.LongType()), T.StructField("shard", T.LongType())])
    new = spark.read.schema(whole).parquet(batch) if points is not None else spark.createDataFrame([], whole)
    out = spark.read.schema(ids).parquet(dropped) if gone is not None else spark.createDataFrame([], ids)
    leaving = out.select("point_id").unionByName(new.select("point_id"))
    touched = {r["shard"] for r in out.select("shard").unionByName(new.select("shard")).distinct().collect()}
    merged = None
    for _ in range(tries):
        if merged is None:
            kept = load(spark, path, base, touched).join(leaving, "point_id", "left_anti")
            rows = kept.select(*whole.names).unionByName(new.select(*whole.names))
            merged = _write(rows, path, base.points + new.count(), shard_points)
        shards = {s: v for s, v in base.shards.items() if s not in touched} | merged
        made = Snapshot(base.number + 1, base.number, base.schema, shards)
        try:
            files.commit_json(spark, _log(path, made.number), made.as_json())
            return made
        except files.Taken:
            newest = snapshot(spark, path)
            if any(newest.shards.get(s) != base.shards.get(s) for s in touched):
                merged = None
            base = newest
    raise Conflict(f"{path}: {tries} changes came first")


def history(spark: SparkSession, path: str) -> list[Snapshot]:
    """All snapshots, oldest first: log files only."""
    return [snapshot(spark, path, n) for n in versions(spark, path)]

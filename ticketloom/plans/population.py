"""Fill the vector table from labelled tickets."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom import fixed_values as fv
from ticketloom.operators.encoding import encode, fit_hashing_encoder
from ticketloom.operators.payload import payload_column, with_chunks
from ticketloom.operators.ranking import dense_ids
from ticketloom.sources import snapshots
from ticketloom.sources import vector_table as vt
from ticketloom.sources.tables import staged


def points(labeled: DataFrame, encoder, key: str = "tweet_id") -> DataFrame:
    """Chunk, number and encode: point_id, vector, payload."""
    chunked = with_chunks(dense_ids(labeled, key, tie=("text",)))
    return encode(encoder, chunked).select(
        "point_id", "vector", payload_column(chunked).alias("payload")
    )


def populate(labeled: DataFrame, path: str, encoder=None, dim: int = fv.VECTOR_DIM,
             limit: int | None = None, recreate: bool = False,
             key: str = "tweet_id") -> tuple[int, PipelineModel | None]:
    """Fill the table unless it already has rows; returns the point count and the encoder."""
    spark = labeled.sparkSession
    if not recreate and not vt.is_empty(spark, path):
        return vt.count(spark, path), encoder
    rows = labeled.orderBy(F.col(key)).limit(limit) if limit else labeled
    if encoder is None:
        encoder = fit_hashing_encoder(with_chunks(rows), "chunk_text", dim)
    vt.write_all(points(rows, encoder, key), path)
    return vt.count(spark, path), encoder


def stored_schema(labeled: DataFrame) -> T.StructType:
    """Of a table that `refresh` keeps: what `populate` stores, and a digest of the payload."""
    chunked = with_chunks(labeled)
    payload = chunked.select(payload_column(chunked).alias("payload")).schema
    return T.StructType([*vt.BASE.fields, payload["payload"], T.StructField("digest", T.StringType())])


def refresh(labeled: DataFrame, path: str, encoder, key: str = "tweet_id") -> dict[str, int]:
    """Bring a table with snapshots up to the given tickets: encode only new and changed ones.

    Both sides meet by key and digest of the stored payload. Changed tickets keep their point id, new ones
    get the next ids in key order, vanished ones leave; all in one snapshot. Nothing is committed when
    nothing changed. Tickets without a key are refused, keys must be unique. Returns how many there were of
    each kind.
    """
    spark = labeled.sparkSession
    snapshots.create(spark, path, stored_schema(labeled))
    chunked = with_chunks(labeled)
    payload = payload_column(chunked)
    new = staged(chunked.select(F.col(key).alias("key"), payload.alias("payload"),
                                F.sha2(F.to_json(payload), 256).alias("digest")), "given")
    rows, keys, named = new.agg(F.count("*"), F.count_distinct("key"), F.count("key")).first()
    if named < rows or keys < rows:
        raise ValueError(f"{rows - named} tickets without {key}, {named - keys} with one that repeats")
    at = snapshots.snapshot(spark, path)
    old = snapshots.load(spark, path, at).select(
        F.col(f"payload.{key}").alias("key"), "point_id", F.col("digest").alias("old_digest"))
    state = F.when(F.col("old_digest").isNull(), "added").when(F.col("digest").isNull(), "removed").when(
        F.col("digest") == F.col("old_digest"), "kept").otherwise("changed")
    judged = staged(new.select("key", "digest").join(old, "key", "full_outer").withColumn("state", state),
                    "judged")
    counts = {r["state"]: r["count"] for r in judged.groupBy("state").count().collect()}
    counts = {name: counts.get(name, 0) for name in ("added", "changed", "removed", "kept")}
    if counts["added"] + counts["changed"] + counts["removed"]:
        first = old.agg(F.coalesce(F.max("point_id") + 1, F.lit(0).cast("long"))).first()[0]
        added = dense_ids(judged.filter("state = 'added'").select("key"), "key").select(
            "key", (F.col("point_id") + F.lit(first)).alias("point_id"))
        fresh = judged.filter("state = 'changed'").select("key", "point_id").unionByName(added)
        todo = new.join(fresh, "key").withColumn("chunk_text", F.col("payload.chunk_text"))
        points = encode(encoder, todo).select("point_id", "vector", "payload", "digest")
        snapshots.change(spark, path, points, judged.filter("state = 'removed'").select("point_id"))
    return counts

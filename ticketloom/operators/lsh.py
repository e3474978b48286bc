"""Approximate top-k by hash tables: random projections, several probes, exact scores.

A table hashes a unit vector by the signs of `bits` random projections. A query reads, in every table,
the buckets nearest to it: flipping a sign costs the size of its projection, and buckets are read in
the order of their total cost. Rows of a bucket are scored exactly, so only a hit in no probed bucket
can be missed, and probing all buckets of one table is exact.

The index holds every row once per table. Queries and rows meet on (table, bucket, salt): a bucket has as
many salts as its rows need, so copies of one vector, which share their buckets, spread over tasks.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.operators import similarity as sim

#: Share of the exact hits that a search must find, the queries it is measured on, and what is added to
#: it for their being a sample.
LEAST_RECALL = 0.9
MEASURED = 1_000
MARGIN = 0.02
#: Rows of a bucket that one task holds.
SALT_ROWS = 20_000


@dataclass(frozen=True)
class Hashing:
    """`tables` hash tables of 2**bits buckets; the seed fixes the projections."""

    dim: int
    tables: int = 4
    bits: int = 5
    seed: int = 42

    def projections(self) -> np.ndarray:
        shape = (self.dim, self.tables * self.bits)
        return np.random.default_rng(self.seed).normal(size=shape)

    def margins(self, vectors: np.ndarray) -> np.ndarray:
        """(row, table, bit): signed projections of unit vectors."""
        found = sim.unit_rows(vectors) @ self.projections()
        return found.reshape(len(vectors), self.tables, self.bits)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """(row, table): the number of the bucket a row lies in, unique over all tables."""
        bucket = (self.margins(vectors) >= 0) @ (1 << np.arange(self.bits))
        return bucket + (np.arange(self.tables) << self.bits)

    def probes(self, vectors: np.ndarray, most: int) -> np.ndarray:
        """(row, table, place): buckets by the cost of the signs that must be flipped."""
        margins = self.margins(vectors)
        own = (margins >= 0) @ (1 << np.arange(self.bits))
        flips = (np.arange(1 << self.bits)[:, None] >> np.arange(self.bits)) & 1
        near = np.argsort(np.abs(margins) @ flips.T, axis=2, kind="stable")[:, :, :most]
        return (own[:, :, None] ^ near) + (np.arange(self.tables) << self.bits)[:, None]


def _lists(values: np.ndarray) -> pa.Array:
    return pa.array(list(values.reshape(len(values), -1).astype(np.int64)), pa.list_(pa.int64()))


def _coded(df: DataFrame, vector: str, numbers, out: str) -> DataFrame:
    """`df` with an array of bucket numbers per row."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _lists(numbers(sim.vectors_of(batch[vector])))
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, out])

    return df.mapInArrow(run, f"{fields}, `{out}` array<long>")


def with_codes(corpus: DataFrame, hashing: Hashing, point_id: str = "point_id",
               vector: str = "vector") -> DataFrame:
    """(code, hit_id, vector): each row once per table. Rows without a vector are left out."""
    rows = corpus.filter(F.col(vector).isNotNull()).select(
        F.col(point_id).cast("long").alias("hit_id"), F.col(vector).alias("vector"))
    return _coded(rows, "vector", hashing.codes, "codes").select(
        F.explode("codes").alias("code"), "hit_id", "vector")


def write_index(coded: DataFrame, path: str, block_rows: int = SALT_ROWS) -> DataFrame:
    """Store by bucket. A bucket is cut into salts of about `block_rows` rows, each written by one task."""
    salts = coded.groupBy("code").agg(
        F.ceil(F.count("*") / F.lit(block_rows)).cast("long").alias("salts"))
    salted = coded.join(salts, "code").withColumn("salt", F.pmod(F.xxhash64("hit_id"), F.col("salts")))
    salted.repartition("code", "salt").write.mode("overwrite").partitionBy("code").parquet(path)
    return coded.sparkSession.read.schema(salted.schema).parquet(path)


def _asked(queries: DataFrame, query_id: str, query_vector: str) -> DataFrame:
    return queries.filter(F.col(query_vector).isNotNull()).select(
        F.col(query_id).cast("long").alias("query_id"), F.col(query_vector).alias("asked"))


def top_k(queries: DataFrame, index: DataFrame, hashing: Hashing, probes: int, k: int = fv.TOP_K,
          floor: float = fv.SIMILARITY_FLOOR, query_id: str = "query_id", query_vector: str = "vector",
          skip_same_id: bool = False) -> DataFrame:
    """query_id, hit_id, similarity, rank among the rows of `probes` buckets in every table."""
    sim.check_k(k)
    asked = _coded(_asked(queries, query_id, query_vector), "asked",
                   lambda v: hashing.probes(v, probes), "codes")
    salts = index.groupBy("code").agg(F.max("salts").alias("salts"))  # one row a bucket
    wanted = asked.select("query_id", "asked", F.explode("codes").alias("code")).join(salts, "code").select(
        "query_id", "asked", "code",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    hits = sim.scanned(wanted, index.drop("salts"), ["code", "salt"], k, floor, skip_same_id)
    # a row may be found in several tables
    once = hits.groupBy("query_id", "hit_id").agg(
        F.max("similarity").alias("similarity"), F.min("block").alias("block"))
    return sim.ranked_hits(once, k)


def probes_for(queries: DataFrame, corpus: DataFrame, hashing: Hashing, least: float = LEAST_RECALL,
               k: int = fv.TOP_K, floor: float = fv.SIMILARITY_FLOOR, query_id: str = "query_id",
               query_vector: str = "vector", hit_id: str = "point_id", hit_vector: str = "vector",
               skip_same_id: bool = False) -> int:
    """Fewest probes a table that find `least` of the exact hits of about MEASURED of the queries.

    The sample's exact search is one pass over the corpus. A hit's place is the least place of its bucket
    in the query's order, over all tables; one count per place is collected.
    """
    every = 1 << hashing.bits
    step = max(1, queries.count() // MEASURED)
    sample = queries.filter(F.pmod(F.xxhash64(query_id), F.lit(step)) == 0)
    exact = sim.top_k(sample, corpus, hashing.dim, k=k, floor=floor, query_id=query_id,
                      query_vector=query_vector, hit_id=hit_id, hit_vector=hit_vector,
                      skip_same_id=skip_same_id).select("query_id", "hit_id")
    order = _coded(_asked(sample, query_id, query_vector), "asked",
                   lambda v: hashing.probes(v, every), "codes").select("query_id", "codes")
    hit_codes = with_codes(corpus.select(hit_id, hit_vector), hashing, hit_id, hit_vector).select(
        "hit_id", "code")
    # codes lie table after table, so a place within the table is what remains
    places = exact.join(hit_codes, "hit_id").join(order, "query_id").select(
        "query_id", "hit_id",
        F.pmod(F.array_position("codes", F.col("code")) - 1, F.lit(every)).alias("place"))
    counts = places.groupBy("query_id", "hit_id").agg(F.min("place").alias("place")).groupBy(
        "place").count().collect()
    hits = np.zeros(every)
    for row in counts:
        hits[row["place"]] = row["count"]
    enough = np.cumsum(hits) >= min(1.0, least + MARGIN) * hits.sum()
    return int(np.argmax(enough)) + 1 if hits.sum() else every

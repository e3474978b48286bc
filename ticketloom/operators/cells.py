"""Approximate top-k: the corpus is stored by cell, a query reads the cells nearest to it.

Stands in for a vector store's index. Cells are centroids of unit vectors. Hits are scored exactly,
and probing all cells gives the exact result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.operators import similarity as sim

#: Share of the exact hits that a search by cell must find, the queries it is measured on, and what is
#: added to it for their being a sample.
LEAST_RECALL = 0.9
MEASURED = 1_000
MARGIN = 0.02
#: Rows of a cell that one task holds.
SALT_ROWS = 20_000


def as_features(corpus: DataFrame, vector: str) -> DataFrame:
    return corpus.withColumn("_raw", array_to_vector(F.col(vector)))


def fit_cells(corpus: DataFrame, cells: int, vector: str = "vector", seed: int = 42,
              fraction: float = 1.0, rounds: int = 10) -> PipelineModel:
    """Centroids of unit vectors. `fraction` < 1 trains on a sample: it moves cell borders and
    so recall, never which rows are stored."""
    rows = as_features(corpus, vector).select("_raw")
    if fraction < 1.0:
        rows = rows.sample(fraction=fraction, seed=seed)
    return Pipeline(stages=[
        Normalizer(inputCol="_raw", outputCol="_unit", p=2.0),
        KMeans(featuresCol="_unit", predictionCol="cell", k=cells, seed=seed, maxIter=rounds),
    ]).fit(rows)


def with_cell(model: PipelineModel, corpus: DataFrame, vector: str = "vector") -> DataFrame:
    """Assign every row to its nearest centroid. No shuffle."""
    return model.transform(as_features(corpus, vector)).select(*corpus.columns, "cell")


def write_cells(assigned: DataFrame, path: str, files_per_cell: int = 8) -> DataFrame:
    """Store by cell. A salt spreads every cell over several tasks, so a cell that holds a large
    part of the corpus is not written by one."""
    salt = F.pmod(F.xxhash64("point_id"), F.lit(files_per_cell))
    assigned.repartition("cell", salt).write.mode("overwrite").partitionBy("cell").parquet(path)
    return assigned.sparkSession.read.parquet(path)


def nearest_cells(asked: DataFrame, model: PipelineModel, probes: int) -> DataFrame:
    """Each query (query_id, asked) once per cell to read, with the cell's place among its nearest; the
    centres are a bounded broadcast."""
    centers = np.array(model.stages[-1].clusterCenters())
    half = (centers ** 2).sum(axis=1) / 2

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            gaps = half - sim.unit_rows(sim.vectors_of(batch["asked"])) @ centers.T
            near = np.argsort(gaps, axis=1, kind="stable")[:, :probes].astype(np.int64)
            cells = pa.array(list(near), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["query_id"], batch["asked"], cells],
                                             names=["query_id", "asked", "cells"])

    kind = asked.schema["asked"].dataType.simpleString()
    found = asked.mapInArrow(probe, f"query_id long, asked {kind}, cells array<long>")
    return found.select("query_id", "asked", F.posexplode("cells").alias("place", "cell"))


def probes_for(queries: DataFrame, assigned: DataFrame, model: PipelineModel, dim: int,
               least: float = LEAST_RECALL, k: int = fv.TOP_K, floor: float = fv.SIMILARITY_FLOOR,
               query_id: str = "query_id", query_vector: str = "vector",
               hit_id: str = "point_id", hit_vector: str = "vector", skip_same_id: bool = False) -> int:
    """Fewest cells to read for `least` of the exact hits of about MEASURED of the queries.

    The sample's exact search is one pass over the corpus; only one count per cell is collected. The
    sample's recall has a standard error of half a percent or so, hence MARGIN.
    """
    every = len(model.stages[-1].clusterCenters())
    step = max(1, queries.count() // MEASURED)
    sample = queries.filter(F.pmod(F.xxhash64(query_id), F.lit(step)) == 0)
    exact = sim.top_k(sample, assigned, dim, k=k, floor=floor, query_id=query_id, query_vector=query_vector,
                      hit_id=hit_id, hit_vector=hit_vector, skip_same_id=skip_same_id)
    asked, _ = sim.as_sides(sample, assigned, query_id, query_vector, hit_id, hit_vector)
    places = nearest_cells(asked, model, every).select("query_id", "cell", "place")
    counts = exact.select("query_id", "hit_id").join(
        assigned.select(F.col(hit_id).alias("hit_id"), "cell"), "hit_id").join(
        places, ["query_id", "cell"]).groupBy("place").count().collect()
    hits = np.zeros(every)
    for row in counts:
        hits[row["place"]] = row["count"]
    enough = np.cumsum(hits) >= min(1.0, least + MARGIN) * hits.sum()
    return int(np.argmax(enough)) + 1 if hits.sum() else every


def cell_top_k(queries: DataFrame, stored: DataFrame, model: PipelineModel, dim: int,
               probes: int, k: int = fv.TOP_K, floor: float = fv.SIMILARITY_FLOOR,
               query_id: str = "query_id", query_vector: str = "vector",
               hit_id: str = "point_id", hit_vector: str = "vector",
               skip_same_id: bool = False, block_rows: int = SALT_ROWS) -> DataFrame:
    """Best k per query among the rows of its `probes` nearest cells.

    Queries and rows join on (cell, salt, group): a cell is cut into as many salts as its rows need, the
    queries into groups of bounded size; a query goes to each salt of its cells, a row to each group.
    """
    sim.check_k(k)
    asked, rows = sim.as_sides(queries, stored, query_id, query_vector, hit_id, hit_vector)
    groups, every = sim.pieces_of(asked, sim.GROUP_QUERIES), len(model.stages[-1].clusterCenters())
    # one row per cell
    salts = F.broadcast(rows.groupBy("cell").agg(
        F.ceil(F.count("*") / F.lit(block_rows)).cast("long").alias("_salts")
    ))
    salted = rows.join(salts, "cell").withColumn(
        "_salt", F.pmod(F.xxhash64("hit_id"), F.col("_salts"))
    ).drop("_salts").withColumn("_g", sim.every(groups))
    probed = nearest_cells(asked, model, probes).join(salts, "cell")
    wanted = probed.select("query_id", "asked", sim.piece("query_id", groups).alias("_g"), "cell", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)).alias("_salt"))
    hits = sim.scanned(wanted, salted, ["cell", "_salt", "_g"], k, floor, skip_same_id, tasks=groups * every)
    return sim.ranked_hits(hits, k)


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found."""
    pairs = exact.select("query_id", "hit_id")
    found = pairs.join(
        approximate.select("query_id", "hit_id").withColumn("_hit", F.lit(1)),
        ["query_id", "hit_id"], "left",
    )
    return found.agg(
        F.count("*").alias("exact_hits"), F.count("_hit").alias("found"),
        (F.count("_hit") / F.count("*")).alias("recall"),
    )

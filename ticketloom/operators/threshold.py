"""All pairs of similar vectors: a threshold join without k, with exact skipping.

Unit vectors at cosine t lie at distance r = sqrt(2 - 2t), so distances to a few pivots bound
similarities. Every row belongs to the cell of its nearest pivot and, in it, to a ring of distances to
that pivot. A query skips

* a cell that lies behind a bisecting plane further away than r: for some pivot p the query is nearer
  to p than to the cell's pivot c by (|q - c|^2 - |q - p|^2) / (2 |c - p|) > r;
* a ring whose distances to the pivot differ from the query's by more than r (triangle inequality);
* in a ring, runs of rows ordered by that distance for the same reason, before any product is taken.

Queries and rows meet on (cell, ring, salt, query group), all of bounded size; only pairs that pass the
threshold leave a task. Equal vectors form one class, named by its smallest id: pairs are pairs of classes,
so a vector with a million copies is compared once. Rows without a vector, or with a zero one, take no part.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.operators import cells as ce
from ticketloom.operators import similarity as sim
from ticketloom.sources.tables import staged

RINGS = 64
BLOCK_ROWS = 20_000
GROUP_QUERIES = 20_000
RUN_ROWS = 512
#: Distances of unit vectors are at most 2; rounding is far below the slack.
WIDTH = 2.0 / RINGS
SLACK = 1e-6

PAIRS = "query_id long, hit_id long, similarity double"


@dataclass
class Pivots:
    """Bounded: as many points as cells."""

    points: np.ndarray

    def distances(self, unit: np.ndarray) -> np.ndarray:
        squares = (unit ** 2).sum(1)[:, None] - 2 * unit @ self.points.T + (self.points ** 2).sum(1)
        return np.sqrt(np.maximum(squares, 0.0))

    def gaps(self) -> np.ndarray:
        gaps = self.distances(self.points)
        np.fill_diagonal(gaps, np.inf)
        return np.where(gaps > SLACK, gaps, np.inf)

    def visits(self, unit: np.ndarray, radius: float) -> list[np.ndarray]:
        """Per query the numbers cell * RINGS + ring of the blocks that may hold a near row."""
        far = self.distances(unit)
        near = np.empty(far.shape, dtype=bool)
        for c, gap in enumerate(self.gaps()):
            behind = (far[:, c, None] ** 2 - far ** 2) / (2 * gap)
            near[:, c] = behind.max(axis=1) <= radius + SLACK
        low = np.floor(np.maximum(far - radius - SLACK, 0) / WIDTH).astype(np.int64)
        high = np.minimum(np.floor((far + radius + SLACK) / WIDTH).astype(np.int64), RINGS - 1)
        ring = np.arange(RINGS)
        inside = near[:, :, None] & (ring >= low[:, :, None]) & (ring <= high[:, :, None])
        return [np.flatnonzero(row) for row in inside.reshape(len(unit), -1)]


def fit_pivots(corpus: DataFrame, n: int = 32, vector: str = "vector", seed: int = 42,
               fraction: float = 1.0) -> Pivots:
    """Pivots are centres of the corpus. They, and `fraction`, decide how much is skipped, never what is
    found."""
    return Pivots(np.array(ce.fit_cells(corpus, n, vector, seed, fraction).stages[-1].clusterCenters()))


def classes(vectors: DataFrame, point_id: str = "point_id", vector: str = "vector") -> DataFrame:
    """(class_id, vector, copies): one row per different vector; copies meet in partial aggregates."""
    usable = F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0)
    return vectors.filter(usable).groupBy(F.col(vector).alias("vector")).agg(
        F.min(F.col(point_id).cast("long")).alias("class_id"), F.count("*").alias("copies"))


def membership(vectors: DataFrame, found: DataFrame, point_id: str = "point_id",
               vector: str = "vector") -> DataFrame:
    """(point_id, class_id) of every row that takes part; Spark splits a class of many copies."""
    return vectors.select(F.col(point_id).alias("point_id"), F.col(vector).alias("vector")).join(
        found, "vector").select("point_id", "class_id")


def _placed(corpus: DataFrame, pivots: Pivots) -> DataFrame:
    """(hit_id, vector, block, off): the block of each row and its distance to the cell's pivot."""
    kind = corpus.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = pivots.distances(sim.unit_rows(sim.vectors_of(batch["vector"])))
            cell = far.argmin(axis=1)
            off = far[np.arange(len(far)), cell]
            ring = np.minimum(np.floor(off / WIDTH).astype(np.int64), RINGS - 1)
            yield pa.RecordBatch.from_arrays(
                [batch["hit_id"], batch["vector"], pa.array(cell * RINGS + ring), pa.array(off)],
                names=["hit_id", "vector", "block", "off"])

    return corpus.mapInArrow(run, f"hit_id long, vector {kind}, block long, off double")


def _visiting(queries: DataFrame, pivots: Pivots, radius: float) -> DataFrame:
    kind = queries.schema["asked"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                blocks = pivots.visits(sim.unit_rows(sim.vectors_of(batch["asked"])), radius)
                yield pa.RecordBatch.from_arrays(
                    [batch["query_id"], batch["asked"], pa.array(blocks, pa.list_(pa.int64()))],
                    names=["query_id", "asked", "blocks"])

    return queries.mapInArrow(run, f"query_id long, asked {kind}, blocks array<long>")


def _near(pivots: Pivots, threshold: float, radius: float):
    def run(key, asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = [], [], []
        if asked.num_rows and rows.num_rows:
            off = rows["off"].to_numpy()
            order = np.argsort(off, kind="stable")
            off, hit_ids = off[order], rows["hit_id"].to_numpy()[order]
            vectors = sim.unit_rows(sim.vectors_of(rows["vector"].combine_chunks()))[order]
            query_ids = asked["query_id"].to_numpy()
            queries = sim.unit_rows(sim.vectors_of(asked["asked"].combine_chunks()))
            far = pivots.distances(queries)[:, key[0].as_py() // RINGS]
            for start in range(0, len(off), RUN_ROWS):
                run_off = off[start:start + RUN_ROWS]
                which = np.flatnonzero((far >= run_off[0] - radius - SLACK) & (far <= run_off[-1] + radius + SLACK))
                step = max(1, sim.PAIR_BUDGET // RUN_ROWS)
                for first in range(0, len(which), step):
                    part = which[first:first + step]
                    score = np.round(queries[part] @ vectors[start:start + RUN_ROWS].T, sim.DIGITS)
                    row, col = np.nonzero(score >= threshold)
                    found[0].append(query_ids[part[row]])
                    found[1].append(hit_ids[start + col])
                    found[2].append(score[row, col])
        kinds = np.int64, np.int64, np.float64
        columns = [np.concatenate(c) if c else np.empty(0, kind) for c, kind in zip(found, kinds)]
        return pa.table(dict(zip(("query_id", "hit_id", "similarity"), columns)))

    return run


@dataclass
class Joined:
    #: query_id, hit_id, similarity: classes at or above the threshold, no class with itself.
    pairs: DataFrame
    #: One row: (query, block) pairs there are and those that were visited.
    report: DataFrame


def similarity_join(queries: DataFrame, corpus: DataFrame, threshold: float, pivots: Pivots | None = None,
                    block_rows: int = BLOCK_ROWS, group_queries: int = GROUP_QUERIES) -> Joined:
    """Pairs of classes (see `classes`) of the queries and the corpus with cosine >= threshold."""
    if not -1 < threshold <= 1:
        raise ValueError(f"a cosine threshold lies in (-1, 1], not {threshold}")
    radius = float(np.sqrt(2 - 2 * threshold))
    pivots = pivots or fit_pivots(corpus)
    asked = queries.select(F.col("class_id").alias("query_id"), F.col("vector").alias("asked"))
    rows = staged(_placed(corpus.select(F.col("class_id").alias("hit_id"), "vector"), pivots), "placed")
    visits = staged(_visiting(asked, pivots, radius), "visits")
    # one row per block that holds a row: at most cells * RINGS, whatever the corpus
    sizes = rows.groupBy("block").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("long").alias("salts"))
    groups = sim.pieces_of(visits, group_queries)
    salted = rows.join(F.broadcast(sizes), "block").select(
        "block", F.pmod(F.xxhash64("hit_id"), F.col("salts")).alias("salt"),
        sim.every(groups).alias("group"), "hit_id", "vector", "off")
    every = visits.select("query_id", "asked", sim.piece("query_id", groups).alias("group"),
                          F.explode("blocks").alias("block")).join(F.broadcast(sizes), "block")
    wanted = every.select("query_id", "asked", "block", "group", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    keys = ["block", "salt", "group"]
    pairs = wanted.groupBy(*keys).cogroup(salted.groupBy(*keys)).applyInArrow(
        _near(pivots, threshold, radius), PAIRS).filter("query_id <> hit_id")
    total = sizes.agg(F.count("*").alias("blocks"))
    report = every.agg(F.count("*").alias("visited")).join(F.broadcast(total)).join(
        F.broadcast(visits.agg(F.count("*").alias("queries"))))
    return Joined(pairs, report.select("queries", "blocks", "visited",
                                       (F.col("queries") * F.col("blocks") - F.col("visited")).alias("skipped")))

"""Cosine top-k of query vectors against a vector table.

Queries and corpus meet in groups of bounded size: the corpus is cut into blocks by a hash of the
id, the queries into groups, and each (query group, block) pair yields its best k per query. With no
more queries than one group holds, which is the usual case, no corpus row is copied; otherwise a row is
copied MOST times, or once per MOST_ROWS rows of the other side if those are more. Candidates
are merged in two steps. Nothing goes through the driver and no pair of rows is emitted.
"""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.sources.vector_table import SHARD_POINTS, shard_of

PAIR_BUDGET = 1 << 22
#: Queries and corpus rows that are multiplied at once: their products stay in a core's cache.
STEP_QUERIES, STEP_ROWS = 512, 1024
BLOCK_ROWS = 4_096
GROUP_QUERIES = 4_096
#: A side is cut in at most MOST pieces, unless these would hold more than MOST_ROWS rows.
MOST = 8
MOST_ROWS = 50_000
MERGED_BLOCKS = 64
MANY = 4
SLACK = 1e-9
DIGITS = 10  # similarities are compared at this precision, so equal vectors tie exactly

HIT_FIELDS = "query_id long, hit_id long, similarity double, block long"


@dataclass
class Best:
    """The best k hits so far of each query: row numbers of queries, ids and similarities.

    `kth` and `kth_hit` hold each query's k-th best similarity and its id; -inf while it has fewer.
    """

    query: np.ndarray
    hit: np.ndarray
    similarity: np.ndarray
    kth: np.ndarray
    kth_hit: np.ndarray

    @classmethod
    def empty(cls, queries: int) -> "Best":
        return cls(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64),
                   np.full(queries, -np.inf), np.zeros(queries, np.int64))

    def add(self, query, hit, similarity, k: int) -> "Best":
        query = np.concatenate([self.query, query])
        hit = np.concatenate([self.hit, hit])
        similarity = np.concatenate([self.similarity, similarity])
        order = np.lexsort((hit, -similarity, query))
        query, hit, similarity = query[order], hit[order], similarity[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        last, kth, kth_hit = place == k - 1, self.kth.copy(), self.kth_hit.copy()
        kth[query[last]], kth_hit[query[last]] = similarity[last], hit[last]
        keep = place < k
        return Best(query[keep], hit[keep], similarity[keep], kth, kth_hit)

    def of(self, which: np.ndarray) -> "Best":
        """Those of some queries, numbered by their places in `which`."""
        place = np.full(len(self.kth), -1)
        place[which] = np.arange(len(which))
        mine = place[self.query] >= 0
        return Best(place[self.query[mine]], self.hit[mine], self.similarity[mine], self.kth[which],
                    self.kth_hit[which])

    def can_enter(self, query, hit, similarity) -> np.ndarray:
        bar = self.kth[query]
        return (similarity > bar) | ((similarity == bar) & (hit < self.kth_hit[query]))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def vectors_of(column: pa.Array) -> np.ndarray:
    """An Arrow list column as a matrix of doubles, without a Python loop."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def scan_block(best: Best, queries: np.ndarray, query_ids: np.ndarray, which: np.ndarray,
               ids: np.ndarray, vectors: np.ndarray, k: int, floor: float,
               skip_same_id: bool) -> Best:
    """Fold one block of the corpus into the best hits of the queries numbered `which`."""
    if not len(ids) or not len(which):
        return best
    others = ~np.isin(best.query, which)
    parts = [(best.query[others], best.hit[others], best.similarity[others])]
    kth, kth_hit = best.kth.copy(), best.kth_hit.copy()
    by_id = np.argsort(ids, kind="stable")
    for start in range(0, len(which), STEP_QUERIES):
        some = which[start:start + STEP_QUERIES]
        own = same_ids(query_ids[some], ids, by_id) if skip_same_id else None
        part = scan_rows(best.of(some), queries[some], ids, vectors, own, k, floor)
        parts.append((some[part.query], part.hit, part.similarity))
        kth[some], kth_hit[some] = part.kth, part.kth_hit
    query, hit, similarity = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(query, kind="stable")
    return Best(query[order], hit[order], similarity[order], kth, kth_hit)


def same_ids(asking: np.ndarray, ids: np.ndarray, by_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs that share an id, in order of the row; `by_id` sorts `ids`."""
    first = np.searchsorted(ids, asking, side="left", sorter=by_id)
    n = np.searchsorted(ids, asking, side="right", sorter=by_id) - first
    row = np.repeat(np.arange(len(asking)), n)
    col = by_id[np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)]
    order = np.argsort(col, kind="stable")
    return row[order], col[order]


def scan_rows(best: Best, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own, k: int,
              floor: float) -> Best:
    """Fold the rows into the best hits of a few queries, without the pairs in `own`."""
    for start in range(0, len(ids), STEP_ROWS):
        part_ids, part = ids[start:start + STEP_ROWS], vectors[start:start + STEP_ROWS]
        found = queries @ part.T
        if own:
            here = slice(*np.searchsorted(own[1], (start, start + len(part_ids))))
            found[own[0][here], own[1][here] - start] = -np.inf
        # Only what reaches a query's k-th best so far can enter. The slack covers rounding, so
        # ties stay in and the id decides between them.
        cut = np.maximum(best.kth, floor) - SLACK
        near = found >= cut[:, None]
        if len(part_ids) > k and np.count_nonzero(near) > MANY * k * len(queries):
            cut = np.maximum(cut, np.partition(found, -k, axis=1)[:, -k] - SLACK)
            near = found >= cut[:, None]
        place = np.flatnonzero(near)
        if not len(place):
            continue
        asking, hits = place // len(part_ids), part_ids[place % len(part_ids)]
        value = np.round(found.ravel()[place], DIGITS)
        good = (value >= floor) & best.can_enter(asking, hits, value)
        best = best.add(asking[good], hits[good], value[good], k)
    return best


def ranked_hits(hits: DataFrame, k: int) -> DataFrame:
    """Global best k per query from the blocks' candidates; ties go to the smaller id.

    The first step merges MERGED_BLOCKS blocks at a time, so the second sees few rows per query.
    """
    order = (F.desc("similarity"), "hit_id")
    some = Window.partitionBy("query_id", F.floor(F.col("block") / MERGED_BLOCKS)).orderBy(*order)
    near = hits.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k)
    every = Window.partitionBy("query_id").orderBy(*order)
    return near.withColumn("rank", F.row_number().over(every)).filter(F.col("rank") <= k).select(
        "query_id", "hit_id", "similarity", "rank"
    )


def check_k(k: int) -> None:
    if k < 1:
        raise ValueError(f"k must be at least 1, not {k}")


def as_sides(queries: DataFrame, corpus: DataFrame, query_id: str, query_vector: str,
             hit_id: str, hit_vector: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, vector) and (hit_id, vector), rows without a vector left out."""
    asked = queries.select(
        F.col(query_id).cast("long").alias("query_id"), F.col(query_vector).alias("asked")
    ).filter(F.col("asked").isNotNull())
    stored = corpus.select(
        F.col(hit_id).cast("long").alias("hit_id"), F.col(hit_vector).alias("vector"),
        *([F.col("cell").cast("long").alias("cell")] if "cell" in corpus.columns else []),
    ).filter(F.col("vector").isNotNull())
    return asked, stored


def top_k(queries: DataFrame, corpus: DataFrame, dim: int, k: int = fv.TOP_K,
          floor: float = fv.SIMILARITY_FLOOR, query_id: str = "query_id",
          query_vector: str = "vector", hit_id: str = "point_id",
          hit_vector: str = "vector", skip_same_id: bool = False,
          block_rows: int = BLOCK_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """The k most similar corpus rows of every query with similarity >= floor.

    Returns query_id, hit_id, similarity, rank. Vectors need not be normalised. One task holds a block of
    `block_rows` rows and a group of `group_queries` queries, or larger ones where there would be more than
    MOST of them.
    """
    check_k(k)
    asked, stored = as_sides(queries, corpus, query_id, query_vector, hit_id, hit_vector)
    groups, blocks = pieces_of(asked, group_queries), pieces_of(stored, block_rows)
    left = asked.withColumn("_g", piece("query_id", groups)).withColumn("_b", every(blocks))
    right = stored.withColumn("_b", piece("hit_id", blocks)).withColumn("_g", every(groups))
    hits = scanned(left, right, ["_b", "_g"], k, floor, skip_same_id, tasks=groups * blocks)
    return ranked_hits(hits, k)


def pieces_of(df: DataFrame, rows: int) -> int:
    """Pieces of about `rows` rows, but at most MOST; more only to keep each within MOST_ROWS."""
    n = df.count()
    return max(1, min(-(-n // rows), MOST), -(-n // MOST_ROWS))


def piece(column: str, n: int) -> Column:
    """A piece number by the id's hash, so copies of one vector spread over all of them."""
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("long")


def every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def scanned(left: DataFrame, right: DataFrame, keys: Sequence[str], k: int, floor: float,
            skip_same_id: bool, tasks: int = 1) -> DataFrame:
    """The best k of every query in each group of (queries, corpus block) that share `keys`.

    More than one of `tasks`: the groups are dealt to so many; Spark else merges groups of few bytes, though
    their work grows with the product of both sides.
    """
    def scan(key, queries: pa.Table, corpus: pa.Table) -> pa.Table:
        ids, best = np.empty(0, np.int64), Best.empty(0)
        if queries.num_rows and corpus.num_rows:
            ids = queries["query_id"].to_numpy()
            best = scan_block(
                Best.empty(len(ids)), unit_rows(vectors_of(queries["asked"].combine_chunks())), ids,
                np.arange(len(ids)), corpus["hit_id"].to_numpy(),
                unit_rows(vectors_of(corpus["vector"].combine_chunks())), k, floor, skip_same_id,
            )
        return pa.table({
            "query_id": ids[best.query], "hit_id": best.hit, "similarity": best.similarity,
            "block": np.full(len(best.hit), key[0].as_py(), np.int64),
        })

    if tasks > 1:
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, HIT_FIELDS)


def unit_vector(vector: Column) -> Column:
    """An array column scaled to length 1; the zero vector stays zero."""
    norm = F.sqrt(F.aggregate(
        vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")
    ))
    return F.when(
        norm > 0, F.transform(vector, lambda x: (x / norm).cast("float"))
    ).otherwise(vector)


def low_similarity(queries: DataFrame, hits: DataFrame, query_id: str = "query_id",
                   threshold: float = fv.SIMILARITY_FLOOR) -> DataFrame:
    """Per query: hits, best similarity, and whether the context is too weak to trust."""
    found = hits.groupBy(F.col("query_id").alias(query_id)).agg(
        F.count("*").alias("retrieved_count"), F.max("similarity").alias("best_similarity")
    )
    weak = F.coalesce(F.col("best_similarity") < threshold, F.lit(True))
    return (
        queries.select(query_id)
        .join(found, query_id, "left")
        .select(
            query_id,
            F.coalesce("retrieved_count", F.lit(0)).alias("retrieved_count"),
            "best_similarity",
            weak.alias("low_similarity"),
        )
    )


def hit_rows(hits: DataFrame, vectors: DataFrame, hit_id: str = "point_id",
             shard_points: int = SHARD_POINTS) -> DataFrame:
    """Ranked hits with the stored ticket fields; similarity at four digits.

    `hits` should be a staged table: Spark then knows its size, broadcasts it when it is small,
    and, as the shard is part of the join key, reads only the shards that hold a hit.
    """
    keys, found = ["hit_id"], hits.filter(F.col("rank") >= 1)
    stored = [F.col(hit_id).alias("hit_id")]
    if "shard" in vectors.columns:
        keys.append("shard")
        stored.append(F.col("shard"))
        shard = shard_of(F.col("hit_id"), shard_points)
        found = found.withColumn("shard", shard.cast(vectors.schema["shard"].dataType))
    payload = vectors.select(
        *stored,
        *[F.col(f"payload.{c}").alias(c)
          for c in ("tweet_id", "airline", "agent_response", "priority", "priority_score")],
        F.col("payload.original_text").alias("text"),
    )
    return found.join(payload, keys).select(
        "query_id", "rank", "hit_id", "tweet_id", "airline", "text", "agent_response",
        "priority", "priority_score", F.round("similarity", 4).alias("similarity"),
    )


HIT_COLUMNS = ("rank", "tweet_id", "airline", "text", "agent_response", "priority",
               "priority_score", "similarity")


def hit_lists(rows: DataFrame, columns: Sequence[str] = HIT_COLUMNS) -> DataFrame:
    """One array of hit structs per query, in rank order; at most k entries each."""
    return rows.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct(*columns))).alias("hits")
    )


def similarity_percent(similarity: Column) -> Column:
    return F.round(100 * F.coalesce(similarity, F.lit(0.0))).cast("int")

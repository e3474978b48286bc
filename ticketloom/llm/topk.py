"""Exact top-k by inner product: columnar branch and bound over blocks of dimensions.

Vectors lie in vertical layout, one array per dimension. A query adds up its products block by
block of dimensions, those where it has the most mass first. After each block the remaining mass of
query and candidate bounds what a candidate can still gain or lose (Cauchy-Schwarz), the k-th
best lower bound is a threshold, and candidates whose upper bound stays below it are compacted away.
Scores are integers and bounds are rounded outwards, so the result is exact.

Corpus and queries meet in groups of bounded size: (corpus group, query group) is the key, each
group keeps k candidates per query, and the groups' candidates are merged in two steps.

Components are floor(scale * x). Vectors that are null, hold a null or non-finite component, have no
id, or hold a scaled component that is no long take no part. Groups whose products could pass 2**53 are
searched in integers, without bounds; a score among the best that is no long ends the query. Rows that
share an id are vectors of their own: each asks, and each is a candidate of the others. Shorter vectors are
padded with zeros. Ties go to the smaller id. Empty tables give an empty result, fewer than k candidates all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketloom.llm.staging import staged

GROUP_ROWS = 4096
GROUP_QUERIES = 1024
BLOCK = 8
#: Sums of products below it are exact as floats.
EXACT = 1 << 53
#: Groups whose candidates are merged by one first-step task.
MERGED_GROUPS = 64

RESULT = "query_id long, query_row long, vec_id long, score long, cgroup long"


def quantised(df: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """row, a number of its own, vec_id and its integer components. Stage it: the number must not change."""
    raw = F.transform(F.col(embedding), lambda x: F.lit(float(scale)) * x.cast("double"))
    fine = F.forall("raw", lambda x: F.coalesce(F.abs(x) < F.lit(float(1 << 63)), F.lit(False)))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), raw.alias("raw"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("raw").isNotNull() & fine)
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id",
                       F.transform("raw", lambda x: F.floor(x).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as a dense integer matrix, padded with zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    sizes = lists.value_lengths().to_numpy(False).astype(np.int64)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = lists.flatten().to_numpy(False)
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    import pyarrow.compute as pc

    return max([1] + [pc.max(pc.list_value_length(c)).as_py() or 0 for c in columns])


def best(ids: np.ndarray, rows: np.ndarray, columns: np.ndarray, own: int, query: np.ndarray, k: int):
    """(ids, scores) of the k best rows but row `own`; `columns` is vertical: one row per dimension."""
    order = np.argsort(-np.abs(query), kind="stable")
    blocks = [order[i:i + BLOCK] for i in range(0, len(order), BLOCK)]
    alive = np.flatnonzero(rows != own)
    score = np.zeros(len(alive))
    squares = np.einsum("ij,ij->j", columns, columns)[alive]
    mass = float(query @ query)
    for block in blocks:
        part = columns[block] if len(alive) == columns.shape[1] else columns[np.ix_(block, alive)]
        score += query[block] @ part
        squares = squares - np.einsum("ij,ij->j", part, part)
        mass = max(0.0, mass - float(query[block] @ query[block]))
        if len(alive) > k and mass:
            # one more than the bound: square roots may be off by far less than that
            slack = np.sqrt(np.maximum(squares, 0.0) * mass) * (1 + 1e-9) + 1
            floor = np.partition(score - slack, len(alive) - k)[len(alive) - k]
            keep = score + slack >= floor
            if not keep.all():
                alive, score, squares = alive[keep], score[keep], squares[keep]
    first = np.lexsort((ids[alive], -score))[:k]
    return ids[alive][first], score[first]


def best_exact(ids: np.ndarray, rows: np.ndarray, columns: np.ndarray, own: int, query: np.ndarray, k: int):
    """The same for integers of any size: longs, or Python's integers as objects."""
    alive = np.flatnonzero(rows != own)
    score = query @ columns[:, alive]
    first = sorted(range(len(alive)), key=lambda i: (-score[i], ids[alive[i]]))[:k]
    return ids[alive][first], np.array([int(score[i]) for i in first], dtype=np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) over `vectors` (row, vec_id, v); queries are chosen rows of it."""
    n_rows, n_queries = vectors.agg(
        F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    cgroups, qgroups = -(-n_rows // GROUP_ROWS) or 1, -(-n_queries // GROUP_QUERIES) or 1

    def grouped(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(n)).alias(column)

    def every(column: str, n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(column)

    corpus = vectors.select("row", "vec_id", "v", grouped("cgroup", cgroups), every("qgroup", qgroups))
    queries = vectors.filter(is_query).select(
        F.col("row").alias("asked_row"), F.col("vec_id").alias("asked"), F.col("v").alias("q"), every("cgroup", cgroups),
        grouped("qgroup", qgroups))
    fields = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()),
                        ("score", pa.int64()), ("cgroup", pa.int64())])

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return fields.empty_table()
        width = _width(left.column("v"), right.column("q"))
        ids, rows = left.column("vec_id").to_numpy(), left.column("row").to_numpy()
        columns = np.ascontiguousarray(_matrix(left.column("v"), width).T)
        asked = _matrix(right.column("q"), width)
        most, other = int(np.abs(columns).max()), int(np.abs(asked).max())
        search_one, kind = best, np.float64
        if width * max(most, other) ** 2 >= EXACT:
            search_one, kind = best_exact, np.int64 if width * most * other < 1 << 63 else object
        columns, asked, out = columns.astype(kind), asked.astype(kind), []
        names = right.column("asked").to_pylist(), right.column("asked_row").to_pylist()
        for query_id, own, query in zip(*names, asked):
            found, score = search_one(ids, rows, columns, own, query, k)
            n = len(found)
            out.append((np.full(n, query_id), np.full(n, own), found, score.astype(np.int64)))
        four = [np.concatenate(c) for c in zip(*out)]
        return pa.Table.from_arrays(
            [pa.array(c) for c in four] + [pa.array([key[0].as_py()] * len(four[0]), pa.int64())],
            schema=fields)

    pairs = corpus.groupBy("cgroup", "qgroup").cogroup(queries.groupBy("cgroup", "qgroup"))
    found = pairs.applyInArrow(search, RESULT)
    order = [F.col("score").desc(), F.col("vec_id")]
    some = Window.partitionBy("query_row", F.floor(F.col("cgroup") / MERGED_GROUPS)).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(*order))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    vectors = staged(quantised(embeddings, "vec_id", "embedding", scale), "vectors")
    return top_k(vectors, F.col("vec_id") % every == 0, k)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rn FROM s
)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 10
"""

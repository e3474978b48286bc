"""Embedding whitening from an exact distributed covariance and refined float32 eigenvectors.

Components become integers q = floor(scale * c). Two passes gather, inside the tasks, exact integer sums
of q and of the products of q less its rounded mean; Spark adds the tasks' sums. So the covariance is an
exact ratio of integers, whatever the partitions, and what reaches the driver grows with the square of
the dimension only, never with the rows.

The driver takes the eigenvectors of the matrix in float32 and corrects them by Ogita-Aishima steps,
which are matrix products, in extended precision: each step about doubles the right digits. Pairs of
eigenvalues too near for that division form clusters; a cluster is solved as a small matrix of its own,
shifted by its mean eigenvalue, and its vectors are rotated.

Vectors that are null, hold a null or non-finite component, or one whose scaled value reaches 2**52, take
no part; a null id does. Repeated ids are rows of their own. Shorter vectors are padded with components 0.
Components without variance (an eigenvalue within rounding of zero, as with equal rows or a single one)
have no whitened coordinate and are not returned; so an empty table gives an empty result. Equal
eigenvalues leave the choice of their vectors free; every row sees the same one. Signs: a vector's
largest entry is positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components are split into limbs of so many bits, and rows into slices, so that sums of products of a
#: slice are whole numbers below 2**53: float products are exact.
LIMB_BITS = 20
SLICE_ROWS = 4096
#: Sums leave the tasks as high and low halves, so that they stay longs.
HALF_BITS = 26
LARGEST = float(1 << 52)

STEPS = 40
HIGH = np.longdouble
#: The last bits of a sum of products. A division by a gap turns them into a rotation, whose square is an
#: error of length: gaps that would let it be seen count as none, and a cluster's own matrix decides.
ROUNDING = float(np.finfo(HIGH).eps)
LEAST_GAP = ROUNDING * 2.0 ** 28


@dataclass
class Whitening:
    """What the fit list decides: all of it is bounded by the dimension."""

    scale: int
    n: int
    #: Sums of q, the rounded means and the rest of the sums, as Python's integers.
    sums: list[int]
    means: list[int]
    rests: list[int]
    #: Falling eigenvalues of the covariance and their unit vectors, one a column.
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def components(self, k: int) -> int:
        """How many of the first k have variance."""
        least = self.trace * len(self.values) * 2.0 ** -50
        return int(np.sum(self.values[:k] > least))

    def project(self, q: np.ndarray, k: int) -> np.ndarray:
        centred = (q - np.array(self.means, dtype=np.int64)).astype(np.float64)
        centred -= np.array([r / self.n for r in self.rests])
        return centred @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))


def read(batch: pa.RecordBatch, scale: int, width: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part, their integer components padded to one width, their lengths)."""
    lists = batch.column("embedding")
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(False).astype(np.int64)
    owner = np.repeat(np.arange(len(lists)), lengths)
    values = lists.flatten()
    numbers = pc.fill_null(values.cast(pa.float64()), float("nan")).to_numpy(False) * float(scale)
    with np.errstate(invalid="ignore"):
        bad = ~(np.abs(numbers) < LARGEST)
    takes_part = lists.is_valid().to_numpy(False).copy()
    takes_part[owner[bad]] = False
    rows = np.flatnonzero(takes_part)
    place = np.cumsum(takes_part) - 1
    kept = takes_part[owner]
    at = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((len(rows), max(width, int(lengths[rows].max(initial=0)))), dtype=np.int64)
    out[place[owner[kept]], at[kept]] = np.floor(numbers[kept]).astype(np.int64)
    return rows, out, lengths[rows]


def _halves(total: dict, key, value: np.ndarray) -> None:
    high, low = value >> HALF_BITS, value & ((1 << HALF_BITS) - 1)
    if key in total:
        total[key][0] += high
        total[key][1] += low
    else:
        total[key] = [high, low]


def _sums(scale: int):
    """Sums of q by dimension; dimension -1 counts the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            rows, q, _ = read(batch, scale)
            n += len(rows)
            more = max(0, q.shape[1] - len(high))
            high, low = np.pad(high, (0, more)), np.pad(low, (0, more))
            high[:q.shape[1]] += (q >> HALF_BITS).sum(0)
            low[:q.shape[1]] += (q & ((1 << HALF_BITS) - 1)).sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, len(high)), pa.int64()), pa.array(np.r_[0, high], pa.int64()),
             pa.array(np.r_[n, low], pa.int64())], names=["i", "high", "low"])

    return run


def _products(scale: int, means: list[int]):
    """Sums of products of centred components, by pair of dimensions and power of the limbs' base."""
    centre, width = np.array(means, dtype=np.int64), len(means)
    first, second = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            _, q, _ = read(batch, scale, width)
            for start in range(0, len(q), SLICE_ROWS):
                z = q[start:start + SLICE_ROWS] - centre
                limbs = []
                while True:
                    if np.abs(z).max(initial=0) < 1 << LIMB_BITS:
                        limbs.append(z.astype(np.float64))
                        break
                    limbs.append((z & ((1 << LIMB_BITS) - 1)).astype(np.float64))
                    z = z >> LIMB_BITS
                for a, left in enumerate(limbs):
                    for b, right in enumerate(limbs):
                        exact = (left.T @ right).astype(np.int64)
                        _halves(total, a + b, exact[first, second])
        for power, (high, low) in sorted(total.items()):
            yield pa.RecordBatch.from_arrays(
                [pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                 pa.array(np.full(len(first), power), pa.int64()), pa.array(high), pa.array(low)],
                names=["i", "j", "power", "high", "low"])

    return run


def _added(df: DataFrame, *keys: str) -> list:
    halves = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    return df.groupBy(*keys).agg(*halves).collect()


def _spectral(matrix: np.ndarray) -> float:
    return float(np.linalg.norm(matrix.astype(np.float64), 2))


def _clusters(values: np.ndarray, least: float) -> list[np.ndarray]:
    """Places of eigenvalues that follow one another at no more than `least`, in falling order."""
    order = np.argsort(-values, kind="stable")
    cuts = np.flatnonzero(-np.diff(values[order]) > least) + 1
    return np.split(order, cuts)


def refined(matrix: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors of a symmetric matrix from rough ones, in extended precision."""
    a, x = matrix.astype(HIGH), start.astype(HIGH)
    size, one = _spectral(a), np.eye(len(a), dtype=HIGH)
    for _ in range(STEPS):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        # rounding differs across the diagonal; symmetric, its part in a step is a rotation
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        near = max(2 * (_spectral(s - np.diag(values)) + size * _spectral(r)), len(a) * size * LEAST_GAP)
        gap = values[None, :] - values[:, None]
        groups = _clusters(values, near)
        alike = np.zeros(gap.shape, dtype=bool)
        for group in groups:
            alike[np.ix_(group, group)] = True
        step = np.where(alike, r / 2, (s + values[None, :] * r) / np.where(alike, 1, gap))
        x = x + x @ step
        solved = False
        for group in groups:
            if len(group) < 2:
                continue
            part = x[:, group]
            middle = values[group].mean()
            small = part.T @ (a @ part) - middle * (part.T @ part)
            rest = np.abs(small - np.diag(np.diag(small))).max()
            if rest > 8 * len(a) * size * ROUNDING:
                _, turn = np.linalg.eigh((small / np.abs(small).max()).astype(np.float64))
                x[:, group] = part @ turn.astype(HIGH)
                solved = True
        if not solved and np.abs(step).max() < 1e-17:
            break
    return values, x


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit vectors, as doubles; rough ones come from float32."""
    size = np.abs(matrix).max(initial=0)
    if not size:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    scaled = matrix / size
    _, rough = np.linalg.eigh(scaled.astype(np.float32))
    values, vectors = refined(scaled, rough)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order] * size, vectors[:, order]
    vectors = vectors / np.sqrt((vectors * vectors).sum(0))
    peak = vectors[np.abs(vectors).argmax(0), np.arange(len(values))]
    return values.astype(np.float64), (vectors * np.where(peak < 0, -1, 1)).astype(np.float64)


def fit(df: DataFrame, embedding: str, scale: int = 1024) -> Whitening:
    """The whitening of all vectors of `df` that take part."""
    rows = df.select(F.col(embedding).alias("embedding"))
    found = _added(rows.mapInArrow(_sums(scale), "i long, high long, low long"), "i")
    whole = {r["i"]: (int(r["high"]) << HALF_BITS) + int(r["low"]) for r in found}
    n, width = whole.pop(-1, 0), len(whole)
    sums = [whole[i] for i in range(width)]
    means = [(2 * s + n) // (2 * n) for s in sums] if n else sums
    rests = [s - n * m for s, m in zip(sums, means)]
    moments = [[0] * width for _ in range(width)]
    kind = "i long, j long, power long, high long, low long"
    if n and width:
        for r in _added(rows.mapInArrow(_products(scale, means), kind), "i", "j", "power"):
            half = (int(r["high"]) << HALF_BITS) + int(r["low"])
            moments[r["i"]][r["j"]] += half << (LIMB_BITS * r["power"])
    covariance = np.zeros((width, width), dtype=HIGH)
    for i in range(width):
        for j in range(i, width):
            exact = Fraction(n * moments[i][j] - rests[i] * rests[j], n * n)
            main = float(exact)
            covariance[i, j] = covariance[j, i] = HIGH(main) + HIGH(float(exact - Fraction(main)))
    values, vectors = eigen(covariance)
    return Whitening(scale, n, sums, means, rests, values, vectors, float(np.trace(covariance)))


def _identity(model: Whitening, k: int):
    """Sums of whitened coordinates and of their products."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            _, q, _ = read(batch, model.scale, len(model.means))
            for start in range(0, len(q), SLICE_ROWS):
                w = model.project(q[start:start + SLICE_ROWS], k)
                total += w.sum(0)
                squares += w.T @ w
        at = [(i, j) for i in range(-1, k) for j in range(k)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in at], pa.int64()), pa.array([j for _, j in at], pa.int64()),
             pa.array(np.r_[total, squares.ravel()])], names=["i", "j", "part"])

    return run


def identity_error(df: DataFrame, embedding: str, model: Whitening, k: int) -> float:
    """Largest absolute entry of the whitened coordinates' covariance minus the identity."""
    parts = df.select(F.col(embedding).alias("embedding")).mapInArrow(
        _identity(model, k), "i long, j long, part double")
    table = np.zeros((k + 1, k))
    for r in parts.groupBy("i", "j").agg(F.sum("part").alias("part")).collect():
        table[r["i"] + 1, r["j"]] = r["part"]
    mean = table[0] / model.n
    return float(np.abs(table[1:] / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def _deviations(q: np.ndarray, model: Whitening) -> pa.Array:
    """Sums over the dimensions of (n * q - sum of q) squared, as decimal texts of any length."""
    z = q - np.array(model.means, dtype=np.int64)
    most = int(np.abs(z).max(initial=0)) * model.n + max(map(abs, model.rests), default=0)
    if most * most * max(1, z.shape[1]) < 1 << 63:
        off = z * model.n - np.array(model.rests, dtype=np.int64)
        return pa.array((off * off).sum(1)).cast(pa.string())
    off = z.astype(object) * model.n - np.array(model.rests, dtype=object)
    return pa.array([str(v) for v in (off * off).sum(1)], pa.string())


def whitened(df: DataFrame, vec_id: str, embedding: str, model: Whitening, k: int = 8) -> DataFrame:
    """(vec_id, deviation_exact, whitened): an array of at most k coordinates a row that takes part."""
    k = model.components(k)
    width = len(model.means)
    fields = pa.schema([("vec_id", pa.int64()), ("deviation_exact", pa.string()),
                        ("whitened", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, q, _ = read(batch, model.scale, width)
            ids = batch.column("vec_id").take(pa.array(rows))
            flat = model.project(q, k).ravel()
            ends = pa.array(np.arange(len(rows) + 1) * k, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [ids, _deviations(q, model), pa.ListArray.from_arrays(ends, pa.array(flat))],
                schema=fields)

    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    if not k:
        return rows.limit(0).select(
            "vec_id", F.lit("").alias("deviation_exact"), F.array().cast("array<double>").alias("whitened"))
    return rows.mapInArrow(run, "vec_id long, deviation_exact string, whitened array<double>")


def digest(embeddings: DataFrame, k: int = 8, scale: int = 1024) -> DataFrame:
    """One row per vector and component. `deviation` is null where it is no long, as with tens of millions
    of rows; `deviation_exact` holds its digits always."""
    model = fit(embeddings, "embedding", scale)
    k = model.components(k)
    error = identity_error(embeddings, "embedding", model, k) if k else 0.0
    shares = F.array(*[F.lit(float(v) / model.trace) for v in model.values[:k]]).cast("array<double>")
    rows = whitened(embeddings, "vec_id", "embedding", model, k)
    return rows.select("vec_id", "deviation_exact", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
        F.col("deviation_exact").try_cast("long").alias("deviation"), "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
        "deviation_exact")

"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy.

A document is the average of the learned vectors of its hashed features: its words (case and
punctuation kept), the byte n-grams of its words with their borders, and one feature for a word that
repeats the one before it. A softmax layer over the average gives the two classes. As everything
after the look-up is linear, scoring needs one number per feature: the gain in log-odds.

Fitting takes at most SAMPLE_PER_CLASS labelled rows of each class, chosen by a hash of their key;
the class shares of all labelled rows are put back into the bias. It runs in one task on that bounded
sample; the model (a few MB, BUCKETS x DIM) is broadcast. Scoring is one pass over whole texts.

Rows with a null key or label are not learned from; a key with several labels counts each of them, and a
key with several texts is learned with its smallest.
Null and empty texts have no features: their score is the share of label 1. If a class is missing
from the training rows, every score is that share (0.5 without any training row).
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.llm import arrays
from ticketloom.llm.worker_memory import let_go

BUCKETS = 1 << 17
DIM = 8
GRAMS = (2, 3, 4)
SAMPLE_PER_CLASS = 2_000
#: Batches taken, however small the sample: a few hundred labels are passed over many times.
STEPS = 800
RATE = 0.6
BATCH = 32
SEED = 11

_SPACE = np.uint8(10)
_GAPS = np.zeros(256, dtype=bool)
_GAPS[[b for b in range(256) if not arrays.TOKENS[b]]] = True


def features(data: np.ndarray, offsets: np.ndarray):
    """Hashed features of a slice of texts: yields (bucket array, row array) parts."""
    words = arrays.WordTable(data, offsets, arrays.TOKENS)
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    yield (words.hashes % np.uint64(BUCKETS)).astype(np.int64), row
    if len(words.hashes) > 1:
        again = (words.hashes[1:] == words.hashes[:-1]) & (row[1:] == row[:-1])
        at = row[1:][again]
        yield np.full(len(at), BUCKETS, dtype=np.int64), at
    # every text between spaces, so that a word's first and last n-grams show its borders
    lengths = np.diff(offsets)
    n = len(data) + len(lengths) + 1
    padded = np.full(n, _SPACE, dtype=np.uint8)
    text_row = np.repeat(np.arange(len(lengths)), lengths)
    padded[np.arange(len(data)) + text_row + 1] = data
    gap = _GAPS[padded]
    padded[gap] = _SPACE
    rows = np.repeat(np.arange(len(lengths) + 1), np.append(lengths + 1, 1))
    for first in range(0, n, arrays.CHUNK_BYTES):
        last = min(n, first + arrays.CHUNK_BYTES + max(GRAMS) - 1)
        part = padded[first:last].astype(np.uint64)
        gaps = gap[first:last]
        for k in GRAMS:
            m = min(arrays.CHUNK_BYTES, len(part) - k + 1)
            if m <= 0:
                continue
            whole = np.ones(m, dtype=bool)
            for j in range(1, k - 1):
                whole &= ~gaps[j:m + j]
            whole &= ~(gaps[:m] & gaps[k - 1:m + k - 1])
            at = np.flatnonzero(whole)
            code = np.full(len(at), k, dtype=np.uint64)
            for j in range(k):
                code = (code << np.uint64(8)) | part[at + j]
            with np.errstate(over="ignore"):
                code = (code * np.uint64(arrays.STEP)) >> np.uint64(64 - 17)
            # its first byte tells an n-gram's text; a border before it stands between two, so take the next
            yield (code % np.uint64(BUCKETS)).astype(np.int64), rows[at + first + gaps[at]]


def document_features(texts: Iterable[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: distinct features and their counts, in 32 bits: the sample is held as a whole."""
    out = []
    for text in texts:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        parts = [f for f, _ in features(data, np.array([0, len(data)]))]
        found, counts = np.unique(np.concatenate(parts), return_counts=True)
        out.append((found.astype(np.int32), counts.astype(np.int32)))
    return out


class Model:
    """Feature vectors, softmax weights and the share of label 1."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray, share: float):
        self.vectors, self.weights, self.bias, self.share = vectors, weights, bias, share

    @classmethod
    def constant(cls, share: float) -> Model:
        return cls(np.zeros((BUCKETS + 1, DIM), np.float32), np.zeros((DIM, 2), np.float32),
                   np.array([0.0, _log_odds(share)]), share)

    @classmethod
    def fit(cls, docs: list, labels: np.ndarray, share: float) -> Model:
        """SGD on softmax loss over averaged vectors; the sample's class shares are taken out."""
        rng = np.random.default_rng(SEED)
        vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 1, DIM))
        weights, bias = np.zeros((DIM, 2)), np.zeros(2)
        done = 0
        while done < STEPS:
            order = rng.permutation(len(docs))
            for first in range(0, len(order), BATCH):
                batch = order[first:first + BATCH]
                rate = RATE * max(0.0, 1 - done / STEPS)
                done += 1
                ids = np.concatenate([docs[i][0] for i in batch])
                sizes = np.array([len(docs[i][0]) for i in batch])
                share_of = np.concatenate([docs[i][1] / docs[i][1].sum() for i in batch if len(docs[i][0])])
                row = np.repeat(np.arange(len(batch)), sizes)
                used, place = np.unique(ids, return_inverse=True)
                own = vectors[used]
                hidden = np.stack([np.bincount(row, share_of * own[place, d], len(batch))
                                   for d in range(DIM)], axis=1)
                logits = hidden @ weights + bias
                logits -= logits.max(axis=1, keepdims=True)
                prob = np.exp(logits)
                prob /= prob.sum(axis=1, keepdims=True)
                prob[np.arange(len(batch)), labels[batch]] -= 1
                back = prob @ weights.T
                weights -= rate * hidden.T @ prob
                bias -= rate * prob.sum(axis=0) / len(batch)
                for d in range(DIM):
                    own[:, d] -= rate * np.bincount(place, share_of * back[row, d], len(used))
                vectors[used] = own
        inside = labels.mean()
        bias[1] += _log_odds(share) - _log_odds(inside)
        return cls(vectors.astype(np.float32), weights.astype(np.float32), bias, share)

    def gains(self) -> np.ndarray:
        """Log-odds of label 1 that each feature adds to the average."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64)

    @property
    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, vectors=self.vectors, weights=self.weights, bias=self.bias,
                            share=self.share)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        held = np.load(io.BytesIO(data))
        return cls(held["vectors"], held["weights"], held["bias"], float(held["share"]))


def _log_odds(share: float) -> float:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return math.log(share / (1 - share))


def held_out(key: Column) -> Column:
    """Rows that no model may learn from."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id",
        text: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learn from a bounded sample of the labelled rows that are not held out."""
    marks = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter(
        F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~F.coalesce(held_out(F.col("k")), F.lit(True)))
    marks = marks.distinct()
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return Model.constant(share)
    # a hash threshold first, so that what is ordered and cut is a little more than the bound
    span, chosen = 1 << 30, None
    for y, n in counts.items():
        limit = min(span, math.ceil(span * (1.1 * per_class + 100) / n))
        part = marks.filter((F.col("y") == y) & (F.pmod(F.xxhash64("k"), F.lit(span)) < limit))
        part = part.orderBy(F.xxhash64("k"), "k").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(
        F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("t").alias("t"))

    def learn(table: pa.Table) -> pa.Table:
        let_go()  # of what operators before this one left in the worker
        order = pc.sort_indices(table, [("k", "ascending"), ("y", "ascending"), ("t", "ascending")]).to_pylist()
        texts = (table["t"][i].as_py() or "" for i in order)
        y = table["y"].to_numpy().astype(np.int64)[order]
        model = Model.fit(document_features(texts), y, share) if len(set(y.tolist())) == 2 \
            else Model.constant(share)
        return pa.table({"model": pa.array([model.to_bytes()], pa.binary())})

    model = rows.groupBy().applyInArrow(learn, "model binary").collect()
    return Model.from_bytes(model[0]["model"]) if model else Model.constant(share)


def with_score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """`docs` with the probability of label 1; a column of that name is replaced."""
    kept = [c for c in docs.columns if c != column]
    own = [f"c{i}" for i in range(len(kept))]  # no column of the input is taken for the text
    gains = docs.sparkSession.sparkContext.broadcast(model.gains())
    offset = model.offset

    def score(batches):
        let_go()
        held = gains.value
        for part in arrays.slices(batches, "_text"):
            data, offsets = arrays.text_bytes(part.column("_text"))
            n = part.num_rows
            total, count = np.zeros(n), np.zeros(n)
            for ids, row in features(data, offsets):
                total += np.bincount(row, held[ids], n)[:n]
                count += np.bincount(row, minlength=n)[:n]
            odds = total / np.maximum(count, 1) + offset
            value = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [part.column(i) for i in range(len(kept))] + [pa.array(np.round(value, 9))],
                names=own + ["_score"])

    rows = docs.select(*(F.col(c).alias(o) for c, o in zip(kept, own)),
                       F.col(text).cast("string").alias("_text"))
    fields = [T.StructField(o, docs.schema[c].dataType) for c, o in zip(kept, own)]
    scored = rows.mapInArrow(score, T.StructType([*fields, T.StructField("_score", T.DoubleType())]))
    return scored.select(*(F.col(o).alias(c) for c, o in zip(kept, own)), F.col("_score").alias(column))


THRESHOLD = 0.3


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels)
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

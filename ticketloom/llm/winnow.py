"""Benchmark decontamination by winnowed fingerprints, extended to exact shared windows.

A document is contaminated where it repeats `window` consecutive words of a benchmark item, or all
words of a shorter item. Fingerprints are the hashes of GRAM words of which every run of
window - GRAM + 1 neighbours keeps its minimum; any shared span of `window` words therefore has a
common fingerprint on both sides. The benchmark's fingerprints set bits in a map of fixed size; a
document fingerprint that finds its bit proposes the windows around it, and proposals are joined
with the benchmark's windows by their words, so hashes never decide. Neighbouring windows that hold
extend each other to the whole shared span. Items shorter than a window are looked up whole.

Nulls, empty texts and texts without words have no hits; items with null ids or no words take no
part; items that share an id count as one. Repeated documents are kept, each with its own result.
Equal windows of many items or many documents join by key; Spark splits a hot one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.llm import arrays
from ticketloom.llm.staging import staged

WINDOW = 10
GRAM = 5
#: The filter's size, whatever the benchmark's; a full map proposes more and stays right.
MAP_BITS = 1 << 26
PIECE_BITS = 1 << 16

PROPOSALS = T.ArrayType(T.StructType([
    T.StructField("win", T.StringType()), T.StructField("len", T.IntegerType()),
    T.StructField("starts", T.ArrayType(T.IntegerType()))]))
_ARROW = pa.list_(pa.struct([
    ("win", pa.string()), ("len", pa.int32()), ("starts", pa.list_(pa.int32()))]))


def fingerprints(words: arrays.WordTable, window: int, gram: int):
    """Winnowed grams of rows with at least `window` words: (hash, first word, row)."""
    hashes, first, row = words.grams(gram)
    run = window - gram + 1
    n = len(hashes) - run + 1
    if n <= 0:
        return hashes[:0], first[:0], row[:0]
    least = hashes[:n].copy()
    for j in range(1, run):
        np.minimum(least, hashes[j:n + j], out=least)
    least[row[:n] != row[run - 1:]] = 0  # a run does not cross rows
    highest = np.zeros(len(hashes), dtype=np.uint64)
    for j in range(run):
        np.maximum(highest[j:n + j], least, out=highest[j:n + j])
    kept = highest == hashes
    return hashes[kept], first[kept], row[kept]


def _word(data: bytes, words: arrays.WordTable, at: int) -> bytes:
    return data[words.starts[at]:words.ends[at]]


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _phrase(data: bytes, words: arrays.WordTable, first: int, n: int) -> str:
    return b" ".join(_word(data, words, i) for i in range(first, first + n)).translate(
        _LOWER).decode("utf-8", "replace")


def _bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(7)) & np.uint64(MAP_BITS - 1)


def benchmark_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Every window of every item: (item string, win, len)."""
    schema = T.StructType([T.StructField("item", T.StringType()),
                           T.StructField("win", T.StringType()),
                           T.StructField("len", T.IntegerType())])

    def cut(batches):
        for part in arrays.slices(batches, "text"):
            data, offsets = arrays.text_bytes(part.column("text"))
            words, raw = arrays.WordTable(data, offsets, arrays.WORDS), data.tobytes()
            item, win, size = [], [], []
            for name, first, n in zip(part.column("item").to_pylist(), words.rows, words.counts):
                length = min(n, window)
                for i in range(first, first + n - length + 1) if length else ():
                    item.append(name)
                    win.append(_phrase(raw, words, i, length))
                    size.append(length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.string()), pa.array(win, pa.string()),
                 pa.array(size, pa.int32())], names=["item", "win", "len"])

    rows = items.filter(F.col(item_id).isNotNull()).select(
        F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(cut, schema).distinct()


def _filter_map(windows: DataFrame, window: int, gram: int) -> np.ndarray:
    """Bits of the benchmark's fingerprints: MAP_BITS / 8 bytes, however many items there are."""
    schema = "piece long, bit long"

    def bits(batches):
        for part in arrays.slices(batches, "win"):
            data, offsets = arrays.text_bytes(part.column("win"))
            words = arrays.WordTable(data, offsets, arrays.WORDS)
            hashes = [fingerprints(words, window, gram)[0]]
            for k in range(1, window):
                found, _, row = words.grams(k, seed=1)
                hashes.append(found[words.counts[row] == k])
            at = np.unique(_bits(np.concatenate(hashes))).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at // PIECE_BITS), pa.array(at % PIECE_BITS)], names=["piece", "bit"])

    def pack(key, rows):
        piece = np.zeros(PIECE_BITS, dtype=np.uint8)
        piece[rows.column("bit").to_numpy()] = 1
        return pa.table({"piece": [key[0].as_py()], "bits": [np.packbits(piece).tobytes()]})

    pieces = windows.select("win").mapInArrow(bits, schema).distinct()
    pieces = pieces.groupBy("piece").applyInArrow(pack, "piece long, bits binary")
    whole = np.zeros(MAP_BITS // 8, dtype=np.uint8)
    for row in pieces.toLocalIterator():
        at = row["piece"] * (PIECE_BITS // 8)
        whole[at:at + PIECE_BITS // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return whole


def _proposed(part_words, raw, known, window, gram, short):
    """Windows to look up, per row: {(phrase, length): starts}."""
    def hit(hashes):
        at = _bits(hashes)
        return (known[(at >> np.uint64(3)).astype(np.int64)]
                >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1

    out: dict[int, set] = {}
    hashes, first, row = fingerprints(part_words, window, gram)
    seen = hit(hashes)
    for r, f in zip(row[seen].tolist(), first[seen].tolist()):
        low, high = int(part_words.rows[r]), int(part_words.rows[r + 1]) - window
        around = range(max(low, f - (window - gram)) - low, min(high, f) - low + 1)
        out.setdefault(r, set()).update(around)
    found = {r: {} for r in out}
    for r, starts in out.items():
        low = int(part_words.rows[r])
        for s in sorted(starts):
            found[r].setdefault((_phrase(raw, part_words, low + s, window), window), []).append(s)
    for k in short:
        hashes, first, row = part_words.grams(k, seed=1)
        seen = hit(hashes)
        for r, f in zip(row[seen].tolist(), first[seen].tolist()):
            low = int(part_words.rows[r])
            found.setdefault(r, {}).setdefault(
                (_phrase(raw, part_words, f, k), k), []).append(f - low)
    return found


def covered(spans: Column) -> Column:
    """Words inside at least one of the spans (start, len), an unsorted array."""
    def step(state, span):
        end = span["start"] + span["len"]
        return F.struct(
            F.greatest(state["end"], end).alias("end"),
            (state["n"] + F.greatest(F.lit(0), end - F.greatest(state["end"], span["start"])))
            .cast("long").alias("n"))

    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda state: state["n"])


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, gram: int = GRAM,
                  carry: Sequence[str] | None = None) -> DataFrame:
    """`docs` with n_words, n_hit, n_items, items_sha256, contaminated and the hit spans.

    `carry` names the columns to keep (all by default); result columns replace columns of the same
    name. Documents are read once; only rows with proposals enter a shuffle, and they carry their
    own number instead of their text.
    """
    spark = docs.sparkSession
    added = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans")
    kept = [c for c in (docs.columns if carry is None else carry) if c not in added]
    windows = staged(benchmark_windows(items, item_id, item_text, window), "windows")
    short = sorted(r["len"] for r in
                   windows.filter(F.col("len") < window).select("len").distinct().collect())
    known = spark.sparkContext.broadcast(_filter_map(windows, window, gram))

    def propose(batches):
        for part in arrays.slices(batches, "_text"):
            data, offsets = arrays.text_bytes(part.column("_text"))
            words, raw = arrays.WordTable(data, offsets, arrays.WORDS), data.tobytes()
            found = _proposed(words, raw, known.value, window, gram, short)
            wins = [[{"win": w, "len": n, "starts": s} for (w, n), s in found[r].items()]
                    if r in found else None for r in range(part.num_rows)]
            names = [n for n in part.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [part.column(n) for n in names]
                + [pa.array(words.counts.astype(np.int64)), pa.array(wins, _ARROW)],
                names=[*names, "_words", "_wins"])

    carried = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)],
                          F.col(text).cast("string").alias("_text"))
    schema = T.StructType([f for f in carried.schema if f.name != "_text"]
                          + [T.StructField("_words", T.LongType()),
                             T.StructField("_wins", PROPOSALS)])
    base = staged(carried.mapInArrow(propose, schema).withColumn(
        "_row", F.monotonically_increasing_id()), "proposals")
    looked = base.filter(F.col("_wins").isNotNull()).select("_row", F.explode("_wins").alias("w"))
    looked = looked.select("_row", "w.win", "w.len", "w.starts")
    hits = staged(looked.join(windows.select("win", "len").distinct(), ["win", "len"], "left_semi"),
                  "hits")
    spans = hits.select("_row", F.explode("starts").alias("start"), "len")
    spans = spans.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("start", "len"))).alias("hit_spans"))
    names = hits.select("_row", "win", "len").join(windows, ["win", "len"]).select(
        "_row", "item").distinct()
    names = names.groupBy("_row").agg(F.array_sort(F.collect_list("item")).alias("_items"))
    # a row without proposals has no hits: it stays where it is
    proposed = base.filter(F.col("_wins").isNotNull()).drop("_wins")
    out = proposed.join(spans, "_row", "left").join(names, "_row", "left")
    out = out.unionByName(base.filter(F.col("_wins").isNull()).drop("_wins"), allowMissingColumns=True)
    none = F.array().cast("array<string>")
    ids = F.coalesce(F.col("_items"), none)
    hit = F.when(F.col("hit_spans").isNull(), F.lit(0).cast("long")).otherwise(covered(F.col("hit_spans")))
    return out.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("_words").alias("n_words"),
        hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"), "hit_spans")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document with its counts, without text or spans."""
    return contamination(docs, items, carry=["doc_id"]).drop("hit_spans")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), iw AS (
  SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p
        FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
        FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, n, p, win FROM dw SEMI JOIN iw USING (n, win)
), words AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS place FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h
  FROM (SELECT DISTINCT doc_id, item FROM hit JOIN iw USING (n, win)) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

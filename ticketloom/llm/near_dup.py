"""Near-duplicate classes by ProbMinHash over weighted word shingles, banding and verification.

A document is the multiset of its shingles of SHINGLE words (lower-cased); fewer words are one
shingle. Similarity is the probability Jaccard of the two weight distributions. ProbMinHash draws
it: every shingle of weight w is a Poisson process of rate w, each arrival goes to a random one of
the signature's components, the earliest arrival holds it, and a shingle stops once its next arrival
is later than all components' holders. Two signatures agree in a component with the probability
Jaccard as probability. BANDS bands of ROWS components make buckets; at 0.8 a pair shares none of
them with probability (1 - 0.8**5)**32, about 3 in a million.

Texts with equal shingle weights are one representative. In each bucket every member is compared
with the first one, which links most groups at a linear number of pairs. Buckets whose other members
still lie in several classes are cut into blocks of at most BLOCK members and BLOCK_BYTES of text, and
one task compares two blocks: it takes pairs of different classes that the signatures (at 5 standard
errors below the threshold) leave possible, the likeliest first, verifies them, merges classes as it
goes, and hands on the links of a spanning forest alone. So no pair leaves a task unless it is a link,
however many similar texts stay unlinked. A pair that shares several buckets is compared in the first
one. Verification is exact on the shingle weights of whole texts; words are told apart by the hashes of
`arrays.word_hashes`. Classes are the connected components of the verified links.

A null text is a class of its own. Texts without words are alike only if equal. Repeated rows are
kept and share a class. Class ids are the row numbers of their smallest row.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.llm import arrays
from ticketloom.llm.components import components
from ticketloom.llm.staging import arrow_rows, staged

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 5
BLOCK = 512
BLOCK_BYTES = 4 << 20
#: Rows of a batch that Python receives; a row may hold two whole texts.
ARROW_ROWS = 500

SIZE = BANDS * ROWS


def weighted(hashes: np.ndarray, row: np.ndarray):
    """Distinct shingles of each row with their counts: (hash, row, weight), by row and hash."""
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    if not len(hashes):
        return hashes, row, np.zeros(0)
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))
    at = np.flatnonzero(new)
    return hashes[at], row[at], np.diff(np.append(at, len(hashes))).astype(np.float64)


def shingles(words: arrays.WordTable, k: int = SHINGLE):
    """Weighted shingles of a slice; a row with 1 to k - 1 words has them all as its one shingle."""
    parts = [words.grams(k)]
    for n in range(1, k):
        if (words.counts == n).any():
            hashes, first, row = words.grams(n)
            short = words.counts[row] == n
            parts.append((hashes[short], first[short], row[short]))
    return weighted(np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts]))


def signatures(hashes: np.ndarray, row: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
    """ProbMinHash signatures (n_rows x SIZE); rows without shingles hold zeros.

    All rows advance together, one arrival of every still running shingle at a time. Arrival times and
    components come from the shingle's hash and the arrival's number alone.
    """
    earliest = np.full(n_rows * SIZE, np.inf)
    holder = np.zeros(n_rows * SIZE, dtype=np.uint64)
    time = np.zeros(len(hashes))
    step = 0
    while len(hashes):
        step += 1
        draw = arrays.mix(hashes ^ arrays.mix(np.array([step * 0x51ED27], dtype=np.uint64))[0])
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
        time = time - np.log(uniform) / weight
        slot = row * SIZE + (arrays.mix(draw) % np.uint64(SIZE)).astype(np.int64)
        np.minimum.at(earliest, slot, time)
        won = earliest[slot] == time
        holder[slot[won]] = hashes[won]
        latest = earliest.reshape(n_rows, SIZE).max(axis=1)
        running = time < latest[row]
        hashes, row, weight, time = hashes[running], row[running], weight[running], time[running]
    return holder.reshape(n_rows, SIZE)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band (n_rows x BANDS)."""
    with np.errstate(over="ignore"):
        total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), BANDS)).copy()
        for j in range(ROWS):
            total = total * np.uint64(arrays.STEP) + signature[:, j::ROWS]
    return arrays.mix(total)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two (sorted hashes, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    shared = a[0][at] == b[0]
    x, y = a[1][at[shared]], b[1][shared]
    if not len(x):
        return 0.0
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    ratio = y / x
    # for shared d: 1 / sum of max(x/x_d, y/y_d); it depends on x_d and the ratio y_d/x_d alone
    if (ratio == ratio[0]).all():
        return float(x.sum() / (only_x + x.sum() + only_y / ratio[0]))
    total = 0.0
    for one in np.unique(ratio):
        total += x[ratio == one].sum() / (only_x + only_y / one + np.maximum(x, y / one).sum())
    return float(total)


def signed_rows(docs: DataFrame, text: str) -> DataFrame:
    """`docs` (columns c0..) with _key, _bands, _sketch (a byte of each component) and _marks (32 bits of
    each band: two bands that differ look equal once in 2**32), one pass."""
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("_key", T.BinaryType()),
                           T.StructField("_bands", T.ArrayType(T.LongType())),
                           T.StructField("_sketch", T.BinaryType()),
                           T.StructField("_marks", T.BinaryType())])

    def sign(batches):
        for part in arrays.slices(batches, text):
            data, offsets = arrays.text_bytes(part.column(text))
            words = arrays.WordTable(data, offsets, arrays.WORDS)
            n = part.num_rows
            hashes, row, weight = shingles(words)
            signature = signatures(hashes, row, weight, n)
            bands = arrays.signed(band_hashes(signature))
            sketch = arrays.mix(signature).astype(np.uint8)
            marks = arrays.mix(bands.view(np.uint64)).astype(np.uint32)
            ends = np.searchsorted(row, np.arange(n + 1))
            keys, kept, sketches, marked = [], [], [], []
            texts = part.column(text)
            for i in range(n):
                a, b = ends[i], ends[i + 1]
                if a == b:
                    whole = texts[i].as_py()
                    keys.append(None if whole is None else hashlib.blake2b(
                        b"t" + whole.encode(), digest_size=16).digest())
                    kept.append(None)
                    sketches.append(None)
                    marked.append(None)
                    continue
                gcd = np.gcd.reduce(weight[a:b].astype(np.int64))
                even = (weight[a:b].astype(np.int64) // gcd).tobytes()
                keys.append(hashlib.blake2b(hashes[a:b].tobytes() + even, digest_size=16).digest())
                kept.append(bands[i])
                sketches.append(sketch[i].tobytes())
                marked.append(marks[i].tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column(name) for name in names]
                + [pa.array(keys, pa.binary()), pa.array(kept, pa.list_(pa.int64())),
                   pa.array(sketches, pa.binary()), pa.array(marked, pa.binary())],
                names=[*names, "_key", "_bands", "_sketch", "_marks"])

    return docs.mapInArrow(sign, schema)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose texts are at least `threshold` similar."""
    def check(batches):
        for batch in batches:
            for part in arrays.slices([batch], "ta", arrays.SLICE_BYTES // 2):
                sides = []
                for name in ("ta", "tb"):
                    sides.append(_weights(part.column(name)))
                held = pa.array([similarity(x, y) >= threshold - 1e-12 for x, y in zip(*sides)],
                                pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").filter(held), part.column("b").filter(held)], names=["a", "b"])

    joined = pairs.select("a", "b").join(
        texts.select(F.col("_row").alias("b"), F.col("_text").alias("tb")), "b").join(
        texts.select(F.col("_row").alias("a"), F.col("_text").alias("ta")), "a")
    return joined.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def _possible(threshold: float) -> int:
    """Agreeing components below which a pair at the threshold is 5 standard errors away."""
    return math.floor(SIZE * threshold - 5 * math.sqrt(SIZE * threshold * (1 - threshold)))


def block_links(members: DataFrame, least: int, threshold: float) -> DataFrame:
    """Links (a, b) that join the components of members of one bucket: a spanning forest of each group.

    `members` has bucket, band, rep, component, _sketch, _marks and _text. A group is one pair of blocks.
    """
    sizes = members.groupBy("bucket").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)),
        F.ceil(F.sum(F.octet_length("_text")) / F.lit(BLOCK_BYTES))).cast("long").alias("n"))
    placed = members.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n")))
    kept = ["bucket", "band", "rep", "component", "_sketch", "_marks", "_text", "own"]
    spread = placed.select(*kept, F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"))
    spread = spread.select(*kept, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def link(table: pa.Table) -> pa.Table:
        sketch = np.stack([np.frombuffer(x.as_py(), dtype=np.uint8) for x in table.column("_sketch")])
        marks = np.stack([np.frombuffer(x.as_py(), dtype=np.uint32) for x in table.column("_marks")])
        rep, component, own, band = (table.column(c).to_numpy() for c in ("rep", "component", "own", "band"))
        two_blocks = (table.column("i").to_numpy() != table.column("j").to_numpy()).any()
        _, tree = np.unique(component, return_inverse=True)
        found = [], [], []
        for x in range(len(rep) - 1):
            n = (sketch[x + 1:] == sketch[x]).sum(axis=1)
            ok = (n >= least) & (component[x + 1:] != component[x])
            if two_blocks:
                ok &= own[x + 1:] != own[x]
            at = np.flatnonzero(ok)
            at = at[(marks[x + 1 + at] == marks[x]).argmax(axis=1) == band[x]]
            for part, values in zip(found, (np.full(len(at), x), at + x + 1, n[at])):
                part.append(values)
        xs, ys, agree = (np.concatenate(part) if part else np.zeros(0, np.int64) for part in found)
        links = [], []
        if len(xs):
            root = np.arange(tree.max() + 1)

            def find(node: int) -> int:
                while root[node] != node:
                    root[node] = root[root[node]]
                    node = root[node]
                return node

            some, place = np.unique(np.concatenate([xs, ys]), return_inverse=True)
            weights = _weights(table.column("_text").take(some))
            wx, wy = place[:len(xs)], place[len(xs):]
            for at in np.argsort(-agree, kind="stable"):
                x, y = int(xs[at]), int(ys[at])
                one, other = find(tree[x]), find(tree[y])
                if one != other and similarity(weights[wx[at]], weights[wy[at]]) >= threshold - 1e-12:
                    root[one] = other
                    links[0].append(int(min(rep[x], rep[y])))
                    links[1].append(int(max(rep[x], rep[y])))
        return pa.table({"a": pa.array(links[0], pa.int64()), "b": pa.array(links[1], pa.int64())})

    return spread.groupBy("bucket", "i", "j").applyInArrow(link, "a long, b long")


def _weights(column: pa.ChunkedArray | pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sorted shingles of each text and their weights."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(c.cast(pa.large_string()) for c in column.chunks)
    data, offsets = arrays.text_bytes(column)
    hashes, row, weight = shingles(arrays.WordTable(data, offsets, arrays.WORDS))
    ends = np.searchsorted(row, np.arange(len(column) + 1))
    return [(hashes[i:j], weight[i:j]) for i, j in zip(ends, ends[1:])]


def _open_members(members: DataFrame, found: DataFrame, reps: DataFrame) -> DataFrame:
    """Members, the first ones aside, of buckets that reach into several components."""
    others = _labelled(members.filter((F.col("rep") != F.col("first")) & (F.col("n") > 2)), found, "rep")
    open_ = others.groupBy("bucket", "band").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s"))
    # the same members often share several bands: the first bucket of each set is enough
    open_ = open_.filter(F.col("low") != F.col("high")).groupBy("m", "s").agg(
        F.min(F.struct("band", "bucket")).alias("_b")).select(F.col("_b.bucket").alias("bucket"))
    return others.join(open_, "bucket", "left_semi").select("bucket", "band", "rep", "component").join(
        reps.select(F.col("_row").alias("rep"), "_sketch", "_marks", "_text"), "rep")


def _labelled(rows: DataFrame, found: DataFrame, node: str, out: str = "component") -> DataFrame:
    """`rows` with the component of `node`; a node without a link is its own."""
    named = found.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return rows.join(named, F.col(node) == F.col("_n"), "left").withColumn(
        out, F.coalesce("_c", F.col(node))).drop("_n", "_c")


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose ends are not yet in one component, with both components."""
    ends = _labelled(_labelled(pairs, found, "a", "ca"), found, "b", "cb")
    return ends.filter(F.col("ca") != F.col("cb"))


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: only the components that these join are worked on."""
    joined = staged(_across(links, found).select("ca", "cb"), "across")
    if not joined.count():
        return found
    roots = components(joined, "ca", "cb")
    new = roots.join(found.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_anti")
    moved = _labelled(found.withColumnRenamed("component", "old"), roots, "old").select("node", "component")
    return staged(moved.unionByName(new), "components")


def classes_of(reps: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of every representative (_row, _bands, _sketch, _marks, _text) with a link."""
    buckets = reps.select(F.posexplode("_bands").alias("band", "bucket"), F.col("_row").alias("rep"))
    full = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("first"))
    members = staged(buckets.join(full.filter(F.col("n") > 1), "bucket"), "members")
    # only texts that share a bucket are moved again
    texts = staged(reps.drop("_bands").join(
        members.select(F.col("rep").alias("_row")).distinct(), "_row", "left_semi"), "texts")
    sketches = texts.select(F.col("_row").alias("rep"), "_sketch")
    least = _possible(threshold)

    first = members.filter(F.col("rep") != F.col("first")).select(
        F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    links = staged(verified(_agreeing(first, sketches, least), texts, threshold), "links-first")
    found = staged(components(links), "components")
    return _merged(found, staged(block_links(_open_members(members, found, texts), least, threshold),
                                 "links-blocks"))


def _agreeing(pairs: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """Pairs whose sketches agree in at least `least` components."""
    def check(batches):
        for part in batches:
            if not part.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=np.uint8).reshape(-1, SIZE)
                    for c in ("sa", "sb"))
            held = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays(
                [part.column("a").filter(held), part.column("b").filter(held)], names=["a", "b"])

    joined = pairs.join(sketches.select(F.col("rep").alias("b"), F.col("_sketch").alias("sb")), "b").join(
        sketches.select(F.col("rep").alias("a"), F.col("_sketch").alias("sa")), "a")
    return joined.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def with_classes(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD,
                 carry: list[str] | None = None, first_by: str | None = None) -> DataFrame:
    """`docs` (or its columns `carry`) with class_id, class_size and is_first.

    A class's first row is the one with the smallest `first_by`, a kept column (nulls first), then
    the smallest row number.
    """
    added = ("class_id", "class_size", "is_first")
    kept = [c for c in (docs.columns if carry is None else carry) if c not in added]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)],
                       F.col(text).cast("string").alias("_text"))
    spark = docs.sparkSession
    with arrow_rows(spark, ARROW_ROWS):
        base = staged(signed_rows(rows, "_text").withColumn("_row", F.monotonically_increasing_id()),
                      "signed")
    keyed = base.filter(F.col("_key").isNotNull())
    firsts = keyed.groupBy("_key").agg(F.min("_row").alias("rep"))
    copies = staged(keyed.select("_row", "_key").join(firsts, "_key").select("_row", "rep"), "copies")
    reps = base.filter(F.col("_bands").isNotNull()).join(
        copies.filter(F.col("_row") == F.col("rep")).select("_row"), "_row", "left_semi").select(
        "_row", "_bands", "_sketch", "_marks", "_text")
    with arrow_rows(spark, ARROW_ROWS):
        found = classes_of(reps, threshold)
    classes = staged(_labelled(copies, found, "rep").select("_row", "component"), "classes")
    order = F.lit(0).alias("by") if first_by is None else F.col(f"c{kept.index(first_by)}").alias("by")
    ordered = classes.join(base.select("_row", order), "_row") if first_by else classes.withColumn("by", order)
    sizes = ordered.groupBy("component").agg(
        F.count(F.lit(1)).alias("size"), F.min("_row").alias("low"),
        F.min(F.struct("by", "_row")).alias("first"))
    found = classes.join(sizes, "component").select(
        F.col("_row").alias("_r"), F.col("low").alias("class_id"), F.col("size").alias("class_size"),
        (F.col("first._row") == F.col("_row")).alias("is_first"))
    out = base.join(found, F.col("_row") == F.col("_r"), "left")
    class_id = F.coalesce("class_id", F.col("_row"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)],
                      class_id.alias("class_id"),
                      F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
                      F.coalesce("is_first", F.lit(True)).alias("is_first"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id with the smallest doc_id of its class and the class's size."""
    found = staged(with_classes(docs, carry=["doc_id"]), "near")
    named = found.groupBy("class_id").agg(F.min("doc_id").alias("class_doc_id"))
    return found.join(named, "class_id").select("doc_id", F.col("class_doc_id").alias("class_id"),
                                                "class_size")

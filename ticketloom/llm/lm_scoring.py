"""Cross-entropy difference between matched n-gram models of a target and a background corpus.

The background is every document, the target those of them that are marked. Both models are bigram
models over one vocabulary and one inventory of bigrams: tokens (between white space) and bigrams
that the background holds at least LEAST_COUNT times, at every size; the rest are one unknown token,
or back off. The counts are exact and cover all documents.

P(w | h) = L c(h, w) / c(h) + (1 - L k(h) / c(h)) P(w), k(h) the kept bigrams' count after h,
P(w) = (c(w) + 1) / (n + size), with counts of the model's own corpus. A document's score is the
mean over its tokens of the target's loss less the background's, in nats: below 0 means closer to
the target. A text begins with a start mark.

Both tables grow with the corpus and stay Spark tables. Documents are read once and cut into groups of
about GROUP_BYTES of text, kept as numbers of the group's distinct words. Groups deal out what they
counted as packed slices, words by a range of their hash and bigrams by their history; a slice's answer
holds the sums over all groups in the slice's own order, so that no key travels back. k(h) is c(h) less the
bigrams after h that occur once. Histories of at least HOT_COUNT tokens are dealt out by both words, and
their parts added up in a table of their own. Only totals and the two marks' counts reach the driver.

Null and empty texts have no tokens and scores of 0. Repeated rows count as often as they occur.
Without a target document the target model is uniform.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.llm import arrays
from ticketloom.llm.packing import pack, unpack
from ticketloom.llm.staging import staged
from ticketloom.llm.worker_memory import freed

LEAST_COUNT = 2
MIX = 0.6
#: Bytes of text, and of 16 a row, that are counted and scored together; one text is never cut.
GROUP_BYTES = 16 << 20
#: Marked keys up to which they are broadcast to the documents instead of shuffled with them.
BROADCAST_KEYS = 2_000_000
#: Words, or bigrams, of all groups that a part of the exchange aims at.
PART_KEYS = 1_000_000
#: Tokens from which a history's bigrams are dealt out by both words.
HOT_COUNT = 100_000
#: Tokens of a group that one stored row holds.
ROW_TOKENS = 1_000_000

#: Numbers of the start mark and the unknown token; a known word's is 2 + (part << 32) + its rank there.
START, UNKNOWN, FIRST = 0, 1, 2

BLOBS = [f"x{i}" for i in range(6)]
#: Packed columns of a group: `kind` and `b` say which.
PACKED = T.StructType([T.StructField("g", T.LongType()), T.StructField("kind", T.StringType()),
                       T.StructField("b", T.LongType()), *(T.StructField(x, T.BinaryType()) for x in BLOBS)])


def marked(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """`docs` with _target: whether the key is one of `keys`."""
    keys = keys.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k")).distinct()
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return docs.join(keys, F.col(key) == F.col("_k"), "left").withColumn(
        "_target", F.col("_k").isNotNull()).drop("_k")


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and each row's number of them."""
    words = arrays.WordTable(data, offsets, arrays.TOKENS)
    return words.hashes, words.counts


def packed(g: int, kind: str, b: int, *blobs: bytes) -> dict:
    return {"g": g, "kind": kind, "b": b} | dict(zip(BLOBS, blobs))


def counted(number: np.ndarray, sizes: np.ndarray, target: np.ndarray, distinct: int) -> list[np.ndarray]:
    """Per word: occurrences, those in the target, and both of those that end a text."""
    inside = np.repeat(target, sizes).astype(np.float64)
    last = np.cumsum(sizes)[sizes > 0] - 1
    return [np.bincount(place, weight, distinct).astype(np.int64) for place, weight in (
        (number, None), (number, inside), (number[last], None), (number[last], inside[last]))]


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` without texts but with _n, their tokens, and their place (g, b), beside packed rows.

    A group's `text` row holds its documents' tokens and marks, `code` rows the tokens as numbers of its
    distinct words, the `word` row these words' hashes and counts. Staged: a document keeps its group.
    """
    own = [c for c in docs.columns if c not in ("_text", "_target")]
    schema = T.StructType([*PACKED.fields, T.StructField("_n", T.LongType()),
                           *(T.StructField(c, docs.schema[c].dataType) for c in own)])

    def finish(g, held):
        hashes, sizes, target = (np.concatenate(x) for x in zip(*held))
        yield packed(g, "text", 0, pack(sizes), pack(target)) | {"_n": 0}
        found, number = np.unique(hashes, return_inverse=True)
        for first in range(0, len(number), ROW_TOKENS):
            yield packed(g, "code", first // ROW_TOKENS, pack(number[first:first + ROW_TOKENS])) | {"_n": 0}
        if len(found):
            yield packed(g, "word", 0, pack(np.diff(found, prepend=np.uint64(0))),
                         *(pack(x) for x in counted(number, sizes, target, len(found)))) | {"_n": len(found)}

    def number(batches):
        g, size, rows, held, types = TaskContext.get().partitionId() << 32, 0, 0, [], None

        def batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r.get(name) for r in rows], kind) for name, kind in types], names=schema.names)

        for part in arrays.slices(batches, "_text", min(arrays.SLICE_BYTES, GROUP_BYTES)):
            types = types or [
                ("g", pa.int64()), ("kind", pa.string()), ("b", pa.int64()), *((x, pa.binary()) for x in BLOBS),
                ("_n", pa.int64()), *((c, part.schema.field(c).type) for c in own)]
            data, offsets = arrays.text_bytes(part.column("_text"))
            more = len(data) + 16 * part.num_rows
            if size and size + more > GROUP_BYTES:
                for row in finish(g, held):
                    yield batch([row])
                g, size, rows, held = g + 1, 0, 0, []
            hashes, sizes = tokens(data, offsets)
            held.append((hashes, sizes, part.column("_target").to_numpy(False).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(part.num_rows, g)), pa.array(["document"] * part.num_rows, pa.string()),
                pa.array(np.arange(rows, rows + part.num_rows)),
                *(pa.nulls(part.num_rows, pa.binary()) for _ in BLOBS), pa.array(sizes.astype(np.int64)),
                *(part.column(c) for c in own)], names=schema.names)
            size, rows = size + more, rows + part.num_rows
        if held:
            for row in finish(g, held):
                yield batch([row])

    return staged(docs.mapInArrow(number, schema), "lm-documents")


def table_of(rows: list[dict], schema: T.StructType) -> pa.Table:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.table({f.name: pa.array([r.get(f.name) for r in rows], kinds[f.dataType.simpleString()])
                     for f in schema.fields})


def joined(rows: list[dict], column: str) -> np.ndarray:
    found = [unpack(r[column]) for r in rows]
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def tasks(df: DataFrame, groups: int) -> int:
    """Tasks for so many groups: each has one of its own as long as they are not many thousands."""
    return max(1, min(2 * groups, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups // 16)))


def word_slices(rows: DataFrame, parts: int) -> DataFrame:
    """The groups' words cut by ranges of their hashes."""
    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                columns = [unpack(row[x]) for x in BLOBS[:5]]
                hashes = np.cumsum(columns[0].view(np.uint64), dtype=np.uint64)
                part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                at = np.searchsorted(part, np.arange(parts + 1).astype(np.uint64))
                out = [packed(row["g"], "word", b, pack(np.diff(hashes[i:j], prepend=np.uint64(0))),
                              *(pack(c[i:j]) for c in columns[1:]))
                       for b, (i, j) in enumerate(zip(at, at[1:])) if i < j]
                yield from table_of(out, PACKED).to_batches()

    return rows.filter("kind = 'word'").select(*PACKED.names).mapInArrow(cut, PACKED)


SUMS = ["size", "n", "nt", "e", "et"]
WORDS = T.StructType([*PACKED.fields, *(T.StructField(c, T.LongType()) for c in SUMS)])


def word_sums(table: pa.Table) -> pa.Table:
    """Each slice's words that are known, their ranks and sums over all groups; one row has the totals."""
    rows = table.to_pylist()
    keys = [np.cumsum(unpack(r["x0"]).view(np.uint64), dtype=np.uint64) for r in rows]
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(place, joined(rows, x), len(found)).astype(np.int64) for x in BLOBS[1:5]]
    known = sums[0] >= LEAST_COUNT
    rank = np.cumsum(known) - 1
    totals = dict(zip(SUMS, [int(known.sum()), *(int(s[known].sum()) for s in sums)]))
    out, ends = [], np.cumsum([len(k) for k in keys])
    for row, key, end in zip(rows, keys, ends):
        at = place[end - len(key):end]
        kept = at[known[at]]
        out.append(packed(row["g"], "word", row["b"], pack(known[at]), pack(np.diff(rank[kept], prepend=0)),
                          *(pack(s[kept]) for s in sums)) | (dict.fromkeys(SUMS, 0) if out else totals))
    return table_of(out, WORDS)


def exchanged(slices: DataFrame, parts: int, add, schema: T.StructType, label: str) -> DataFrame:
    """The answers to all slices; slices of one part meet in one task."""
    return staged(slices.repartition(tasks(slices, parts), "b").groupBy("b").applyInArrow(
        lambda table: freed(add, table), schema), label)


class Group:
    """A group's tokens as places among its known words, in the order of their numbers; 0 and 1 are the marks."""

    def __init__(self, rows: list[dict], parts: int, hot_count: int):
        kinds = {}
        for row in sorted(rows, key=lambda r: r["b"]):
            kinds.setdefault(row["kind"], []).append(row)
        self.kinds, self.parts = kinds, parts
        words = kinds.get("word", [])
        known = joined(words, "x0").astype(bool)
        self.ids = np.concatenate([np.array([START, UNKNOWN]), *(
            FIRST + (r["b"] << 32) + np.cumsum(unpack(r["x1"])) for r in words)])
        self.sums = np.stack([joined(words, x) for x in BLOBS[2:6]], axis=1)
        place = np.full(len(known), UNKNOWN)
        place[known] = np.arange(FIRST, FIRST + known.sum())
        self.sizes = joined(kinds["text"], "x0")
        self.target = np.repeat(joined(kinds["text"], "x1"), self.sizes)
        codes = joined(kinds.get("code", []), "x0")
        self.word = place[codes] if len(codes) else codes
        self.history = np.append(START, self.word[:-1])[:len(self.word)]
        self.history[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = START
        self.hot = np.append([True, True], self.sums[:, 0] >= hot_count)

    def pairs(self):
        """Distinct bigrams as (history, word), their parts' order, and each token's place among them."""
        codes, place = np.unique((self.history << 32) | self.word, return_inverse=True)
        history, word = codes >> 32, codes & 0xFFFFFFFF
        with np.errstate(over="ignore"):
            key = self.ids[history].view(np.uint64) * np.uint64(arrays.STEP)
            key += np.where(self.hot[history], self.ids[word].view(np.uint64), np.uint64(0))
        part = (arrays.mix(key) % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order))
        return history, word, place, [(int(part[order[i]]), order[i:j]) for i, j in zip(cuts, cuts[1:])]


def heads_of(history: np.ndarray) -> np.ndarray:
    """Where another history begins."""
    return np.flatnonzero(np.diff(history, prepend=-1))


def pair_slices(coded: DataFrame, words: DataFrame, groups: int, parts: int) -> DataFrame:
    """The groups' bigrams: histories' numbers, marks of hot ones and followers; words' numbers and counts."""
    def cut(table: pa.Table) -> pa.Table:
        group = Group(table.to_pylist(), parts, HOT_COUNT)
        g = table.column("g")[0].as_py()
        history, word, place, slices = group.pairs()
        n = np.bincount(place, minlength=len(history))
        nt = np.bincount(place, group.target, len(history)).astype(np.int64)
        out = []
        for b, at in slices:
            begin = heads_of(history[at])
            head = history[at][begin]
            out.append(packed(
                g, "pair", b, pack(np.diff(group.ids[head], prepend=0)), pack(group.hot[head]),
                pack(np.diff(begin, append=len(at))), pack(group.ids[word[at]]), pack(n[at]), pack(nt[at])))
        return table_of(out, PACKED)

    rows = coded.unionByName(words.select(*PACKED.names))
    return rows.repartition(tasks(rows, groups), "g").groupBy("g").applyInArrow(
        lambda table: freed(cut, table), PACKED)


PAIRS = T.StructType([*PACKED.fields, *(T.StructField(x, T.BinaryType()) for x in ("hot", "s", "st"))])


def pair_sums(table: pa.Table) -> pa.Table:
    """Each slice's kept bigrams, their sums, and after each history the bigrams that occur once.

    A hot history's are this part's alone; one row has them all, to be added up.
    """
    rows = table.to_pylist()
    heads = [np.cumsum(unpack(r["x0"])) for r in rows]
    every, number = np.unique(np.concatenate(heads), return_inverse=True)
    hot = np.zeros(len(every), dtype=bool)
    hot[number] = joined(rows, "x1").astype(bool)
    words, word = np.unique(joined(rows, "x3"), return_inverse=True)
    codes, place = np.unique(np.repeat(number, joined(rows, "x2")) * len(words) + word, return_inverse=True)
    n, nt = (np.bincount(place, joined(rows, x), len(codes)).astype(np.int64) for x in ("x4", "x5"))
    kept = n >= LEAST_COUNT
    single = codes[~kept] // len(words)
    s, st = (np.bincount(single, c[~kept], len(every)).astype(np.int64) for c in (n, nt))
    out, first, first_head = [], 0, 0
    for row, head in zip(rows, heads):
        size = int(unpack(row["x2"]).sum())
        at, own = place[first:first + size], number[first_head:first_head + len(head)]
        first, first_head = first + size, first_head + len(head)
        of = at[kept[at]]
        out.append(packed(row["g"], "pair", row["b"], pack(kept[at]), pack(n[of]), pack(nt[of]),
                          pack(s[own]), pack(st[own]))
                   | ({} if out else {"hot": pack(every[hot]), "s": pack(s[hot]), "st": pack(st[hot])}))
    return table_of(out, PAIRS)


def hot_heads(pairs: DataFrame) -> DataFrame:
    """For hot histories: the bigrams after them that occur once, in both corpora."""
    def spread(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(unpack(row[c])) for c in ("hot", "s", "st")],
                                                 names=["h", "s", "st"])

    parts = pairs.filter("hot IS NOT NULL").select("hot", "s", "st").mapInArrow(spread, "h long, s long, st long")
    return staged(parts.groupBy("h").agg(F.sum("s").alias("s"), F.sum("st").alias("st")), "lm-heads")


def hot_members(words: DataFrame) -> DataFrame:
    """Groups and the numbers of the hot words they hold."""
    def spread(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rank, n = np.cumsum(unpack(row["x1"])), unpack(row["x2"])
                ids = FIRST + (row["b"] << 32) + rank[n >= HOT_COUNT]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["g"])), pa.array(ids)],
                                                 names=["g", "h"])

    return words.select("g", "b", "x1", "x2").mapInArrow(spread, "g long, h long")


def totals(df: DataFrame, columns: list) -> list[int]:
    return [x or 0 for x in df.agg(*(F.sum(c) for c in columns)).first()]


def text_totals(rows: DataFrame) -> list[int]:
    """Tokens, those of the target, texts that have some, and those of the target."""
    def add(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes, target = unpack(row["x0"]), unpack(row["x1"])
                some = (sizes > 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(x)]) for x in (sizes.sum(), sizes @ target, some.sum(), some @ target)],
                    names=["n", "nt", "t", "tt"])

    found = rows.filter("kind = 'text'").select("x0", "x1").mapInArrow(add, "n long, nt long, t long, tt long")
    return totals(found, ["n", "nt", "t", "tt"])


def with_losses(docs: DataFrame, target_keys: DataFrame, key: str = "doc_id", text: str = "text",
                carry: list[str] | None = None) -> DataFrame:
    """`docs` with n_tokens, ce_target, ce_background and ce_difference (nats per token)."""
    added = ["n_tokens", "ce_target", "ce_background", "ce_difference"]
    kept = [c for c in (docs.columns if carry is None else carry) if c not in added]
    own = [f"c{i}" for i in range(len(kept))]
    rows = docs.select(*(F.col(c).alias(o) for c, o in zip(kept, own)),
                       F.col(text).cast("string").alias("_text"), F.col(key).alias("_key"))
    rows = numbered(marked(rows, target_keys.select(F.col(key).alias("_key")), "_key").drop("_key"))

    n, nt, texts, texts_t = text_totals(rows)
    groups, distinct = totals(rows.filter("kind IN ('text', 'word')"), [
        (F.col("kind") == "text").cast("long"), "_n"])
    word_parts, pair_parts = max(1, -(-distinct // PART_KEYS)), max(1, -(-n // PART_KEYS))
    words = exchanged(word_slices(rows, word_parts), word_parts, word_sums, WORDS, "lm-words")
    size, *known = totals(words, SUMS)
    coded = rows.filter("kind IN ('text', 'code')").select(*PACKED.names)
    pairs = exchanged(pair_slices(coded, words, groups, pair_parts), pair_parts, pair_sums, PAIRS, "lm-pairs")
    heads = hot_heads(pairs)
    single = {r["h"]: (r["s"], r["st"]) for r in heads.filter(F.col("h").isin(START, UNKNOWN)).collect()}
    # n, nt, e, et of the start mark, as if it ended no text, and of the unknown token
    marks = np.array([(texts, texts_t, 0, 0), (n - known[0], nt - known[1], texts - known[2], texts_t - known[3])])

    longs = [F.lit(None).cast("long").alias(c) for c in ("s", "st")]
    blobs = [F.lit(None).cast("binary").alias(x) for x in BLOBS]
    held = coded.unionByName(words.select(*PACKED.names)).unionByName(pairs.select(*PACKED.names)).select(
        "*", *longs).unionByName(hot_members(words).join(heads, "h").select(
            "g", F.lit("head").alias("kind"), F.col("h").alias("b"), *blobs, "s", "st"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("_b")
        group = Group(right.to_pylist(), pair_parts, HOT_COUNT)
        sums = np.concatenate([marks, group.sums])
        history, word, place, slices = group.pairs()
        once, both = np.zeros((len(sums), 2)), np.zeros((len(history), 2))
        answers = {r["b"]: r for r in group.kinds.get("pair", [])}
        for b, at in slices:
            row = answers[b]
            once[history[at][heads_of(history[at])]] = np.stack([unpack(row["x3"]), unpack(row["x4"])], axis=1)
            both[at[unpack(row["x0"]).astype(bool)]] = np.stack([unpack(row["x1"]), unpack(row["x2"])], axis=1)
        for mark in (START, UNKNOWN):
            once[mark] = single.get(mark, (0, 0))
        hot = group.kinds.get("head", [])
        once[np.searchsorted(group.ids, [r["b"] for r in hot])] = np.array(
            [(r["s"], r["st"]) for r in hot]).reshape(-1, 2)
        count = (sums[:, :2] - sums[:, 2:]).astype(np.float64)
        before, after = np.maximum(count, 1)[history], (count - once)[history]
        unigram = sums[:, :2] + 1.0
        unigram[START] = 0
        chance = (1 - MIX * after / before) * unigram[word] / (np.array([n, nt]) + size + 1) + MIX * both / before
        losses = -np.log(chance)
        row = np.repeat(np.arange(len(group.sizes)), group.sizes)
        target, background = (np.bincount(row, losses[place, i], len(group.sizes))
                              / np.maximum(group.sizes, 1) for i in (1, 0))
        return pa.table([*(left.column(o) for o in own), pa.array(group.sizes), pa.array(target),
                         pa.array(background), pa.array(target - background)], names=own + added)

    schema = T.StructType([*(T.StructField(o, docs.schema[c].dataType) for c, o in zip(kept, own)),
                           T.StructField(added[0], T.LongType()),
                           *(T.StructField(c, T.DoubleType()) for c in added[1:])])
    count = tasks(rows, groups)
    found = rows.filter("kind = 'document'").select(F.col("g").alias("_g"), F.col("b").alias("_b"), *own)
    scored = found.repartition(count, "_g").groupBy("_g").cogroup(
        held.repartition(count, "g").groupBy("g")).applyInArrow(lambda left, right: freed(score, left, right), schema)
    return scored.select(*(F.col(o).alias(c) for c, o in zip(kept, own)), *added)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document, losses at six digits; the target is what labels.quality marks with 1."""
    found = with_losses(docs, labels.filter(F.col("quality") == 1).select("doc_id"), carry=["doc_id"])
    return found.select("doc_id", "n_tokens", *(
        F.round(c, 6).alias(c) for c in ("ce_target", "ce_background", "ce_difference")))


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r\x00]+'),
      lambda x: x <> '') AS w,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS t FROM documents
), tok AS (
  SELECT doc_id, t, p, w[p] AS w FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM docs)
), least AS (
  SELECT 2 AS c, count(*) AS n, count(*) FILTER (t) AS nt FROM tok
), known AS (
  SELECT w FROM tok GROUP BY w HAVING count(*) >= (SELECT c FROM least)
), named AS (
  SELECT doc_id, t, p, coalesce(known.w, chr(10)) AS w FROM tok LEFT JOIN known USING (w)
), pair AS (
  SELECT doc_id, t, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY p), '') AS h, w FROM named
), word AS (
  SELECT w, (count(*) + 1) / ((SELECT n FROM least) + (SELECT count(*) FROM known) + 1) AS b,
    (count(*) FILTER (t) + 1) / ((SELECT nt FROM least) + (SELECT count(*) FROM known) + 1) AS g
  FROM named GROUP BY w
), counts AS (
  SELECT h, w, count(*) AS n, count(*) FILTER (t) AS nt FROM pair GROUP BY h, w
), head AS (
  SELECT h, greatest(sum(n), 1) AS c, greatest(sum(nt), 1) AS ct,
    coalesce(sum(n) FILTER (n >= (SELECT c FROM least)), 0) AS k,
    coalesce(sum(nt) FILTER (n >= (SELECT c FROM least)), 0) AS kt FROM counts GROUP BY h
), loss AS (
  SELECT h, w,
    -ln((1 - 0.6e0 * k / c) * b + CASE WHEN n >= (SELECT c FROM least) THEN 0.6e0 * n / c ELSE 0 END) AS b,
    -ln((1 - 0.6e0 * kt / ct) * g + CASE WHEN n >= (SELECT c FROM least) THEN 0.6e0 * nt / ct ELSE 0 END)
      AS g
  FROM counts JOIN head USING (h) JOIN word USING (w)
), mean AS (
  SELECT doc_id, avg(b) AS b, avg(g) AS g FROM pair JOIN loss USING (h, w) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(coalesce(g, 0), 6) AS ce_target,
  round(coalesce(b, 0), 6) AS ce_background, round(coalesce(g - b, 0), 6) AS ce_difference
FROM docs LEFT JOIN mean USING (doc_id)
"""

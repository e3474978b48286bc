"""Token ids as directly addressable codes in binary files.

A segment file holds the ids of consecutive documents. An id is split into 8-bit chunks, lowest
first. Level 0 has the first chunk of every id, level n the chunk n of every id that needs it; a
continuation bitmap per level says which ids go on, and a rank directory (set bits before every
512th position) finds an id's place on the next level. So any id is read by its position with a few
byte reads and no decoding of its neighbours.

File layout, little-endian: b"DAC1", part u32, segment u32, documents u32, ids u64, levels u32; then
document ids i64 (with a flag byte each: 0 for a null id), first id of each document u64 and one
past the last; then per level: entries u64, chunk bytes, bitmap bytes, rank directory u32.

Encoding runs in ascending order of (key, text hash); equal keys with different texts may span
files. Files are written under names of their own by whichever task attempt ran; the manifest, which
Spark commits, names the ones that count, so a lost or repeated task leaves only unnamed files.
A null text is empty and has the end id alone. Null keys come first. Repeated rows are all kept.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketloom.llm import arrays
from ticketloom.llm.staging import staged
from ticketloom.session import scratch_path

MAGIC = b"DAC1"
HEAD = struct.Struct("<4sIIIQI")
SEGMENT_IDS = 1 << 20
RANK_STEP = 512
#: Word parts an encoding worker remembers before it starts afresh.
CACHE_PARTS = 1_500_000


def levels_of(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(chunks, continues) per level of an unsigned id array."""
    out, rest = [], ids.astype(np.uint64)
    while True:
        more = rest >> np.uint64(8)
        goes_on = more > 0
        out.append(((rest & np.uint64(255)).astype(np.uint8), goes_on))
        if not goes_on.any():
            return out
        rest = more[goes_on]


def pack(part: int, segment: int, keys: list, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment file's bytes; `starts` has one more entry than `keys`."""
    levels = levels_of(ids)
    null = np.array([k is not None for k in keys], dtype=np.uint8)
    out = [HEAD.pack(MAGIC, part, segment, len(keys), len(ids), len(levels)),
           np.array([k or 0 for k in keys], dtype="<i8").tobytes(), null.tobytes(),
           starts.astype("<u8").tobytes()]
    for chunks, goes_on in levels:
        padded = np.zeros(-(-len(goes_on) // RANK_STEP) * RANK_STEP, dtype=np.uint8)
        padded[:len(goes_on)] = goes_on
        counts = padded.reshape(-1, RANK_STEP).sum(axis=1, dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(counts)])[:-1].astype("<u4")
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), np.packbits(padded).tobytes(),
                ranks.tobytes()]
    return b"".join(out)


class Segment:
    """A reader over a segment's bytes (or a memory map of its file)."""

    def __init__(self, data):
        self.data = memoryview(data)
        magic, self.part, self.segment, docs, self.n, n_levels = HEAD.unpack_from(self.data, 0)
        if magic != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(self.data, dtype=kind, count=count, offset=at)
            at += found.nbytes
            return found

        keys, present = take("<i8", docs), take("u1", docs)
        self.keys = [int(k) if p else None for k, p in zip(keys, present)]
        self.starts = take("<u8", docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            blocks = -(-n // RANK_STEP)
            self.levels.append((take("u1", n), take("u1", blocks * RANK_STEP // 8),
                                take("<u4", blocks)))

    def __getitem__(self, i: int) -> int:
        """The id at position i: one chunk, bit and rank per level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for shift, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * shift)
            if not bits[i >> 3] >> (7 - (i & 7)) & 1:
                break
            block = i // RANK_STEP
            inside = bits[block * RANK_STEP // 8:(i >> 3) + 1].tobytes()
            below = int.from_bytes(inside, "big") >> (8 - (i & 7))
            i = int(ranks[block]) + below.bit_count()
        return value

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of a range of positions."""
        last = self.n if last is None else last
        out = np.zeros(last - first, dtype=np.uint32)
        where, low, high = np.arange(last - first), first, last
        for shift, (chunks, bits, ranks) in enumerate(self.levels):
            out[where] |= chunks[low:high].astype(np.uint32) << np.uint32(8 * shift)
            base = low // RANK_STEP * RANK_STEP
            flags = np.unpackbits(bits[base // 8:-(-high // 8)])
            goes_on = flags[low - base:high - base] == 1
            if not goes_on.any():
                break
            low = int(ranks[low // RANK_STEP]) + int(flags[:low - base].sum())
            where = where[goes_on]
            high = low + len(where)
        return out


_SPACE, _LETTER, _PUNCT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[b for b in range(128) if chr(b).isalpha()]] = _LETTER
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = _PUNCT
_CLASS[~arrays.TOKENS.astype(bool)] = _SPACE
_LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def segments(data: np.ndarray, offsets: np.ndarray):
    """Parts that texts fall into without changing their ids: (hash, first byte, last byte + 1, plain).

    A part is a word between white space. A plain word, ASCII letters and then punctuation, is two
    parts, and its letters count in lower case; other words keep their case.
    """
    breaks = np.zeros(len(data) + 1, dtype=bool)
    breaks[offsets] = True
    found, first = [], 0
    while first < len(data):
        last = arrays.chunk_end(arrays.TOKENS, data, first)
        part = data[first:last]
        kind = _CLASS[part]
        inside = kind != _SPACE
        edge = np.append(True, ~inside[:-1] | breaks[first + 1:last])
        begins = np.flatnonzero(inside & edge)
        if len(begins):
            word = np.cumsum(inside & edge) - 1  # of each byte; blanks count to the word before them
            letters = np.add.reduceat((kind == _LETTER).astype(np.int32), begins)
            punct = np.add.reduceat((kind == _PUNCT).astype(np.int32), begins)
            size = np.add.reduceat(inside.astype(np.int32), begins)
            back = np.append(False, (kind[1:] == _LETTER) & (kind[:-1] == _PUNCT)) & ~edge
            turns = np.add.reduceat(back.astype(np.int32), begins)
            plain = (letters + punct == size) & (letters > 0) & (turns == 0) & (kind[begins] == _LETTER)
            two = plain & (punct > 0)
            at = np.sort(np.concatenate([begins, (begins + letters)[two]]))
            owner = word[at]
            ends = np.where(np.isin(at, begins) & two[owner], at + letters[owner],
                            begins[owner] + size[owner])
            folded = np.where(plain[np.maximum(word, 0)], _LOWERED[part], part)
            folded = np.where(inside, folded, 0)
            found.append((arrays.word_hashes(folded, at, ends), at + first, ends + first, plain[owner]))
        first = last
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*found))


class WordEncoder:
    """Encodes texts part by part, remembering parts by their 64-bit hash, see `arrays.word_hashes`.

    Valid for tokenizers that lower case, drop white space, and merge neither across white space nor
    from letters into punctuation, like the word BPE: a text's ids are then those of its parts in
    turn. Texts with a NUL byte, which hashes leave out, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self):
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.starts = self.sizes = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for i in range(0, len(texts), 20_000):
            some = self.tokenizer.encode_batch(texts[i:i + 20_000], add_special_tokens=False)
            out += [coded.ids for coded in some]
        return out

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """Where the hashes are remembered; -1 for unknown ones."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def _learn(self, data: np.ndarray, hashes, first, last, plain):
        raw = data.tobytes()
        texts = [raw[a:b].lower().decode() if p else raw[a:b].decode("utf-8", "replace")
                 for a, b, p in zip(first.tolist(), last.tolist(), plain.tolist())]
        coded = self._encode(texts)
        sizes = np.array([len(c) for c in coded], dtype=np.int64)
        ids = np.fromiter((i for c in coded for i in c), dtype=np.uint32, count=int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes + len(self.ids)
        order = np.argsort(np.concatenate([self.hashes, hashes]), kind="stable")
        self.hashes = np.concatenate([self.hashes, hashes])[order]
        self.starts = np.concatenate([self.starts, starts])[order]
        self.sizes = np.concatenate([self.sizes, sizes])[order]
        self.ids = np.concatenate([self.ids, ids])

    def __call__(self, column: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        data, offsets = arrays.text_bytes(column)
        hashes, first, last, plain = segments(data, offsets)
        distinct, sample, place = np.unique(hashes, return_index=True, return_inverse=True)
        known = self._places(distinct)
        if len(self.hashes) + (known < 0).sum() > CACHE_PARTS:
            self._forget()
            known = self._places(distinct)
        new = sample[known < 0]
        if len(new):
            self._learn(data, hashes[new], first[new], last[new], plain[new])
            known = self._places(distinct)
        at = known[place]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0)
                       + np.repeat(self.starts[at] - (ends - sizes), sizes)].astype("<u4").tobytes()
        bounds = np.append(0, ends)[np.searchsorted(first, offsets)] * 4
        out = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        if (data == 0).any():
            odd = [i for i, t in enumerate(column.to_pylist()) if t and "\0" in t]
            for i, coded in zip(odd, self._encode([column[i].as_py() for i in odd])):
                out[i] = np.array(coded, dtype="<u4").tobytes()
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and tokenizer file."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _store(folder: str, name: str, data: bytes) -> str:
    """Write a file where all executors see it: any folder that Arrow's file systems reach."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    with system.open_output_stream(f"{path}/{name}") as out:
        out.write(data)
    return name


def write(docs: DataFrame, folder: str, make_encoder: Callable[[], Callable], key: str = "doc_id",
          text: str = "text", end_id: int = 1) -> DataFrame:
    """Encode `docs` into segment files in `folder`; returns the manifest, already written.

    The manifest has one row per file: part, segment, name, n_docs, n_ids and start, the ids of all
    files before it.
    """
    from pyarrow import fs

    spark = docs.sparkSession
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(f"{path}/files", recursive=True)

    def encode(batches: Iterable[pa.RecordBatch]):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder, end = make_encoder(), np.array([end_id], dtype="<u4").tobytes()
        keys, coded, size, segment = [], [], 0, 0

        def close():
            starts = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])])
            ids = np.frombuffer(b"".join(coded), dtype="<u4")
            name = _store(f"{folder}/files", f"{part:06d}-{segment:06d}-{uuid.uuid4().hex}.dac",
                          pack(part, segment, keys, starts, ids))
            return pa.RecordBatch.from_pylist([{
                "part": part, "segment": segment, "name": name, "n_docs": len(keys),
                "n_ids": len(ids)}], schema=_MANIFEST)

        for piece in arrays.slices(batches, "text"):
            for k, ids in zip(piece.column("key").to_pylist(), coder(piece.column("text"))):
                keys.append(k)
                coded.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= SEGMENT_IDS:
                    yield close()
                    keys, coded, size, segment = [], [], 0, segment + 1
        if keys:
            yield close()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"),
                       F.xxhash64(text).alias("mark"))
    rows = rows.repartitionByRange("key", "mark").sortWithinPartitions("key", "mark")
    files = staged(rows.select("key", "text").mapInArrow(
        encode, "part int, segment int, name string, n_docs long, n_ids long"), "segments")
    before = (Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0))
        .alias("base"))
    inside = F.coalesce(F.sum("n_ids").over(
        Window.partitionBy("part").orderBy("segment").rowsBetween(*before)), F.lit(0))
    manifest = files.withColumn("inside", inside).join(parts, "part").select(
        "part", "segment", "name", "n_docs", "n_ids",
        (F.col("base") + F.col("inside")).cast("long").alias("start"))
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


_MANIFEST = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("name", pa.string()),
                       ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read(spark: SparkSession, folder: str, values: bool = True) -> DataFrame:
    """Documents of the files in `folder`: key, start, n_tokens, ids_crc32 and, if asked, ids."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    fields = [("part", pa.int32()), ("segment", pa.int32()), ("key", pa.int64()),
              ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    if values:
        fields.append(("ids", pa.list_(pa.int64())))
    schema = ("part int, segment int, key long, local long, n_tokens long, ids_crc32 long"
              + (", ids array<long>" if values else ""))

    def decode(batches):
        for batch in batches:
            for content in batch.column("content"):
                found = Segment(content.as_buffer())
                ids, starts = found.ids(), found.starts
                spans = [ids[a:b] for a, b in zip(starts[:-1], starts[1:])]
                n = len(spans)
                columns = [pa.array([found.part] * n, pa.int32()),
                           pa.array([found.segment] * n, pa.int32()),
                           pa.array(found.keys, pa.int64()), pa.array(starts[:-1]),
                           pa.array(np.diff(starts)),
                           pa.array([zlib.crc32(s.astype("<u4")) for s in spans], pa.int64())]
                if values:
                    columns.append(pa.array([s.astype(np.int64) for s in spans], fields[-1][1]))
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    named = manifest.select("name").withColumn("counts", F.lit(True))
    files = spark.read.format("binaryFile").load(f"{folder}/files").select(
        "content", F.element_at(F.split("path", "/"), -1).alias("name"))
    files = files.join(named, "name", "left_semi").select("content")
    docs = files.mapInArrow(decode, schema)
    out = docs.join(manifest.select("part", "segment", "start"), ["part", "segment"])
    return out.select("key", (F.col("start") + F.col("local")).alias("start"), "n_tokens",
                      "ids_crc32", *(["ids"] if values else []))


def digest(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "dac")
    write(docs, folder, lambda: encoder(tokenizer), end_id=end_id)
    return read(spark, folder, values=False).withColumnRenamed("key", "doc_id")

"""Arrow text columns as numpy arrays: bounded slices, word tables and n-gram hashes.

Everything works on whole texts. Temporaries are bounded by `SLICE_BYTES` and `CHUNK_BYTES`, except
that one text is never split between slices and one word never between chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
CHUNK_BYTES = 1 << 19

STEP = 0x9E3779B97F4A7C15


def fold_table(kept: bytes, lower: bool) -> np.ndarray:
    """256 entries: 0 where a byte separates words, else the byte itself, A-Z lowered if asked."""
    table = np.zeros(256, dtype=np.uint8)
    for byte in kept:
        table[byte] = ord(chr(byte).lower()) if lower and byte < 128 else byte
    return table


#: Lower-cased letters and digits; every byte of a non-ASCII character belongs to a word.
WORDS = fold_table(bytes(b for b in range(256) if b > 127 or chr(b).isalnum()), lower=True)
#: Whatever stands between ASCII white space (and NUL), case and punctuation kept.
TOKENS = fold_table(bytes(b for b in range(1, 256) if b not in b" \t\n\v\f\r"), lower=False)


def slices(batches, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of a slice hold at most `most` bytes, or are one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False)
        ends = np.cumsum(lengths, dtype=np.int64)
        first, n = 0, batch.num_rows
        while first < n:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(first, last - first)
            first = last


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and their n + 1 offsets; a null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    whole = np.frombuffer(data, dtype=np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(values: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def chunk_end(fold: np.ndarray, data: np.ndarray, first: int) -> int:
    """Where a chunk that begins at `first` may end without cutting a word."""
    end = first + CHUNK_BYTES
    if end >= len(data):
        return len(data)
    gaps = np.flatnonzero(fold[data[first:end]] == 0)
    if len(gaps):
        return first + int(gaps[-1]) + 1
    while end < len(data) and fold[data[end]]:
        end += 1
    return end


#: MASKS[n] keeps the first n bytes of a little-endian 64-bit block.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def word_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words folded[start:end], none of whose bytes is 0.

    Words up to 8 bytes never share one. A longer word's blocks of 8 are mixed each with its place before
    they are added, so no regular pattern of bytes cancels out: two of n long words collide with
    probability n * n / 2**65.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    padded = np.concatenate([folded, np.zeros(8, dtype=np.uint8)])
    at_byte = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(folded) + 1,), (1,))
    sizes = ends - starts
    step = np.uint64(STEP)
    with np.errstate(over="ignore"):
        sums = mix((at_byte[starts] & MASKS[np.minimum(sizes, 8)]) + step)
        long = np.flatnonzero(sizes > 8)
        if len(long):
            blocks = (sizes[long] - 1) >> 3  # besides the first
            before = np.cumsum(blocks) - blocks
            place = np.arange(int(blocks.sum())) - np.repeat(before, blocks) + 1
            first = np.repeat(starts[long], blocks) + 8 * place
            rest = np.minimum(np.repeat(ends[long], blocks) - first, 8)
            parts = mix((at_byte[first] & MASKS[rest]) + step * (place + 1).astype(np.uint64))
            sums[long] += np.add.reduceat(parts, before)
    return mix(sums)


class WordTable:
    """Words of a slice: 64-bit hashes, byte spans and each row's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: np.ndarray):
        breaks = np.zeros(len(data) + 1, dtype=bool)
        breaks[offsets] = True
        hashes, starts, ends = [], [], []
        first = 0
        while first < len(data):
            last = chunk_end(fold, data, first)
            bytes_ = fold[data[first:last]]
            inside = bytes_ != 0
            begins = inside.copy()
            begins[1:] &= ~inside[:-1] | breaks[first + 1:last]
            at = np.flatnonzero(begins)
            if len(at):
                stops = inside.copy()
                stops[:-1] &= ~inside[1:] | breaks[first + 1:last]
                over = np.flatnonzero(stops) + 1
                hashes.append(word_hashes(bytes_, at, over))
                starts.append(at + first)
                ends.append(over + first)
            first = last
        none = np.zeros(0, dtype=np.int64)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        self.starts = np.concatenate(starts) if starts else none
        self.ends = np.concatenate(ends) if ends else none
        self.rows = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.rows)

    def grams(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all k consecutive words of a row: (hash, first word, row)."""
        n = len(self.hashes)
        if n < k:
            none = np.zeros(0, dtype=np.int64)
            return np.zeros(0, dtype=np.uint64), none, none
        row = np.repeat(np.arange(len(self.counts)), self.counts)
        first = np.flatnonzero(np.arange(n - k + 1) + k <= self.rows[1:][row[:n - k + 1]])
        with np.errstate(over="ignore"):
            total = np.full(len(first), np.uint64(mix(np.array([seed + k], dtype=np.uint64))[0]))
            for j in range(k):
                total = total * np.uint64(STEP) + self.hashes[first + j]
        return mix(total), first, row[first]


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark's longs."""
    return values.view(np.int64)

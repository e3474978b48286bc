"""Integer arrays as compressed bytes for tables and shuffles."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

HEADER = struct.Struct("<qb")


def pack(values: np.ndarray) -> bytes:
    """The values' 64-bit forms byte by byte of significance, zstd over the bytes that some value uses."""
    values = np.ascontiguousarray(values)
    if values.dtype != np.uint64:
        values = values.astype(np.int64)
    planes = values.view(np.uint8).reshape(-1, 8).T
    top = int(np.bitwise_or.reduce(values.view(np.uint64))) if len(values) else 0
    width = -(-top.bit_length() // 8)
    body = pa.compress(planes[:width].tobytes(), codec="zstd", asbytes=True) if width else b""
    return HEADER.pack(len(values), width) + body


def unpack(blob: bytes) -> np.ndarray:
    """The packed values as 64-bit integers."""
    size, width = HEADER.unpack_from(blob)
    planes = np.zeros((8, size), dtype=np.uint8)
    if width:
        body = pa.decompress(blob[HEADER.size:], decompressed_size=size * width, codec="zstd", asbytes=True)
        planes[:width] = np.frombuffer(body, dtype=np.uint8).reshape(width, size)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.int64)

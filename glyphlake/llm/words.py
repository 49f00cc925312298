"""Words of texts as 64-bit hashes, whole batches at a time in numpy; bitmaps that travel to the tasks."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix

#: Words are runs of anything but ASCII white space, with A-Z lower-cased.
_SPACE = bytes(x in (9, 10, 11, 12, 13, 32) for x in range(256))
_LOWER = bytes(x + 32 * (65 <= x <= 90) for x in range(256))
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_ODD = np.uint64(0x9FB21C651E98DF25)
#: Words of more bytes are hashed one by one.
_WIDE = 64


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a byte string, in order, and where each starts."""
    low = data.translate(_LOWER) + b" \0\0\0\0\0\0\0\0"
    space = np.frombuffer((data + b" ").translate(_SPACE), np.uint8)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
    h = mix((eight[start] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _ODD)
    more = np.flatnonzero(size > 8)
    at = 8
    while len(more) and at < _WIDE:
        h[more] = mix(h[more] + (eight[start[more] + at] & _MASK[np.minimum(size[more] - at, 8)]) * _ODD)
        at += 8
        more = more[size[more] > at]
    for i in more.tolist():
        h[i] = int.from_bytes(blake2b(low[start[i] : start[i] + size[i]], digest_size=8).digest(), "little")
    return h, start


def bitmap_of(df: DataFrame, key: Column, bits: int) -> bytes:
    """A bitmap of `bits` bits (a multiple of 32768) with the bit pmod(key, bits) of every row set."""
    slots = df.select((F.pmod(key, F.lit(bits)) + 1).alias("s")).select("s", F.bitmap_bucket_number("s").alias("b"))
    if slots.count() < bits:  # few: the slots travel, beyond that every task's bitmap
        slots = slots.repartition("b")
    out = np.zeros(bits // 8, np.uint8)
    for r in slots.groupBy("b").agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).toLocalIterator():
        out[(r.b - 1) * 4096 : r.b * 4096] |= np.frombuffer(r.m, np.uint8)
    return out.tobytes()


def in_bitmap(bitmap: bytes, keys: np.ndarray) -> np.ndarray:
    """Which keys (signed 64-bit) the bitmap may have."""
    bits = np.frombuffer(bitmap, np.uint8)
    slot = keys.astype(np.int64) % (8 * len(bits))
    return ((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)


def dealt(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The order that sorts rows by part, and the span of each part in it."""
    order = np.argsort(part, kind="stable")
    sorted_ = part[order]
    cut = [0, *(np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1).tolist(), len(part)]
    return order, [(a, b) for a, b in zip(cut, cut[1:], strict=False) if b > a]


def packed(rows: np.ndarray) -> bytes:
    """The rows of a structured array, first bytes first: alike bytes lie side by side and compress."""
    return np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), rows.dtype.itemsize).T.tobytes()


def unpacked(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    out = np.empty(sum(map(len, blobs)) // kind.itemsize, kind)
    at = 0
    for b in blobs:
        n = len(b) // kind.itemsize
        out[at : at + n].view(np.uint8).reshape(n, kind.itemsize)[:] = np.frombuffer(b, np.uint8).reshape(kind.itemsize, n).T
        at += n
    return out


def blobs_of(table: pa.Table, name: str) -> Iterator[bytes]:
    for chunk in table.column(name).chunks:
        for x in chunk:
            yield x.as_py()

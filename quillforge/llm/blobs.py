"""Column blocks in binary cells, and the exchange of them between groups and hash buckets.

A row per window would cost more in row headers than in content.  Instead a task sends each bucket one
compressed block of NumPy columns.  Blocks hold bounded numbers of entries and are dealt by key like any row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from .common import unsigned

#: Text bytes behind a hash bucket of an exchange, which one task holds at a time: two groups' worth, and more once there
#: are MANY_BUCKETS, so that what a group sends to a bucket does not become less than its row's header.
BUCKET_TEXT, MANY_BUCKETS = 512 << 20, 32_768
_CODEC = pa.Codec("zstd", compression_level=1)


def pack(columns: Sequence[np.ndarray], delta: bool = False) -> bytes:
    """Columns of one length; with delta the first is sorted and stored as differences."""
    n = len(columns[0])
    parts = []
    for k, col in enumerate(columns):
        if k == 0 and delta and n:
            col = np.diff(col, prepend=col.dtype.type(0))
        parts.append(np.ascontiguousarray(col).view(np.uint8).reshape(n, col.dtype.itemsize).T.tobytes())
    raw = b"".join(parts)
    return n.to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpack(blob: bytes, dtypes: Sequence[str], delta: bool = False) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    sizes = [np.dtype(d).itemsize for d in dtypes]
    raw = np.frombuffer(_CODEC.decompress(blob[8:], decompressed_size=n * sum(sizes)), dtype=np.uint8)
    out, at = [], 0
    for k, (d, size) in enumerate(zip(dtypes, sizes, strict=True)):
        col = np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(d).reshape(n)
        if k == 0 and delta:
            col = np.cumsum(col, dtype=col.dtype)
        out.append(col)
        at += n * size
    return out


def unpack_all(blobs: Sequence[bytes], dtypes: Sequence[str], delta: bool = False) -> list[np.ndarray]:
    each = [unpack(b, dtypes, delta) for b in blobs]
    if not each:
        return [np.zeros(0, d) for d in dtypes]
    return [np.concatenate(cols) for cols in zip(*each, strict=True)]


def bucket_count(groups: int, total: int) -> int:
    """Buckets for so many groups and bytes of text."""
    return max(8, min(groups // 2, MANY_BUCKETS), total // BUCKET_TEXT)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the top 32 bits, so that buckets are hash ranges."""
    return ((unsigned(hashes) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def by_key(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct key with the rows that have it."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    cuts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    for i, j in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
        yield int(ordered[i]), order[i:j]


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the row before it in any of the columns."""
    n = len(columns[0])
    head = np.ones(n, dtype=bool)
    if n > 1:
        head[1:] = False
        for c in columns:
            head[1:] |= c[1:] != c[:-1]
    return head


def cells(table: pa.Table, name: str) -> list[bytes]:
    return [x for x in table.column(name).to_pylist() if x is not None]

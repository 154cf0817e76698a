"""Sketches of hashes that are merged by shard, and what a shard tells those that sent them.

A group of texts sends, for each shard of the cell space, the sorted list of the cells that its hashes touch.  The merged
shard answers each group with one bit per cell it sent: is the cell's count two or more?  No sketch is ever broadcast or
held whole, and the number of cells follows the number of hashes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .blobs import bucket_of, by_key, pack, starts_of, unpack

#: Cells of a shard: the least, and beyond MANY_SHARDS shards up to the most (a byte each in one task).
SHARD_CELLS, MANY_SHARDS, MOST_SHARD_CELLS = 1 << 23, 4096, 1 << 28
#: Bits of a slot in a group's table of counted cells.
SLOT_BITS = 24


class Shards(NamedTuple):
    """How many shards the cell space has, and how many cells each."""

    count: int
    cells: int

    @classmethod
    def of(cls, cells: int) -> Shards:
        size = min(MOST_SHARD_CELLS, max(SHARD_CELLS, cells // MANY_SHARDS))
        return cls(max(1, -(-cells // size)), size)


def cell_keys(hashes: np.ndarray, shards: Shards) -> np.ndarray:
    """shard << 32 | cell."""
    cell = (hashes & np.uint64(0xFFFFFFFF)) * np.uint64(shards.cells) >> np.uint64(32)
    return (bucket_of(hashes, shards.count).astype(np.uint64) << np.uint64(32)) | cell


def touched(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and which of them are touched more than once."""
    keys = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    at = np.flatnonzero(starts_of(keys))
    return keys[at], np.diff(np.append(at, len(keys))) > 1


def _by_shard(keys: np.ndarray):
    return by_key((keys >> np.uint64(32)).astype(np.int64))


def sketch_table(g: int, rows: dict[int, tuple[np.ndarray, np.ndarray]], shards: Shards) -> pa.Table:
    """(shard, g, cells) of the touched keys of each numbered sketch."""
    out = []
    for row, (keys, twice) in rows.items():
        for s, at in _by_shard(keys):
            out.append((row * shards.count + s, g, pack([(keys[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32), twice[at]], True)))
    cols = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.table({"shard": pa.array(cols[0], pa.int32()), "g": pa.array(cols[1], pa.int32()), "cells": pa.array(cols[2], pa.binary())})


def merged(shards: Shards):
    """Adds up one shard's sketches and answers each with a bit per cell."""

    def run(part: pa.Table) -> pa.Table:
        sketches = part.column("cells").to_pylist()
        counts = np.zeros(shards.cells, dtype=np.uint8)
        for blob in sketches:
            at, twice = unpack(blob, ("<u4", "?"), True)
            counts[at] = np.minimum(counts[at] + 1 + twice, 2)
        bits = [np.packbits(counts[unpack(blob, ("<u4", "?"), True)[0]] >= 2).tobytes() for blob in sketches]
        return pa.table({"g": part.column("g"), "shard": part.column("shard"), "bits": pa.array(bits, pa.binary())})

    return run


def counted_twice(answers: pa.Table, row: int, keys: np.ndarray, shards: Shards) -> np.ndarray:
    """Of a numbered sketch's distinct keys, those that the merged sketch counts twice or more."""
    answer = dict(zip(answers.column("shard").to_pylist(), answers.column("bits").to_pylist(), strict=True))
    hot = np.zeros(len(keys), dtype=bool)
    for s, at in _by_shard(keys):
        hot[at] = np.unpackbits(np.frombuffer(answer[row * shards.count + s], np.uint8), count=len(at)).astype(bool)
    return keys[hot]


class Slots:
    """A set of keys that may hold more than it was given, and never less."""

    def __init__(self, keys: np.ndarray) -> None:
        self.table = np.zeros(1 << SLOT_BITS, dtype=bool)
        self.table[self._slot(keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        return self.table[self._slot(keys)]

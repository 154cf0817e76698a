"""Edit distances and alignments.

Distances of whole texts are bit-parallel (Myers, in Hyyro's form): a column of the table is one integer, so a text of
n words takes n steps of n bits.  Alignments keep every BLOCK-th column and make the others again on the way back.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Columns between two that an alignment keeps.
BLOCK = 256
_COUNTS = StructType([StructField(c, IntegerType()) for c in ("hits", "substitutions", "deletions", "insertions")])
_BLOCKS = ArrayType(StructType([StructField(c, StringType()) for c in ("op", "ref", "hyp")]))


def _masks(ref: Sequence) -> dict:
    out: dict = {}
    for i, x in enumerate(ref):
        out.setdefault(x, []).append(i)
    mask = bytearray((len(ref) + 7) // 8)
    for x, at in out.items():
        for i in at:
            mask[i >> 3] |= 1 << (i & 7)
        out[x] = int.from_bytes(mask, "little")
        for i in at:
            mask[i >> 3] = 0
    return out


def _column(eq: int, pv: int, mv: int, full: int) -> tuple[int, int, int, int, int]:
    """Next pv and mv (vertical steps of +1 and -1), equal diagonals, and horizontal steps of +1 and -1."""
    d0 = ((((eq & pv) + pv) ^ pv) | eq | mv) & full
    ph, mh = mv | (full & ~(d0 | pv)), pv & d0
    up, down = ((ph << 1) | 1) & full, (mh << 1) & full
    return down | (full & ~(d0 | up)), up & d0, d0, ph, mh


def distance(ref: Sequence, hyp: Sequence) -> int:
    """Levenshtein distance with unit costs, of any length."""
    if not len(ref):
        return len(hyp)
    masks, full, last = _masks(ref), (1 << len(ref)) - 1, len(ref) - 1
    pv, mv, out = full, 0, len(ref)
    for x in hyp:
        pv, mv, _, ph, mh = _column(masks.get(x, 0), pv, mv, full)
        out += (ph >> last) - (mh >> last)
    return out


@F.arrow_udf(IntegerType())
def word_distance(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Levenshtein distance of two word arrays with unit costs."""
    return pa.array([None if not (r.is_valid and h.is_valid) else distance(r.as_py(), h.as_py()) for r, h in zip(ref, hyp, strict=True)], pa.int32())


@F.arrow_udf(IntegerType())
def _text_distance(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    return pa.array([None if not (r.is_valid and h.is_valid) else distance(r.as_py(), h.as_py()) for r, h in zip(ref, hyp, strict=True)], pa.int32())


def char_distance(ref: Column, hyp: Column) -> Column:
    """Distance of the words' characters, without spaces."""
    return _text_distance(F.array_join(ref, ""), F.array_join(hyp, ""))


def pairwise_cer(a: Column, b: Column) -> Column:
    """Of normalised texts: both empty 0, one empty 1, else edits over a's length; directional, may exceed 1."""
    return F.when((a == "") & (b == ""), 0.0).when((a == "") | (b == ""), 1.0).otherwise(F.levenshtein(a, b) / F.length(a))


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two arrays."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    return F.slice(a, 1, F.when(first > 0, (first - 1).cast("int")).otherwise(n))


def _operations(ref: Sequence, hyp: Sequence) -> tuple[int, int, int, int]:
    """Hits, substitutions, deletions and insertions of one best alignment."""
    masks, full = _masks(ref), (1 << len(ref)) - 1
    kept, state = [], (full, 0)
    for j, x in enumerate(hyp):
        if j % BLOCK == 0:
            kept.append(state)
        state = _column(masks.get(x, 0), *state, full)[:2]
    out, i, j = [0, 0, 0, 0], len(ref), len(hyp)
    while i and j:
        start = (j - 1) // BLOCK * BLOCK
        state, columns = kept[start // BLOCK], []
        for x in hyp[start:j]:
            pv, mv, d0, _, _ = _column(masks.get(x, 0), *state, full)
            state = pv, mv
            columns.append((pv, d0))
        while i and j > start:
            pv, d0 = columns[j - 1 - start]
            if ref[i - 1] == hyp[j - 1] or not d0 >> (i - 1) & 1:
                out[ref[i - 1] != hyp[j - 1]] += 1
                i, j = i - 1, j - 1
            elif pv >> (i - 1) & 1:
                out[2] += 1
                i -= 1
            else:
                out[3] += 1
                j -= 1
    return out[0], out[1], out[2] + i, out[3] + j


@F.arrow_udf(_COUNTS)
def operations(refs: pa.Array, hyps: pa.Array) -> pa.Array:
    """Decomposition of the word distance; the split among equal alignments prefers substitutions."""
    rows = [_operations(r.as_py() or [], h.as_py() or []) for r, h in zip(refs, hyps, strict=True)]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int32()) for k in range(4)], names=list(_COUNTS.fieldNames()))


def _longest(ref: Sequence, places: dict, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, list[tuple[int, int]]]:
    """Length of the longest equal runs within the ranges, and where all of them start, in order."""
    best, hits, ending = 0, [], {}
    for i in range(alo, ahi):
        at = places.get(ref[i])
        now = {}
        if at is not None:
            for j in at[bisect_left(at, blo) : bisect_left(at, bhi)] if at[0] < blo or at[-1] >= bhi else at:
                n = now[j] = ending.get(j - 1, 0) + 1
                if n > best:
                    best, hits = n, [(i - n + 1, j - n + 1)]
                elif n == best:
                    hits.append((i - n + 1, j - n + 1))
        ending = now
    return best, hits


def matching_blocks(ref: Sequence, hyp: Sequence) -> list[tuple[int, int, int]]:
    """Equal runs (place, place, length): the longest first, of equals the first, and the same left and right of it.

    All runs of the greatest length that follow one another are taken at once, so a range is searched once for each
    length and not for each run.
    """
    places: dict = {}
    for j, x in enumerate(hyp):
        places.setdefault(x, []).append(j)
    todo, out = [(0, len(ref), 0, len(hyp))], []
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        if alo == ahi or blo == bhi:
            continue
        n, hits = _longest(ref, places, alo, ahi, blo, bhi)
        if not n:
            continue
        for i, j in hits:
            if i >= alo and j >= blo:
                out.append((i, j, n))
                todo.append((alo, i, blo, j))
                alo, blo = i + n, j + n
        todo.append((alo, ahi, blo, bhi))
    return sorted(out)


def opcodes(ref: Sequence, hyp: Sequence) -> list[tuple[str, int, int, int, int]]:
    """equal, replace, delete and insert ranges of both, by matching blocks."""
    out, i, j = [], 0, 0
    for a, b, n in [*matching_blocks(ref, hyp), (len(ref), len(hyp), 0)]:
        if a > i or b > j:
            out.append(("replace" if a > i and b > j else "delete" if a > i else "insert", i, a, j, b))
        i, j = a + n, b + n
        if n:
            if out and out[-1][0] == "equal" and out[-1][2] == a and out[-1][4] == b:
                out[-1] = ("equal", out[-1][1], i, out[-1][3], j)
            else:
                out.append(("equal", a, i, b, j))
    return out


@F.pandas_udf(_BLOCKS)
def aligned_blocks(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Word pairs that differ, by matching blocks; replaced blocks are zipped, the rest is deleted or inserted."""
    for refs, hyps in batches:
        out = []
        for r, h in zip(refs, hyps, strict=True):
            r, h, rows = list(r), list(h), []
            for op, a, b, c, d in opcodes(r, h):
                if op != "equal":
                    both = min(b - a, d - c) if op == "replace" else 0
                    rows += [{"op": "replace", "ref": r[a + k], "hyp": h[c + k]} for k in range(both)]
                    rows += [{"op": "delete", "ref": x, "hyp": None} for x in r[a + both : b]]
                    rows += [{"op": "insert", "ref": None, "hyp": x} for x in h[c + both : d]]
            out.append(rows)
        yield pd.Series(out)

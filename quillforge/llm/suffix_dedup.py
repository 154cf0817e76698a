"""Suffix-array deduplication: repeated byte strings of at least DEPTH bytes are removed, the first one stays.

Depth-limited radix sort, most significant digits first.  Suffixes are told apart only through their first DEPTH bytes,
by passes over ever longer prefixes; after each pass a suffix that shares its prefix with no other leaves, and after the
last one the equal groups are exactly the repeated windows.

* Neighbouring suffixes travel together, led by the suffix that starts with a word: what it shares with others, they
  share, and where it stands alone so do all windows that contain its prefix.  A pass over every single byte's suffix
  would exchange more than the texts.
* The first passes (PASSES) go through the first 32 and 80 bytes.  A group of texts sends the cells of its prefixes'
  hashes by shard, and each shard answers which of them are touched twice (see sketch): no prefix that occurs twice is
  lost, and what is kept by chance leaves in the last pass.  Windows without such a prefix (words of over 68 bytes) are
  left to the last pass.
* The last pass sorts what is left through all DEPTH bytes, by the digests of the bytes that neighbours share, from coarse
  to fine:

1. a suffix's anchor: the DIGIT bytes with the least hash in its first DEPTH bytes.  Equal windows have equal anchors,
   and about 35 neighbouring suffixes have the same one; they travel as one run.  Runs whose anchor is alone leave.
2. the run's whole extent.  Runs with equal extents are equal suffix by suffix: all but the first are repeats.
   Where an anchor has one extent only, its first run is decided too.
3. where extents differ, for the first run of each extent: the core of each part of a run (STEP neighbouring
   suffixes, placed by their distance from the anchor), which is the bytes that all of them start with, and again the
   part's extent.  Parts whose core is alone leave, and equal extents are decided.
4. where they differ still, the suffix itself, through all DEPTH bytes.

Each pass is an exchange by hash range of column blocks (see blobs), pre-combined per task: of equal extents a
task sends the first only, so neither thousands of copies nor a very frequent passage make a bucket hot.  Texts
are exchanged once (see packed).  Digests are 128 bits together.

Positions count UTF-8 bytes; matches never cross documents; overlapping repeats (also in one document) count.  A
null text is empty and stays empty.  A null id sorts after all ids.  doc_id is a key: rows that repeat an id
share one rank, and all lose what any of them loses, cut to their length.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .blobs import bucket_count, bucket_of, by_key, cells, pack, starts_of, unpack_all
from .common import BLOCK_BYTES, NULL_ID, SPACE, Rolling, blocks, bounded_batches, byte_codes, cut_lineage, group_count, group_of, merge_runs, mix, part_count, passed, ragged, table, text_bytes
from .packed import Texts, packed_by_group
from .sketch import Shards, Slots, cell_keys, counted_twice, merged, sketch_table, touched

DEPTH = 100
DIGIT = 32
STEP = 8
#: Percents of the depth that the first passes go through, and cells of their sketches per leading suffix.
PASSES = (32, 80)
CELLS = 2
#: Runs that a task gathers before it sends them: about those of a group of the least size.
FLUSH_RUNS = 250_000
_RUN = ("<u8", "<u8", "<i8", "<i4", "<u4")  # digit, extent, id, start, suffixes and (from bit 16) how far the anchor is
_OPEN = ("<i8", "<i4", "<u4")
_AT = ("<i8", "<i4", "<u2")  # id, start, suffixes
_SUFFIX = ("<u8", "<u8", "<i8", "<i4")  # two digests, id, start


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def _parts(data: np.ndarray, offsets: np.ndarray, depth: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of whole texts, and of an outsized text by parts, which share depth - 1 bytes: first text, place, bytes, and the
    texts' places in them."""
    for i, j in blocks(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= BLOCK_BYTES:
            yield i, lo, data[lo:hi], offsets[i : j + 1] - lo
        else:
            for at in range(lo, hi - depth + 1, BLOCK_BYTES - depth + 1):
                stop = min(hi, at + BLOCK_BYTES)
                yield i, at, data[at:stop], np.array([0, stop - at])


class Prefixes:
    """The leading suffixes of a block: those that start with a word, but not with their text, as the byte before tells."""

    def __init__(self, block: np.ndarray, places: np.ndarray) -> None:
        body = ~SPACE[block]
        at = np.flatnonzero(body[1:] & ~body[:-1]) + 1
        text = np.searchsorted(places, at, side="right") - 1
        inner = at > places[text]
        self.at, self.stop = at[inner], places[text[inner] + 1]
        self.hashes = Rolling(byte_codes(block, 0), 0) if len(self.at) else None

    def keys(self, length: int, shards: Shards) -> np.ndarray:
        """Keeps the suffixes that are so long, and gives the cells of their prefixes."""
        fit = self.at + length <= self.stop
        self.at, self.stop = self.at[fit], self.stop[fit]
        return cell_keys(self.hashes.of(self.at, self.at + length), shards) if len(self.at) else np.zeros(0, np.uint64)

    def keep(self, alive: np.ndarray) -> np.ndarray:
        """Keeps some, and gives the places of the others."""
        gone = self.at[~alive]
        self.at, self.stop = self.at[alive], self.stop[alive]
        return gone


def _first_passes(texts: Texts, depth: int, lengths: Sequence[int], shards: Shards, known: Sequence[Slots]) -> list[np.ndarray]:
    """Keys of the pass after the known ones, block by block."""
    out = []
    for _, _, block, places in _parts(texts.data, texts.offsets, depth):
        p = Prefixes(block, places)
        for length, slots in zip(lengths, known, strict=False):
            p.keep(slots.may_have(p.keys(length, shards)))
        out.append(p.keys(lengths[len(known)], shards))
    return out


def _known(texts: Texts, answers: pa.Table, depth: int, lengths: Sequence[int], shards: Shards) -> list[Slots]:
    """Of each pass that is answered, the cells that are touched twice."""
    rows = {s // shards.count for s in answers.column("shard").to_pylist()}
    known: list[Slots] = []
    while len(known) in rows:
        keys, _ = touched(_first_passes(texts, depth, lengths, shards, known))
        known.append(Slots(counted_twice(answers, len(known), keys, shards)))
    return known


def _send_first(depth: int, lengths: Sequence[int], shards: Shards):
    def run(part: pa.Table) -> pa.Table:
        return sketch_table(part.column("g")[0].as_py(), {0: touched(_first_passes(Texts(part), depth, lengths, shards, []))}, shards)

    return run


def _send_next(depth: int, lengths: Sequence[int], shards: Shards, row: int):
    def run(part: pa.Table, answers: pa.Table) -> pa.Table:
        texts = Texts(part)
        known = _known(texts, answers, depth, lengths, shards)
        if len(known) < row:  # nothing was sent before, so nothing is left
            return sketch_table(0, {}, shards)
        return sketch_table(part.column("g")[0].as_py(), {row: touched(_first_passes(texts, depth, lengths, shards, known))}, shards)

    return run


def _live(block: np.ndarray, places: np.ndarray, depth: int, lengths: Sequence[int], shards: Shards, known: Sequence[Slots]) -> np.ndarray:
    """Whether the window at each place has no prefix of a word that is alone."""
    p = Prefixes(block, places)
    change = np.zeros(len(block) + 1, dtype=np.int64)
    for length, slots in zip(lengths, known, strict=False):
        gone = p.keep(slots.may_have(p.keys(length, shards)))
        # windows that contain it start after its end less the depth, and before it
        change += np.bincount(np.maximum(gone + length - depth, 0), minlength=len(change)) - np.bincount(gone, minlength=len(change))
    return np.cumsum(change[:-1]) == 0


def _block_runs(data: np.ndarray, offsets: np.ndarray, depth: int, digit: int, live: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a block's live windows: text index, start in the block, number of suffixes, anchor digest and extent digest of each
    run."""
    n = len(data)
    if n < depth:
        return tuple(np.zeros(0, d) for d in ("<i8", "<i8", "<i8", "<u8", "<u8"))
    # a window must end before its text does
    valid = np.zeros(n - depth + 2, dtype=np.int32)
    first, last = offsets[:-1], offsets[1:] - depth + 1
    ok = last > first
    np.add.at(valid, first[ok], 1)
    np.add.at(valid, last[ok], -1)
    at = np.flatnonzero((np.cumsum(valid[:-1]) > 0) & live[: len(valid) - 1])
    if not len(at):
        return tuple(np.zeros(0, d) for d in ("<i8", "<i8", "<i8", "<u8", "<u8"))
    grams = Rolling(byte_codes(data, 0), 0).sliding(digit)
    place = np.arange(len(grams), dtype=np.uint64)
    least = _sliding_min((grams & np.uint64(0xFFFFFFFFFF000000)) | place, depth - digit + 1)
    anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.searchsorted(offsets, at, side="right") - 1
    head = np.flatnonzero(starts_of(anchor[at], text, at - np.arange(len(at))))
    start, count = at[head], np.diff(np.append(head, len(at)))
    extent = Rolling(byte_codes(data, 1), 1).of(start, start + count + depth - 1)
    # an anchor is a least hash: mixed anew, digits spread over all buckets
    return text[head], start, count + ((anchor[start] - start) << 16), mix(grams[anchor[start]] + np.uint64(1)), extent


def anchored_runs(texts: Texts, depth: int, digit: int, lengths: Sequence[int], shards: Shards, known: Sequence[Slots]) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of all live windows: text index, start in the text, suffixes, anchor, extent."""
    for i, lo, block, places in _parts(texts.data, texts.offsets, depth):
        t, s, c, a, e = _block_runs(block, places, depth, digit, _live(block, places, depth, lengths, shards, known))
        yield t + i, s + lo - texts.offsets[t + i], c, a, e


def _send(bucket: np.ndarray, columns: list[np.ndarray], delta: bool) -> Iterator[tuple[int, bytes]]:
    for b, rows in by_key(bucket):
        if delta:
            rows = rows[np.argsort(columns[0][rows], kind="stable")]
        yield b, pack([c[rows] for c in columns], delta)


def _combine(keys: Sequence[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of keys, then place, each place once; and where in that order each distinct key begins."""
    order = np.lexsort((start, doc, *reversed(keys)))
    order = order[starts_of(*[k[order] for k in keys], doc[order], start[order])]
    return order, starts_of(*[k[order] for k in keys])


_SKETCH_SCHEMA, _ANSWER_SCHEMA = "shard int, g int, cells binary", "g int, shard int, bits binary"
_RUNS_SCHEMA = "bucket int, runs binary, gone binary"
_PART_SCHEMA = "g int, gone binary, open binary"
_SUFFIX_SCHEMA = "bucket int, suffixes binary, gone binary"


def _rows(schema: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "g": pa.int32()}
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.binary())) for n, c in zip(schema, cols, strict=True)], names=schema)


def _find_runs(depth: int, digit: int, lengths: Sequence[int], shards: Shards, buckets: int):
    def flush(gathered: list[list[np.ndarray]]) -> pa.RecordBatch:
        anchor, extent, doc, start, count = (np.concatenate(c) for c in zip(*gathered, strict=True))
        order, head = _combine((anchor, extent), doc, start)
        first, rest = order[head], order[~head]
        runs = dict(_send(bucket_of(anchor[first], buckets), [c[first] for c in (anchor, extent, doc, start, count)], True))
        short = (count & 0xFFFF).astype(np.uint16)
        gone = dict(_send(bucket_of(anchor[rest], buckets), [c[rest] for c in (doc, start, short)], False))
        return _rows(["bucket", "runs", "gone"], [(b, runs.get(b), gone.get(b)) for b in sorted(runs.keys() | gone.keys())])

    def run(part: pa.Table, answers: pa.Table) -> pa.Table:
        texts = Texts(part)
        known = _known(texts, answers, depth, lengths, shards)
        out, gathered, held = [], [], 0
        for text, start, count, anchor, extent in anchored_runs(texts, depth, digit, lengths, shards, known):
            gathered.append([anchor, extent, texts.ids[text], start.astype(np.int32), count.astype(np.uint32)])
            held += len(text)
            if held >= FLUSH_RUNS:
                out.append(flush(gathered))
                gathered, held = [], 0
        return pa.Table.from_batches([*out, flush(gathered)] if held else out or [_rows(["bucket", "runs", "gone"], [])])

    return run


def _to_groups(groups: int, gone: list[np.ndarray], still: list[np.ndarray]) -> pa.Table:
    """Per text group: what is removed, and what the next pass has to look at."""
    out: dict[int, list] = {}
    for k, cols in enumerate((gone, still)):
        for g, rows in by_key(group_of(cols[0], groups)):
            rows = rows[np.lexsort((cols[1][rows], cols[0][rows]))]
            out.setdefault(g, [None, None])[k] = pack([c[rows] for c in cols])
    return pa.Table.from_batches([_rows(["g", "gone", "open"], [(g, *v) for g, v in out.items()])])


def _judge_runs(groups: int):
    def run(part: pa.Table) -> pa.Table:
        anchor, extent, doc, start, count = unpack_all(cells(part, "runs"), _RUN, True)
        gone = unpack_all(cells(part, "gone"), _AT)
        order, head = _combine((anchor, extent), doc, start)
        again = order[~head]
        first = order[head]
        # an anchor with several extents: the first run of each is looked at suffix by suffix
        a = anchor[first]
        mixed = np.zeros(len(first), dtype=bool)
        same = a[1:] == a[:-1]
        mixed[1:] |= same
        mixed[:-1] |= same
        still = first[mixed]
        return _to_groups(groups, [np.concatenate([x, y[again]]) for x, y in zip(gone, (doc, start, (count & 0xFFFF).astype(np.uint16)), strict=True)], [c[still] for c in (doc, start, count)])

    return run


def _extents(part: pa.Table, doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of the given slices in bounded blocks: which of them, the block, and each one's place in it."""
    texts = Texts(part)
    data, offsets, row = texts.data, texts.offsets, texts.rows_of(doc)
    base = offsets[row] + start
    length = np.minimum(length, offsets[row + 1] - base)
    ends = np.append(0, np.cumsum(length))
    for i, j in blocks(ends):
        yield np.arange(i, j), data[ragged(base[i:j], length[i:j])], ends[i:j] - ends[i]


def _find_parts(depth: int, step: int, buckets: int):
    def run(part: pa.Table, todo: pa.Table) -> pa.Table:
        doc, start, packed = unpack_all(cells(todo, "open"), _OPEN)
        count, far = (packed & 0xFFFF).astype(np.int64), (packed >> 16).astype(np.int64)
        rows: list[tuple] = []
        for which, block, at in _extents(part, doc, start, count + depth - 1) if len(doc) else ():
            n, top = count[which], far[which]
            # suffix i of a run is far - i before the anchor; a part has the distances of one multiple of step
            high, low = top // step, (top - n + 1) // step
            k = high - low + 1
            run_ = np.repeat(np.arange(len(which)), k)
            j = np.repeat(high, k) - ragged(np.zeros(len(k), np.int64), k)
            last, first = np.maximum(j * step, (top - n + 1)[run_]), np.minimum(j * step + step - 1, top[run_])
            size = first - last + 1
            base, anchor = at[run_], (at + top)[run_]
            begin, core = anchor - first, anchor - j * step
            one = mix(Rolling(byte_codes(block, 0), 0).of(core, core - step + 1 + depth) + j.astype(np.uint64))
            two = Rolling(byte_codes(block, 1), 1).of(begin, begin + size + depth - 1)
            d, s = doc[which][run_], (start[which][run_] + (begin - base)).astype(np.int32)
            order, head = _combine((one, two), d, s)
            lead, rest = order[head], order[~head]
            rows += [(b, blob, None) for b, blob in _send(bucket_of(one[lead], buckets), [x[lead] for x in (one, two, d, s, size.astype(np.uint32))], True)]
            rows += [(b, None, blob) for b, blob in _send(bucket_of(one[rest], buckets), [x[rest] for x in (d, s, size.astype(np.uint16))], False)]
        return pa.Table.from_batches([_rows(["bucket", "runs", "gone"], rows)])

    return run


def _find_suffixes(depth: int, buckets: int):
    def run(part: pa.Table, todo: pa.Table) -> pa.Table:
        doc, start, count = unpack_all(cells(todo, "open"), _OPEN)
        runs: dict[int, list[bytes]] = {}
        gone: dict[int, list[bytes]] = {}
        for which, block, at in _extents(part, doc, start, count.astype(np.int64) + depth - 1) if len(doc) else ():
            c = count[which].astype(np.int64)
            here = ragged(at, c)
            one, two = (Rolling(byte_codes(block, k), k).of(here, here + depth) for k in (0, 1))
            d, s = np.repeat(doc[which], c), ragged(start[which].astype(np.int64), c).astype(np.int32)
            order, head = _combine((one, two), d, s)
            first, rest = order[head], order[~head]
            for b, blob in _send(bucket_of(one[first], buckets), [x[first] for x in (one, two, d, s)], True):
                runs.setdefault(b, []).append(blob)
            for b, blob in _send(bucket_of(one[rest], buckets), [d[rest], s[rest], np.ones(len(rest), np.uint16)], False):
                gone.setdefault(b, []).append(blob)
        rows = [(b, x, None) for b, xs in runs.items() for x in xs] + [(b, None, x) for b, xs in gone.items() for x in xs]
        return pa.Table.from_batches([_rows(["bucket", "suffixes", "gone"], rows)])

    return run


def _judge_suffixes(groups: int):
    def run(part: pa.Table) -> pa.Table:
        one, two, doc, start = unpack_all(cells(part, "suffixes"), _SUFFIX, True)
        gone = unpack_all(cells(part, "gone"), _AT)
        order, head = _combine((one, two), doc, start)
        again = order[~head]
        more = (doc[again], start[again], np.ones(len(again), np.uint16))
        none = [np.zeros(0, d) for d in _AT]
        return _to_groups(groups, [np.concatenate([x, y]) for x, y in zip(gone, more, strict=True)], none)

    return run


def _cut(depth: int, keep: Sequence[str], as_text: bool):
    def run(part: pa.Table, marks: pa.Table) -> pa.Table:
        texts = Texts(part)
        ids, data, offsets = texts.ids, texts.data, texts.offsets
        doc, start, count = unpack_all(cells(marks, "gone"), _AT)
        order = np.argsort(doc, kind="stable")
        doc, start = doc[order], start[order].astype(np.int64)
        stop = start + count[order] + depth - 1
        lo, hi = np.searchsorted(doc, ids), np.searchsorted(doc, ids, side="right")
        kept, removed, froms, tos, sizes = [], np.zeros(len(ids), np.int64), [], [], [0]
        for r in range(len(ids)):
            text = data[offsets[r] : offsets[r + 1]]
            a, b = merge_runs(start[lo[r] : hi[r]], np.minimum(stop[lo[r] : hi[r]], len(text)))
            a, b = a[b > a], b[b > a]
            removed[r] = int((b - a).sum())
            froms.append(a)
            tos.append(b)
            sizes.append(len(a))
            edges = np.column_stack([np.append(0, b), np.append(a, len(text))]).tolist()
            kept.append(b"".join([text[x:y].tobytes() for x, y in edges if y > x]))
        span = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (froms, tos)], ["start", "stop"])
        if as_text:
            kept = [x.decode("utf-8", "ignore") for x in kept]
        columns = {
            "doc_id": pa.array(ids), "kept": pa.array(kept, pa.string() if as_text else pa.binary()), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed),
            "spans": pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), span),
        }
        rest = texts.rest()
        return pa.table(columns | {c: rest.column(f"keep_{c}") for c in keep})

    return run


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", depth: int = DEPTH, keep: Sequence[str] = (), as_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, kept binary, n_bytes, n_removed, spans array<struct<start, stop>>, and the keep columns.

    as_text: kept is a string, without the bytes of characters that were cut in part.  Outputs go before keep.
    """
    spark = docs.sparkSession
    keep = passed(keep, ("doc_id", "kept", "n_bytes", "n_removed", "spans"))
    bounded_batches(spark)
    total = text_bytes(docs, text)
    groups = group_count(total)
    buckets = bucket_count(groups, total)
    packed = packed_by_group(docs, groups, part_count(spark, groups, total), text, key, keep)
    digit = min(DIGIT, max(1, depth // 2))
    shards = Shards.of(CELLS * total // 6)  # about six bytes a word
    lengths = [max(1, depth * p // 100) for p in PASSES]
    sent = packed.groupBy("g").applyInArrow(_send_first(depth, lengths, shards), _SKETCH_SCHEMA)
    answers = cut_lineage(sent.groupBy("shard").applyInArrow(merged(shards), _ANSWER_SCHEMA))
    for row in range(1, len(lengths)):
        sent = packed.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_send_next(depth, lengths, shards, row), _SKETCH_SCHEMA)
        answers = answers.unionByName(cut_lineage(sent.groupBy("shard").applyInArrow(merged(shards), _ANSWER_SCHEMA)))
    runs = packed.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_find_runs(depth, digit, lengths, shards, buckets), _RUNS_SCHEMA)
    judged = cut_lineage(runs.groupBy("bucket").applyInArrow(_judge_runs(groups), _PART_SCHEMA))
    still = judged.filter("open is not null").select("g", "open")
    parts = packed.groupBy("g").cogroup(still.groupBy("g")).applyInArrow(_find_parts(depth, max(1, min(STEP, depth // 4)), buckets), _RUNS_SCHEMA)
    finer = cut_lineage(parts.groupBy("bucket").applyInArrow(_judge_runs(groups), _PART_SCHEMA))
    still = finer.filter("open is not null").select("g", "open")
    suffixes = packed.groupBy("g").cogroup(still.groupBy("g")).applyInArrow(_find_suffixes(depth, buckets), _SUFFIX_SCHEMA)
    late = suffixes.groupBy("bucket").applyInArrow(_judge_suffixes(groups), _PART_SCHEMA)
    early = judged.filter("gone is not null").select("g", "gone").unionByName(finer.filter("gone is not null").select("g", "gone"))
    gone = early.unionByName(late.filter("gone is not null").select("g", "gone"))
    schema = StructType.fromDDL(f"doc_id long, kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>")
    for c in keep:
        schema.add(c, docs.schema[c].dataType)
    out = packed.groupBy("g").cogroup(gone.groupBy("g")).applyInArrow(_cut(depth, keep, as_text), schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as pairs of hexadecimal digits; a window's hash is put together from those of its parts (64 bits).
ORACLE_SQL = r"""
WITH b AS (SELECT doc_id, x, i, n FROM (SELECT doc_id, unnest(bs) AS x, generate_subscripts(bs, 1) AS i, len(bs) AS n FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS bs FROM documents))),
h2 AS (SELECT doc_id, x, i, n, hash(x, lead(x, 1) OVER w) AS h FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
h4 AS (SELECT doc_id, x, i, n, hash(h, lead(h, 2) OVER w) AS h FROM h2 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
h8 AS (SELECT doc_id, x, i, n, h AS h4, hash(h, lead(h, 4) OVER w) AS h FROM h4 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
h16 AS (SELECT doc_id, x, i, n, h4, hash(h, lead(h, 8) OVER w) AS h FROM h8 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
h32 AS (SELECT doc_id, x, i, n, h4, hash(h, lead(h, 16) OVER w) AS h FROM h16 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
h100 AS (SELECT doc_id, x, i, CASE WHEN i + 99 <= n THEN hash(h, lead(h, 32) OVER w, lead(h, 64) OVER w, lead(h4, 96) OVER w) END AS h FROM h32 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
late AS (SELECT doc_id, x, i, h IS NOT NULL AND row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS late FROM h100),
gone AS (SELECT doc_id, x, i, bool_or(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM late),
span AS (SELECT doc_id, x, i, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM gone),
kept AS (SELECT doc_id, count(*) AS n_bytes, count_if(gone) AS n_removed, count_if(starts) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS kept FROM span GROUP BY doc_id)
SELECT doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""

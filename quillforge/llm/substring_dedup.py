"""Substring deduplication over word windows: windows that also start in an earlier document are removed.

Count-min prefilter.  Every partition (a group of documents) sketches the hashes of its WINDOW-word windows; the
sketches are merged, and the merged counts overestimate the windows' counts.  A second pass groups exactly only the
windows estimated at two or more, so none is lost:

* A partition's sketch is sent as the sorted list of the cells it touches, by shard of the cell space.  The merged
  shard answers each partition with one bit per cell it sent, so no sketch is ever broadcast or held whole, and the
  number of cells follows the number of windows (CELLS per window in each of ROWS rows).
* The exact pass groups estimated windows by 128-bit digests.  Neighbouring ones with the same anchor (their ANCHOR
  words of least hash) travel as a run; runs with equal extents are equal window by window, and only where an
  anchor has several extents the windows are sent one by one.  Within a task copies are combined before they are sent.
* Texts are exchanged once (see packed).

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; windows are judged on the input; a repeat within one document alone is
kept.  Null and empty texts have no words.  A null id sorts after all ids.  Rows that repeat an id count as one
document: neither hides the other, and each loses what the id's windows lose.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .blobs import bucket_count, bucket_of, cells, starts_of, unpack_all
from .common import BLOCK_BYTES, NULL_ID, Rolling, blocks, bounded_batches, cut_lineage, group_count, merge_runs, mix, part_count, passed, ragged, table, text_bytes, word_digests, word_spans
from .packed import Texts, packed_by_group
from .sketch import Shards, cell_keys, counted_twice, merged, sketch_table, touched
from .suffix_dedup import _AT, _OPEN, _RUN, _SUFFIX, _rows, _send, _sliding_min, _to_groups

WINDOW = 13
ANCHOR = 5
ROWS = 2
CELLS = 2
#: Words that one vectorised step handles.
BLOCK_WORDS = 256 << 10


class Words:
    """Word digests of a group's texts and the place of each word in its text."""

    def __init__(self, texts: Texts) -> None:
        starts, stops, one, two, counts = [], [], [], [], []
        for lo, hi, base in _parts(texts.data, texts.offsets):
            data = texts.data[lo:hi]
            s, e, first = word_spans(data, base)
            starts.append(s + lo)
            stops.append(e + lo)
            one.append(word_digests(data, s, e, 0))
            two.append(word_digests(data, s, e, 1))
        empty = np.zeros(0, np.int64)
        self.starts, self.stops = np.concatenate([empty, *starts]), np.concatenate([empty, *stops])
        self.codes = (np.concatenate([np.zeros(0, np.uint64), *one]), np.concatenate([np.zeros(0, np.uint64), *two]))
        self.offsets = np.searchsorted(self.starts, texts.offsets)


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Blocks of whole texts, or of an outsized text up to white space: from, to, the texts' places in it."""
    from .common import SPACE

    for i, j in blocks(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= BLOCK_BYTES or j > i + 1:
            yield lo, hi, offsets[i : j + 1] - lo
            continue
        while lo < hi:
            stop = min(hi, lo + BLOCK_BYTES)
            while stop < hi and not SPACE[data[stop]]:  # an outsized word stays whole
                more = np.flatnonzero(SPACE[data[stop : min(hi, stop + BLOCK_BYTES)]])
                stop = stop + int(more[0]) if len(more) else min(hi, stop + BLOCK_BYTES)
            yield lo, stop, np.array([0, stop - lo])
            lo = stop


def _steps(offsets: np.ndarray, window: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Blocks of words for windowing: first text, from word, to word, places of the texts; long texts overlap by parts."""
    for i, j in blocks(offsets, BLOCK_WORDS):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= BLOCK_WORDS:
            yield i, lo, hi, offsets[i : j + 1] - lo
        else:
            for at in range(lo, hi - window + 1, BLOCK_WORDS - window + 1):
                stop = min(hi, at + BLOCK_WORDS)
                yield i, at, stop, np.array([0, stop - at])


def _valid(n: int, offsets: np.ndarray, window: int) -> np.ndarray:
    """Places where a window starts that ends within its text."""
    mark = np.zeros(max(n - window + 2, 1), dtype=np.int32)
    first, last = offsets[:-1], offsets[1:] - window + 1
    ok = last > first
    np.add.at(mark, first[ok], 1)
    np.add.at(mark, last[ok], -1)
    return np.flatnonzero(np.cumsum(mark[:-1]) > 0)


def _window_keys(words: Words, window: int, shards: Shards) -> Iterator[tuple[tuple, np.ndarray, list[np.ndarray]]]:
    """For each step its valid windows and their cells, shard << 32 | cell, in each row of the sketch."""
    for step in _steps(words.offsets, window):
        _, lo, hi, places = step
        at = _valid(hi - lo, places, window)
        if not len(at):
            continue
        keys = []
        for row in range(ROWS):
            h = Rolling(words.codes[row % 2][lo:hi], row % 2).of(at, at + window)
            keys.append(cell_keys(h, shards))
        yield step, at, keys


def _touched(words: Words, window: int, shards: Shards) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row of the sketch: the distinct cells and which of them are touched more than once."""
    each: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
    for _, _, keys in _window_keys(words, window, shards):
        for row, k in enumerate(keys):
            each[row].append(k)
    return [touched(ks) for ks in each]


def _sketch(window: int, shards: Shards):
    def run(part: pa.Table) -> pa.Table:
        return sketch_table(part.column("g")[0].as_py(), dict(enumerate(_touched(Words(Texts(part)), window, shards))), shards)

    return run


def _member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys


def _first_docs(order: np.ndarray, head: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each key's first document, and the rows of later documents."""
    at = np.flatnonzero(head)
    least = np.repeat(doc[order][at], np.diff(np.append(at, len(order))))
    late = doc[order] != least
    return order[~late], order[late]


def _order(keys: Sequence[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((start, doc, *reversed(keys)))
    return order, starts_of(*[k[order] for k in keys])


def _find_runs(window: int, anchor_words: int, shards: Shards, buckets: int):
    def run(part: pa.Table, answers: pa.Table) -> pa.Table:
        texts = Texts(part)
        words = Words(texts)
        hot = [counted_twice(answers, row, keys, shards) for row, (keys, _) in enumerate(_touched(words, window, shards))]
        gathered = []
        for (i, lo, hi, places), at, keys in _window_keys(words, window, shards):
            flag = np.ones(len(at), dtype=bool)
            for row in range(ROWS):
                flag &= _member(hot[row], keys[row])
            at = at[flag]
            if not len(at):
                continue
            grams = Rolling(words.codes[0][lo:hi], 0).sliding(anchor_words)
            place = np.arange(len(grams), dtype=np.uint64)
            anchor = (_sliding_min((grams & np.uint64(0xFFFFFFFFFF000000)) | place, window - anchor_words + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
            text = np.searchsorted(places, at, side="right") - 1
            head = np.flatnonzero(starts_of(anchor[at], text, at - np.arange(len(at))))
            start, count = at[head], np.diff(np.append(head, len(at)))
            extent = Rolling(words.codes[1][lo:hi], 1).of(start, start + count + window - 1)
            row = text[head] + i
            gathered.append([mix(grams[anchor[start]] + np.uint64(1)), extent, texts.ids[row], (start + lo - words.offsets[row]).astype(np.int32), count.astype(np.uint32)])
        if not gathered:
            return pa.Table.from_batches([_rows(["bucket", "runs", "gone"], [])])
        anchor, extent, doc, start, count = (np.concatenate(c) for c in zip(*gathered, strict=True))
        first, late = _first_docs(*_order((anchor, extent), doc, start), doc)
        runs = dict(_send(bucket_of(anchor[first], buckets), [c[first] for c in (anchor, extent, doc, start, count)], True))
        gone = dict(_send(bucket_of(anchor[late], buckets), [c[late] for c in (doc, start, count.astype(np.uint16))], False))
        return pa.Table.from_batches([_rows(["bucket", "runs", "gone"], [(b, runs.get(b), gone.get(b)) for b in sorted(runs.keys() | gone.keys())])])

    return run


def _judge_runs(groups: int):
    def run(part: pa.Table) -> pa.Table:
        anchor, extent, doc, start, count = unpack_all(cells(part, "runs"), _RUN, True)
        gone = unpack_all(cells(part, "gone"), _AT)
        order, head = _order((anchor, extent), doc, start)
        first, late = _first_docs(order, head, doc)
        # anchors with several extents are looked at window by window
        lead = order[head]
        a, n = np.unique(anchor[lead], return_counts=True)
        mixed = first[_member(a[n > 1], anchor[first])]
        return _to_groups(groups, [np.concatenate([x, y[late]]) for x, y in zip(gone, (doc, start, count.astype(np.uint16)), strict=True)], [c[mixed] for c in (doc, start, count)])

    return run


def _find_windows(window: int, buckets: int):
    def run(part: pa.Table, todo: pa.Table) -> pa.Table:
        doc, start, count = unpack_all(cells(todo, "open"), _OPEN)
        rows: list[tuple] = []
        if len(doc):
            texts = Texts(part)
            words = Words(texts)
            base = words.offsets[texts.rows_of(doc)] + start
            length = count.astype(np.int64) + window - 1
            ends = np.append(0, np.cumsum(length))
            for i, j in blocks(ends, BLOCK_WORDS):
                take = ragged(base[i:j], length[i:j])
                c = count[i:j].astype(np.int64)
                here = ragged(ends[i:j] - ends[i], c)
                one, two = (Rolling(words.codes[k][take], k).of(here, here + window) for k in (0, 1))
                d, s = np.repeat(doc[i:j], c), ragged(start[i:j].astype(np.int64), c).astype(np.int32)
                first, late = _first_docs(*_order((one, two), d, s), d)
                rows += [(b, blob, None) for b, blob in _send(bucket_of(one[first], buckets), [x[first] for x in (one, two, d, s)], True)]
                rows += [(b, None, blob) for b, blob in _send(bucket_of(one[late], buckets), [d[late], s[late], np.ones(len(late), np.uint16)], False)]
        return pa.Table.from_batches([_rows(["bucket", "suffixes", "gone"], rows)])

    return run


def _judge_windows(groups: int):
    def run(part: pa.Table) -> pa.Table:
        one, two, doc, start = unpack_all(cells(part, "suffixes"), _SUFFIX, True)
        gone = unpack_all(cells(part, "gone"), _AT)
        _, late = _first_docs(*_order((one, two), doc, start), doc)
        more = (doc[late], start[late], np.ones(len(late), np.uint16))
        return _to_groups(groups, [np.concatenate([x, y]) for x, y in zip(gone, more, strict=True)], [np.zeros(0, d) for d in _AT])

    return run


def _cut(window: int, keep: Sequence[str]):
    def run(part: pa.Table, marks: pa.Table) -> pa.Table:
        texts = Texts(part)
        words = Words(texts)
        doc, start, count = unpack_all(cells(marks, "gone"), _AT)
        order = np.argsort(doc, kind="stable")
        doc, start = doc[order], start[order].astype(np.int64)
        stop = start + count[order] + window - 1
        lo, hi = np.searchsorted(doc, texts.ids), np.searchsorted(doc, texts.ids, side="right")
        kept, removed = [], np.zeros(len(texts.ids), np.int64)
        body = texts.data.tobytes()
        for r in range(len(texts.ids)):
            first, last = int(words.offsets[r]), int(words.offsets[r + 1])
            drop = np.zeros(last - first + 1, dtype=np.int64)
            if hi[r] > lo[r]:
                a, b = merge_runs(start[lo[r] : hi[r]], np.minimum(stop[lo[r] : hi[r]], last - first))
                a, b = a[b > a], b[b > a]
                drop[a] += 1
                drop[b] -= 1
            stay = np.flatnonzero(np.cumsum(drop[:-1]) == 0) + first
            removed[r] = last - first - len(stay)
            kept.append(b" ".join([body[x:y] for x, y in zip(words.starts[stay].tolist(), words.stops[stay].tolist(), strict=True)]))
        columns = {"doc_id": pa.array(texts.ids), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(np.diff(words.offsets).astype(np.int64)), "n_removed": pa.array(removed)}
        rest = texts.rest()
        return pa.table(columns | {c: rest.column(f"keep_{c}") for c in keep})

    return run


def remove_repeated_windows(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row: doc_id, kept string (the words left, joined by a space), n_words, n_removed, keep columns.

    Outputs go before keep.
    """
    spark = docs.sparkSession
    keep = passed(keep, ("doc_id", "kept", "n_words", "n_removed"))
    bounded_batches(spark)
    total = text_bytes(docs, text)
    groups = group_count(total)
    shards = Shards.of(CELLS * total // 6)  # about six bytes a word
    buckets = bucket_count(groups, total)
    anchor_words = min(ANCHOR, window)
    packed = packed_by_group(docs, groups, part_count(spark, groups, total), text, key, keep)
    sketches = packed.groupBy("g").applyInArrow(_sketch(window, shards), "shard int, g int, cells binary")
    answers = cut_lineage(sketches.groupBy("shard").applyInArrow(merged(shards), "g int, shard int, bits binary"))
    runs = packed.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_find_runs(window, anchor_words, shards, buckets), "bucket int, runs binary, gone binary")
    judged = cut_lineage(runs.groupBy("bucket").applyInArrow(_judge_runs(groups), "g int, gone binary, open binary"))
    todo = judged.filter("open is not null").select("g", "open")
    windows = packed.groupBy("g").cogroup(todo.groupBy("g")).applyInArrow(_find_windows(window, buckets), "bucket int, suffixes binary, gone binary")
    late = windows.groupBy("bucket").applyInArrow(_judge_windows(groups), "g int, gone binary, open binary")
    gone = judged.filter("gone is not null").select("g", "gone").unionByName(late.filter("gone is not null").select("g", "gone"))
    schema = StructType.fromDDL("doc_id long, kept string, n_words long, n_removed long")
    for c in keep:
        schema.add(c, docs.schema[c].dataType)
    out = packed.groupBy("g").cogroup(gone.groupBy("g")).applyInArrow(_cut(window, keep), schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM (SELECT doc_id, regexp_split_to_array(text, '[\x20\x09-\x0D]+') AS words FROM documents)) WHERE word <> ''),
win AS (SELECT doc_id, i, string_agg(word, ' ') OVER x AS s, count(*) OVER x AS n FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM win WHERE n = 13) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM late, range(13) o(j)),
kept AS (SELECT w.doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY w.i) FILTER (g.i IS NULL) AS kept FROM w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""

"""Texts dealt into groups by id and kept, compressed, in the shared checkpoint folder.

An operator that looks at the texts several times exchanges them once: blocks of ids and Zstandard-compressed
texts are dealt by group and checkpointed.  The checkpoint keeps its partitioning, so later steps grouped by
``g`` read it in place, and an executor lost on the way costs no more than its own tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blobs import by_key
from .common import cut_lineage_by, string_parts, with_text_group

_CODEC = pa.Codec("zstd", compression_level=1)
#: Text bytes that a task gathers before it sends blocks to the groups.
FLUSH_BYTES = 24 << 20


def _block(ids: np.ndarray, lengths: np.ndarray, text: bytes) -> bytes:
    raw = ids.astype("<i8").tobytes() + lengths.astype("<i8").tobytes() + text
    return len(ids).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unblock(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, size = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    raw = np.frombuffer(_CODEC.decompress(blob[16:], decompressed_size=size), dtype=np.uint8)
    return raw[: 8 * n].view("<i8"), raw[8 * n : 16 * n].view("<i8"), raw[16 * n :]


def _pack(keep: Sequence[str]):
    def flush(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        data, offsets = string_parts(table.column("t"))
        ids, lengths = table.column("k").to_numpy(), np.diff(offsets)
        out: list[tuple] = []
        for g, rows in by_key(table.column("g").to_numpy()):
            text = b"".join(data[offsets[r] : offsets[r + 1]].tobytes() for r in rows)
            rest = None
            if keep:
                sink = pa.BufferOutputStream()
                part = table.select([f"keep_{c}" for c in keep]).take(pa.array(rows))
                with pa.ipc.new_stream(sink, part.schema) as w:
                    w.write_table(part)
                rest = sink.getvalue().to_pybytes()
            out.append((g, _block(ids[rows], lengths[rows], text), rest))
        g, block, rest = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(block, pa.binary()), pa.array(rest, pa.binary())], names=["g", "block", "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            if size >= FLUSH_BYTES:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def packed_by_group(docs: DataFrame, groups: int, parts: int, text: str = "text", key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """(g, block, rest), partitioned by g and checkpointed."""
    packed = with_text_group(docs, groups, text, key, keep).mapInArrow(_pack(keep), "g int, block binary, rest binary")
    return cut_lineage_by(packed, parts, "g")


class Texts:
    """The texts of one group, in the order of their ids (ties: of their bytes' arrival)."""

    def __init__(self, part: pa.Table) -> None:
        each = [_unblock(b) for b in part.column("block").to_pylist()]
        ids = np.concatenate([x[0] for x in each]) if each else np.zeros(0, np.int64)
        lengths = np.concatenate([x[1] for x in each]) if each else np.zeros(0, np.int64)
        data = np.concatenate([x[2] for x in each]) if each else np.zeros(0, np.uint8)
        self.ids, self.data = ids, data
        self.offsets = np.append(0, np.cumsum(lengths)).astype(np.int64)
        self._rest = part.column("rest").to_pylist()

    def rest(self) -> pa.Table | None:
        tables = [pa.ipc.open_stream(x).read_all() for x in self._rest if x is not None]
        return pa.concat_tables(tables) if tables else None

    def rows_of(self, ids: np.ndarray) -> np.ndarray:
        """A row for each id (the first, where rows repeat an id)."""
        order = np.argsort(self.ids, kind="stable")
        return order[np.searchsorted(self.ids[order], ids)]

"""Byte-level BPE encoding and decoding.

Overlapping chunk encoding: a text is cut into chunks that overlap, each chunk is pre-tokenised by itself, and two
chunks are stitched at a place in the overlap where both have a pre-token boundary; from such a place on the
pattern finds the same matches in both.  Where an overlap has no common boundary, the left chunk is extended.  The
pieces (pre-tokens) are then encoded by the ranks; decoding concatenates the tokens' raw bytes.

A text of up to SPREAD_CHARS is handled by one task, chunk by chunk.  The chunks of longer ones are dealt over all
tasks, which pre-tokenise and encode them in parallel; a text's chunks then meet to be stitched, as ids and boundaries.

Resynchronisation needs care at a chunk's right edge, where a match may end too early: matches that touch the edge
are not used.  A lookahead of one character (``\\s+(?!\\S)``) is inside the chunk for every match that does not.

Piece ids are cached per worker, for at most CACHE_PIECES pieces.  A null text encodes to no ids.  Rows are handled
one by one, so repeated rows, ties and null ids do not matter, and an empty table gives an empty result.
The vocabulary file is read by the driver and broadcast (its size is checked against MAX_VOCABULARY_BYTES).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, table

CHUNK_CHARS = 2 << 10
OVERLAP_CHARS = 128
#: Texts beyond this are dealt in chunks of SPREAD_CHUNK characters, which overlap by SPREAD_OVERLAP.
SPREAD_CHARS = 64 << 10
SPREAD_CHUNK, SPREAD_OVERLAP = 16 << 10, 1 << 10
#: Characters before a chunk's end whose boundaries are not trusted: matches there may end too early.
EDGE = 4
CACHE_PIECES = 200_000
MAX_VOCABULARY_BYTES = 64 << 20
IDS_PER_BATCH = 1 << 20


def stitched_pieces(text: str, pattern, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[list[str]]:
    """Lists of pre-tokens which together are the pattern's matches in the whole text."""
    n, at = len(text), 0
    if n <= chunk:
        yield pattern.findall(text)
        return
    while at < n:
        size = chunk
        while True:
            stop = min(n, at + size)
            if stop == n:
                yield pattern.findall(text[at:])
                return
            # the next chunk starts within this one; boundaries of both are compared in the overlap
            spans = [m.span() for m in pattern.finditer(text, at, stop)]
            mine = {b for _, b in spans if stop - overlap <= b < stop - EDGE}
            other = [m.start() for m in pattern.finditer(text, stop - overlap, min(n, stop + overlap))]
            # the first boundary of the other chunk is its cut, not a match's
            shared = [b for b in other[1:] if b in mine]
            if shared:
                join = shared[-1]
                yield [text[a:b] for a, b in spans if b <= join]
                at = join
                break
            size += chunk


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is larger than MAX_VOCABULARY_BYTES")
    return data


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class PieceIds(dict):
    """Piece -> its ids as little-endian 32-bit bytes."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        out = np.asarray(self.encode(piece.encode("utf-8", "replace")), dtype="<u4").tobytes()
        if len(self) < CACHE_PIECES:
            self[piece] = out
        return out


_WORKER: dict[tuple, object] = {}


def _codec(data: bytes, pattern: str):
    key = ("encode", hash(data), pattern)
    if key not in _WORKER:
        import regex
        import tiktoken

        ranks = parse_ranks(data)
        core = tiktoken.Encoding("quillforge", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _WORKER[key] = (regex.compile(pattern), PieceIds(core.encode_single_piece if hasattr(core, "encode_single_piece") else core._core_bpe.encode_single_piece))
    return _WORKER[key]


def _decoder(data: bytes) -> list[bytes]:
    key = ("decode", hash(data))
    if key not in _WORKER:
        ranks = parse_ranks(data)
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        _WORKER[key] = tokens
    return _WORKER[key]


def _replaced(batch: pa.RecordBatch, lo: int, hi: int, new: dict[str, pa.Array]) -> pa.RecordBatch:
    part = batch.slice(lo, hi - lo)
    names = [n for n in part.schema.names if n not in new]
    return pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in names] + list(new.values()), names=[*names, *new])


def _with_field(df: DataFrame, name: str, kind: str) -> StructType:
    return StructType([f for f in df.schema.fields if f.name != name] + StructType.fromDDL(f"`{name}` {kind}").fields)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of each whole text as array<int> (a column named like out is replaced)."""
    bounded_batches(df.sparkSession)
    data = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    whole = _encode_whole(df.filter(size <= SPREAD_CHARS), data, pattern, text, out)
    outsized = df.filter(size > SPREAD_CHARS)
    if outsized.isEmpty():
        return whole
    return whole.unionByName(_encode_spread(outsized, data, pattern, text, out))


def _encode_whole(df: DataFrame, data, pattern: str, text: str, out: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, pieces = _codec(data.value, pattern)
        get = pieces.__getitem__
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            held, sizes, lo, n = [], [], 0, 0
            for i in range(batch.num_rows):
                value = column[i].as_py() or ""
                blob = b"".join([b"".join(map(get, part)) for part in stitched_pieces(value, matcher)])
                held.append(blob)
                sizes.append(len(blob) >> 2)
                n += sizes[-1]
                if n >= IDS_PER_BATCH or i + 1 == batch.num_rows:
                    flat = np.frombuffer(b"".join(held), dtype="<i4")
                    ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat))
                    yield _replaced(batch, lo, i + 1, {out: ids})
                    held, sizes, lo, n = [], [], i + 1, 0

    return df.mapInArrow(run, _with_field(df, out, "array<int>"))


def chunk_pieces(text: str, at: int, matcher, get) -> tuple[bytes, bytes, bytes]:
    """Of a chunk that starts at a place of its text: the ends of its pieces there, how many ids each has, and the ids."""
    spans = [m.span() for m in matcher.finditer(text)]
    blobs = [get(text[a:b]) for a, b in spans]
    ends = np.array([b for _, b in spans], "<i8") + at
    return ends.tobytes(), np.array([len(x) >> 2 for x in blobs], "<i4").tobytes(), b"".join(blobs)


def stitch(chunks: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray | None:
    """Ids of a text from its chunks (start, stop, ends of pieces, ids of each, ids) in order; None where two chunks have no
    common boundary.

    A boundary of a chunk is the end of one of its pieces; its start is a cut, and its last EDGE characters are not trusted
    unless the text ends there.
    """
    out, begin = [], 0
    for i, (start, stop, ends, sizes, ids) in enumerate(chunks):
        if i + 1 < len(chunks):
            following = chunks[i + 1]
            mine = ends[(ends > following[0]) & (ends < stop - EDGE) & (ends > begin)]
            shared = mine[np.isin(mine, following[2])]
            if not len(shared):
                return None
            end = int(shared[0])
        else:
            end = stop
        use = (ends > begin) & (ends <= end)
        places = np.append(0, np.cumsum(sizes))
        lo, hi = np.flatnonzero(use)[[0, -1]] if use.any() else (0, -1)
        out.append(ids[places[lo] : places[hi + 1]])
        begin = end
    return np.concatenate(out) if out else np.zeros(0, "<i4")


def _encode_spread(df: DataFrame, data, pattern: str, text: str, out: str) -> DataFrame:
    others = [c for c in df.columns if c not in (text, out)]
    numbered = df.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.lit(0).alias("none")).alias("rest"), F.col(text).alias("t"))
    starts = F.sequence(F.lit(0), F.ceil(F.length("t") / SPREAD_CHUNK).cast("int") - 1)
    parts = numbered.select("row", "rest", F.posexplode(F.transform(starts, lambda i: F.substring(F.col("t"), i * SPREAD_CHUNK + 1, F.lit(SPREAD_CHUNK + SPREAD_OVERLAP)))).alias("i", "t"))
    # what else the row has goes with its first chunk
    parts = parts.withColumn("rest", F.when(F.col("i") == 0, F.col("rest"))).repartition("row", "i")

    def pre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, pieces = _codec(data.value, pattern)
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                made = chunk_pieces(one.column("t")[0].as_py(), one.column("i")[0].as_py() * SPREAD_CHUNK, matcher, pieces.__getitem__)
                yield pa.RecordBatch.from_arrays([*one.columns, *(pa.array([x], pa.binary()) for x in made)], names=[*one.schema.names, "ends", "sizes", "ids"])

    schema = StructType([*parts.schema.fields, *StructType.fromDDL("ends binary, sizes binary, ids binary").fields])
    done = parts.mapInArrow(pre, schema)

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        texts = table.column("t").to_pylist()
        at = [i * SPREAD_CHUNK for i in table.column("i").to_pylist()]
        cols = [[np.frombuffer(x, kind) for x in table.column(c).to_pylist()] for c, kind in (("ends", "<i8"), ("sizes", "<i4"), ("ids", "<i4"))]
        ids = stitch([(a, a + len(t), *x) for a, t, *x in zip(at, texts, *cols, strict=True)])
        value = "".join(t[:SPREAD_CHUNK] for t in texts)
        if ids is None:  # a piece longer than an overlap: by growing chunks, one after another
            matcher, pieces = _codec(data.value, pattern)
            ids = np.frombuffer(b"".join(pieces[p] for part in stitched_pieces(value, matcher, SPREAD_CHUNK, SPREAD_OVERLAP) for p in part), "<i4")
        rest = table.column("rest").combine_chunks()
        return pa.table([rest.slice(0, 1) if not isinstance(rest, pa.ChunkedArray) else rest.chunk(0).slice(0, 1), pa.array([value]), pa.array([ids], pa.list_(pa.int32()))], names=["rest", "t", "ids"])

    joined = done.groupBy("row").applyInArrow(join, StructType([done.schema["rest"], *StructType.fromDDL("t string, ids array<int>").fields]))
    place = {c: F.col(f"rest.c{i}") for i, c in enumerate(others)} | {text: F.col("t"), out: F.col("ids")}
    return joined.select(*[place[f.name].alias(f.name) for f in _with_field(df, out, "array<int>").fields])


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes of each row's ids as binary (null ids: no bytes)."""
    bounded_batches(df.sparkSession)
    data = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _decoder(data.value).__getitem__
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            flat, offsets, valid = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
            raw = [b"".join(map(get, flat[a:b].tolist())) if ok else b"" for a, b, ok in zip(offsets[:-1], offsets[1:], valid, strict=True)]
            yield _replaced(batch, 0, batch.num_rows, {out: pa.array(raw, pa.binary())})

    return df.mapInArrow(run, _with_field(df, out, "binary"))


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decode(encode(docs, path, public_tokenizers.PATTERN).drop("text"), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

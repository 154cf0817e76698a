"""Best-two-fit packing of documents into sequences of bounded length.

A sequence is filled greedily, largest fitting document first.  When nothing fits any more, its smallest document
is replaced by two unpacked ones that together fit the expanded gap more tightly, if there are such.

Equal lengths are interchangeable, so a packer works on counts per length: the set of available lengths is one big
integer, "largest length up to x" is a bit scan, and "two lengths with this sum" an AND of the set with its mirror
image.  Documents are dealt by a hash of their id into shards of about SHARD_PIECES pieces, which are packed
independently (a shard wastes at most about one sequence); no task sees more than a shard.

Tokens: the ids of the given tokenizer file without special tokens, then END_ID.  Pieces that the tokenizer's own
pattern finds are encoded by themselves, a batch's new ones in one call, and cached per worker (about CACHE_PIECES);
texts with characters that its normaliser treats specially (_SPECIAL tells) go through the tokenizer whole.  Only
documents longer than a sequence are cut, into full pieces and a rest.

Null texts count as empty: one END_ID.  Repeated rows and null ids are packed like any other row.  An empty table
gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, bounded_batches, string_parts, table

CAPACITY = 2048
END_ID = 0
SHARD_PIECES = 60_000
CACHE_PIECES = 400_000
MAX_TOKENIZER_BYTES = 64 << 20
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


class Available:
    """Counts per length, with the set of lengths that have any as bits of an integer, also mirrored."""

    def __init__(self, counts: Sequence[int]) -> None:
        self.top = len(counts) - 1
        self.counts = list(counts)
        self.bits = sum(1 << i for i, n in enumerate(self.counts) if n)
        self.mirror = sum(1 << (self.top - i) for i, n in enumerate(self.counts) if n)

    def largest(self, limit: int) -> int:
        """Largest available length up to limit, 0 if there is none."""
        return (self.bits & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 and self.bits & ((1 << (limit + 1)) - 2) else 0

    def take(self, length: int) -> None:
        self.counts[length] -= 1
        if not self.counts[length]:
            self.bits ^= 1 << length
            self.mirror ^= 1 << (self.top - length)

    def give(self, length: int) -> None:
        if not self.counts[length]:
            self.bits |= 1 << length
            self.mirror |= 1 << (self.top - length)
        self.counts[length] += 1

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two available lengths with this sum, the larger first."""
        shift = self.top - total
        both = self.bits & (self.mirror >> shift if shift >= 0 else self.mirror << -shift)
        both &= (1 << total) - 2 if total > 0 else 0
        while both:
            a = both.bit_length() - 1
            if 2 * a < total:
                return None
            if 2 * a > total or self.counts[a] > 1:
                return a, total - a
            both ^= 1 << a
        return None


def pack_lengths(counts: Sequence[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of lengths.  counts[n]: documents of length n, from 1 to capacity."""
    left = Available([0, *counts[1:]] + [0] * (capacity + 1 - len(counts)))
    out = []
    while left.bits:
        own, gap = [], capacity
        while length := left.largest(gap):
            left.take(length)
            own.append(length)
            gap -= length
        # own falls, so its last is the smallest
        if gap and left.bits:
            least = own[-1]
            for total in range(gap + least, least, -1):
                if two := left.pair(total):
                    own.pop()
                    left.give(least)
                    for x in two:
                        left.take(x)
                        own.append(x)
                    break
        out.append(own)
    return out


def _pack_shard(capacity: int):
    def run(key: tuple, part: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        part = part.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("row", "ascending"), ("piece", "ascending")])
        lengths = part.column("length").to_numpy()
        counts = np.bincount(lengths, minlength=capacity + 1)
        bins = pack_lengths(counts.tolist(), capacity)
        sizes = np.array([len(b) for b in bins], dtype=np.int64)
        flat = np.array([x for b in bins for x in b], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        ends = np.cumsum(flat)
        offset = ends - flat - np.repeat((ends - flat)[first], sizes) if len(flat) else flat
        sequence = np.repeat(np.arange(len(bins)), sizes)
        # the slots of each length, in order, take the documents of that length, in order
        slot = np.argsort(flat, kind="stable")
        where = np.empty(len(flat), np.int64)
        where[: len(slot)] = slot
        keep = part.drop_columns(["shard"])
        return keep.append_column("sequence_id", pa.array((np.int64(shard) << 32) + sequence[where])).append_column("offset", pa.array(offset[where]))

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece, row and length (1 to capacity)."""
    shards = max(1, math.ceil(pieces.count() / shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(shards)).cast("int"))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return dealt.groupBy("shard").applyInArrow(_pack_shard(capacity), schema)


# ---------------------------------------------------------------- tokens


def read_tokenizer(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(data) > MAX_TOKENIZER_BYTES:
        raise ValueError("the tokenizer file is larger than MAX_TOKENIZER_BYTES")
    return data


# Fixed value: the end mark of the tokenizer's words.
END_OF_WORD = "</w>"
#: From here on letters may change with lower case or composition in ways that libraries do not share.
PLAIN_END = 0x250
#: Characters before it that white space or lower case treats differently.
_SPECIAL = re.compile("[\x1c-\x1f\x85\xa0\u0130\u0250-\U0010ffff]")


def _of_kind(kind: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(PLAIN_END) if unicodedata.category(chr(i))[0] == kind)


def piece_pattern() -> re.Pattern:
    """The tokenizer file's pattern on plain characters: contractions, letters, single digits, other characters."""
    letters, digits = _of_kind("L"), _of_kind("N")
    return re.compile(f"[{letters}]+|'(?:[stmd]|re|ve|ll)|[{digits}]|[^\\s{letters}{digits}]+")


class PieceIds(dict):
    """Piece -> its ids as little-endian 32-bit bytes."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer
        self.find = piece_pattern().findall
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(END_OF_WORD)]] = True

    def whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _ids(self, text: str) -> np.ndarray:
        # the batch call that keeps no offsets
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def learn(self, pieces: list[str]) -> None:
        """Encodes new pieces in one call; each ends with the one token that ends a word."""
        ids = self._ids(" ".join(pieces))
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(pieces) or (len(cuts) and cuts[-1] != len(ids)):
            self.update((p, self.whole(p)) for p in pieces)
            return
        raw, at = ids.tobytes(), 0
        for p, cut in zip(pieces, (4 * cuts).tolist(), strict=True):
            self[p] = raw[at:cut]
            at = cut

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [None if "<|" in t or not t.isascii() and _SPECIAL.search(t) or any(c in t for c in "\x1c\x1d\x1e\x1f") else self.find(t.lower()) for t in texts]
        if len(self) > CACHE_PIECES:
            self.clear()
        new = list({p for part in parts if part for p in part if p not in self})
        for i in range(0, len(new), 2000):
            self.learn(new[i : i + 2000])
        get = self.__getitem__
        return [self.whole(t) if part is None else b"".join(map(get, part)) for t, part in zip(texts, parts, strict=True)]


_WORKER: dict[int, PieceIds] = {}


def _pieces(data: bytes) -> PieceIds:
    key = hash(data)
    if key not in _WORKER:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _WORKER[key] = PieceIds(Tokenizer.from_str(data.decode()))
    return _WORKER[key]


def token_pieces(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32, row (tells repeated rows apart), and ids if asked for."""
    spark = docs.sparkSession
    bounded_batches(spark)
    data = spark.sparkContext.broadcast(read_tokenizer(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _pieces(data.value)
        end = np.array([END_ID], dtype="<u4").tobytes()
        width = 4 * capacity
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            ids = []
            keys, rows, texts = (batch.column(i) for i in range(3))
            _, offsets = string_parts(texts)
            encoded = (x for i, j in blocks(offsets, 4 * BLOCK_BYTES) for x in words.encode([t or "" for t in texts[i:j].to_pylist()]))
            for k, row, x in zip(keys.to_pylist(), rows.to_pylist(), encoded, strict=True):
                blob = x + end
                for p, at in enumerate(range(0, len(blob), width)):
                    part = blob[at : at + width]
                    for c, v in zip(columns, (k, p, at >> 2, len(part) >> 2, zlib.crc32(part), row), strict=True):
                        c.append(v)
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<i4"))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(run, PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset."""
    from .common import cut_lineage

    pieces = cut_lineage(token_pieces(docs, path, capacity=capacity, with_ids=with_ids))
    return pack_pieces(pieces, capacity).drop("row")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

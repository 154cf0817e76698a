"""Helpers shared by the training-data operators: tables, text groups and vectorised byte kernels.

The kernels work on the flat UTF-8 buffer of an Arrow string column, so a whole batch of texts is
hashed, split and windowed with a few NumPy passes and no loop over rows.  Batches are cut into
blocks of at most ``BLOCK_BYTES`` of text (one text at least), which bounds a worker's memory.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step handles at a time.
BLOCK_BYTES = 512 << 10
#: Text bytes per group when texts are dealt out by key: the least, and beyond MANY_GROUPS groups up to the most.
GROUP_BYTES, MANY_GROUPS, MOST_GROUP_BYTES = 8 << 20, 100_000, 64 << 20
#: Text bytes per partition of dealt texts, which holds many groups one after another.
PART_BYTES = 128 << 20

_U = np.uint64
#: Odd multipliers of the two polynomial hashes modulo 2^64.
BASES = (_U(0x9E3779B97F4A7C15 | 1), _U(0xC2B2AE3D27D4EB4F | 1))
_BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * _U(2) + _U(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passed(keep: Sequence[str], outputs: Sequence[str]) -> list[str]:
    """The columns to pass through: one that is named like an output gives way to it."""
    return [c for c in keep if c not in outputs]


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; where none is configured (tests, single machine) a local default is set."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="quillforge-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder: the rows survive lost executors and plans stay short."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables written to the shared checkpoint folder.

    For loops: a table that is read again has its true size, so small ones are joined by broadcast, while the size
    estimates of checkpointed plans multiply with each join and slow planning down after a few rounds.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/tables-{uuid.uuid4().hex}"
        self.made = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that no later step reads."""
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage_by(df: DataFrame, parts: int = 0, key: str = "") -> DataFrame:
    """cut_lineage() of df, dealt into parts by key if given, which the copy remembers: later steps grouped by the key that
    df is dealt by read it in place."""
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    # an adaptive plan does not tell its partitioning to the checkpoint
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(df.repartition(parts, key) if parts else df)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


#: Stands for a null id: it sorts after all others.
NULL_ID = (1 << 63) - 1


def next_prime(n: int) -> int:
    n = max(2, n)
    while any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def group_count(total: int) -> int:
    """A prime number of groups for so many bytes of text."""
    size = min(MOST_GROUP_BYTES, max(GROUP_BYTES, total // MANY_GROUPS))
    return 1 if total <= size else next_prime(math.ceil(total / size))


def part_count(spark: SparkSession, groups: int, total: int) -> int:
    """Partitions for so many groups: those of a shuffle, and more where they would hold over PART_BYTES of text."""
    return min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PART_BYTES)))


def with_text_group(docs: DataFrame, groups: int, text: str = "text", key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """(k, t, g, kept columns): the id (null: NULL_ID), the text (null: empty) and the text's group, id mod groups."""
    k = F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID))
    return docs.select(
        k.alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.pmod(k, F.lit(groups).cast("long")).cast("int").alias("g"), *[F.col(c).alias(f"keep_{c}") for c in keep]
    )


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    return np.mod(ids, groups).astype(np.int32)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2,000 rows and 16 MB: what a Python worker holds does not depend on text lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


# ---------------------------------------------------------------- Arrow access


def string_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of an Arrow string or binary array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, dtype=np.int64 if big else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of at most limit bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


# ---------------------------------------------------------------- hashing


def _pow_table(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Cached powers of a base and of its inverse modulo 2^64."""

    def __init__(self) -> None:
        self.up: dict[int, np.ndarray] = {}
        self.down: dict[int, np.ndarray] = {}

    def get(self, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if which not in self.up or len(self.up[which]) < n:
            size = max(n, BLOCK_BYTES + 4096) if n <= BLOCK_BYTES + 4096 else n
            base = BASES[which]
            inverse = _U(pow(int(base), -1, 1 << 64))
            self.up[which], self.down[which] = _pow_table(base, size), _pow_table(inverse, size)
            if size > BLOCK_BYTES * 4:  # do not keep the tables of an outsized text
                up, down = self.up.pop(which), self.down.pop(which)
                return up[:n], down[:n]
        return self.up[which][:n], self.down[which][:n]


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (splitmix64)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Rolling:
    """Hashes of any slices [start, stop) of a sequence of codes, from one prefix sum."""

    def __init__(self, codes: np.ndarray, which: int) -> None:
        up, self.down = POWERS.get(which, len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def sliding(self, width: int) -> np.ndarray:
        n = len(self.sums) - 1 - width
        return mix((self.sums[width:] - self.sums[: n + 1]) * self.down[: n + 1] + _U(width))


#: Longest word, in bytes, that the polynomial hash is used for: modulo 2^64 it meets crafted sequences of 1,024 and more.
SHORT_WORD = 32


def word_digests(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit digest of each word."""
    out = Rolling(byte_codes(data, which), which).of(starts, stops)
    outsized = np.flatnonzero(stops - starts > SHORT_WORD)
    if len(outsized):
        out[outsized] = [xxhash.xxh3_64_intdigest(data[a:b].data, 1 + which) for a, b in zip(starts[outsized], stops[outsized], strict=True)]
    return out


def sequence_digests(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each whole sequence of codes [places[i], places[i + 1])."""
    flat = np.ascontiguousarray(codes)
    return np.array([xxhash.xxh3_64_intdigest(flat[a:b].data) for a, b in zip(places[:-1], places[1:], strict=True)], dtype=np.uint64)


def byte_codes(data: np.ndarray, which: int) -> np.ndarray:
    return _BYTE_CODES[which][data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the words ([^\\x20\\x09-\\x0D]+) in a block, and the first word's index of each text (n + 1)."""
    body = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[1:-1] = body[1:] != body[:-1]
    # a text's first and last bytes are edges too
    first, last = offsets[:-1], offsets[1:]
    full = last > first
    start = np.zeros(len(data) + 1, dtype=bool)
    stop = np.zeros(len(data) + 1, dtype=bool)
    start[1:-1] = edge[1:-1] & body[1:]
    stop[1:-1] = edge[1:-1] & body[:-1]
    heads, tails = first[full], last[full]
    start[heads] = body[heads]
    stop[tails] |= body[tails - 1]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop)
    return starts, stops, np.searchsorted(starts, offsets)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def merge_runs(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals, sorted; touching ones become one."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    head = np.ones(len(start), dtype=bool)
    head[1:] = start[1:] > stop[:-1]
    at = np.flatnonzero(head)
    return start[at], stop[np.append(at[1:] - 1, len(start) - 1)]

"""Near-duplicate detection by ProbMinHash, banding and verification.

ProbMinHash: the shingles of a text (five consecutive words, weighted by how often they occur) arrive in Poisson
processes whose rates are their weights; every arrival falls into one of REGISTERS registers, and each register
keeps the shingle that arrives first.  A shingle stops once its next arrival lies beyond all registers' times.  Two
texts agree in a register with the probability Jaccard of their weighted shingles.  BANDS bands of registers are
hashed; texts that share a band's hash meet in its bucket and are verified on their shingles.  A text that repeats
shingles has a second signature with all weights one, which agrees with the probability of the Jaccard index of the
distinct shingles; its bands go to the same buckets.  For other texts the two signatures are equal.

A pair is a near duplicate if the probability Jaccard of its weighted shingles, or the Jaccard index of its distinct
ones, is at least THRESHOLD.  Classes are the components of these links.  A pair at 0.8 by either measure misses every
bucket with a probability of 2.2e-4, one at 0.85 of 5e-6.

* Copies (equal word sequences) are one vertex: they are grouped by a 128-bit digest with map-side combination.
* Within a bucket not all pairs are made.  In each round a bucket names centres, four times as many as in the
  round before; every member not known to be connected is verified against them, and centres that are done leave.
  When the remaining members of a bucket are known to be connected it is done.  So no link between components is
  lost, and a bucket of near copies takes about as many pairs as it has members.
* Texts that share only a common passage fill buckets without being near.  The members of buckets that the first round
  leaves open are therefore dealt anew by an exact prefix filter: the shingles of each text are ordered by the number
  of these texts that have them, rarest first, and texts meet in the buckets of the shingles of their prefixes.  A
  prefix ends once the shingles after it are less than THRESHOLD of the text, by number and by weight.  What two near
  texts share is at least THRESHOLD of each by one of the two measures (the probability Jaccard is at most the sum of
  the smaller shares), so the rarest shingle that they share is in both prefixes and no link is lost.
* Two texts share nothing that comes before their first common shingle, so in its bucket the places of the shingle bound
  their similarity: pairs that cannot be near are not verified, and texts that cannot be near any other of the bucket's
  sizes leave it.  The first centre of these buckets is the text whose shingles most others have, as near copies are
  nearest to what they were copied from; further ones come in random order.
* A centre that many members meet is dealt out in as many copies as its pairs need (PAIRS_PER_COPY), so a very
  large group is verified by many tasks.  Components are found by one task while
  the links are at most LOCAL_EDGES, else by label propagation with pointer jumping.
* Verification compares shingles by 64-bit digests; shingles of a text whose digests clash count as one, with the sum
  of their weights.

Words are ``[^\\x20\\x09-\\x0D]+``; a text of one to four words has one shingle, all of it; texts without words (null,
empty) are copies of each other.  Rows that repeat an id are documents of their own, told apart by their texts; rows
that repeat id and text are one vertex, as all copies are.  A null id sorts after all ids; class_id is null where all
of a class have none.  Of each class the row with the least id (of repeated rows: the first) is kept.  Extra columns
are ignored.  A text is held whole by one task, with about 40 bytes a word; signatures are made in steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blobs import bucket_of, by_key, pack, starts_of, unpack, unpack_all
from .common import BLOCK_BYTES, NULL_ID, Rolling, Scratch, blocks, bounded_batches, cut_lineage_by, mix, sequence_digests, signed, string_parts, table

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS = 16
BAND_ROWS = 4
REGISTERS = BANDS * BAND_ROWS
PAIRS_PER_COPY = 2000
LOCAL_EDGES = 1_000_000
#: Shingles that one step of a signature handles.
STEP_SHINGLES = 400_000
#: Bytes of shingle sets in a group of the prefix filter.
PREFIX_GROUP_BYTES = 32 << 20


class _Flat:
    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets


def _digests(data: np.ndarray, offsets: np.ndarray):
    """Word digests of texts: two code arrays and the texts' places in them."""
    from .substring_dedup import Words

    w = Words(_Flat(data, offsets))
    return w.codes, w.offsets


def shingles(codes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, digest and weight of each distinct shingle, by text."""
    counts = np.diff(places)
    width = np.minimum(counts, SHINGLE_WORDS)
    n = np.where(counts > 0, counts - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), n)
    first = np.cumsum(n) - n
    start = np.arange(int(n.sum())) - first[text] + places[:-1][text]
    h = Rolling(codes, 0).of(start, start + width[text])
    order = np.argsort(mix(h ^ mix(text.astype(np.uint64) + np.uint64(1))))
    head = np.flatnonzero(starts_of(h[order], text[order]))
    weight = np.diff(np.append(head, len(order)))
    return text[order[head]], h[order[head]], weight


def prob_minhash(text: np.ndarray, digest: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """texts x registers: the digest of the first arrival in each register (0 where a text has no shingle)."""
    time = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, dtype=np.uint64)
    for lo in range(0, len(text), STEP_SHINGLES):
        part = slice(lo, lo + STEP_SHINGLES)
        _arrivals(text[part], digest[part], weight[part], time, winner, texts, registers)
    return winner.reshape(texts, registers)


def _arrivals(text: np.ndarray, digest: np.ndarray, weight: np.ndarray, time: np.ndarray, winner: np.ndarray, texts: int, registers: int) -> None:
    """Lets shingles arrive until none can still come first anywhere."""
    live = np.arange(len(text))
    at = np.zeros(len(text))
    step = 0
    while len(live):
        # few live shingles: several arrivals at a time
        many = int(min(64, max(1, 4096 // len(live))))
        rank = np.arange(step, step + many, dtype=np.uint64)
        seed = mix(digest[live, None] + (rank * np.uint64(0x9E3779B97F4A7C15))[None, :])
        gap = -np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live, None]
        when = at[live, None] + np.cumsum(gap, axis=1)
        slot = (mix(seed + np.uint64(1)) % np.uint64(registers)).astype(np.int64) + text[live, None] * registers
        flat_when, flat_slot = when.ravel(), slot.ravel()
        np.minimum.at(time, flat_slot, flat_when)
        won = flat_when == time[flat_slot]
        winner[flat_slot[won]] = np.repeat(digest[live], many)[won]
        at[live] = when[:, -1]
        step += many
        latest = time.reshape(texts, registers).max(axis=1)
        live = live[at[live] < latest[text[live]]]


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """texts x bands."""
    n, registers = signature.shape
    rows = signature.reshape(n, bands, registers // bands)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for i in range(rows.shape[2]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
    return out


def text_bands(text: np.ndarray, digest: np.ndarray, weight: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """texts x 2 BANDS, weighted before unweighted, and which of them count: the second half where it differs."""
    bands = np.zeros((texts, 2 * BANDS), dtype=np.uint64)
    made = np.zeros(bands.shape, dtype=bool)
    if texts:
        bands[:, :BANDS] = band_hashes(prob_minhash(text, digest, weight, texts))
        made[:, :BANDS] = True
    repeats = np.unique(text[weight > 1])
    if len(repeats):
        of = np.isin(text, repeats)
        plain = prob_minhash(np.searchsorted(repeats, text[of]), digest[of], np.ones(int(of.sum()), np.int64), len(repeats))
        bands[repeats, BANDS:] = band_hashes(plain)
        made[repeats, BANDS:] = bands[repeats, BANDS:] != bands[repeats, :BANDS]
    return bands, made


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = string_parts(batch.column("t"))
        for i, j in blocks(offsets, 4 * BLOCK_BYTES):
            codes, places = _digests(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            d = [sequence_digests(codes[k], places) for k in (0, 1)]
            filled = np.flatnonzero(np.diff(places) > 0)
            text, digest, weight = shingles(codes[0], places)
            dense = np.zeros(j - i, np.int64)
            dense[filled] = np.arange(len(filled))
            bands, made = text_bands(dense[text], digest, weight, len(filled))
            sizes = np.zeros(j - i, np.int64)
            sizes[filled] = made.sum(axis=1)
            flat = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(signed(bands[made])))
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([part.column("k"), part.column("th"), pa.array(signed(d[0])), pa.array(signed(d[1])), flat], names=["k", "th", "d1", "d2", "bands"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted digests of distinct shingles, and their weights where any is not one."""
    for batch in batches:
        data, offsets = string_parts(batch.column("t"))
        for i, j in blocks(offsets, 4 * BLOCK_BYTES):
            codes, places = _digests(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            text, digest, weight = merged_weights(*shingles(codes[0], places))
            cut = np.searchsorted(text, np.arange(j - i + 1))
            ids = [digest[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            weights = [None if (weight[a:b] == 1).all() else weight[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("v").slice(i, j - i), pa.array(ids, pa.binary()), pa.array(weights, pa.binary())], names=["v", "ids", "weights"])


def merged_weights(text: np.ndarray, digest: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by text and digest; equal digests of a text become one, with the sum of their weights."""
    order = np.lexsort((digest, text))
    text, digest, weight = text[order], digest[order], weight[order]
    head = np.flatnonzero(starts_of(text, digest))
    weight = np.add.reduceat(weight, head) if len(head) else weight
    return text[head], digest[head], weight.astype(np.uint32)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of distinct ids."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum over common d of 1 / sum over e of max(a_e / a_d, b_e / b_d)."""
    ids = np.union1d(a, b)
    x, y = np.zeros(len(ids)), np.zeros(len(ids))
    x[np.searchsorted(ids, a)] = wa
    y[np.searchsorted(ids, b)] = wb
    with np.errstate(divide="ignore"):
        ratio = np.where(x > 0, y / np.where(x > 0, x, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    x, y = x[order], y[order]
    # with e before d in this order a_e / a_d is the larger one, from d on b_e / b_d
    before, after = np.cumsum(x), np.append(np.cumsum(y[::-1])[::-1][1:], 0)
    common = (x > 0) & (y > 0)
    return float((1 / (before[common] / x[common] + after[common] / y[common])).sum())


def near(a: np.ndarray, wa: np.ndarray | None, b: np.ndarray, wb: np.ndarray | None, threshold: float) -> bool:
    """By distinct shingles or by weighted ones; ids are sorted and distinct, weights None are all one."""
    plain = wa is None and wb is None
    if plain and min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    if jaccard(a, b) >= threshold:
        return True
    if plain:
        return False
    return probability_jaccard(a, np.ones(len(a)) if wa is None else wa, b, np.ones(len(b)) if wb is None else wb) >= threshold


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = lambda x: np.frombuffer(x, "<u8")
            weights = lambda x: None if x is None else np.frombuffer(x, "<u4")
            keep = [
                near(ids(a), weights(wa), ids(b), weights(wb), threshold)
                for a, wa, b, wb in zip(*(batch.column(c).to_pylist() for c in ("x_ids", "x_weights", "ids", "weights")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("x", "cx", "y", "cy")], names=["x", "cx", "y", "cy"])

    return run


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        root = v
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[v] != root:
            parent[v], v = root, parent[v]
        return root

    for batch in batches:
        for a, b in zip(batch.column("cx").to_pylist(), batch.column("cy").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    ids = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(v) for v in ids], pa.int64())], names=["id", "c"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, c): each vertex of edges (cx, cy) with the least vertex of its component.

    At most LOCAL_EDGES edges are joined by one task (16 bytes each); more by label propagation with pointer jumping.
    """
    edges = scratch.put(edges.distinct())
    if edges.count() <= LOCAL_EDGES:
        return scratch.put(edges.repartition(1).mapInArrow(_union_find, "id long, c long"))
    both = scratch.put(edges.unionByName(edges.select(F.col("cx").alias("cy"), F.col("cy").alias("cx"))).distinct())
    labels = scratch.put(both.groupBy(F.col("cx").alias("id")).agg(F.min("cy").alias("m")).select("id", F.least("id", "m").alias("c")))
    while True:
        heard = both.join(labels, both["cx"] == labels["id"]).groupBy(F.col("cy").alias("id")).agg(F.min("c").alias("m"))
        told = labels.join(heard, "id", "left").select("id", F.least("c", "m").alias("n"), F.col("c").alias("old"))
        jump = labels.select(F.col("id").alias("n"), F.col("c").alias("far"))
        after = scratch.put(told.join(jump, "n", "left").select("id", F.least("n", "far").alias("c"), "old"))
        scratch.drop(labels)
        labels = after.select("id", "c")
        if after.filter("c <> old").isEmpty():
            scratch.drop(both)
            return labels


def _flat_sets(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each text's ids; all distinct ids, sorted; and how many of the texts have each."""
    each = [np.frombuffer(x, "<u8") for x in table.column("ids").to_pylist()]
    distinct, counts = np.unique(np.concatenate(each) if each else np.zeros(0, np.uint64), return_counts=True)
    return each, distinct, counts


def _ask_counts(ranges: int):
    """From a group of texts to each range of digests: those the texts have, and in how many of them."""

    def run(table: pa.Table) -> pa.Table:
        _, distinct, counts = _flat_sets(table)
        r, blob = [], []
        for k, at in by_key(bucket_of(distinct, ranges)):
            r.append(k)
            blob.append(pack([distinct[at], counts[at].astype(np.uint32)], delta=True))
        return pa.table({"g": pa.array([table.column("g")[0].as_py()] * len(r), pa.int32()), "r": pa.array(r, pa.int32()), "blob": pa.array(blob, pa.binary())})

    return run


def _answer_counts(table: pa.Table) -> pa.Table:
    """From a range of digests to each group: in how many texts of all groups its digests are."""
    asked = [unpack(b, ["u8", "u4"], delta=True) for b in table.column("blob").to_pylist()]
    distinct, where = np.unique(np.concatenate([d for d, _ in asked]), return_inverse=True)
    total = np.zeros(len(distinct), np.uint64)
    np.add.at(total, where, np.concatenate([c for _, c in asked]).astype(np.uint64))
    cut = np.cumsum([0, *(len(d) for d, _ in asked)])
    blob = [pack([total[where[a:b]]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return table.set_column(table.column_names.index("blob"), "blob", pa.array(blob, pa.binary())).select(["g", "r", "blob"])


def prefix(ids: np.ndarray, weights: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The rarest shingles, until those after them are less than threshold of the text by number and by weight; and the weight
    before each."""
    order = np.lexsort((ids, counts))
    before = np.cumsum(weights[order]) - weights[order]
    slack = 1 - threshold + 1e-9
    keep = (np.arange(len(ids)) <= slack * len(ids)) | (before <= slack * weights.sum())
    return order[keep], before[keep]


#: Of a text in a shingle's bucket: its shingles, those from this one on, the share of its weight that these are, whether
#: shingles repeat, and how common they are.
BOUNDS = ["n", "m", "mass", "repeats", "common"]
_PREFIXES = "v long, shared array<long>, m array<int>, mass array<double>, n int, repeats boolean, common double"


def _prefixes(threshold: float):
    """The prefix of each text, without the shingles that no other text has, and its bounds there."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        each, distinct, _ = _flat_sets(texts)
        parts = sorted(zip(answers.column("r").to_pylist(), answers.column("blob").to_pylist(), strict=True))
        # ranges follow the order of the digests
        total = unpack_all([b for _, b in parts], ["u8"])[0]
        shared, m, mass, rows = [], [], [], []
        for ids, w in zip(each, texts.column("weights").to_pylist(), strict=True):
            counts = total[np.searchsorted(distinct, ids)]
            weights = np.ones(len(ids)) if w is None else np.frombuffer(w, "<u4").astype(np.float64)
            at, before = prefix(ids, weights, counts, threshold)
            here = np.flatnonzero(counts[at] > 1)
            shared.append(ids[at[here]].view(np.int64))
            m.append((len(ids) - here).astype(np.int32))
            mass.append(1 - before[here] / weights.sum())
            rows.append((len(ids), w is not None, float(np.log(counts).mean())))
        cut = pa.array(np.cumsum([0, *map(len, shared)]), pa.int32())
        lists = [pa.ListArray.from_arrays(cut, pa.array(np.concatenate([np.zeros(0, kind), *x]))) for x, kind in ((shared, np.int64), (m, np.int32), (mass, np.float64))]
        flat = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.float64()), strict=True)]
        return pa.table([texts.column("v"), *lists, *flat], names=["v", "shared", "m", "mass", "n", "repeats", "common"])

    return run


def may_be_near(threshold: float, x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """Of two texts with BOUNDS: false only if they are not near, or share a shingle that comes before the bucket's.

    They share at most the smaller m; and by weight at most the smaller mass, where shingles repeat.
    """
    slack = 1e-9
    distinct = F.least(x("m"), y("m")) * (1 + threshold) + slack >= threshold * (x("n") + y("n"))
    weighted = (x("repeats") | y("repeats")) & (F.least(x("mass"), y("mass")) + slack >= threshold)
    return distinct | weighted


def deal_by_prefix(alive: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """The members of alive (b, v, c) in the buckets of their prefixes' shingles, without buckets of one component; the first
    centre of each has place -1."""
    parts = int(alive.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vertices = scratch.put(alive.select("v", "c").distinct())
    own = sets.join(vertices, "v")
    size = own.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    groups = max(parts, -(-size // PREFIX_GROUP_BYTES))
    own = own.withColumn("g", F.pmod(F.xxhash64("v"), F.lit(groups)).cast("int"))
    asked = own.select("g", "ids").groupBy("g").applyInArrow(_ask_counts(groups), "g int, r int, blob binary")
    answers = asked.groupBy("r").applyInArrow(_answer_counts, "g int, r int, blob binary")
    prefixes = own.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_prefixes(threshold), _PREFIXES)
    dealt = prefixes.join(vertices, "v").select("v", "c", "n", "repeats", "common", F.explode(F.arrays_zip("shared", "m", "mass")).alias("at"))
    dealt = scratch.put(dealt.select(F.col("at.shared").alias("b"), "v", "c", "n", "at.m", "at.mass", "repeats", "common"))
    # a text that is not near one of the bucket's least size, sharing all it can, is not near a larger one
    least = dealt.groupBy("b").agg(F.min("n").alias("least"), F.max("repeats").alias("some"))
    hope = may_be_near(threshold, F.col, {"n": F.col("least"), "m": F.col("m"), "mass": F.col("mass"), "repeats": F.col("some")}.get)
    every, dealt = dealt, scratch.put(dealt.join(least, "b").filter(hope).drop("least", "some"))
    first = F.min(F.struct((-F.col("common")).alias("rank"), "v"))["v"]
    open_ = dealt.groupBy("b").agg(F.count("*").alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi"), first.alias("first")).filter("lo <> hi")
    place = F.when(F.col("v") == F.col("first"), -1.0).otherwise(F.pmod(F.xxhash64("v", "b"), F.lit(1_000_000)) * F.col("size") / 1_000_000)
    out = scratch.put(dealt.join(open_, "b").select("b", "v", "c", place.alias("place"), *BOUNDS))
    for done in (vertices, every, dealt):
        scratch.drop(done)
    return out


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, class_id (least id of its class), text_hash (xxhash64 of the text), kept."""
    spark = docs.sparkSession
    bounded_batches(spark)
    k = F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID))
    rows = docs.select(k.alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))
    scratch = Scratch(spark)
    # rows are numbered once, as they are written; texts are found again by id and hash
    signed_rows = rows.mapInArrow(_signatures, "k long, th long, d1 long, d2 long, bands array<long>")
    signed_rows = scratch.put(signed_rows.withColumn("row", F.monotonically_increasing_id()))
    # a vertex is a distinct word sequence, named by its first row
    distinct = scratch.put(signed_rows.groupBy("d1", "d2").agg(F.min(F.struct("k", "row", "th")).alias("first"), F.any_value("bands").alias("bands")))
    exploded = distinct.select(F.col("first.row").alias("v"), F.explode("bands").alias("b"))
    shared = exploded.groupBy("b").agg(F.count("*").alias("n"), F.min("v").alias("x")).filter("n > 1")
    # the first centre of a bucket is its least member; place orders the others at random, as they become centres
    place = F.pmod(F.xxhash64("v", "b"), F.lit(1_000_000)) * F.col("n") / 1_000_000
    members = scratch.put(exploded.join(shared, "b").select("b", "v", "x", place.alias("place")))
    wanted = distinct.select(F.col("first.row").alias("v"), F.col("first.k").alias("k"), F.col("first.th").alias("th")).join(members.select("v").distinct(), "v")
    sets = rows.join(wanted, ["k", "th"]).select("v", "t").mapInArrow(_shingle_sets, "v long, ids binary, weights binary")
    # rows that repeat id and text give one set
    sets = cut_lineage_by(sets.groupBy("v").agg(F.first("ids").alias("ids"), F.first("weights").alias("weights")))

    def verified(pairs: DataFrame) -> DataFrame:
        copies = pairs.groupBy("x").agg(F.ceil(F.count("*") / PAIRS_PER_COPY).cast("int").alias("copies"))
        dealt = pairs.join(copies, "x").withColumn("copy", F.pmod(F.xxhash64("y"), F.col("copies")).cast("int"))
        left = copies.join(sets.withColumnRenamed("v", "x"), "x").select("x", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("ids").alias("x_ids"), F.col("weights").alias("x_weights"))
        met = dealt.join(left, ["x", "copy"]).join(sets.withColumnRenamed("v", "y"), "y")
        return met.select("x", "cx", "y", "cy", "x_ids", "x_weights", "ids", "weights").mapInArrow(_verify(threshold), "x long, cx long, y long, cy long")

    alive = members.filter("v <> x").select("b", "v", F.col("v").alias("c"), "place")
    pairs = members.filter("v <> x").select("x", F.col("x").alias("cx"), F.col("v").alias("y"), F.col("v").alias("cy")).distinct()
    low, step, links, dealt = 0, 1, [], False
    while True:
        pairs = scratch.put(pairs)
        # centres that are done leave
        rest = alive.filter(F.col("place") >= low)
        if not pairs.isEmpty():  # a range of places may hold no centre
            found = scratch.put(verified(pairs))
            links.append(found.select(F.col("x").alias("cx"), F.col("y").alias("cy")))
            # members of one component need no further pairs
            moved = components(found.select("cx", "cy"), scratch).select(F.col("id").alias("c"), F.col("c").alias("new")).filter("new <> c")
            rest = rest.join(moved, "c", "left").withColumn("c", F.coalesce("new", "c")).select(*alive.columns)
        rest = scratch.put(rest)
        # a bucket is done when its remaining members are known to be connected
        open_ = rest.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("b")
        before, alive = alive, scratch.put(rest.join(open_, "b").select(*alive.columns))
        for done in (before, rest, pairs):  # the first of these is the table of members
            scratch.drop(done)
        if not dealt and not alive.isEmpty():
            before, alive, low, dealt = alive, deal_by_prefix(alive, sets, threshold, scratch), -1, True
            scratch.drop(before)
        if alive.isEmpty():
            break
        low, step = low + step, 4 * step
        side = lambda name: [F.col(c).alias(f"{name}_{c}") for c in alive.columns[4:]]
        centre = F.col("place") < low
        picks = alive.filter(centre).select("b", F.col("v").alias("x"), F.col("c").alias("cx"), *side("x"))
        met = alive.select("b", F.col("v").alias("y"), F.col("c").alias("cy"), centre.alias("too"), *side("y")).join(picks, "b")
        hope = may_be_near(threshold, lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}"))
        pairs = met.filter(F.expr("cx <> cy and (not too or x < y)") & hope).select("x", "cx", "y", "cy").distinct()
    labels = None
    if links:
        labels = components(reduce(DataFrame.unionByName, links), scratch).select(F.col("id").alias("v"), "c")
        for done in links:
            scratch.drop(done)
    named = distinct.select("d1", "d2", "first", F.col("first.row").alias("v"))
    named = named.withColumn("c", F.col("v")) if labels is None else named.join(labels, "v", "left").withColumn("c", F.coalesce("c", "v"))
    least = named.groupBy("c").agg(F.min("first").alias("least"))
    classes = named.join(least, "c").select("d1", "d2", "least")
    out = signed_rows.select("k", "th", "row", "d1", "d2").join(classes, ["d1", "d2"])
    known = lambda c: F.when(c != NULL_ID, c)
    return out.select(known(F.col("k")).alias("doc_id"), known(F.col("least.k")).alias("class_id"), F.col("th").alias("text_hash"), (F.col("row") == F.col("least.row")).alias("kept"))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")

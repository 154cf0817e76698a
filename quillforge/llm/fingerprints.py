"""Document fingerprints: a bottom-k sketch of shingle hashes.  Native: DataFrame and SQL functions only.

A sketch is a sorted ``array<bigint>`` of the k smallest distinct 63-bit hashes of a text's five-word shingles
(words are ``[^\\x20\\x09-\\x0D]+``; a text of one to four words has one shingle, its whole word sequence; a
text without words has the empty sketch).  Sketches merge by union and cut, so parts may be sketched apart, and
estimate resemblance, containment and the number of distinct shingles.  Up to k distinct shingles all are exact.

Null texts count as empty.  Two empty sketches resemble each other fully (1.0), an empty and a filled one not at
all.  Equal texts have equal sketches; repeated rows and ids stay separate rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hashes kept per sketch: a standard error of about 0.044 at a resemblance of one half.
K = 128
SHINGLE_WORDS = 5
#: Documents per ordering bucket, and the most buckets: their bounds are a constant of the plan (17 bytes each).
BUCKET_ROWS = 1500
MAX_BUCKETS = 100_000
_SPACES = r"[\x20\x09-\x0D]+"


def shingle_hashes(df: DataFrame, text: str, out: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """Adds ``out``: the hash of each shingle of ``text``, in order, with repeats."""
    # each step is a projection of its own, so that no lambda computes an array anew for each element
    w, h = f"__{out}_w", f"__{out}_h"
    df = df.withColumn(w, F.filter(F.split(F.col(text), _SPACES), lambda x: x != F.lit("")))
    df = df.withColumn(h, F.transform(F.col(w), lambda x: F.xxhash64(x))).drop(w)
    many = F.transform(
        F.slice(F.col(h), 1, F.greatest(F.size(h) - F.lit(words - 1), F.lit(0))),
        lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *[F.get(F.col(h), i + F.lit(k)) for k in range(1, words)]), 1),
    )
    whole = F.array(F.shiftrightunsigned(F.xxhash64(F.lit("short"), F.to_json(F.col(h))), 1))
    one = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < words, whole).otherwise(many)
    return df.withColumn(out, one).drop(h)


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, words: int = SHINGLE_WORDS) -> DataFrame:
    """Adds the bottom-k sketch of ``text`` (null: empty) as ``out``."""
    raw = f"__{out}_s"
    df = shingle_hashes(df.withColumn(f"__{out}_t", F.coalesce(F.col(text), F.lit(""))), f"__{out}_t", raw, words)
    return df.withColumn(out, bottom_k(F.col(raw), k)).drop(raw, f"__{out}_t")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard index; both empty: 1, one empty: 0."""
    both = merged(a, b, k)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both).cast("double")
    )


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) * F.lit(2.0**63) / F.get(a, F.lit(k - 1)).cast("double"))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's distinct shingles that b has; an empty a is contained fully."""
    r, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * (na + nb) / ((r + 1) * na)))


def as_text(a: Column) -> Column:
    """Base64 of the sketch's hashes, eight bytes each, big-endian."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def merge_all(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """Sketches of groups from sketches of their members, with map-side merging: a group's size does not matter."""
    ranked = df.select(*keys, F.explode(sketch).alias("h")).distinct()
    # two stages: k smallest per salt, then per group
    salted = ranked.withColumn("s", F.pmod(F.xxhash64("h"), F.lit(64)))
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "s").orderBy("h"))).filter(F.col("r") <= k)
    last = first.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).filter(F.col("r") <= k)
    return last.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(sketch))


def with_next_text(docs: DataFrame, key: str = "doc_id", text: str = "text", sketch: int = 0) -> DataFrame:
    """(key, text, next_text): the next text by descending key (nulls last), the first's after the last.

    With sketch = k also each text's sketch and the next text's: sketch, next_sketch.

    Rows are dealt into ranges of about BUCKET_ROWS rows, ordered within them, and each range also gets a copy of the first
    row of the range that follows; so texts are exchanged once and no task sees all rows.  Ranges are those of a sampled
    range partitioning of (key, hash of the text): gaps between keys do not matter, and rows without a key are dealt by
    their texts.  Rows that share a key follow each other in the order of their texts' hashes; rows that repeat both, which
    nothing tells apart, share a range.
    """
    base = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # ascending order of at: descending keys, nulls last
    at = F.struct(F.col("k").isNull().alias("z"), F.coalesce(F.bitwise_not("k"), F.lit(0)).cast("long").alias("r"), F.xxhash64("t").alias("o"))
    base = base.withColumn("at", at)
    n = base.count()
    if not n:
        empty = base.select(F.col("k").alias(key), F.col("t").alias(text), F.col("t").alias("next_text"))
        return empty.withColumns({c: F.array().cast("array<bigint>") for c in ("sketch", "next_sketch")}) if sketch else empty
    buckets = min(MAX_BUCKETS, math.ceil(n / BUCKET_ROWS))
    # the first row of each range, at most MAX_BUCKETS of them
    ranged = base.select("at.*").repartitionByRange(buckets, "z", "r", "o").select(F.struct("z", "r", "o").alias("at"), F.spark_partition_id().alias("p"))
    heads = sorted(tuple(x["head"]) for x in ranged.groupBy("p").agg(F.min("at").alias("head")).collect())
    as_json = "[" + ",".join(f'{{"z":{str(z).lower()},"r":{r},"o":{o}}}' for z, r, o in heads) + "]"
    bounds = F.from_json(F.lit(as_json), "array<struct<z:boolean,r:bigint,o:bigint>>")
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(len(heads).bit_length()))])
    # binary search for the last bound that is not after the row
    step = lambda i, half: F.when((i + half <= len(heads)) & (F.get(bounds, i + half - 1) <= F.col("at")), i + half).otherwise(i)
    base = base.withColumn("b", F.greatest(F.aggregate(halves, F.lit(0), step) - 1, F.lit(0)))
    before = F.when(F.col("b") == 0, len(heads) - 1).otherwise(F.col("b") - 1)
    here, copy = F.struct("b", F.lit(0).alias("copy")), F.struct(before.alias("b"), F.lit(1).alias("copy"))
    to = F.when(F.get(bounds, F.col("b")) == F.col("at"), F.array(here, copy)).otherwise(F.array(here))
    dealt = base.select("k", "t", "at", F.explode(to).alias("to")).select("k", "t", "at", "to.b", "to.copy")
    w = Window.partitionBy("b").orderBy("copy", "at")
    if sketch:
        dealt = with_sketch(dealt, "t", "s", sketch)
    leads = {"next_text": F.lead("t").over(w)} | ({"next_sketch": F.lead("s").over(w)} if sketch else {})
    out = dealt.withColumns(leads).filter("copy = 0")
    return out.select(F.col("k").alias(key), F.col("t").alias(text), "next_text", *([F.col("s").alias("sketch"), "next_sketch"] if sketch else []))


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    from .common import table

    pairs = with_next_text(table(spark, sf_dir, "documents").select("doc_id", "text"), sketch=K)
    pairs = pairs.withColumn("n_chars", F.length("text").cast("long")).withColumn("tail", (F.col("n_chars") / 3).cast("int"))
    pairs = pairs.withColumn("edited", F.concat(F.expr("left(text, n_chars - tail)"), F.expr("left(next_text, tail)")))
    pairs = pairs.withColumn("edited_sha256", F.sha2("edited", 256))
    pairs = with_sketch(pairs, "edited", "e")
    a, e, n = F.col("sketch"), F.col("e"), F.col("next_sketch")
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256", as_text(a).alias("fingerprint"), as_text(e).alias("edited_fingerprint"),
        resemblance(a, e).alias("near_edited"), resemblance(a, n).alias("near_next"), distinct_count(a).alias("n_shingles"),
    )

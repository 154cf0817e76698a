"""Corpus operators: manifests and joins, leakage audits, coverage, sampling, vocabularies."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.functions import quality as Q
from quillforge.functions import text as T
from quillforge.storage import fixed

# ---------------------------------------------------------------- manifests


def join_supervisions(recordings: DataFrame, supervisions: DataFrame, key: str = "recording_id") -> DataFrame:
    return recordings.join(supervisions, key)


def label_with_fallback(recordings: DataFrame, labels: DataFrame, key: str, fallback: str, label: str, strict: bool = True) -> DataFrame:
    """Label by key, else by the fallback column; strict: a recording without any is an error when rows are read."""
    by_id = labels.select(F.col("key").alias(key), F.col(label).alias("__a"))
    by_stem = labels.select(F.col("key").alias(fallback), F.col(label).alias("__b"))
    out = recordings.join(by_id, key, "left").join(by_stem, fallback, "left")
    found = F.coalesce("__a", "__b")
    if strict:
        found = F.when(found.isNull(), F.raise_error(F.concat(F.lit("no label for "), F.col(key).cast("string")))).otherwise(found)
    return out.withColumn(label, found).drop("__a", "__b")


def keep_only(rows: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    return rows.join(keep.select(key), key, "left_semi")


def missing(rows: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return rows.join(present.select(key), key, "left_anti")


def unpaired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side of what stands on one side only."""
    l, r = left.select(key).distinct().withColumn("__l", F.lit(1)), right.select(key).distinct().withColumn("__r", F.lit(1))
    both = l.join(r, key, "full")
    return both.filter("__l is null or __r is null").select(key, F.when(F.col("__r").isNull(), "left").otherwise("right").alias("side"))


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that refuses unpaired keys."""
    if not unpaired(left, right, key).isEmpty():
        raise ValueError(f"rows without a partner on {key}")
    return left.join(right, key)


def clamp(supervisions: Column, duration: Column) -> Column:
    """Supervisions that end after the cut end with it."""
    end = lambda s: F.when(s["start"] + s["duration"] > duration, F.bround(duration - s["start"], 4)).otherwise(s["duration"])
    return F.transform(supervisions, lambda s: s.withField("duration", end(s)))


def row_numbers(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds number, the row's place from 0 in a stable order.

    Numbers continue over ranges of the order: a range's rows are counted first, so no task sees all rows.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id())
    # ids rise with the partition in the upper bits and the row in the lower 33
    part, within = F.shiftright("__row", 33), F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    # the bounds of ranges are sampled, so the rows are fixed before they are counted
    ranged = fixed(ranged.withColumn("__part", part).withColumn("__at", within))
    counts = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # one row per partition
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    offsets = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    number = F.element_at(offsets, F.col("__part")).cast("long") + F.col("__at")
    return ranged.withColumn("number", number).drop("__row", "__part", "__at")


def numbered(rows: DataFrame, prefix: str, order: Sequence[str], width: int = 8) -> DataFrame:
    """Adds id, prefix and the row's number in a stable order."""
    return row_numbers(rows, order).withColumn("id", T.padded_id(prefix, F.col("number"), width)).drop("number")


def guard_split(split: str, min_votes: int | None) -> None:
    """Votes filter training data only: development and test sets are anchors."""
    if min_votes is not None and split in ("dev", "test"):
        raise ValueError(f"no vote filter on split {split!r}")


def refuse_pseudo_labels(manifest: DataFrame) -> DataFrame:
    if not manifest.filter("pseudo_label").isEmpty():
        raise ValueError("an evaluation manifest must not have pseudo labels")
    return manifest


# ---------------------------------------------------------------- leakage


def split_overlap(rows: DataFrame, split: str, corpus: str, key: str) -> DataFrame:
    """corpus, split_a, split_b, keys: distinct keys that two splits of a corpus share.

    Each key meets only itself: its splits are a small set, whose pairs are made in place.
    """
    sets = rows.filter(F.col(key).isNotNull()).groupBy(corpus, key).agg(F.array_sort(F.collect_set(split)).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
    return sets.select(corpus, F.explode(pairs).alias("p")).groupBy(corpus, "p.split_a", "p.split_b").agg(F.count("*").alias("keys"))


def token_leaks(paths: DataFrame, path: str, ids: DataFrame, video: str) -> DataFrame:
    """id, paths: which ids appear as tokens of which paths; both sides are made distinct before they meet."""
    tokens = paths.select(F.col(path), F.explode(T.path_tokens(F.col(path))).alias(video)).distinct()
    return tokens.join(ids.select(video).distinct(), video).groupBy(video).agg(F.array_sort(F.collect_set(path)).alias("paths"))


def unverifiable(rows: DataFrame, split: str, corpus: str, key: str) -> DataFrame:
    """corpus, split, n: rows without a key, which no overlap audit can clear."""
    return rows.filter(F.col(key).isNull()).groupBy(corpus, split).agg(F.count("*").alias("n"))


def leak_exit_code(leaks: DataFrame) -> int:
    """What a leak audit's process ends with: 1 if anything leaks, else 0."""
    return 0 if leaks.isEmpty() else 1


# ---------------------------------------------------------------- coverage and samples


def corpus_counts(rows: DataFrame, text: Column, votes: Column | None, least: int | None, present: Column, group: str = "split") -> DataFrame:
    """group, total, kept, missing, empty, filtered: rows of a corpus by the first reason that removes them.

    A row is empty without normalised text, else filtered with fewer net votes than least, else missing without its
    recording, else kept.
    """
    rules = [("empty", text == "")]
    if least is not None:
        rules.append(("filtered", votes < least))
    reason = Q.first_reason(*rules, ("missing", ~F.coalesce(present, F.lit(False))))
    counted = rows.select(group, reason.alias("reason")).groupBy(group)
    return counted.agg(F.count("*").alias("total"), *[F.count_if(F.col("reason") == r).alias(r) for r in ("kept", "missing", "empty", "filtered")])


def hours(seconds: Column) -> Column:
    """Aggregate."""
    return F.sum(seconds) / 3600.0


def disjoint_ids(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """The union of sources whose ids must not meet."""
    every = reduce(DataFrame.unionByName, sources)
    if not every.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError(f"an id of {key} is in two sources")
    return every


def coverage(rows: DataFrame, key: Column, name: str = "source") -> DataFrame:
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def dominance(counts: DataFrame, limit: float = 30.0) -> DataFrame:
    """One row: the largest group's share in percent and whether it is over the limit."""
    share = F.max("n") * 100.0 / F.sum("n")
    return counts.agg(share.alias("share"), (share > limit).alias("dominant"))


def top(counts: DataFrame, k: int, name: str = "source") -> DataFrame:
    return counts.orderBy(F.desc("n"), name).limit(k)


def even_indices(spark, total: int, num: int) -> DataFrame:
    """Evenly spaced indices below total, both ends included, distinct."""
    if num <= 0 or total <= 0:
        raise ValueError("num and total must be positive")
    if num >= total:
        return spark.range(total).select(F.col("id").alias("i"))
    if num == 1:
        return spark.range(1).select(F.col("id").alias("i"))
    return spark.range(num).select(F.bround(F.col("id") * F.lit(total - 1) / F.lit(num - 1)).cast("long").alias("i")).distinct()


def uniform(seed: str, key: Column) -> Column:
    """In [0, 1), by MD5 of seed and key: the same row has the same number in any partitioning."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def weighted_choice(u: Column, weights: Sequence[tuple[str, float]]) -> Column:
    total = sum(w for _, w in weights)
    if total <= 0 or any(w < 0 for _, w in weights):
        raise ValueError("weights must not be negative and must have a positive sum")
    out, run = None, 0.0
    for name, w in weights[:-1]:
        run += w / total
        out = F.when(u < run, name) if out is None else out.when(u < run, name)
    return F.lit(weights[-1][0]) if out is None else out.otherwise(weights[-1][0])


# ---------------------------------------------------------------- vocabularies


def first_seen_vocabulary(symbols: DataFrame, order: Sequence[str], symbol: str, reserved: int = 2) -> DataFrame:
    """symbol, id by first appearance after the reserved ids."""
    firsts = symbols.groupBy(symbol).agg(F.min(F.struct(*order)).alias("at"))
    return row_numbers(firsts, ["at", symbol]).select(symbol, (F.col("number") + reserved).cast("int").alias("id"))


def vocabulary_fingerprint(vocabulary: DataFrame) -> DataFrame:
    """One row: fingerprint (SHA-256 of the lines id, tab, token by id), size, real_len (without disambiguation tokens).

    A SHA-256 reads its input in order: the driver streams it, a thousand lines at a time, and holds no more than the
    lines of one range of ids.
    """
    sha = hashlib.sha256()
    line = F.concat(F.col("id").cast("string"), F.lit("\t"), "token", F.lit("\n"))
    lines = vocabulary.groupBy(F.floor(F.col("id") / 1000).alias("part")).agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("x"))
    for row in lines.select("part", F.array_join(F.col("x.line"), "").alias("text")).orderBy("part").select("text").toLocalIterator():
        sha.update(row["text"].encode())
    return vocabulary.agg(F.lit(sha.hexdigest()).alias("fingerprint"), F.count("*").alias("size"), F.count_if(~T.disambiguation(F.col("token"))).alias("real_len"))


def check_vocabulary(vocabulary: DataFrame, output_dim: int | None = None, fingerprint: str | None = None) -> None:
    """Refuses a vocabulary of another size than the model, or another identity than its card; unknowns pass."""
    one = vocabulary_fingerprint(vocabulary).first()
    if output_dim is not None and output_dim != one["real_len"]:
        raise ValueError(f"the model has {output_dim} outputs, the vocabulary {one['real_len']}")
    if fingerprint is not None and fingerprint != one["fingerprint"]:
        raise ValueError("the vocabulary is not the one of the model card")


def with_targets(rows: DataFrame, targets: DataFrame, text: str = "text") -> DataFrame:
    """ids of each text; [1] where it has none."""
    return rows.join(targets, text, "left").withColumn("ids", F.coalesce("ids", F.array(F.lit(1))))


# ---------------------------------------------------------------- models


def infer(rows: DataFrame, load: Callable[[], Callable], column: str, out: str, kind: str) -> DataFrame:
    """Adds out: the model's result of a column.  load runs once per worker task; its result maps a pandas Series to one.

    Rows should be sorted by length within partitions (length_sorted) when the model pads batches.
    """

    def run(batches):
        model = load()
        for b in batches:
            yield b.assign(**{out: model(b[column])})

    return rows.mapInPandas(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + [f"`{out}` {kind}"]))


def infer_padded(rows: DataFrame, load: Callable[[], Callable], column: str, out: str, kind: str, batch: int = 16) -> DataFrame:
    """infer() for models that take a batch of frame arrays filled up to the longest, and their lengths.

    Rows are sorted by length within partitions, so a batch has little filling.
    """

    def run(batches):
        model = load()
        for b in batches:
            made = []
            for i in range(0, len(b), batch):
                each = [np.array(list(map(np.asarray, x)), dtype=np.float32) for x in b[column].iloc[i : i + batch]]
                lengths = np.array([len(x) for x in each])
                filled = np.zeros((len(each), lengths.max(), *next((x.shape[1:] for x in each if len(x)), (0,))), np.float32)
                for row, x in zip(filled, each, strict=True):
                    row[: len(x)] = x
                made += list(model(filled, lengths))
            yield b.assign(**{out: made})

    sorted_ = rows.withColumn("__n", F.size(column)).sortWithinPartitions("__n").drop("__n")
    return sorted_.mapInPandas(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + [f"`{out}` {kind}"]))


def infer_both(rows: DataFrame, first: Callable[[], Callable], second: Callable[[], Callable], column: str, kind: str = "string") -> DataFrame:
    """Adds hyp1 and hyp2 of two models, one after the other: no worker holds both."""
    return infer(fixed(infer(rows, first, column, "hyp1", kind)), second, column, "hyp2", kind)


def length_sorted(rows: DataFrame, length: str) -> DataFrame:
    return rows.sortWithinPartitions(length)


def mux(sources: Sequence[tuple[DataFrame, float]], key: str, seed: str = "mux") -> DataFrame:
    """Rows of all sources in one frame with a position that interleaves them by weight; sort by it to read them mixed."""
    out = None
    for rows, weight in sources:
        if weight <= 0:
            raise ValueError("weights must be positive")
        one = rows.withColumn("position", -F.log(1 - uniform(seed, F.col(key))) / F.lit(float(weight)))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no sources")
    return out


def duration_buckets(rows: DataFrame, duration: str, buckets: int, longest: float) -> DataFrame:
    """Adds bucket (0 to buckets - 1) of equal width up to the longest duration."""
    return rows.withColumn("bucket", F.least(F.floor(F.col(duration) * buckets / longest), F.lit(buckets - 1)).cast("int"))


def file_digests(files: DataFrame) -> DataFrame:
    """path, sha256 of each file's content."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))

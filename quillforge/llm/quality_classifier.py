"""Quality classifier over document statistics.

Random Fourier features approximate a Gaussian kernel over FEATURES; every partition of the training rows adds up
its normal equations, the sums are solved for ridge scores, and isotonic regression on rows that the ridge did not
see turns scores into probabilities.  Label, language, source and id are never inputs of a score.

Fitting uses at most about MAX_LABELS labelled rows (a hash sample where there are more), of which every
CALIBRATION-th is kept for calibration: the driver sees MAX_PARTS partial sums of (WIDTH + 1)^2 numbers and the
calibration scores.  Scoring is one pass without an exchange.  Ties: equal texts have equal scores.

Null and empty texts have all statistics zero and are scored like any text.  Repeated rows and null ids are scored
row by row.  Without labels, or with one class only, the score is the share of label 1 (one half without labels).
Repeated labels of a document count as often as they stand; null labels are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from .common import bounded_batches, cut_lineage, passed, string_parts, table
from .text_stats import all_counts

MAX_LABELS = 20_000
CALIBRATION = 4
MAX_PARTS = 16
WIDTH = 256
RIDGE = 1e-3
SEED = 17
FEATURES = ("size", "word_length", "symbols", "dup_lines", "repeats", "capitals", "digits", "points", "shouts", "bars", "types", "wordless", "lines", "wide", "echoes")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text."""
    c = all_counts(data, offsets)
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    some = c["n_words"] > 0
    columns = [
        np.log1p(c["n_words"]), np.minimum(c["word_chars"] / words, 40), np.minimum(c["n_symbols"] / words, 5), c["n_dup_lines"] / np.maximum(c["lines"], 1),
        c["n_repeat_words"] / words, c["upper"] / chars, c["digits"] / chars, c["points"] / chars, np.minimum(c["shouts"] / words, 3), np.minimum(c["bars"] / words, 3),
        c["types"] / words * some, c["wordless"] / words, np.minimum(c["lines"] / words, 1), c["wide"] / chars, c["echoes"] / words,
    ]
    return np.column_stack(columns).astype(np.float64)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # random frequencies, features x WIDTH
    phase: np.ndarray
    ridge: np.ndarray  # WIDTH + 1
    knots: np.ndarray  # raw scores
    levels: np.ndarray  # calibrated

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2.0 / len(self.phase)) * np.cos(((x - self.mean) / self.scale) @ self.weights + self.phase)
        return np.column_stack([z, np.ones(len(z))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        level = np.interp(raw, self.knots, self.levels)
        if len(self.knots) == 1:
            return level
        # a small share of the raw score keeps the order within a level
        return np.clip(0.99 * level + 0.01 / (1 + np.exp(-6 * (raw - 0.5))), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; each block is a knot at its mean x with its mean y."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)) % 3 == 1


def feature_rows(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """The kept columns and x, the array of FEATURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(*string_parts(batch.column("__text")))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], flat], names=[*keep, "x"])

    schema = StructType([docs.schema[c] for c in keep]).add("x", ArrayType(DoubleType()))
    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInArrow(run, schema)


def _x(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten()).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", max_labels: int = MAX_LABELS) -> Model:
    """Labels are (key, label); those held out by the caller must not be among them."""
    bounded_batches(docs.sparkSession)
    marked = labels.select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y")).filter("__k is not null and __y is not null")
    n = marked.count()
    if n > max_labels:
        marked = marked.filter(F.pmod(F.xxhash64(F.lit(SEED), "__k"), F.lit(1_000_000)) < F.lit(math.floor(1e6 * max_labels / n)))
    # the sample's size is bounded by max_labels, so it may be broadcast
    joined = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(F.broadcast(marked), "__k")
    fold = joined.withColumn("__c", F.pmod(F.xxhash64(F.lit("fold"), "__k"), F.lit(CALIBRATION)) == 0)
    # the features of the bounded sample go to few tasks; texts are read by as many as there are
    rows = cut_lineage(feature_rows(fold, "__t", ["__y", "__c"]).repartition(MAX_PARTS).sortWithinPartitions("__y", "x"))
    stats = rows.select("__y", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    mean, scale = np.zeros(len(FEATURES)), np.ones(len(FEATURES))
    for r in stats:
        mean[r["i"]], scale[r["i"]] = r["m"], max(r["s"], 1e-6)
    rng = np.random.default_rng(SEED)
    weights = rng.normal(size=(len(FEATURES), WIDTH)) / math.sqrt(len(FEATURES))
    phase = rng.uniform(0, 2 * np.pi, WIDTH)
    share = rows.agg(F.avg("__y")).first()[0]
    empty = Model(mean, scale, weights, phase, np.zeros(WIDTH + 1), np.zeros(1), np.full(1, 0.5 if share is None else share))
    if share in (None, 0.0, 1.0):
        return empty

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((WIDTH + 1, WIDTH + 1)), np.zeros(WIDTH + 1)
        for batch in batches:
            z = empty.fourier(_x(batch))
            a += z.T @ z
            b += z.T @ np.asarray(batch.column("__y")).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()])], names=["a", "b"])

    sums = rows.filter("not __c").select("__y", "x").mapInArrow(normal, "a binary, b binary").collect()  # at most MAX_PARTS rows
    a = sum(np.frombuffer(r["a"]).reshape(WIDTH + 1, WIDTH + 1) for r in sums)
    b = sum(np.frombuffer(r["b"]) for r in sums)
    ridge = np.linalg.solve(a + RIDGE * max(a[-1, -1], 1.0) * np.eye(WIDTH + 1), b)
    fitted = Model(mean, scale, weights, phase, ridge, np.zeros(1), np.zeros(1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(fitted.raw(_x(batch))), batch.column("__y")], names=["s", "y"])

    check = rows.filter("__c").select("__y", "x").mapInArrow(scored, "s double, y int").orderBy("s", "y").collect()  # a CALIBRATION-th of the sample
    if not check:
        return Model(mean, scale, weights, phase, ridge, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    knots, levels = isotonic(np.array([r["s"] for r in check]), np.array([float(r["y"]) for r in check]))
    return Model(mean, scale, weights, phase, ridge, knots, levels)


def score(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns of keep, score (0 to 1) and predicted (1 if score >= 0.5).  Outputs go before keep."""
    bounded_batches(docs.sparkSession)
    keep = passed(keep, ("score", "predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(features(*string_parts(batch.column("__text"))))
            columns = [*[batch.column(c) for c in keep], pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "score", "predicted"])

    schema = StructType([docs.schema[c] for c in keep]).add("score", "double").add("predicted", "integer")
    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInArrow(run, schema)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

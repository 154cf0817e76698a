"""Sinks: manifests, text corpora, per-file transcripts, reports and cards."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


def manifest(df: DataFrame, path: str) -> None:
    """JSON lines, gzip."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def features(df: DataFrame, path: str, by: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def corpus_text(df: DataFrame, path: str, text: str = "text", split: str | None = None) -> None:
    """One text per line; of the training split only, where there is a split column."""
    rows = df.filter(F.col(split) == "train") if split else df
    rows.select(F.regexp_replace(text, r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(path)


def tsv(df: DataFrame, path: str, *order) -> None:
    """A sorted report; reports are small, so they are one file."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", False).csv(path)


def per_file(df: DataFrame, path: str, key: str = "recording_id", text: str = "text", seconds: str | None = None) -> None:
    """A text file per recording, and beside them one line of JSON: files, characters and seconds of audio."""
    df.select(key, text).write.mode("overwrite").partitionBy(key).text(f"{path}/texts")
    counts = [F.count_distinct(key).alias("files"), F.sum(F.length(text)).alias("characters")]
    card(df.agg(*counts, *([F.sum(seconds).alias("audio_s")] if seconds else [])), f"{path}/summary")


@F.pandas_udf(BinaryType())
def wav_bytes(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """16-bit mono WAV files; a null is no file."""

    def one(x, r):
        if x is None:
            return None
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 2, int(r), 0, "NONE", ""))
            w.writeframes(np.asarray(x).astype("<i2").tobytes())
        return out.getvalue()

    return pd.Series([one(x, r) for x, r in zip(samples, rate, strict=True)])


def wav_files(df: DataFrame, path: str, key: str = "recording_id", samples: str = "samples", rate: int = 16_000) -> DataFrame:
    """Writes key, path and content of each recording as a WAV file's bytes, and returns the manifest (key, path, bytes).

    Files go into a table by key, as many small files in a folder would slow down every listing.
    """
    files = df.select(key, F.concat(F.col(key).cast("string"), F.lit(".wav")).alias("path"), wav_bytes(F.col(samples), F.lit(rate)).alias("content"))
    files.filter("content is not null").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).select(key, "path", F.octet_length("content").alias("bytes"))


def golden(df: DataFrame, path: str, values: str, **meta) -> None:
    """A golden series for comparisons in other engines: little-endian 32-bit floats by row order, and its description.

    A golden series is one row with an array, small by nature.
    """
    if df.limit(2).count() != 1:
        raise ValueError("a golden series is one row")
    packed = F.pandas_udf(lambda s: s.map(lambda x: np.asarray(x, "<f4").tobytes()), BinaryType())
    df.select(packed(F.col(values)).alias("content"), F.size(values).alias("n"), *[F.lit(v).alias(k) for k, v in meta.items()]).write.mode("overwrite").parquet(path)


def error_stats(pairs: DataFrame, path: str, key: str = "u", ref: str = "ref", hyp: str = "hyp") -> None:
    """A line per utterance: key, reference words, hits, substitutions, deletions, insertions."""
    from quillforge.functions.align import operations

    each = pairs.select(F.col(key).alias("key"), F.size(ref).alias("n"), operations(F.col(ref), F.col(hyp)).alias("o"))
    each.select("key", "n", "o.hits", "o.substitutions", "o.deletions", "o.insertions").write.mode("overwrite").option("sep", "\t").csv(path)


def card(df: DataFrame, path: str) -> None:
    """A one-row frame as JSON."""
    if df.limit(2).count() != 1:
        raise ValueError("a card has one row")
    df.coalesce(1).write.mode("overwrite").json(path)


def markdown_report(df: DataFrame, title: str, most: int = 100) -> str:
    """A table of at most `most` rows; more rows are an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows), ""])


def phoneme_targets(df: DataFrame, path: str) -> None:
    """text, ids -> one JSON object per text, not escaped to ASCII."""
    df.select(F.to_json(F.struct("text", "ids")).alias("value")).write.mode("overwrite").text(path)

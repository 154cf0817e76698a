"""Sources: every schema is declared, nothing is inferred; an empty source is an error where a pipeline needs rows."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, ShortType, StringType, StructField, StructType

from quillforge.functions import text as T

SHARD = "audio struct<bytes: binary, path: string>, path string, sentence string, accent string"
VOTED = "file_path string, text string, up_votes string, down_votes string, dataset string"
CUTS = "id string, recording_id string, start double, duration double, channel int, supervisions array<struct<id: string, recording_id: string, start: double, duration: double, channel: int, language: string, text: string>>"
# Audio file extensions of the folder scan.
AUDIO = ("wav", "mp3", "flac", "ogg", "opus", "m4a", "aac", "wma", "webm", "mp4")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The frame itself; an error if it has no rows."""
    if df.isEmpty():
        raise ValueError(f"{what}: no rows")
    return df


def parquet_columns(spark: SparkSession, path: str, columns: Sequence[str | Column]) -> DataFrame:
    """Only these columns are read."""
    return spark.read.parquet(path).select(*columns)


def unified_text(spark: SparkSession, sources: dict[str, tuple[str, str]]) -> DataFrame:
    """Sources as name -> (path, text column): source, text."""
    out = None
    for name, (path, column) in sources.items():
        one = spark.read.parquet(path).select(F.lit(name).alias("source"), F.col(column).alias("text"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no sources")
    return out


def csv_table(spark: SparkSession, path: str | list[str], schema: str = VOTED) -> DataFrame:
    """With header; columns that the file lacks are null."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def json_lines(spark: SparkSession, path: str, schema: str = CUTS, parts: int | None = None) -> DataFrame:
    """JSON lines, gzip too.  A gzip file is one split, so its rows may be dealt into parts."""
    df = spark.read.schema(schema).json(path)
    return df.repartition(parts) if parts else df


def files(spark: SparkSession, path: str, extensions: Sequence[str] = AUDIO, content: bool = True) -> DataFrame:
    """path, recording_id, length and content of files with one of the extensions, in any case."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    df = df.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(list(extensions)))
    return df.select("path", T.stem(F.col("path")).alias("recording_id"), "length", *(["content"] if content else []))


@F.pandas_udf(StructType([StructField("samples", ArrayType(ShortType())), StructField("rate", IntegerType()), StructField("channels", IntegerType()), StructField("error", StringType())]))
def decode_wav(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """16-bit PCM; several channels are interleaved.  What cannot be read has an error and null samples."""
    for s in batches:
        rows = []
        for raw in s:
            try:
                with wave.open(io.BytesIO(raw)) as w:
                    if w.getsampwidth() != 2:
                        raise ValueError("not 16-bit PCM")
                    data = np.frombuffer(w.readframes(w.getnframes()), "<i2")
                    rows.append((data.tolist(), w.getframerate(), w.getnchannels(), None))
            except Exception as e:  # noqa: BLE001  a bad file is a row with an error
                rows.append((None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["samples", "rate", "channels", "error"])


def require_format(wav: Column, rate: int = 16_000, channels: int = 1) -> Column:
    """Error text of a decoded file that has another rate or channel count; null if it fits."""
    return (
        F.when(wav["error"].isNotNull(), wav["error"])
        .when(wav["rate"] != rate, F.concat(F.lit("sample rate "), wav["rate"].cast("string")))
        .when(wav["channels"] != channels, F.concat(F.lit("channels "), wav["channels"].cast("string")))
    )


def recogs(lines: DataFrame, value: str = "value") -> DataFrame:
    """utt, ref, hyp from lines `utt:\\tref=['a', 'b']` and `utt:\\thyp=[...]`; other lines are ignored.

    An utterance without its pair, or no lines at all, is an error when the result is used.
    """
    pattern = r"^(.*?):\t(ref|hyp)=\[(.*)\]\s*$"
    parts = lines.select(F.regexp_extract(value, pattern, 1).alias("utt"), F.regexp_extract(value, pattern, 2).alias("side"), F.regexp_extract(value, pattern, 3).alias("list"), F.col(value).rlike(pattern).alias("ok")).filter("ok")
    words = F.transform(F.regexp_extract_all("list", F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0)), lambda w: F.regexp_replace(F.substring(w, 2, 1_000_000), r"""['"]$""", ""))
    wide = parts.select("utt", "side", words.alias("words")).groupBy("utt").pivot("side", ["ref", "hyp"]).agg(F.first("words"))
    unpaired = F.col("ref").isNull() | F.col("hyp").isNull()
    return wide.select("utt", F.when(unpaired, F.raise_error(F.concat(F.lit("unpaired utterance "), "utt"))).otherwise(F.col("ref")).alias("ref"), "hyp")


def transcript_blocks(lines: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, start, text, stop: lines after a time line belong to it; empty blocks are left out; stop is the next start."""
    at = T.clock_seconds(F.col(value))
    w = Window.partitionBy(key).orderBy(order)
    marked = lines.select(key, order, value, at.alias("at")).withColumn("block", F.count("at").over(w))
    body = marked.filter("block > 0").groupBy(key, "block").agg(
        F.max("at").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("at").isNull() & (F.trim(value) != ""), F.struct(order, F.trim(value).alias("t"))))), lambda x: x["t"]), " ").alias("text"),
    )
    next_start = F.lead("start").over(Window.partitionBy(key).orderBy("block"))
    return body.withColumn("stop", next_start).filter("text <> ''").drop("block")


def vocabulary_by_line(lines: DataFrame, order: str = "line", value: str = "value") -> DataFrame:
    """id, token: blank lines do not count, ids are line numbers from 0."""
    from quillforge.operators.corpus import row_numbers

    full = lines.filter(F.trim(value) != "").select(order, T.vocabulary_token(F.col(value)).alias("token"))
    return row_numbers(full, [order]).select(F.col("number").cast("int").alias("id"), "token")


def vocabulary_by_id(lines: DataFrame, value: str = "value") -> DataFrame:
    """id, token of lines with exactly two parts."""
    parts = F.filter(F.split(value, r"\s+"), lambda x: x != "")
    return lines.select(parts.alias("p")).filter(F.size("p") == 2).select(F.col("p")[1].cast("int").alias("id"), F.col("p")[0].alias("token"))


def lexicon(lines: DataFrame, value: str = "value") -> DataFrame:
    """Distinct normalised words."""
    return lines.select(F.explode(T.tokens(T.normalize_train_target(F.col(value)))).alias("word")).distinct()


def soak_windows(spark: SparkSession, path: str) -> DataFrame:
    schema = "label string, model string, threads int, soak_min double, windows array<struct<t_s: int, rtfx: double, wall_ms: double, n: int, load1: double, temp_c: double>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select("label", "model", "threads", F.explode("windows").alias("w")).select("label", "model", "threads", "w.*")


def card_field(spark: SparkSession, path: str, field: str) -> str | None:
    """One field of a JSON card, as text; None where the card has none."""
    return spark.read.option("wholetext", True).text(path).select(F.get_json_object("value", f"$.{field}").alias("x")).first()["x"]


def reports(spark: SparkSession, folder: str, expected: Sequence[str]) -> DataFrame:
    """name, text, error of each expected report; one that is not there has an error and no text."""
    names = spark.createDataFrame([(n,) for n in expected], "name string")
    there = spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("name"), F.decode("content", "UTF-8").alias("text"))
    missing = F.when(F.col("text").isNull(), F.concat(F.lit("missing report "), F.col("name")))
    return names.join(there, "name", "left").select("name", "text", missing.alias("error"))


def tone(spark: SparkSession, seconds: float, hz: float = 440.0, rate: int = 16_000, amplitude: float = 0.5) -> DataFrame:
    """One row: samples of a sine."""
    n = int(seconds * rate)
    wave_ = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.sin(i * (2 * np.pi * hz / rate)) * (amplitude * 32767)).cast("smallint"))
    return spark.range(1).select(wave_.alias("samples"))

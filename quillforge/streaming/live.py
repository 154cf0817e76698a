"""Streams over files: windows, sessions, interval joins, and stateful operators with their batch twins."""

from __future__ import annotations

import os.path
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions.align import common_prefix
from quillforge.storage import fresh_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: Latest readings of a backlog that its percentiles and trend are taken from.
HISTORY = 4096


def event_stream(spark: SparkSession, sf_dir: str, lateness: str = "30 days") -> DataFrame:
    """Events as a stream with a watermark.  Time zones: the session's; watermarks need TIMESTAMP."""
    # a pattern, as a stream's plain path must be a folder and the table may be one file
    lines = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/event[s].parquet")
    return lines.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all input there is, and returns its result: all rows written, or the last table where the mode
    is complete.

    Batches and the stream's checkpoint are written below the shared folder; a batch that is tried again replaces what
    its first try has written.
    """
    spark = stream.sparkSession
    root = fresh_folder(spark, "stream")
    last = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{number}")
        last[:] = [number]

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    writer.start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    reader = spark.read.schema(stream.schema)
    return reader.parquet(f"{root}/out/{last[0]}") if mode == "complete" else reader.option("recursiveFileLookup", "true").parquet(f"{root}/out")


def tumbling_counts(events: DataFrame, width: str) -> DataFrame:
    return events.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def interval_join(events: DataFrame, first: str, second: str, seconds: int) -> DataFrame:
    """Pairs of a user's events of two types, the second at most so many seconds after the first.

    Events meet by user and by span of that length, so a user's events are dealt over time: a first event looks into its
    own span and the next one, a second event is in one.
    """
    span = lambda ts: F.floor(F.unix_seconds(ts) / seconds)
    a = events.filter(F.col("event_type") == first).select("user_id", F.col("ts").alias("ts_a"))
    a = a.select("*", F.explode(F.array(span(F.col("ts_a")), span(F.col("ts_a")) + 1)).alias("span_a"))
    b = events.filter(F.col("event_type") == second).select(F.col("user_id").alias("user_b"), F.col("ts").alias("ts_b"), span(F.col("ts")).alias("span_b"))
    met = a.join(b, F.expr(f"user_id = user_b and span_a = span_b and ts_b >= ts_a and ts_b <= ts_a + interval {seconds} seconds"))
    return met.drop("span_a", "span_b")


# ---------------------------------------------------------------- backlog


def readings(history: np.ndarray) -> tuple[int, int, int, bool]:
    """Nearest-rank p50, p95 and p99 of the latest readings, and whether they grow: four at least, the mean of the later
    half over that of the first, and the last one not 0."""
    n, half = len(history), len(history) // 2
    ordered = np.sort(history)
    ranks = [int(ordered[max(-(-p * n // 100), 1) - 1]) if n else 0 for p in (50, 95, 99)]
    grows = n >= 4 and history[half:].mean() > history[:half].mean() and history[-1] > 0
    return ranks[0], ranks[1], ranks[2], bool(grows)


def backlog(events: DataFrame) -> DataFrame:
    """user_id, produced, consumed, backlog, p50, p95, p99, growing after each batch.

    The state of a key is two counters and its latest HISTORY readings, one for each event in order of time (ties by
    event_id) within a batch.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        produced, consumed, history = state.get if state.exists else (0, 0, [])
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        used = (rows["event_type"] == "purchase").to_numpy()
        made, spent = produced + np.cumsum(~used), consumed + np.cumsum(used)
        kept = np.concatenate([np.asarray(history, np.int64), np.maximum(made - spent, 0)])[-HISTORY:]
        state.update((int(made[-1]), int(spent[-1]), kept.tolist()))
        names = ("user_id", "produced", "consumed", "backlog", "p50", "p95", "p99", "growing")
        yield pd.DataFrame([(key[0], int(made[-1]), int(spent[-1]), int(kept[-1]), *readings(kept))], columns=names)

    out = "user_id long, produced long, consumed long, backlog long, p50 long, p95 long, p99 long, growing boolean"
    return events.groupBy("user_id").applyInPandasWithState(step, out, "produced long, consumed long, history array<long>", "update", "NoTimeout")


def run_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = run_to_table(backlog(event_stream(spark, sf_dir).select("user_id", "event_id", "ts", "event_type")), "update")
    latest = F.max_by(F.struct("produced", "consumed", "backlog", "p50", "p95", "p99", "growing"), F.col("produced") + F.col("consumed"))
    return seen.groupBy("user_id").agg(latest.alias("x")).select("user_id", "x.*")


# ---------------------------------------------------------------- live decoding

# A repeated first word within half a second of the last committed one is dropped; times compare with this slack.
REPEAT_S, SLACK = 0.5, 1e-6
# Seconds that a decode window keeps, left context before the last committed word, and least audio to decode.
KEEP_S, CONTEXT_S, LEAST_S = 12.0, 2.0, 0.3
# A caption line ends after so many words, or after so many quiet seconds with nothing tentative.
LINE_WORDS, QUIET_S = 16, 1.2


class Heard(NamedTuple):
    """What a live decoder knows of a stream: the last committed word and its time, the words that only the latest
    hypothesis has, where its window starts, its open caption line and when that last grew."""

    word: str | None = None
    until: float = -np.inf
    tail: list = []
    start: float = 0.0
    line: list = []
    grown: float = 0.0


HEARD = "word string, until double, tail array<string>, start double, line array<string>, grown double"


def agree(heard: Heard, words: list, times: list) -> tuple[Heard, list]:
    """LocalAgreement-2: what two hypotheses in a row begin with, after the words committed before, is committed.

    Times rise.  The last committed word may come again at the start of a window that was cut; it is not committed twice.
    """
    at = bisect_right(times, heard.until + SLACK)
    if at < len(words) and words[at] == heard.word and times[at] < heard.until + REPEAT_S:
        at += 1
    agreed = os.path.commonprefix([list(words[at:]), list(heard.tail)])
    end = at + len(agreed)
    after = heard._replace(tail=list(words[end:]))
    return (after._replace(word=words[end - 1], until=times[end - 1]) if agreed else after), agreed


def window_start(heard: Heard, now: float) -> float:
    """Where the decode window starts next: a window of over KEEP_S seconds is cut CONTEXT_S before the last committed word,
    if there is one; nothing else is ever dropped."""
    if now - heard.start <= KEEP_S or heard.word is None:
        return heard.start
    return max(heard.start, heard.until - CONTEXT_S)


def ends_line(line: list, tentative: list, quiet: float) -> bool:
    return len(line) >= LINE_WORDS or (bool(line) and not tentative and quiet > QUIET_S)


def listen(heard: Heard, words: list, times: list, now: float) -> tuple[Heard, list, list | None]:
    """The state after a hypothesis of the window up to now, the newly committed words, and the caption line if it ends.

    Less than LEAST_S of audio is not decoded, and its hypothesis is ignored.
    """
    if now - heard.start < LEAST_S:
        return heard, [], None
    heard, new = agree(heard, words, times)
    heard = heard._replace(start=window_start(heard, now), line=[*heard.line, *new], grown=now if new else heard.grown)
    if ends_line(heard.line, heard.tail, now - heard.grown):
        return heard._replace(line=[], grown=now), new, heard.line
    return heard, new, None


def _saved(heard: Heard) -> tuple:
    return (heard.word, float(heard.until), list(map(str, heard.tail)), float(heard.start), list(map(str, heard.line)), float(heard.grown))


def _captions(key: tuple, rows: pd.DataFrame, heard: Heard) -> tuple[Heard, pd.DataFrame]:
    out = []
    for seq, words, times, now in rows.sort_values("seq")[["seq", "words", "times", "now"]].itertuples(index=False):
        heard, new, line = listen(heard, list(words), list(times), now)
        out.append((key[0], seq, [str(w) for w in new], [str(w) for w in heard.tail], heard.start, None if line is None else " ".join(line)))
    return heard, pd.DataFrame(out, columns=["stream_id", "seq", "committed", "tail", "start", "line"])


CAPTIONS = "stream_id long, seq long, committed array<string>, tail array<string>, start double, line string"


def captions(hypotheses: DataFrame) -> DataFrame:
    """A live decoder over a stream of hypotheses (stream_id, seq, words, times, now: the seconds heard so far).

    Per hypothesis: newly committed words, the tentative ones, where the decode window starts next, and the caption line
    if one ends.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        heard, out = _captions(key, pd.concat(list(batches)), Heard(*state.get) if state.exists else Heard())
        state.update(_saved(heard))
        yield out

    return hypotheses.groupBy("stream_id").applyInPandasWithState(step, CAPTIONS, HEARD, "append", "NoTimeout")


def captions_batch(hypotheses: DataFrame) -> DataFrame:
    """The batch twin of captions.  A stream's hypotheses are one group."""
    return hypotheses.groupBy("stream_id").applyInPandas(lambda key, rows: _captions(key, rows, Heard())[1], CAPTIONS)


def agreement(hypotheses: DataFrame) -> DataFrame:
    """stream_id, committed, tail after each batch of a stream of hypotheses (stream_id, seq, words, times)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done, heard = (list(state.get[0]), Heard(*state.get[1:])) if state.exists else ([], Heard())
        for words, times in pd.concat(list(batches)).sort_values("seq")[["words", "times"]].itertuples(index=False):
            heard, new = agree(heard, list(words), list(times))
            done += new
        state.update(([str(w) for w in done], *_saved(heard)))
        yield pd.DataFrame({"stream_id": [key[0]], "committed": [done], "tail": [heard.tail]})

    return hypotheses.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, committed array<string>, tail array<string>", f"done array<string>, {HEARD}", "update", "NoTimeout")


def agreement_batch(hypotheses: DataFrame) -> DataFrame:
    """The batch twin, by column functions: one row per stream after its last hypothesis.  A stream's hypotheses are one group."""
    start = F.struct(F.array().cast("array<string>").alias("committed"), F.lit(float("-inf")).alias("until"), F.array().cast("array<string>").alias("tail"))

    def step(s, h):
        fresh = F.filter(h["x"], lambda x: x["times"] > s["until"] + SLACK)
        first = F.get(fresh, F.lit(0))
        again = F.coalesce((first["words"] == F.try_element_at(s["committed"], F.lit(-1))) & (first["times"] < s["until"] + REPEAT_S), F.lit(False))
        fresh = F.when(again, F.slice(fresh, 2, F.greatest(F.size(fresh), F.lit(1)))).otherwise(fresh)
        n = F.size(common_prefix(fresh["words"], s["tail"]))
        return F.struct(
            F.concat(s["committed"], F.slice(fresh["words"], F.lit(1), n)).alias("committed"),
            F.coalesce(F.get(fresh, n - 1)["times"], s["until"]).alias("until"),
            F.slice(fresh["words"], n + 1, F.size(fresh)).alias("tail"),
        )

    ordered = F.array_sort(F.collect_list(F.struct("seq", F.arrays_zip("words", "times").alias("x"))))
    last = hypotheses.groupBy("stream_id").agg(F.aggregate(ordered, start, step).alias("s"))
    return last.select("stream_id", "s.committed", "s.tail")


def prefixes(conversations: DataFrame) -> DataFrame:
    """Each turn's text so far is a hypothesis: growing prefixes to its end, three words a step and four steps at least.  A
    word takes 0.6 seconds."""
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    turns = conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), words.alias("w"))
    turns = turns.withColumn("seq", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(4), F.ceil(F.size("w") / 3).cast("int")))))
    hyps = turns.select("stream_id", F.col("seq").cast("long").alias("seq"), F.slice("w", F.lit(1), F.col("seq") * 3).alias("words"))
    return hyps.withColumns({"times": F.transform("words", lambda w, i: (i * 0.6).cast("double")), "now": (F.col("seq") * 1.8).cast("double")})


def committed_words(conversations: DataFrame) -> DataFrame:
    return agreement_batch(prefixes(conversations)).select("stream_id", F.size("committed").alias("committed"), F.size("tail").alias("tail"))


# ---------------------------------------------------------------- windows of samples


def count_windows(chunks: DataFrame, width: int = 512) -> DataFrame:
    """stream_id, window, samples: complete windows of `width` samples; what is left over waits for the next chunk.

    Count windows are no event-time windows, so the remainder is the state of the key.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, rest = state.get if state.exists else (0, [])
        rows = pd.concat(list(batches)).sort_values("seq")
        flat = np.concatenate([np.asarray(rest, np.int64), *(np.asarray(x, np.int64) for x in rows["samples"])])
        n = len(flat) // width
        state.update((seen + n, flat[n * width :].tolist()))
        yield pd.DataFrame({"stream_id": [key[0]] * n, "window": range(seen, seen + n), "samples": flat[: n * width].reshape(n, width).tolist()})

    return chunks.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, window long, samples array<int>", "seen long, rest array<int>", "append", "NoTimeout")


def hops(events: DataFrame, hop: str = "500 milliseconds") -> DataFrame:
    """Rows per stream and hop of event time: what triggers a decode."""
    return events.groupBy("user_id", F.window("ts", hop).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.end").alias("due"), "n")


def single_flight(busy: Callable[[], bool], run: Callable[[], None]) -> bool:
    """Runs unless the work before is still under way; whether it ran."""
    if busy():
        return False
    run()
    return True

"""Command lines: python -m quillforge.cli COMMAND ...

Every command reads tables or files by path, runs the operators and prints or writes their result; an audit that finds a
leak ends with 1.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions import quality as Q
from quillforge.functions import stats as S
from quillforge.functions import text as T
from quillforge.operators import corpus as C
from quillforge.sources import readers as R
from quillforge.sources import sinks as K


def _recogs(spark: SparkSession, path: str) -> DataFrame:
    return R.recogs(spark.read.text(path))


def error_rate(spark: SparkSession, a) -> int:
    """Word error rate of a recogs file."""
    S.corpus_wer(_recogs(spark, a.recogs), "ref", "hyp").show()
    return 0


def compare(spark: SparkSession, a) -> int:
    """Interval of the gain of a candidate over a base on the same utterances."""
    rows = S.paired_errors(_recogs(spark, a.base), _recogs(spark, a.candidate), "utt")
    S.paired_bootstrap(rows, "utt", "base", "candidate", "n", a.boot, a.seed).show()
    return 0


def prepare(spark: SparkSession, a) -> int:
    """A manifest of the voted rows whose text is not empty, and their counts by reason."""
    C.guard_split(a.split, a.min_net_votes)
    rows = R.require_rows(R.csv_table(spark, a.table, R.VOTED), a.table)
    rows = rows.withColumn("text", T.normalize_train_target(F.col("text"))).withColumn("split", F.lit(a.split))
    there = R.files(spark, a.audio_root, content=False).select(F.col("path").alias("audio"), "recording_id")
    joined = rows.withColumn("recording_id", T.stem(F.col("file_path"))).join(there, "recording_id", "left")
    votes = Q.net_votes(F.col("up_votes"), F.col("down_votes"))
    C.corpus_counts(joined, F.col("text"), votes, a.min_net_votes, F.col("audio").isNotNull()).show()
    kept = joined.filter("text <> '' and audio is not null")
    if a.min_net_votes is not None:
        kept = kept.filter(votes >= a.min_net_votes)
    K.manifest(C.numbered(kept, f"{a.split}_", ["recording_id", "file_path"], 7), a.out)
    return 0


def overlap(spark: SparkSession, a) -> int:
    """Keys that splits share, and rows without a key; the exit code is 1 if any is shared."""
    rows = spark.read.parquet(a.table)
    leaks = C.split_overlap(rows, a.split, a.corpus, a.key)
    leaks.show()
    C.unverifiable(rows, a.split, a.corpus, a.key).show()
    return C.leak_exit_code(leaks)


def leaks(spark: SparkSession, a) -> int:
    """Ids that are tokens of paths; the exit code is 1 if there are any."""
    found = C.token_leaks(spark.read.parquet(a.paths), a.path, spark.read.parquet(a.ids), a.id)
    found.show()
    return C.leak_exit_code(found)


def phonemes(spark: SparkSession, a) -> int:
    """Phoneme targets of a table (text, phonemes): ids by first appearance, by text."""
    rows = R.require_rows(spark.read.parquet(a.table).select("text", "phonemes").distinct(), a.table)
    symbols = rows.select("text", F.posexplode(T.phoneme_symbols(F.col("phonemes"))).alias("pos", "symbol"))
    ids = C.first_seen_vocabulary(symbols, ["text", "pos"], "symbol")
    coded = symbols.join(ids, "symbol").groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    K.phoneme_targets(coded, a.out)
    return 0


def card(spark: SparkSession, a) -> int:
    """A model card with the fingerprint of its vocabulary."""
    vocabulary = R.vocabulary_by_id(spark.read.text(a.tokens))
    K.card(C.vocabulary_fingerprint(vocabulary).withColumns({"wer": F.lit(a.wer), "wer_source": F.lit(a.wer_source)}), a.out)
    return 0


def soak(spark: SparkSession, a) -> int:
    """Median real-time factor of the windows that were taken under a light load."""
    S.clean_median(R.soak_windows(spark, a.report), "load1", a.most_load, "rtfx", "label", "model", "threads").show()
    return 0


COMMANDS = {
    error_rate: ["recogs"], compare: ["base", "candidate", ("--boot", int, 1000), ("--seed", int, 42)],
    prepare: ["table", "audio_root", "out", ("--split", str, "train"), ("--min-net-votes", int, None)], overlap: ["table", ("--split", str, "split"), ("--corpus", str, "corpus"), ("--key", str, "key")],
    leaks: ["paths", "ids", ("--path", str, "path"), ("--id", str, "id")], phonemes: ["table", "out"], card: ["tokens", "out", ("--wer", float, None), ("--wer-source", str, None)],
    soak: ["report", ("--most-load", float, 6.0)],
}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillforge")
    commands = parser.add_subparsers(required=True)
    for run, arguments in COMMANDS.items():
        one = commands.add_parser(run.__name__.replace("_", "-"), help=run.__doc__)
        one.set_defaults(run=run)
        for x in arguments:
            if isinstance(x, str):
                one.add_argument(x)
            else:
                one.add_argument(x[0], type=x[1], default=x[2])
    a = parser.parse_args(argv)
    return a.run(spark or SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())

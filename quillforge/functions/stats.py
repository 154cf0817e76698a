"""Percentile conventions, error rates and bootstrap intervals.

Six percentile rules are in use and give different results on small samples; each has its own name.  The index
forms take a sorted array column, so they suit per-group samples of a size that one row can hold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.storage import fixed


#: Rows to resample that are broadcast at most.
BROADCAST_ROWS = 2_000_000


def nearest_rank(value: Column, p: float) -> Column:
    """Aggregate: the ceil(p n)-th value; null for no rows."""
    ordered = F.array_sort(F.collect_list(value))
    return F.get(ordered, F.greatest(F.ceil(F.lit(p) * F.size(ordered)), F.lit(1)).cast("int") - 1)


def linear(value: Column, p: float) -> Column:
    """Aggregate: interpolated."""
    return F.percentile(value, F.lit(p))


def _at(ordered: Column, index: Column) -> Column:
    return F.get(ordered, index.cast("int"))


def lower(ordered: Column, p: float) -> Column:
    """floor((n - 1) p), 0-based."""
    return _at(ordered, F.floor((F.size(ordered) - 1) * F.lit(p)))


def trunc_below(ordered: Column, p: float) -> Column:
    """int(p (n - 1))."""
    return _at(ordered, (F.lit(p) * (F.size(ordered) - 1)).cast("int"))


def trunc(ordered: Column, p: float) -> Column:
    """int(p n); null beyond the last."""
    return _at(ordered, (F.lit(p) * F.size(ordered)).cast("int"))


def trunc_clamped(ordered: Column, p: float) -> Column:
    """int(p n), at most the last."""
    return _at(ordered, F.least((F.lit(p) * F.size(ordered)).cast("int"), F.size(ordered) - 1))


def at_ranks(rows: DataFrame, group: str, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per group: for each name the value at the 0-based index that its function gives of the number of values.

    Values are counted first and found by cumulative count, so no row holds a group; nulls do not count, and an index
    beyond the last gives null.
    """
    w = Window.partitionBy(group)
    counts = rows.groupBy(group, value).agg(F.count(value).alias("__n"))
    placed = counts.withColumns({"__end": F.sum("__n").over(w.orderBy(value)), "__total": F.sum("__n").over(w)})
    hit = lambda at: F.col(value).isNotNull() & (F.col("__end") > at)
    return placed.groupBy(group).agg(*[F.min(F.when(hit(at(F.col("__total"))), F.col(value))).alias(name) for name, at in ranks.items()], F.first("__total").alias("n"))


def micro_rate(errors: Column, total: Column) -> Column:
    """Aggregate: sum of errors over sum of reference units, in percent; one unit at least."""
    return F.sum(errors) * 100.0 / F.greatest(F.sum(total), F.lit(1))


class BlankReference(ValueError):
    """An utterance without reference words has no error rate."""


def corpus_wer(pairs: DataFrame, ref: str, hyp: str, *groups: str) -> DataFrame:
    """groups, errors, words, wer (a share), utterances: word errors over reference words, micro-averaged.

    Raises BlankReference where a reference has no words; a null hypothesis is empty.
    """
    from .align import word_distance

    blank = pairs.filter(F.coalesce(F.size(ref), F.lit(0)) <= 0)
    if not blank.isEmpty():
        raise BlankReference("every utterance needs reference words")
    each = pairs.select(*groups, word_distance(F.col(ref), F.coalesce(F.col(hyp), F.array().cast("array<string>"))).cast("long").alias("e"), F.size(ref).cast("long").alias("n"))
    return each.groupBy(*groups).agg(F.sum("e").alias("errors"), F.sum("n").alias("words"), (F.sum("e") / F.sum("n")).alias("wer"), F.count("*").alias("utterances"))


def paired_errors(base: DataFrame, candidate: DataFrame, key: str, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """key, base, candidate, n: word errors of two systems on the same utterances.

    Refuses utterances that only one of them has, and references that differ: those are not the same test set.
    """
    from quillforge.operators.corpus import paired

    from .align import word_distance

    both = paired(base.select(key, F.col(ref).alias("ref_a"), F.col(hyp).alias("hyp_a")), candidate.select(key, F.col(ref).alias("ref_b"), F.col(hyp).alias("hyp_b")), key)
    if not both.filter("not (ref_a <=> ref_b)").isEmpty():
        raise ValueError(f"references differ between the two systems, by {key}")
    return both.select(key, word_distance(F.col("ref_a"), F.col("hyp_a")).alias("base"), word_distance(F.col("ref_b"), F.col("hyp_b")).alias("candidate"), F.size("ref_a").alias("n"))


def draw(seed: int, replicate: Column, slot: Column, n: Column) -> Column:
    """A uniform index below n, the same in any engine that has MD5."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), slot.cast("string"))), 1, 8), 16, 10).cast("long"), n)


def _resamples(rows: DataFrame, key: str, cols: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """(replicate, i, cols): draws with replacement of as many rows as there are, numbered by key.

    The numbered rows are broadcast if they are few, else both sides are exchanged by i.
    """
    from quillforge.operators.corpus import row_numbers

    # rows are counted, sampled for ranges and dealt: what they cost to make is paid once
    rows = fixed(rows.select(key, *[c for c in cols if c != key]))
    n = rows.count()
    if n == 0:
        raise ValueError("no rows to resample")
    ranked = row_numbers(rows, [key]).select(F.col("number").alias("i"), *cols)
    draws = rows.sparkSession.range(replicates * n).select(F.expr(f"id div {n} + 1").alias("replicate"), (F.col("id") % n).alias("slot"))
    draws = draws.select("replicate", draw(seed, F.col("replicate"), F.col("slot"), F.lit(n)).alias("i"))
    return draws.join(F.broadcast(ranked) if n <= BROADCAST_ROWS else ranked.hint("merge"), "i")


def bootstrap_sums(rows: DataFrame, key: str, cols: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """(replicate, sums of cols) of resamples with replacement; rows are numbered by key.

    Replicate x slot rows are generated where they are used and never stored.
    """
    return _resamples(rows, key, cols, replicates, seed).groupBy("replicate").agg(*[F.sum(c).alias(c) for c in cols])


def bootstrap_interval(sums: DataFrame, value: Column, low: float = 0.025, high: float = 0.975, rule=trunc_below) -> DataFrame:
    """One row: ci_low, ci_high, replicates."""
    ordered = sums.select(value.alias("v")).agg(F.array_sort(F.collect_list("v")).alias("v"), F.count("*").alias("replicates"))
    return ordered.select(rule(F.col("v"), low).alias("ci_low"), rule(F.col("v"), high).alias("ci_high"), "replicates")


def paired_bootstrap(rows: DataFrame, key: str, base: str, candidate: str, total: str, replicates: int = 1000, seed: int = 42, margin: float = 3.0) -> DataFrame:
    """One row: absolute and relative gain of the candidate in percent with intervals, and the shares of replicates above 0 and above margin."""
    sums = bootstrap_sums(rows, key, [base, candidate, total], replicates, seed)
    n = F.greatest(F.col(total), F.lit(1))
    gain = (F.col(base) - F.col(candidate)) * 100.0 / n
    relative = F.when(F.col(base) > 0, (F.col(base) - F.col(candidate)) * 100.0 / F.col(base)).otherwise(0.0)
    one = sums.select(gain.alias("g"), relative.alias("r")).agg(
        F.array_sort(F.collect_list("g")).alias("gs"), F.array_sort(F.collect_list("r")).alias("rs"),
        F.avg((F.col("r") > 0).cast("double")).alias("p_better"), F.avg((F.col("r") >= margin).cast("double")).alias("p_margin"),
    )
    return one.select(
        trunc_clamped(F.col("gs"), 0.025).alias("gain_low"), trunc_clamped(F.col("gs"), 0.975).alias("gain_high"), trunc_clamped(F.col("rs"), 0.025).alias("relative_low"),
        trunc_clamped(F.col("rs"), 0.975).alias("relative_high"), "p_better", "p_margin",
    )


def calibrated_threshold(values: DataFrame, value: str, keep: float) -> DataFrame:
    """One row, tau: the largest value that keeps about this share (rule: lower)."""
    if not 0 < keep <= 1:
        raise ValueError("keep must be in (0, 1]")
    from quillforge.operators.corpus import row_numbers

    n = values.count()
    if n == 0:
        raise ValueError("no values to calibrate on")
    # numbered by ranges of values: no task or heap holds a share of all rows
    return row_numbers(values.select(F.col(value).alias("tau")), ["tau"]).filter(F.col("number") == int((n - 1) * keep)).select("tau")


def bootstrap_percentile(rows: DataFrame, key: str, value: str, p: float, replicates: int, seed: int) -> DataFrame:
    """One row: the interval of a percentile (rule: lower within a resample, linear over resamples)."""
    each = at_ranks(_resamples(rows, key, [value], replicates, seed), "replicate", value, {"v": lambda n: F.floor((n - 1) * F.lit(p))})
    return each.agg(F.percentile("v", F.lit(0.025)).alias("ci_low"), F.percentile("v", F.lit(0.975)).alias("ci_high"))


def clean_median(rows: DataFrame, load: str, most: float, value: str, *groups: str) -> DataFrame:
    """groups, median: of the values that were taken at a load of at most `most`."""
    return rows.filter(F.col(load) <= most).groupBy(*groups).agg(F.percentile(value, F.lit(0.5)).alias("median"))


def verdict(low: Column, high: Column) -> Column:
    """What an interval of a difference shows."""
    return F.when(low > 0, "better").when(high < 0, "worse").otherwise("undecided")

"""Quality rules as a short-circuit cascade.

Each rule rejects texts by itself; a text is kept if no rule rejects it, so the order of the rules changes the cost
and never the result.  Every task runs all rules on a random SAMPLE_SHARE of the texts it meets, batch by batch, and
orders them by what that sample (its latest SAMPLE_ROWS texts) shows: first the rule with the most rejections per second,
then the one with the most among what the rules before it leave, and so on.  A text that an early rule rejects reaches no
later one.  So the sample covers all rows, follows them where they change, and takes no pass, exchange or driver.

The base statistics (see text_stats) are exact for every text; base_failed is a rule on them that goes first.
Null and empty texts have no words and fail it.  Rows are judged one by one: repeated rows, ties and null ids do not
matter.  An empty table gives an empty result; columns that the caller keeps are passed through.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BLOCK_BYTES, blocks, bounded_batches, passed, ragged, string_parts, table
from .text_stats import BASE, Spans, all_counts, base_counts, lines, mask_count, wordless

SAMPLE_ROWS = 1000
SAMPLE_SHARE = 1 / 16
MIN_WORDS = 50


@dataclass(frozen=True)
class Rule:
    """rejects(bytes, offsets) -> one flag per text of a block; slow(text bytes) judges an outsized text from its counts."""

    name: str
    rejects: Callable[[np.ndarray, np.ndarray], np.ndarray]
    by_counts: Callable[[dict[str, np.ndarray]], np.ndarray]


def _many_symbols(c):  # more than one symbol per ten words
    return 10 * c["n_symbols"] > c["n_words"]


def _many_dup_lines(c):  # more than 30 % of the lines with a word
    return 10 * c["n_dup_lines"] > 3 * c["lines"]


def _odd_word_length(c):  # a mean outside two to fifteen
    return (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 15 * c["n_words"])


def _shouting(c):  # more than 40 % of the characters in words are capitals
    return 10 * c["upper"] > 4 * c["word_chars"]


def _few_lettered(c):  # under 80 % of the words have a letter
    return 10 * c["wordless"] > 2 * c["n_words"]


def _words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return Spans(data, offsets).count()


RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda d, o: _many_symbols({"n_symbols": mask_count("n_symbols", d, o), "n_words": _words(d, o)}), _many_symbols),
    Rule("dup_lines", lambda d, o: _many_dup_lines(dict(zip(("lines", "n_dup_lines"), lines(d, o), strict=True))), _many_dup_lines),
    Rule("word_length", lambda d, o: _odd_word_length({"word_chars": mask_count("word_chars", d, o), "n_words": _words(d, o)}), _odd_word_length),
    Rule("shouting", lambda d, o: _shouting({"upper": mask_count("upper", d, o), "word_chars": mask_count("word_chars", d, o)}), _shouting),
    Rule("few_lettered", lambda d, o: _few_lettered({"wordless": wordless(d, s := Spans(d, o)), "n_words": s.count()}), _few_lettered),
)


def _take(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.diff(offsets)[rows]
    return data[ragged(offsets[:-1][rows], lengths)], np.append(0, np.cumsum(lengths))


def cascade(data: np.ndarray, offsets: np.ndarray, rules: Sequence[Rule]) -> np.ndarray:
    """True for the texts that no rule rejects."""
    kept = np.ones(len(offsets) - 1, dtype=bool)
    for i, j in blocks(offsets):
        lo, hi = offsets[i], offsets[j]
        part, places = data[lo:hi], offsets[i : j + 1] - lo
        if hi - lo > BLOCK_BYTES:
            counts = all_counts(part, places)
            kept[i] = not any(bool(r.by_counts(counts)[0]) for r in rules)
            continue
        rows = np.arange(j - i)
        for rule in rules:
            bad = rule.rejects(part, places)
            kept[i + rows[bad]] = False
            if bad.any():
                rows = rows[~bad]
                if not len(rows):
                    break
                part, places = _take(part, places, np.flatnonzero(~bad))
    return kept


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def by_worth(rejects: np.ndarray, seconds: np.ndarray) -> list[int]:
    """Places of the rules, greedily by rejections per second among the texts (rows) that the rules before leave."""
    left, order = np.ones(len(rejects), dtype=bool), []
    open_ = list(range(rejects.shape[1]))
    while open_:
        best = max(open_, key=lambda k: (rejects[left, k].sum() / max(seconds[k], 1e-9), -seconds[k], -k))
        open_.remove(best)
        order.append(best)
        left &= ~rejects[:, best]
    return order


class Sampled:
    """The order of the rules by a running sample of a task's texts."""

    def __init__(self, rules: Sequence[Rule], seed: int = 0) -> None:
        self.rules, self.rng = rules, np.random.default_rng(seed)
        self.rejects = np.zeros((0, len(rules)), dtype=bool)
        self.seconds, self.size = np.zeros(len(rules)), 0

    def see(self, data: np.ndarray, offsets: np.ndarray) -> None:
        fit = np.flatnonzero(np.diff(offsets) <= BLOCK_BYTES)
        n = min(len(fit), max(8, int(len(fit) * SAMPLE_SHARE)))
        part, places = _take(data, offsets, np.sort(self.rng.choice(fit, n, replace=False)))
        for i, j in blocks(places):
            lo, hi = places[i], places[j]
            rejects = np.zeros((j - i, len(self.rules)), dtype=bool)
            for k, rule in enumerate(self.rules):
                began = time.thread_time()
                rejects[:, k] = rule.rejects(part[lo:hi], places[i : j + 1] - lo)
                self.seconds[k] += time.thread_time() - began
            self.size += int(hi - lo)
            self.rejects = np.concatenate([self.rejects, rejects])[-SAMPLE_ROWS:]

    def order(self) -> list[Rule]:
        return [self.rules[k] for k in by_worth(self.rejects, self.seconds / max(self.size, 1))]


def judge(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES) -> DataFrame:
    """The columns of keep, the counts named in BASE, base_failed and kept, for every row.  Outputs go before keep."""
    bounded_batches(docs.sparkSession)
    keep = passed(keep, (*BASE, "base_failed", "kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = Sampled(rules)
        for batch in batches:
            data, offsets = string_parts(batch.column("__text"))
            counts = base_counts(data, offsets)
            failed = base_failed(counts)
            rows = np.flatnonzero(~failed)
            kept = np.zeros(len(failed), dtype=bool)
            sample.see(*_take(data, offsets, rows))
            ordered = sample.order()
            for i, j in blocks(np.append(0, np.cumsum(np.diff(offsets)[rows])), 4 * BLOCK_BYTES):
                kept[rows[i:j]] = cascade(*_take(data, offsets, rows[i:j]), ordered)
            columns = [batch.column(c) for c in keep] + [pa.array(counts[c]) for c in BASE] + [pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *BASE, "base_failed", "kept"])

    schema = StructType([docs.schema[c] for c in keep])
    for c in BASE:
        schema.add(c, "long")
    schema.add("base_failed", "boolean").add("kept", "boolean")
    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInArrow(run, schema)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
n AS (
  SELECT *, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g'))::BIGINT AS upper,
         len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-zÀ-\x{10FFFF}]')))::BIGINT AS wordless
  FROM d),
lines AS (
  SELECT rid, count(*) AS lines, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
win AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS k FROM win) WHERE k > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS r FROM twice, (VALUES (0), (1), (2)) o(j) GROUP BY rid),
f AS (
  SELECT n.*, coalesce(l.lines, 0) AS lines, coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.r, 0)::BIGINT AS n_repeat_words
  FROM n LEFT JOIN lines l USING (rid) LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * upper > 4 * word_chars OR 10 * wordless > 2 * n_words) AS kept
FROM f
"""

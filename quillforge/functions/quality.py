"""Predicates of transcript quality, native columns over normalised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE

# Limits of the hallucination filter.
CHAR_RUN, WORD_CHARS, TOKEN_RUN, UNIQUE_WORDS, UNIQUE_SHARE = 6, 30, 4, 8, 0.30
MIN_CPS, MAX_CPS = 0.5, 40.0


def char_run(text: Column, least: int = CHAR_RUN) -> Column:
    return text.rlike(rf"([^{SPACE[1:-1]}])\1{{{least - 1},}}")


def long_word(words: Column, most: int = WORD_CHARS) -> Column:
    return F.exists(words, lambda w: F.length(w) > most)


def _repeats(words: Column, shift: int, least: int) -> Column:
    """Whether so many words in a row equal the word `shift` places after them."""
    same = F.zip_with(words, F.slice(words, shift + 1, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(a == b, "1").otherwise("0"))
    return F.contains(F.array_join(same, ""), F.lit("1" * least))


def token_run(words: Column, least: int = TOKEN_RUN) -> Column:
    """The same word so many times in a row."""
    return _repeats(words, 1, least - 1)


def low_unique_share(words: Column, least: int = UNIQUE_WORDS, share: float = UNIQUE_SHARE) -> Column:
    return (F.size(words) >= least) & (F.size(F.array_distinct(words)) / F.size(words) < share)


def hallucinated(text: Column, words: Column) -> Column:
    """Any of the four signals; never for a text without words."""
    return (F.size(words) > 0) & (char_run(text) | long_word(words) | token_run(words) | low_unique_share(words))


def ngram_loop(words: Column, n: int, times: int = 2) -> Column:
    """Some n words stand `times` times in a row."""
    return _repeats(words, n, n * (times - 1))


def chars_per_second(text: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, F.length(text) / seconds).otherwise(0.0)


def plausible_rate(text: Column, seconds: Column) -> Column:
    return chars_per_second(text, seconds).between(MIN_CPS, MAX_CPS)


def net_votes(up: Column, down: Column) -> Column:
    """Missing or unreadable votes count as none."""
    return F.coalesce(up.try_cast("int"), F.lit(0)) - F.coalesce(down.try_cast("int"), F.lit(0))


def first_reason(*rules: tuple[str, Column], kept: str = "kept") -> Column:
    """Name of the first rule that holds; a null condition does not hold."""
    out = None
    for name, rule in rules:
        rule = F.coalesce(rule, F.lit(False))
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return F.lit(kept) if out is None else out.otherwise(kept)


def sink_warning(muted: Column, volume: Column) -> Column:
    return F.when(muted, "muted").when(volume == 0, "silent")


def source_warning(muted: Column, volume: Column, least: int = 20) -> Column:
    return F.when(muted, "muted").when(volume < least, "low_volume")

"""Frame-level token sequences: argmax, collapse, words with times, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = 0


def argmax(scores: Column, ties: str = "first") -> Column:
    """0-based place of the largest score; of an empty array 0.  ties: first or last.

    NaN: with first, the first NaN is the largest; with last, a NaN equals every score, so that the later one of the two
    that are compared goes on.
    """
    best = F.array_max(scores)
    if ties == "first":
        at = F.array_position(scores, best) - 1
    elif ties == "last":
        at = F.size(scores) - F.array_position(F.reverse(scores), best)
        nan = lambda x: F.isnan(x.cast("double"))
        start = F.struct(F.get(scores, F.lit(0)).alias("x"), F.lit(0).alias("at"), F.lit(0).alias("i"))

        def later(a, x):
            wins = nan(a["x"]) | nan(x) | (x >= a["x"])
            return F.struct(F.when(wins, x).otherwise(a["x"]).alias("x"), F.when(wins, a["i"]).otherwise(a["at"]).alias("at"), (a["i"] + 1).alias("i"))

        at = F.when(F.exists(scores, nan), F.aggregate(scores, start, later, lambda a: a["at"])).otherwise(at)
    else:
        raise ValueError("ties must be first or last")
    return F.when(F.size(scores) == 0, 0).otherwise(at).cast("int")


def collapse(ids: Column, blank: int = BLANK) -> Column:
    """Repeats of the frame before are dropped, then blanks.  A blank between equal ids keeps both."""
    previous = F.concat(F.array(F.lit(None).cast("int")), ids)
    changed = F.zip_with(ids, F.slice(previous, 1, F.size(ids)), lambda x, p: F.when(~x.eqNullSafe(p) & (x != blank), x))
    return F.array_compact(changed)


def penalize_blank(logits: Column, beta: float, blank: int = BLANK) -> Column:
    return F.transform(logits, lambda x, i: F.when(i == blank, x - beta).otherwise(x))


def greedy_ids(frames: Column, valid: Column, blank: int = BLANK) -> Column:
    """Collapsed argmax path of the first `valid` frames."""
    return collapse(F.transform(F.slice(frames, 1, valid), lambda f: argmax(f)), blank)


def to_pieces(ids: Column, pieces: Column) -> Column:
    """Pieces of ids by a map column; unknown ids give ''."""
    return F.transform(ids, lambda i: F.coalesce(F.element_at(pieces, i), F.lit("")))


def timed_words(path: Column, pieces: Column, stride: float, t0: Column, blank: int = BLANK) -> Column:
    """array<struct<w, t>>: words of a frame path, each with the time of its first piece's frame.

    A piece with the mark starts a word; pieces before the first mark form a word of their own.
    """
    kind = "array<struct<w: string, t: double>>"
    state = F.struct(F.array().cast(kind).alias("done"), F.lit("").alias("w"), F.lit(0.0).alias("t"), F.lit(blank).alias("prev"), F.lit(0).alias("f"))

    def close(s):
        text = F.trim(s["w"])
        return F.when(text != "", F.concat(s["done"], F.array(F.struct(text.alias("w"), s["t"].alias("t"))))).otherwise(s["done"])

    def step(s, x):
        piece = F.coalesce(F.element_at(pieces, x), F.lit(""))
        fresh = (x != blank) & (x != s["prev"])
        starts = fresh & (piece.startswith("▁") | (s["w"] == ""))
        when = t0.cast("double") + s["f"] * F.lit(stride)
        return F.struct(
            F.when(starts, close(s)).otherwise(s["done"]).alias("done"),
            F.when(starts, F.replace(piece, F.lit("▁"), F.lit(""))).when(fresh, F.concat(s["w"], piece)).otherwise(s["w"]).alias("w"),
            F.when(starts, when).otherwise(s["t"]).alias("t"),
            x.alias("prev"),
            (s["f"] + 1).alias("f"),
        )

    return F.aggregate(path, state, step, close)

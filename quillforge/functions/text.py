"""Text normalisers and string keys as Column -> Column functions.

Each normaliser is a contract of its own; metrics must name the one they used.  Java's \\w and \\s are ASCII only, and with
(?U) they are other classes than those of the contracts and slow, so classes are spelt out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space of any script, and the control characters that separate records.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: What stands between words: all but letters, numbers and underscores.
OTHERS = r"[^\p{L}\p{N}_]+"
# Fixed values of the comparison normaliser: colloquial spellings and what they stand for.  Keys are looked up after
# accents are gone, so the accented ones never match; they are kept for parity.
COLLOQUIAL = {"pra": "para", "pro": "para o", "pros": "para os", "pras": "para as", "vc": "voce", "tá": "esta", "ta": "esta", "cê": "voce"}
CURRENCY = {"r$": "reais", "us$": "dolares"}

@F.pandas_udf(StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def _without_marks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def strip_all(text: Column) -> Column:
    """Strips every kind of white space; trim() strips spaces only."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def nfc(text: Column) -> Column:
    """Canonical composition.  Characters below U+0300 are composed; only texts that have others go through Arrow."""
    return F.coalesce(_nfc(F.when(text.rlike("[^\\x00-\\u02FF]"), text)), text)


def strip_accents(text: Column) -> Column:
    """Letters of any script without their accents, by compatibility decomposition; ASCII texts stay in the JVM."""
    return F.coalesce(_without_marks(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def normalize_train_target(text: Column) -> Column:
    """Composed, lower case, accents kept, everything but letters, digits and underscores a space, one space between words."""
    return F.trim(F.regexp_replace(nfc(F.lower(F.coalesce(text, F.lit("")))), OTHERS, " "))


def rewrite_currency(text: Column) -> Column:
    """Amounts after a currency sign are followed by its name; a bare sign becomes the name."""
    for sign, name in (("us$", CURRENCY["us$"]), ("r$", CURRENCY["r$"])):
        escaped = sign.replace("$", r"\$")
        text = F.regexp_replace(text, rf"(?<![a-z]){escaped}\s*(\d[\d.,]*)", f"$1 {name}")
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def expand_colloquial(words: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in COLLOQUIAL.items() for x in kv])
    return F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w))


def tokens(text: Column) -> Column:
    """Words between white space of any kind; none for an empty text."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda x: x != F.lit(""))


def normalize_for_compare(text: Column) -> Column:
    """Lower case, currency named, punctuation (and marks that stand alone) a space, no accents, colloquial words expanded."""
    t = rewrite_currency(strip_all(F.lower(F.coalesce(text, F.lit("")))))
    t = F.regexp_replace(t, OTHERS, " ")
    return F.array_join(expand_colloquial(tokens(strip_accents(t))), " ")


def normalize_call(text: Column) -> Column:
    """Call transcripts: lower case, warning signs and blanks (underscores) gone, letters of Portuguese and digits only."""
    t = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("⚠️"), F.lit(""))
    return normalize_benchmark(F.regexp_replace(t, "_+", " "))


def normalize_benchmark(text: Column) -> Column:
    """Lower case, letters of Portuguese and digits only."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-zàáâãéêíóôõúüç ]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


# ---------------------------------------------------------------- keys and ids


def show_key(path: Column) -> Column:
    """First path component that starts with show_, else the first component, else <unknown>."""
    parts = F.filter(F.split(strip_all(F.coalesce(path, F.lit(""))), "/"), lambda x: x != F.lit(""))
    named = F.filter(parts, lambda x: x.startswith("show_"))
    return F.coalesce(F.get(named, F.lit(0)), F.get(parts, F.lit(0)), F.lit("<unknown>"))


def path_tokens(path: Column, least: int = 8) -> Column:
    """Distinct parts of at least so many characters."""
    return F.array_distinct(F.filter(F.split(path, r"[/\-_.\s]+"), lambda t: F.length(t) >= least))


def stem(path: Column) -> Column:
    """After the last slash, up to the last dot."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def video_id(path: Column) -> Column:
    return F.regexp_replace(stem(path), r"-\d+$", "")


def speaker_key(dataset: Column, path: Column) -> Column:
    """Speaker by corpus layout: the last _ part, the parent folder, or the stem without its number; null if unknown."""
    parts, folders = F.split(stem(path), "_"), F.split(path, "/")
    return (
        F.when(dataset == "underscore", F.when(F.size(parts) >= 3, F.element_at(parts, -1)))
        .when(dataset == "folder", F.when(F.size(folders) >= 2, F.element_at(folders, -2)))
        .when(dataset == "numbered", video_id(path))
    )


def prefix_class(key: Column, classes: dict[str, str], other: str) -> Column:
    """The class of the first prefix that an id starts with."""
    out = F.lit(other)
    for prefix, name in reversed(classes.items()):
        out = F.when(F.startswith(key, F.lit(prefix)), name).otherwise(out)
    return out


def padded_id(prefix: str, number: Column, width: int = 8) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def shard_name(i: Column, total: int) -> Column:
    return F.format_string("data/train-%05d-of-%05d.parquet", i.cast("int"), F.lit(total))


def clock_seconds(line: Column) -> Column:
    """Seconds of a line that is only MM:SS or H:MM:SS, else null."""
    pattern = r"^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*$"
    a, b, c = (F.regexp_extract(line, pattern, i) for i in (1, 2, 3))
    short_form = F.try_to_number(a, F.lit("99")).cast("int") * 60 + F.try_to_number(b, F.lit("99")).cast("int")
    hours = F.try_to_number(a, F.lit("99")).cast("int") * 3600 + F.try_to_number(b, F.lit("99")).cast("int") * 60 + F.try_to_number(c, F.lit("99")).cast("int")
    return F.when(~line.rlike(pattern), F.lit(None).cast("int")).when(c == "", short_form).otherwise(hours)


def vocabulary_token(line: Column) -> Column:
    """What stands before the last space; the whole line without one."""
    return F.when(line.contains(" "), F.regexp_extract(line, r"^(.*) [^ ]*$", 1)).otherwise(line)


def disambiguation(token: Column) -> Column:
    return token.rlike("^#[0-9]+$")


def detokenize(pieces: Column) -> Column:
    """Pieces joined, word marks turned into spaces."""
    return F.trim(F.replace(F.array_join(pieces, ""), F.lit("▁"), F.lit(" ")))


def phoneme_symbols(text: Column) -> Column:
    """The characters of a phoneme string, one symbol each, without white space."""
    return F.filter(F.split(F.regexp_replace(text, f"{SPACE}+", ""), ""), lambda x: x != F.lit(""))


def clock(seconds: Column) -> Column:
    """MM:SS of whole seconds; minutes run on past 59."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), whole % 60)

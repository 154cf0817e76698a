"""Exact statistics of whole texts, vectorised over blocks of texts.

Words are ``[^\\x20\\x09-\\x0D]+``.  Lines are split at ``\\n`` only; a line counts when it has a word.  All
figures are additive counts of a text; null and empty texts have zeros.  Outsized texts go by parts.
"""

from __future__ import annotations

import numpy as np

from .common import BLOCK_BYTES, SPACE, Rolling, blocks, mix, word_digests, word_spans


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


SYMBOLS = _lut(b"[#*$%&|<>]"[1:-1])
UPPER = _lut(bytes(range(65, 91)))
LETTER = _lut(bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0x100)]))  # ASCII letters; lead bytes of other scripts
DIGIT = _lut(b"0123456789")
POINTS = _lut(b".,;:!?")
LEAD = ~_lut(bytes(range(0x80, 0xC0)))  # first bytes of code points
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Counts that one pass over the bytes gives.
MASKS = ("chars", "word_chars", "n_symbols", "upper", "letters", "digits", "points", "shouts", "bars", "wide")
COUNTS = (*MASKS, "n_words", "lines", "n_dup_lines", "n_repeat_words", "wordless", "types", "echoes")


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=sums[1:])
    return np.diff(sums[offsets])


def _mask(name: str, data: np.ndarray) -> np.ndarray:
    if name == "chars":
        return LEAD[data]
    if name == "word_chars":
        return LEAD[data] & ~SPACE[data]
    if name == "n_symbols":
        return SYMBOLS[data]
    if name == "upper":
        out = UPPER[data].copy()
        if len(data) > 1:  # Latin-1 capitals
            out[:-1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        return out
    if name == "letters":
        return LETTER[data]
    if name == "digits":
        return DIGIT[data]
    if name == "points":
        return POINTS[data]
    if name == "shouts":
        return data == 0x21
    if name == "bars":
        return data == 0x7C
    return data >= 0xC0  # wide


def mask_count(name: str, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text, how many characters are of a kind."""
    return _per_text(_mask(name, data), offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: lines with a word, and those of them that equal an earlier line."""
    breaks = np.flatnonzero(data == 0x0A)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    stop = np.sort(np.concatenate([breaks, offsets[1:]]))
    body = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(~SPACE[data], out=body[1:])
    full = body[stop] > body[start]
    start, stop = start[full], stop[full]
    text = np.searchsorted(offsets, start, side="right") - 1
    total = np.bincount(text, minlength=len(offsets) - 1)
    digest = word_digests(data, start, stop, 1)
    order = np.lexsort((digest, text))
    t, h = text[order], digest[order]
    again = np.zeros(len(t), dtype=bool)
    again[1:] = (t[1:] == t[:-1]) & (h[1:] == h[:-1])
    return total, np.bincount(t[again], minlength=len(offsets) - 1)


class Spans:
    """Words of a block and their digests."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.starts, self.stops, self.first = word_spans(data, offsets)
        self.codes = word_digests(data, self.starts, self.stops, 0)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def repeat_words(codes: np.ndarray, first: np.ndarray, text: np.ndarray, width: int = 3) -> np.ndarray:
    """Of each text, the words in width-word windows found at least twice in it."""
    n = len(codes)
    if n < width:
        return np.zeros(len(first) - 1, np.int64)
    ok = text[width - 1 :] == text[: n - width + 1]
    at = np.flatnonzero(ok)
    key = mix(Rolling(codes, 1).of(at, at + width) ^ mix(text[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    k = key[order]
    twin = np.zeros(len(k), dtype=bool)
    same = k[1:] == k[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    cover = np.zeros(n + width, dtype=np.int64)
    hit = at[order[twin]]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + width, -1)
    return np.bincount(text[np.cumsum(cover[:n]) > 0], minlength=len(first) - 1)


def _one_long(data: np.ndarray) -> dict[str, int]:
    """An outsized text: byte counts by parts, words and lines over their digests."""
    from .substring_dedup import Words

    out = dict.fromkeys(COUNTS, 0)
    for at in range(0, len(data), BLOCK_BYTES):
        stop = min(len(data), at + BLOCK_BYTES)
        for m in MASKS:
            # one byte of context for two-byte capitals
            part = data[at : min(len(data), stop + 1)]
            out[m] += int(_mask(m, part)[: stop - at].sum())

    class Whole:
        pass

    whole = Whole()
    whole.data, whole.offsets = data, np.array([0, len(data)])
    words = Words(whole)
    codes, first = words.codes[0], np.array([0, len(words.starts)])
    text = np.zeros(len(codes), np.int64)
    out["n_words"] = len(codes)
    out["n_repeat_words"] = int(repeat_words(codes, first, text)[0])
    letters = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(LETTER[data], out=letters[1:])
    out["wordless"] = int((letters[words.stops] == letters[words.starts]).sum())
    out["types"] = len(np.unique(codes))
    out["echoes"] = int((codes[1:] == codes[:-1]).sum())
    seen: set[bytes] = set()
    for line in data.tobytes().split(b"\n"):
        if line.strip(b" \t\n\v\f\r"):
            out["lines"] += 1
            out["n_dup_lines"] += line in seen
            seen.add(line)
    return out


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts named in BASE of every text, and its lines."""
    return _counts(data, offsets, False)


def all_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts named in COUNTS of every text."""
    return _counts(data, offsets, True)


def _counts(data: np.ndarray, offsets: np.ndarray, full: bool) -> dict[str, np.ndarray]:
    names = COUNTS if full else (*BASE, "lines")
    out = {c: np.zeros(len(offsets) - 1, np.int64) for c in names}
    for i, j in blocks(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        part, places = data[lo:hi], offsets[i : j + 1] - lo
        if hi - lo > BLOCK_BYTES:
            one = _one_long(part)
            for c in names:
                out[c][i] = one[c]
            continue
        for m in MASKS:
            if m in out:
                out[m][i:j] = mask_count(m, part, places)
        out["lines"][i:j], out["n_dup_lines"][i:j] = lines(part, places)
        spans = Spans(part, places)
        out["n_words"][i:j] = spans.count()
        out["n_repeat_words"][i:j] = repeat_words(spans.codes, spans.first, spans.text)
        if full:
            out["wordless"][i:j] = wordless(part, spans)
            order = np.lexsort((spans.codes, spans.text))
            c, t = spans.codes[order], spans.text[order]
            new = np.ones(len(c), dtype=bool)
            new[1:] = (c[1:] != c[:-1]) | (t[1:] != t[:-1])
            out["types"][i:j] = np.bincount(t[new], minlength=j - i)
            echo = (spans.codes[1:] == spans.codes[:-1]) & (spans.text[1:] == spans.text[:-1])
            out["echoes"][i:j] = np.bincount(spans.text[1:][echo], minlength=j - i)
    return out


def wordless(data: np.ndarray, spans: Spans) -> np.ndarray:
    """Of each text, the words without a letter."""
    letters = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(LETTER[data], out=letters[1:])
    return np.bincount(spans.text[letters[spans.stops] == letters[spans.starts]], minlength=len(spans.first) - 1)

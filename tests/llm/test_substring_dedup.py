import hashlib
import random
import re

from quillforge.llm import substring_dedup as sd


def brute(rows, window):
    """rows: (doc_id, text), doc_id unique."""
    docs = [(d, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0]))]
    seen, out = set(), {}
    for doc, words in docs:
        own = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
        drop = set()
        for i, w in enumerate(own):
            if w in seen:
                drop.update(range(i, i + window))
        seen.update(own)
        kept = " ".join(w for i, w in enumerate(words) if i not in drop)
        out[doc] = (len(words), len(drop), hashlib.sha256(kept.encode()).hexdigest())
    return out


def result(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in df.collect()}


def test_small_table(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sd.op2_substring_dedup(spark, sf_small).collect()}
    assert got == brute(rows, sd.WINDOW)


def random_rows(n, seed):
    rng = random.Random(seed)
    base = [rng.choice("abcdefgh") for _ in range(200)]
    rows = [(0, None), (1, ""), (2, "é " * 50), (3, "a b " * 40), (4, " ".join(base)), (5, "\t".join(base)), (6, "\n a\x1fb\x85c\xa0d "), (None, " ".join(base[20:90]))]
    for i in range(7, n):
        cut, length = rng.randrange(150), rng.randrange(3, 50)
        words = [rng.choice("xyz") for _ in range(rng.randrange(20))] + base[cut : cut + length] + rng.choice([[], base[:30], ["é"] * 20])
        rows.append((i, rng.choice([" ", "  ", " \n"]).join(words)))
    return rows


def test_edges_and_random(spark, monkeypatch):
    rows = random_rows(80, 3)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, kept string").repartition(5)
    monkeypatch.setattr(sd, "group_count", lambda *a: 7)
    assert result(sd.remove_repeated_windows(df)) == brute(rows, 13)
    assert result(sd.remove_repeated_windows(df, window=4)) == brute(rows, 4)


def test_long_texts_go_by_parts(monkeypatch):
    import numpy as np

    monkeypatch.setattr(sd, "BLOCK_BYTES", 64)
    monkeypatch.setattr(sd, "blocks", lambda o, n=64: iter([(i, i + 1) for i in range(len(o) - 1)]))
    text = (" ".join(random.Random(1).choices(["a", "bb", "c" * 100, "ddd"], k=400)) + " end").encode()

    class T:
        data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])

    w = sd.Words(T)
    assert [text[a:b].decode() for a, b in zip(w.starts, w.stops, strict=True)] == text.decode().split()
    monkeypatch.setattr(sd, "BLOCK_WORDS", 50)
    at = [x + lo for _, lo, hi, places in sd._steps(w.offsets, 13) for x in sd._valid(hi - lo, places, 13)]
    assert at == list(range(len(w.starts) - 12))


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(map(str, range(20)))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in sd.remove_repeated_windows(df).collect()) == [(1, 0), (1, 0), (2, 20)]
    assert sd.remove_repeated_windows(df.limit(0)).collect() == []


def test_long_words_that_defeat_polynomials_modulo_a_power_of_two(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, "a b c d e f g h i j k l " + one), (2, "a b c d e f g h i j k l " + other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(sd.remove_repeated_windows(df)) == brute(rows, 13)

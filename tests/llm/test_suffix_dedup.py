import hashlib
import random

from quillforge.llm import suffix_dedup


def brute(rows, depth):
    """rows: (doc_id, text), doc_id unique.  Every window is compared with all that start earlier."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (text or "").encode()
        drop = bytearray(len(data))
        for i in range(len(data) - depth + 1):
            window = data[i : i + depth]
            if window in seen:
                drop[i : i + depth] = b"\1" * depth
            seen.add(window)
        kept = bytes(b for b, d in zip(data, drop, strict=True) if not d)
        spans = sum(1 for i, d in enumerate(drop) if d and (i == 0 or not drop[i - 1]))
        out[doc] = (len(data), sum(drop), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect()}


def test_small_table(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.op1_suffix_dedup(spark, sf_small).collect()}
    assert got == brute(rows, suffix_dedup.DEPTH)


def test_edges_and_random(spark, monkeypatch):
    rng = random.Random(5)
    base = "".join(rng.choice("abc ") for _ in range(400))
    rows = [(0, None), (1, ""), (2, "é" * 300), (3, "ab" * 400), (4, base), (5, base), (6, base[50:250] + "Z" + base[250:]), (7, "short"), (None, base)]
    for i in range(8, 60):
        cut, length = rng.randrange(350), rng.randrange(40, 180)
        rows.append((i, "".join(rng.choice("xyz") for _ in range(rng.randrange(90))) + base[cut : cut + length] + rng.choice(["", base[:120], "é" * 60])))
    df = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, kept string, g int").repartition(5)
    assert result(suffix_dedup.remove_repeats(df)) == brute(rows, 100)
    monkeypatch.setattr(suffix_dedup, "FLUSH_RUNS", 10)
    assert result(suffix_dedup.remove_repeats(df, depth=12)) == brute(rows, 12)


def test_long_texts_go_by_parts(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 5000).astype(np.uint8)

    class T:
        pass

    T.data, T.offsets = data, np.array([0, 5000])

    def starts(limit):
        monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", limit)
        monkeypatch.setattr(suffix_dedup, "blocks", lambda o: iter([(0, 1)]))
        return sorted(x for _, s, c, _, _ in suffix_dedup.anchored_runs(T, 100, 32, [], suffix_dedup.Shards(1, 8), []) for a, n in zip(s, c & 0xFFFF) for x in range(a, a + n))

    assert starts(700) == starts(1 << 20) == list(range(4901))


def test_repeated_rows_and_empty_table(spark):
    text = "the same line again " * 20
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(df).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in rows) == [(1, 380), (1, 380), (2, 400)]
    assert suffix_dedup.remove_repeats(df.limit(0)).collect() == []
    kept = suffix_dedup.remove_repeats(df.withColumn("spans_", df["text"]).withColumn("kept", df["text"]), keep=["spans_"])
    assert kept.columns[-1] == "spans_" and kept.count() == 3


def wordy_rows(n, seed):
    """Texts of words, with passages that begin and end inside words, and words longer than any prefix."""
    rng = random.Random(seed)
    vocabulary = ["a", "of", "word", "passage", "é", "longer-word", "x" * 90, "y" * 30]
    base = " ".join(rng.choices(vocabulary, k=400))
    rows = [(0, base), (1, " " * 250), (2, "z" * 250), (3, base.replace(" ", "\n"))]
    for i in range(4, n):
        cut, length = rng.randrange(len(base) - 400), rng.randrange(60, 400)
        own = [" ".join(rng.choices(vocabulary[:6] + [f"u{rng.randrange(10**9)}"], k=rng.randrange(60))) for _ in range(2)]
        rows.append((i, own[0] + base[cut : cut + length] + own[1]))
    return rows


def test_leading_passes_lose_no_window(spark, monkeypatch):
    rows = wordy_rows(60, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(suffix_dedup, "group_count", lambda *a: 5)
    assert result(suffix_dedup.remove_repeats(df)) == brute(rows, 100)
    for passes in ((), (1,), (10, 50, 99), (100,)):
        monkeypatch.setattr(suffix_dedup, "PASSES", passes or (100, 100))
        assert result(suffix_dedup.remove_repeats(df, depth=40)) == brute(rows, 40)


def test_suffixes_that_are_alone_leave_in_the_first_passes():
    """Of texts that share one passage, little but that passage is left for the last pass."""
    import numpy as np

    rng = random.Random(3)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(40))
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(80)) + f" {passage} " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(80)) for _ in range(2)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)

    class T:
        pass

    T.data, T.offsets = data, np.array([0, len(texts[0]), len(data)])
    shards, lengths, known = suffix_dedup.Shards(1, 1 << 20), [32, 80], []
    for _ in lengths:
        keys, twice = suffix_dedup.touched(suffix_dedup._first_passes(T, 100, lengths, shards, known))
        known.append(suffix_dedup.Slots(keys[twice]))
    live = suffix_dedup._live(data, T.offsets, 100, lengths, shards, known)
    for k, text in enumerate(texts):
        at = text.index(passage) + T.offsets[k]
        assert live[at : at + len(passage) - 99].all()
        before = live[T.offsets[k] : at - 100]
        assert before.sum() <= 0.02 * len(before)


def test_very_long_text_goes_by_parts(spark):
    rng = random.Random(6)
    text = " ".join(rng.choices([f"w{i}" for i in range(500)], k=140_000))
    rows = [(1, text), (2, text[5000:9000] + "Q" + text[520_000:526_000] + text[-150:])]
    assert len(text) > suffix_dedup.BLOCK_BYTES
    assert result(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 100)

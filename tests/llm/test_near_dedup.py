import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillforge.llm import near_dedup as nd
from quillforge.llm.common import Scratch


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def weighted(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def probability_jaccard(a, b):
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


def brute(rows, threshold=0.8):
    """Components of all pairs that are near by either measure; rows: (doc_id, text)."""
    bags = [weighted(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            # without repeats the two measures are equal
            weights = set(a.values()) | set(b.values()) != {1}
            if words(rows[i][1]) == words(rows[j][1]) or (a and b and (len(a.keys() & b.keys()) / len(a.keys() | b.keys()) >= threshold or (weights and probability_jaccard(a, b) >= threshold))):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 63), (1 << 63) - 1 if d is None else d)
    return {d: (None if least[find(i)] == (1 << 63) - 1 else least[find(i)]) for i, (d, _) in enumerate(rows)}


def test_small_table(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    got = nd.op10_near_dedup(spark, sf_small).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_chains_copies_and_edges(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "one  two"), (5, "one two three"), (None, "alone here with five words")]
    n = 6
    for _ in range(3):  # chains: each text is near its neighbours only
        text = rng.choices(vocabulary, k=100)
        for _ in range(12):
            rows.append((n, " ".join(text)))
            n += 1
            at = rng.randrange(95)
            text = [*text[:at], *rng.choices(vocabulary, k=1), *text[at + 1 :]]
    base = rng.choices(vocabulary, k=150)
    for _ in range(40):  # a large group around one text
        text = list(base)
        for at in rng.sample(range(150), 2):
            text[at] = rng.choice(vocabulary)
        rows.append((n, " ".join(text)))
        n += 1
    for _ in range(5):  # repeated lines
        line = rng.choices(vocabulary, k=12)
        rows += [(n, " ".join(line * 9)), (n + 1, " ".join(line * 8)), (n + 2, " ".join(line * 2 + rng.choices(vocabulary, k=40)))]
        n += 3
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, class_id int").repartition(4)
    assert {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(df).collect()} == brute(rows)


def test_repeated_rows_keep_one(spark):
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(7, text), (7, text), (9, text + " x"), (8, "else")], "doc_id long, text string").repartition(3)
    got = nd.near_duplicates(df).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == [(7, 7), (7, 7), (8, 8), (9, 7)]
    assert sum(r["kept"] for r in got) == 2
    assert nd.near_duplicates(df.limit(0)).collect() == []


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    ids = rng.integers(1, 1 << 63, 300, dtype=np.uint64)
    a, wa = ids[:200], rng.integers(1, 5, 200)
    b, wb = ids[50:260], rng.integers(1, 5, 210)
    text = np.repeat([0, 1], [200, 210])
    sig = nd.prob_minhash(text, np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 4096)
    exact = probability_jaccard(Counter(dict(zip(a.tolist(), wa.tolist(), strict=True))), Counter(dict(zip(b.tolist(), wb.tolist(), strict=True))))
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03
    order = np.argsort(a), np.argsort(b)
    assert abs(nd.probability_jaccard(a[order[0]], wa[order[0]], b[order[1]], wb[order[1]]) - exact) < 1e-9


@pytest.mark.parametrize("local", [1_000_000, 0])
def test_components_of_a_path(spark, monkeypatch, local):
    monkeypatch.setattr(nd, "LOCAL_EDGES", local)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (95, 100)], "cx long, cy long")
    assert {(r["id"], r["c"]) for r in nd.components(edges, Scratch(spark)).collect()} == {(i, 0) for i in range(41)} | {(i, 90) for i in (90, 95, 100)}


def test_near_copies_that_differ_by_a_frequent_line(spark):
    """Near by distinct shingles only: the repeated line leaves little probability Jaccard."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = []
    for n in range(0, 24, 2):
        text, line = rng.choices(vocabulary, k=304), rng.choices(vocabulary, k=12)
        rows += [(n, " ".join(text)), (n + 1, " ".join(text + line * 60))]
        a, b = weighted(rows[-2][1]), weighted(rows[-1][1])
        assert len(a.keys() & b.keys()) / len(a.keys() | b.keys()) > 0.9 and probability_jaccard(a, b) < 0.4
    want = brute(rows)
    assert all(want[n + 1] == n for n in range(0, 24, 2))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(df).collect()} == want


def thue_morse(n):
    return ["ab"[bin(i).count("1") % 2] for i in range(n)]


def test_a_passage_that_dissimilar_texts_share(spark):
    """Texts meet in the buckets of the passage without being near; near ones among them are still found."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=70)
    rows = []
    for n in range(0, 130, 2):
        own = rng.choices(vocabulary, k=rng.choice([8, 15, 40, 60, 120]))
        other = list(own)
        other[rng.randrange(len(own))] = "x"
        rows += [(n, " ".join(own + passage)), (n + 1, " ".join(other + passage if n % 8 else passage + own * 2))]
    want = brute(rows)
    assert 10 < len(set(want.values())) < 120
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(df).collect()} == want


def test_near_texts_meet_by_prefix_and_pass_the_bound(spark):
    """The rarest shingle that two near texts share is in both prefixes, and its places there do not rule the pair out."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(1500):
        common = rng.choice(400, rng.integers(10, 60), replace=False)
        sets = []
        for _ in range(2):
            ids = np.unique(np.append(common, rng.choice(400, rng.integers(0, 20)))).astype(np.uint64)
            sets.append((ids, rng.integers(1, 4, len(ids)) if rng.random() < 0.5 else None))
        df = rng.integers(1, 9, 400)
        (a, wa), (b, wb) = sets
        if not nd.near(a, wa, b, wb, 0.8):
            continue
        both = np.intersect1d(a, b)
        first = both[np.lexsort((both, df[both.astype(int)]))[0]]
        sides = []
        for ids, w in sets:
            weights = np.ones(len(ids)) if w is None else w.astype(float)
            at, before = nd.prefix(ids, weights, df[ids.astype(int)], 0.8)
            here = int(np.flatnonzero(ids[at] == first)[0])
            sides.append((len(ids), len(ids) - here, float(1 - before[here] / weights.sum()), w is not None))
        rows.append((*sides[0], *sides[1]))
    assert len(rows) > 100
    names = [f"{s} {k}" for s in "xy" for k in ("n int", "m int", "mass double", "repeats boolean")]
    df = spark.createDataFrame(rows, ", ".join(f"{s[0]}_{s[2:]}" for s in names))
    assert df.filter(~nd.may_be_near(0.8, lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}"))).count() == 0


def test_sequences_that_defeat_polynomials_modulo_a_power_of_two(spark):
    one = thue_morse(1024)
    other = ["ab"["ba".index(x)] for x in one]
    rows = [(0, " ".join(one)), (1, " ".join(other)), (2, "".join(one)), (3, "".join(other)), (4, "\t".join(one))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(df).collect()} == brute(rows)


def test_clashing_digests_keep_their_weights():
    text, digest, weight = nd.merged_weights(np.array([0, 0, 0, 1]), np.array([5, 3, 5, 5], np.uint64), np.array([2, 1, 3, 1]))
    assert text.tolist() == [0, 0, 1] and digest.tolist() == [3, 5, 5] and weight.tolist() == [1, 5, 1]


def test_signatures_in_steps(monkeypatch):
    rng = np.random.default_rng(1)
    args = np.sort(rng.integers(0, 4, 900)), rng.integers(1, 1 << 63, 900, dtype=np.uint64), rng.integers(1, 5, 900), 4
    whole = nd.prob_minhash(*args)
    monkeypatch.setattr(nd, "STEP_SHINGLES", 100)
    assert (nd.prob_minhash(*args) == whole).all()


def test_recall_on_a_larger_table(spark):
    """Of the pairs of every fifth row with all rows that are near by distinct shingles, nine tenths at least."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(docs).collect()}
    bags = {r["doc_id"]: set(weighted(r["text"])) for r in docs.collect()}
    found = []
    for q in (d for d in bags if d % 5 == 0 and bags[d]):
        for d, b in bags.items():
            if d != q and b and len(bags[q] & b) >= 0.8 * len(bags[q] | b):
                found.append(got[d] == got[q])
    assert len(found) > 10 and sum(found) >= 0.9 * len(found)


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(8)
    long = " ".join(rng.choices([f"w{i}" for i in range(9000)], k=300_000))
    rows = [(1, long, 0, 1, b"x"), (2, long + " end", 0, 1, b"y"), (3, long[: len(long) // 2], 0, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, v int, class_id int, bands binary")
    got = nd.near_duplicates(df).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {1: 1, 2: 1, 3: 3}

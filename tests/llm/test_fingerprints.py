import hashlib
import random
import re

from pyspark.sql import functions as F

from quillforge.llm import fingerprints as fp


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_query_against_brute_force(spark, sf_small):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    order = sorted(docs, reverse=True)
    rows = {r["doc_id"]: r for r in fp.op8_fingerprints(spark, sf_small).collect()}
    assert len(rows) == len(docs)
    by_text, errors = {}, []
    for i, d in enumerate(order):
        text, after = docs[d], docs[order[(i + 1) % len(order)]]
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        r = rows[d]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        errors += [abs(r["near_edited"] - jaccard(shingles(text), shingles(edited))), abs(r["near_next"] - jaccard(shingles(text), shingles(after)))]
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.03


def test_small_texts_are_exact_and_parts_merge(spark):
    rng = random.Random(2)
    texts = [None, "", " \n", "one", "a b c d", "a b c d e", "a b c d e f"] + [" ".join(rng.choices("abcdefg", k=40)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, o int").repartition(3)
    rows = {r["doc_id"]: r["s"] for r in fp.with_sketch(df, "text", "s").collect()}
    for i, t in enumerate(texts):
        assert len(rows[i]) == len(shingles(t))
    pairs = spark.createDataFrame([(i, j, rows[i], rows[j]) for i in rows for j in rows], "i int, j int, a array<bigint>, b array<bigint>")
    for r in pairs.select("i", "j", fp.resemblance(F.col("a"), F.col("b")).alias("r"), fp.containment(F.col("a"), F.col("b")).alias("c")).collect():
        a, b = shingles(texts[r["i"]]), shingles(texts[r["j"]])
        assert abs(r["r"] - jaccard(a, b)) < 1e-9
        assert abs(r["c"] - (len(a & b) / len(a) if a else 1.0)) < 1e-9
    merged = fp.merge_all(fp.with_sketch(df.withColumn("part", F.col("doc_id") % 2), "text", "s", k=8), ["part"], "s", k=8).collect()
    for m in merged:
        assert m["s"] == sorted({h for i in rows if i % 2 == m["part"] for h in rows[i]})[:8]


def test_counts_beyond_k(spark):
    df = spark.createDataFrame([(" ".join(map(str, range(3004))),)], "t string")
    assert abs(fp.with_sketch(df, "t", "s").select(fp.distinct_count(F.col("s"))).first()[0] - 3000) < 900


def test_next_text_with_gaps_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 2)
    rows = [(5, "e"), (1, "a"), (-900, "z"), (10**15, "big"), (None, "n"), (7, None), (8, "h"), (8, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["text"]): r["next_text"] for r in fp.with_next_text(df).collect() if r["doc_id"] != 8}
    assert got == {(10**15, "big"): "h", (7, ""): "e", (5, "e"): "a", (1, "a"): "z", (-900, "z"): "n", (None, "n"): "big"}
    assert fp.with_next_text(df).count() == 8
    assert fp.with_next_text(df.limit(0), sketch=4).collect() == []
    assert fp.with_next_text(df.filter("doc_id = 5")).first()["next_text"] == "e"


def test_ranges_do_not_follow_gaps_between_ids(spark, monkeypatch):
    """One outlying id, many null ids and repeated rows: no range has most rows, and every next text is right."""
    monkeypatch.setattr(fp, "BUCKET_ROWS", 20)
    rows = [(i, f"t{i}") for i in range(300)] + [(10**15, "far"), (-(10**17), "low")] + [(None, f"n{i}") for i in range(300)] + [(7, "t7")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = fp.with_next_text(df)
    got = out.collect()
    assert len(got) == len(rows)
    after = {(r["doc_id"], r["text"]): r["next_text"] for r in got}
    assert after[(10**15, "far")] == "t299" and after[(250, "t250")] == "t249" and after[(0, "t0")] == "low"
    # the null rows follow one another once, from the lowest id to the far one
    at, chain = after[(-(10**17), "low")], []
    while at != "far":
        chain.append(at)
        at = after[(None, at)]
    assert sorted(chain) == sorted(f"n{i}" for i in range(300))
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 400  # four partitions


def test_query_with_clashing_columns_and_long_texts(spark, tmp_path):
    rng = random.Random(4)
    long = " ".join(rng.choices([f"w{i}" for i in range(5000)], k=120_000))
    rows = [(3, long, "x", 1, b"k"), (2, None, "y", 2, None), (1, "é" * 10, "z", 3, None)]
    spark.createDataFrame(rows, "doc_id long, text string, at string, n_chars int, b binary").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in fp.op8_fingerprints(spark, str(tmp_path)).collect()}
    assert [got[d]["n_chars"] for d in (3, 2, 1)] == [len(long), 0, 10]
    edited = {3: long[: len(long) - len(long) // 3], 2: "", 1: "é" * 7 + long[:3]}
    assert {d: r["edited_sha256"] for d, r in got.items()} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in edited.items()}
    assert abs(got[3]["near_edited"] - 2 / 3) < 0.15 and got[2]["near_edited"] == 1.0

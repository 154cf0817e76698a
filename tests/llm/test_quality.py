import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillforge.llm import quality_classifier as qc
from quillforge.llm import quality_rules as qr
from quillforge.llm import text_stats as ts


def brute(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    seen, lines, dup = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(tri)
    covered = {i + j for i, t in enumerate(tri) if count[t] > 1 for j in range(3)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(covered), "lines": lines,
        "upper": len(re.findall("[A-ZÀ-ÖØ-Þ]", text)), "chars": len(text), "types": len(set(w)), "echoes": sum(a == b for a, b in zip(w, w[1:])),
    }


def texts():
    rng = random.Random(8)
    out = [None, "", "\n\n", " a", "a b c a b c", "a\na\n a\na", "É#É ÷×Ø ß", "x " * 60, "A|B\x1fC\x0bd"]
    for _ in range(150):
        out.append("".join(rng.choice(["a", "b", "É", " ", "\n", "\t", "#", "|", "中", "Z"]) for _ in range(rng.randrange(300))))
    return out


def flat(items):
    raw = [(t or "").encode() for t in items]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw]))


def test_counts(monkeypatch):
    items = texts()
    for limit in (1 << 20, 700, 40):  # the last sends most texts the way of outsized ones
        for module in (ts, __import__("quillforge.llm.common", fromlist=["x"])):
            monkeypatch.setattr(module, "BLOCK_BYTES", limit)
        monkeypatch.setattr(ts, "blocks", lambda o, n=limit, f=ts.blocks.__wrapped__ if hasattr(ts.blocks, "__wrapped__") else __import__("quillforge.llm.common", fromlist=["x"]).blocks: f(o, n))
        got = ts.all_counts(*flat(items))
        for i, t in enumerate(items):
            for name, value in brute(t).items():
                assert got[name][i] == value, (limit, t, name)


def test_cascade_order_does_not_change_the_result(spark, sf_small):
    df = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    one = {r["doc_id"]: r["kept"] for r in qr.judge(df).collect()}
    data, offsets = flat([r["text"] for r in df.orderBy("doc_id").collect()])
    for rules in (qr.RULES, qr.RULES[::-1]):
        base = qr.base_failed(ts.base_counts(data, offsets))
        kept = qr.cascade(data, offsets, rules) & ~base
        assert [one[i] for i in sorted(one)] == kept.tolist()


def test_rules_on_edge_rows(spark):
    good = " ".join(random.Random(1).choices([f"word{i}" for i in range(300)], k=80))
    rows = [(1, None), (1, None), (None, good), (2, good.upper()), (3, good.replace(" ", " # ")), (4, "\n".join([good[:60]] * 9) + good), (5, " | ".join(good.split()))]
    df = spark.createDataFrame([(d, t, True) for d, t in rows], "doc_id long, text string, kept boolean")
    got = sorted(((r["doc_id"] or 0), r["kept"]) for r in qr.judge(df).collect())
    assert got == [(0, True), (1, False), (1, False), (2, False), (3, False), (4, False), (5, False)]
    assert qr.judge(df.limit(0)).collect() == []


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    r = qr.op4_quality_rules(spark, sf).filter("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()
    share = {x["quality"]: x["k"] for x in r}
    assert share[1] > 0.99 and share[0] < 0.5


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = qc.op6_quality_classifier(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = out.filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 100
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.93
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(r["predicted"] for r in rows if r["quality"]) / len(good) > 0.97


def test_classifier_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "x y", "c")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = qc.score(df, qc.fit(df, none)).collect()
    assert [r["predicted"] for r in rows] == [1, 1, 1] and all(0 <= r["score"] <= 1 for r in rows)
    one = qc.fit(df, spark.createDataFrame([(1, 1), (1, None)], "doc_id long, quality int"))
    assert qc.score(df.limit(0), one).collect() == []


def test_isotonic():
    x, y = qc.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([0.0, 0.0, 1.0, 1.0]))
    assert y.tolist() == [0.0, 0.5, 1.0] and x.tolist() == [1.0, 2.5, 4.0]


def test_order_is_by_rejections_per_second_among_what_is_left():
    rejects = np.zeros((100, 4), dtype=bool)
    rejects[:50, 0] = True  # half of all, at cost 1
    rejects[:60, 1] = True  # more, at cost 2: after the first it only adds ten
    rejects[80:, 2] = True  # a fifth, at cost 0.2: best
    assert qr.by_worth(rejects, np.array([1.0, 2.0, 0.2, 0.1])) == [2, 0, 1, 3]
    assert qr.by_worth(rejects[:0], np.array([3.0, 1.0, 2.0, 4.0])) == [1, 2, 0, 3]


def test_running_sample_orders_by_what_it_meets():
    fast = qr.Rule("fast", lambda d, o: np.diff(o) > 5, lambda c: None)
    none = qr.Rule("none", lambda d, o: np.zeros(len(o) - 1, bool), lambda c: None)
    s = qr.Sampled([none, fast])
    data, offsets = flat(["abcdefgh"] * 200)
    for _ in range(3):
        s.see(data, offsets)
    assert [r.name for r in s.order()] == ["fast", "none"] and 20 <= len(s.rejects) <= qr.SAMPLE_ROWS
    s.see(*flat([]))


def test_very_long_and_crafted_texts(spark):
    rng = random.Random(3)
    long = "\n".join(" ".join(rng.choices([f"w{i}" for i in range(4000)], k=40)) for _ in range(8000))
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    lines = one + "\n" + one.translate(str.maketrans("ab", "ba"))  # lines that a polynomial modulo 2^64 takes for equal
    df = spark.createDataFrame([(1, long), (2, lines)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in qr.judge(df).collect()}
    for d, text in ((1, long), (2, lines)):
        want = brute(text)
        assert all(got[d][k] == want[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    assert got[1]["kept"] and got[2]["n_dup_lines"] == 0


def reference_isotonic(x, y):
    """At each x in order: the largest over starts of the least mean up to an end (max-min formula)."""
    order = np.argsort(x, kind="stable")
    v, out = y[order], []
    for i in range(len(v)):
        out.append(max(min(v[a : b + 1].mean() for b in range(i, len(v))) for a in range(i + 1)))
    return x[order], np.array(out)


def test_classifier_against_a_direct_solution(spark):
    """Partition sums, ridge solution, calibration and scores equal those of one matrix in memory."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(~qc.held_out(F.col("doc_id")))
    model = qc.fit(docs, labels)
    rows = docs.join(labels, "doc_id").withColumn("c", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(qc.CALIBRATION)) == 0).collect()
    x, y = qc.features(*flat([r["text"] for r in rows])), np.array([float(r["quality"]) for r in rows])
    check = np.array([r["c"] for r in rows])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-6))
    z = np.sqrt(2 / qc.WIDTH) * np.cos(((x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-6)) @ model.weights + model.phase)
    z = np.column_stack([z, np.ones(len(z))])
    t = z[~check]
    ridge = np.linalg.lstsq(np.vstack([t, np.sqrt(qc.RIDGE * len(t)) * np.eye(t.shape[1])]), np.append(y[~check], np.zeros(t.shape[1])), rcond=None)[0]
    assert np.allclose(t @ ridge, t @ model.ridge, atol=1e-6)
    raw = z[check] @ model.ridge
    xs, levels = reference_isotonic(raw[:120], y[check][:120])
    knots, got = qc.isotonic(raw[:120], y[check][:120])
    blocks = np.cumsum(np.append(0, np.diff(levels) > 1e-12))
    assert np.allclose(got, [levels[blocks == k].mean() for k in range(blocks[-1] + 1)]) and np.allclose(knots, [xs[blocks == k].mean() for k in range(blocks[-1] + 1)])
    scores = {r["doc_id"]: r["score"] for r in qc.score(docs, model).collect()}
    assert np.allclose([scores[r["doc_id"]] for r in rows], model.score(x))


def test_classifier_on_very_long_texts(spark):
    long = " ".join(random.Random(4).choices([f"w{i}" for i in range(3000)], k=250_000))
    df = spark.createDataFrame([(1, long), (2, long + " z"), (3, "x")], "doc_id long, text string")
    model = qc.fit(df, spark.createDataFrame([(1, 1), (3, 0), (2, 1)], "doc_id long, quality int"))
    assert all(0 <= r["score"] <= 1 for r in qc.score(df, model).collect())

"""Queries over whole texts and tables, against brute force on small fixtures."""

import difflib
import random
from collections import Counter

from pyspark.sql import functions as F

from quillforge.functions import align as A
from quillforge.functions import stats as S
from quillforge.plans import catalog

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").split()


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def test_running_wer_has_every_document(spark, tmp_path):
    docs = spark.createDataFrame([(i, "en", "a b c d e f g h i j k") for i in (3, 199, 200, 201, 950)], "doc_id long, lang string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["doc_id"] for r in catalog.QUERIES["running_wer"](spark, str(tmp_path)).collect()) == [3, 199, 200, 201, 950]


def test_percentile_conventions_count_every_event(spark, tmp_path):
    rng = random.Random(2)
    rows = [(u, "xy"[u % 2], float(rng.randrange(40))) for u in range(201)] + [(900, "one", 5.0), (901, "x", None)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_type"]: r.asDict() for r in catalog.QUERIES["percentile_conventions"](spark, str(tmp_path)).collect()}
    assert set(got) == {"x", "y", "one"}
    for kind, r in got.items():
        v = sorted(x for _, k, x in rows if k == kind and x is not None)
        n, at = len(v), 0.9 * (len(v) - 1)
        lo, part = int(at), at - int(at)
        assert (r["low"], r["below"], r["clamped"], r["trunc"]) == (v[lo], v[lo], v[min(int(0.9 * n), n - 1)], v[int(0.9 * n)] if int(0.9 * n) < n else None)
        assert r["nearest"] == v[max(-(-9 * n // 10), 1) - 1]
        assert abs(r["linear"] - (v[lo] + part * (v[min(lo + 1, n - 1)] - v[lo]))) < 1e-6


def test_agreement_compares_whole_turns(spark, tmp_path):
    same = "a" * 70
    rows = [(1, 0, "user", same + "bbb"), (1, 1, "assistant", same + "c"), (2, 0, "user", same), (2, 1, "assistant", same)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r["cer"] for r in catalog.QUERIES["agreement_cer"](spark, str(tmp_path)).collect()}
    assert got == {1: round(3 / 73, 6), 2: 0.0}
    assert [r["conv_id"] for r in catalog.QUERIES["agreement_filter"](spark, str(tmp_path)).collect()] == [2]


def test_training_target_keeps_the_whole_text(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(100))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.QUERIES["normalize_train_target"](spark, str(tmp_path)).first()["norm"].split()[-1] == "word99"


def test_local_agreement_runs_to_the_end_of_a_turn(spark, tmp_path):
    rows = [(1, t, " ".join(f"w{i}" for i in range(n))) for t, n in enumerate((2, 12, 14, 40))]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalog.QUERIES["local_agreement"](spark, str(tmp_path)).orderBy("stream_id").collect()
    assert [(r["committed"], r["tail"]) for r in got] == [(2, 0), (9, 3), (12, 2), (39, 1)]


def test_word_lists_and_audits_read_every_language(spark, tmp_path):
    docs = [(i, lang, f"src-{i}", f"leak{lang}word common only{lang}") for i, lang in enumerate(("en", "de", "fr", "es"))]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "leakenword leakdeword leakfrword leakesword")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert [(r["item_id"], r["tokens"]) for r in run("benchmark_leak_tokens")] == [(7, 4)]
    flat = [w for d in docs for w in d[3].split()]
    assert {r["word"]: r["id"] for r in run("word_list_ids")} == {w: i + 2 for i, w in enumerate(sorted(set(flat)))}
    assert {r["token"]: r["id"] for r in run("vocab_first_seen")} == {w: i + 2 for i, w in enumerate(dict.fromkeys(flat))}
    assert run("vocab_fingerprint")[0]["size"] == len(set(flat))
    assert sorted((r["doc_id"], r["id"]) for r in run("sequential_ids")) == [(i, f"utt_{i:08d}") for i in range(4)]


def test_distances_of_any_length_are_exact():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (rng.choices("abcde", k=rng.randrange(40)) for _ in range(2))
        assert A.distance(a, b) == levenshtein(a, b)
        hits, subs, dels, ins = A._operations(a, b)
        assert (subs + dels + ins, hits + subs + dels, hits + subs + ins) == (levenshtein(a, b), len(a), len(b))
    a, b = (rng.choices("abcde", k=n) for n in (700, 600))  # several blocks
    assert A.distance(a, b) == levenshtein(a, b) == sum(A._operations(a, b)[1:])


def test_alignment_is_that_of_longest_blocks():
    rng = random.Random(6)
    for _ in range(400):
        a, b = (rng.choices("ab", k=rng.randrange(50)) + rng.choices("abcd", k=rng.randrange(30)) for _ in range(2))
        want = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        assert A.opcodes(a, b) == want


def test_error_rates_read_whole_texts(spark, tmp_path):
    rng = random.Random(5)
    texts = {i: [f"w{rng.randrange(90)}" for _ in range(n)] for i, n in enumerate((0, 5, 41, 150, 330))}
    docs = spark.createDataFrame([(i, "en", " ".join(t)) for i, t in texts.items()], "doc_id long, lang string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", "w1 w2")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    errors, kinds = 0, Counter()
    for d, r in texts.items():
        h = [" " if (d + i) % 7 == 0 else x for i, x in enumerate(r, 1) if (d + i) % 11]
        errors += levenshtein(r, h)
        known = {"w1", "w2"}
        for op, a, b, c, e in difflib.SequenceMatcher(None, r, h, autojunk=False).get_opcodes():
            if op == "equal":
                kinds["false_flag"] += sum(x not in known for x in r[a:b])
            elif op == "replace":
                kinds.update("rare_ref" if x not in known else "real_word_hyp" if y in known else "non_word_hyp" for x, y in zip(r[a:b], h[c:e]))
    for name in ("wer_by_lang", "error_decomposition"):
        one = catalog.QUERIES[name](spark, str(tmp_path)).first()
        assert (one["errors"], one["words"]) == (errors, sum(map(len, texts.values())))
    assert {r["kind"]: r["n"] for r in catalog.QUERIES["error_classes"](spark, str(tmp_path)).collect()} == kinds
    chars = ["".join("w" for _ in t) for t in texts.values()]
    one = catalog.QUERIES["cer_micro"](spark, str(tmp_path)).first()
    dropped = sum(sum((d + i) % 6 == 0 for i in range(1, len(c) + 1)) for d, c in enumerate(chars))
    assert (one["errors"], one["chars"]) == (dropped, sum(map(len, chars)))


def test_bootstrap_has_no_largest_input(spark, monkeypatch):
    rows = spark.range(50).select("id", (F.col("id") * 7 % 13).alias("err"), F.lit(3).alias("n"))
    sums = lambda: sorted(map(tuple, S.bootstrap_sums(rows, "id", ["err", "n"], 8, 5).collect()))
    few, share = sums(), S.bootstrap_percentile(rows, "id", "err", 0.8, 8, 5).first()
    assert len(few) == 8 and all(n == 150 for _, _, n in few)
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    plan = S.bootstrap_sums(rows, "id", ["err", "n"], 8, 5)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and sums() == few
    assert S.bootstrap_percentile(rows, "id", "err", 0.8, 8, 5).first() == share
    # above the bound that made it fail
    big = S.bootstrap_sums(spark.range(2_000_001).select("id", F.lit(1).alias("n")), "id", ["n"], 1, 5).collect()
    assert [tuple(r) for r in big] == [(1, 2_000_001)]

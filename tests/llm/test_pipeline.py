"""Each stage against a brute-force version, on its own input."""

import re

import corpus_pipeline as cp
import numpy as np
from quillforge.llm import quality_classifier as qc

from .test_codecs import check_packing
from .test_near_dedup import brute as near_brute
from .test_quality import brute as counts_of
from .test_quality import flat
from .test_suffix_dedup import brute as suffix_brute


def rejected(text):
    """The rules, one by one, on counts made with regular expressions."""
    c = counts_of(text)
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    n, letterless = c["n_words"], sum(not re.search("[A-Za-zÀ-\U0010ffff]", w) for w in words)
    return (
        n < 50 or 100 * c["n_repeat_words"] > 50 * n or 10 * c["n_symbols"] > n or 10 * c["n_dup_lines"] > 3 * c["lines"]
        or not 2 * n <= c["word_chars"] <= 15 * n or 10 * c["upper"] > 4 * c["word_chars"] or 10 * letterless > 2 * n
    )


def test_run(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    kept, each = docs, {"input": {r["doc_id"]: r for r in docs.collect()}}
    for name, stage in cp.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, sf_small).collect(), docs.schema)
        assert kept.columns == docs.columns
        each[name] = {r["doc_id"]: r for r in kept.collect()}
    whole = each["input"]
    labels = spark.read.parquet(f"{sf_small}/labels.parquet").filter(~qc.held_out(cp.F.col("doc_id")))
    model = qc.fit(docs, labels)
    scores = model.score(qc.features(*flat([r["text"] for r in whole.values()])))
    clear = {d: s >= 0.5 for d, s in zip(whole, scores.tolist(), strict=True) if abs(s - 0.5) > 1e-6}
    assert {d for d, ok in clear.items() if ok} == {d for d in each["quality_classifier"] if d in clear}
    assert set(each["quality_rules"]) == {d for d, r in each["quality_classifier"].items() if not rejected(r["text"])}
    classes = near_brute([(d, r["text"]) for d, r in each["quality_rules"].items()])
    assert set(each["near_dedup"]) == {d for d, c in classes.items() if c == d}
    assert all(each["near_dedup"][d] == whole[d] for d in each["near_dedup"])
    cut = suffix_brute([(d, r["text"]) for d, r in each["near_dedup"].items()], 100)
    assert set(each["suffix_dedup"]) == set(cut)
    for d, r in each["suffix_dedup"].items():
        n_bytes, n_removed = cut[d][:2]
        assert r["n_chars"] == len(r["text"])
        # bytes that are left of a character which is cut in part are dropped, three at most at each end of a span
        assert 0 <= n_bytes - n_removed - len(r["text"].encode()) <= 6 * cut[d][2]
    assert len(whole) > len(each["quality_classifier"]) > len(each["quality_rules"]) > len(each["near_dedup"]) > 50
    packed = cp.run(spark, sf_small).collect()
    assert {r["doc_id"] for r in packed} == set(each["suffix_dedup"])
    n = check_packing(packed, {d: r["text"] for d, r in each["suffix_dedup"].items()})
    assert n <= -(-int(np.sum([r["length"] for r in packed])) // 2048) * 1.02 + 1


def test_edges(spark, sf_small):
    text = " ".join(f"word{i}" for i in range(90))
    rows = [(1, text, "a", 1), (1, text, "a", 1), (2, text + " more", None, 2), (None, None, "b", None), (3, "", "c", 0), (4, text.upper(), "d", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, score int").repartition(2)
    assert cp.near_dedup(spark, df, sf_small).count() == 3  # the first pair with 2; the two empty ones; the shouted one
    rules = cp.quality_rules(spark, df, sf_small)
    assert rules.columns == df.columns and sorted(r["doc_id"] for r in rules.collect()) == [1, 1, 2]
    cut = {r["kept"]: r["text"] for r in cp.suffix_dedup(spark, df, sf_small).collect()}
    assert cut["a"] == text and cut["b"] == "" and cut["c"] == ""
    for _, stage in cp.STAGES:
        assert stage(spark, df.limit(0), sf_small).collect() == []


def test_outputs_go_before_kept_columns_of_their_names(spark):
    from quillforge.llm import html_extraction, quality_rules, substring_dedup, suffix_dedup

    names = ["doc_id", "text", "kept", "n_words", "n_removed", "score", "predicted", "spans", "base_failed"]
    df = spark.createDataFrame([(1, "a b", "x", "x", "x", "x", "x", "x", "x")], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    model = qc.fit(df, spark.createDataFrame([], "doc_id long, quality int"))
    for out in (qc.score(df, model, keep=names), quality_rules.judge(df, keep=names), suffix_dedup.remove_repeats(df, keep=names), substring_dedup.remove_repeated_windows(df, keep=names)):
        assert len(set(out.columns)) == len(out.columns) and len(out.collect()) == 1
    pages = df.withColumns({"html": df["text"], "url": df["text"]})
    assert html_extraction.main_text(pages, keep=names).select("text", "score").first() == ("a b", "x")

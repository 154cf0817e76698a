"""From raw documents to packed training sequences.

Stages in order: quality classifier, quality rules, near-duplicate removal, suffix-array deduplication, packing.
Each works on all that the stage before kept; all but the last return the columns of documents.

Nulls, empty texts, repeated rows and empty tables are what the operators define: an empty text fails the rules, one
row of each near-duplicate class stays, and an empty table passes through.  Columns other than doc_id, text and
n_chars (which follows the text) are carried along unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.llm.common import NULL_ID, Scratch, table
from quillforge.llm.near_dedup import near_duplicates
from quillforge.llm.packing import pack_documents
from quillforge.llm.quality_classifier import fit, held_out, score
from quillforge.llm.quality_rules import judge
from quillforge.llm.suffix_dedup import remove_repeats


def _carried(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with column names that no operator uses, and the way back."""
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    model = fit(docs, labels)
    inner, names = _carried(docs)
    scored = score(inner, model, names["text"], list(names.values())).filter("predicted = 1")
    return scored.select(*[F.col(n).alias(c) for c, n in names.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    inner, names = _carried(docs)
    judged = judge(inner, names["text"], list(names.values())).filter("kept")
    return judged.select(*[F.col(n).alias(c) for c, n in names.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    inner, names = _carried(docs)
    classes = near_duplicates(docs.select("doc_id", "text")).filter("kept")
    kept = classes.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("k"), F.col("text_hash").alias("h"))
    keyed = inner.withColumn("k", F.coalesce(F.col(names["doc_id"]).cast("long"), F.lit(NULL_ID))).withColumn("h", F.xxhash64(F.coalesce(F.col(names["text"]), F.lit(""))))
    # rows that repeat both id and text are one document
    one = keyed.join(kept, ["k", "h"], "left_semi").dropDuplicates(["k", "h"])
    return one.select(*[F.col(n).alias(c) for c, n in names.items()])


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    inner, names = _carried(docs)
    rest = [n for c, n in names.items() if c not in ("doc_id", "text", "n_chars")]
    out = remove_repeats(inner, names["text"], names["doc_id"], keep=rest, as_text=True)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[made.get(c, F.col(n)).alias(c) for c, n in names.items()])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: The classifier, the near-duplicate classes and the packing are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        kept = scratch.put(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        docs = before = kept
    packed = STAGES[-1][1](spark, docs, sf_dir)  # has read them all
    scratch.drop(docs)
    return packed

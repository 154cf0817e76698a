"""The folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local master without one gets a temporary folder, which its executors share."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None) or (None if known.isEmpty() else known.get())
    if root is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="quillforge-")
    if known.isEmpty():
        sc.setCheckpointDir(root)
    return root


def fresh_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


def fixed(df: DataFrame) -> DataFrame:
    """df as it is now, in the shared folder: rows that were numbered keep their numbers when an executor is lost."""
    shared_root(df.sparkSession)
    return df.checkpoint()

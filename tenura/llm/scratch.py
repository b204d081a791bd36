"""Intermediate tables in the cluster's shared folder.

A table that several steps read is written once as Parquet below
``spark.checkpoint.dir`` (never a machine-local folder on a cluster), so a
lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tenura.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, grouped by application."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/tenura-llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch while tables are written: some megabytes of text for a Python worker and its executor.
BATCH = 2000


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for what runs inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    with batches_of(spark, BATCH):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

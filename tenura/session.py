"""Session helpers.

The library never assumes a machine-local folder on a cluster: the
checkpoint directory is read from ``spark.checkpoint.dir``.  Only a
``local[...]`` session (tests, bench) gets a scratch folder when the
setting is missing.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "tenura", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra_conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators expect."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the cluster.

    When ``spark.checkpoint.dir`` is unset we only invent one for a local
    master; on a cluster a shared folder must be configured.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not d and sc.master.startswith("local["):
        d = tempfile.mkdtemp(prefix="tenura-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if d:
        # each setCheckpointDir call opens a new sub-folder, so once per session is enough
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(d)
        return d
    raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")


def cut_lineage(df):
    """Reliable checkpoint (survives executor loss), never localCheckpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df, key: str, rows: int):
    """``df`` dealt by a hash of ``key`` over the session's slots, with some ``rows`` a
    task at least; an explicit count, which AQE keeps.  Else a panel small in bytes is
    one partition, however often a fit passes over it.  A partition is in the order of
    ``key``.  Rows enough for one task only stay as they are."""
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df if tasks <= 1 else df.repartition(tasks, key).sortWithinPartitions(key)

"""Incremental survival counts with Structured Streaming.

The reference has no stream; this is the streaming form of its
survival input: new shipment lines arrive as files, are joined to the
(static) orders table, and a stateful aggregation keeps
(t, removed, observed) per time.  After each micro-batch the complete
state is written to the epoch's folder of a table below the shared checkpoint folder, from which
Kaplan-Meier / Nelson-Aalen are computed (``survival.km_from_event_table``).
State and offsets live in the checkpoint location, so a restarted query
(or a lost executor) resumes without double counting.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.operators import survival as sv
from tenura.session import ensure_checkpoint_dir
from tenura.sources.panels import DAYS_PER_MONTH
from tenura.sources.tables import read_table


def shipment_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Streaming (t, e) rows: lineitem files as a stream, orders static."""
    li_schema = read_table(spark, sf_dir, "lineitem").schema
    li = (spark.readStream.schema(li_schema).option("maxFilesPerTrigger", max_files_per_trigger)
          .parquet(f"{sf_dir.rstrip('/')}/lineitem*.parquet")
          .select("l_orderkey", "l_shipdate", "l_returnflag"))
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    j = li.join(o, li.l_orderkey == o.o_orderkey).where(F.col("l_shipdate") >= F.col("o_orderdate"))
    return j.select(F.floor(F.datediff(F.col("l_shipdate"), F.col("o_orderdate")) / F.lit(DAYS_PER_MONTH)).cast("int").alias("t"),
                    F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("e"))


def run_time_counts(spark: SparkSession, sf_dir: str, out_dir: str | None = None) -> str:
    """Run the stream to the end of the available input (availableNow) and
    return the path of the state table (epoch, t, removed, observed)."""
    base = ensure_checkpoint_dir(spark)
    run = out_dir or os.path.join(base, f"stream-{uuid.uuid4().hex}")
    table = os.path.join(run, "time_counts")
    counts = shipment_stream(spark, sf_dir).groupBy("t").agg(
        F.count(F.lit(1)).alias("removed"), F.sum(F.col("e").cast("long")).alias("observed"))

    def publish(batch: DataFrame, epoch: int):
        # a folder for each epoch: a write that fails leaves the last state whole, a repeated one replaces itself
        batch.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")

    q = (counts.writeStream.outputMode("complete").foreachBatch(publish)
         .option("checkpointLocation", os.path.join(run, "_checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return table


def latest_counts(spark: SparkSession, table: str) -> DataFrame:
    """The state (t, removed, observed) of the newest epoch written."""
    all_epochs = spark.read.parquet(table)
    newest = all_epochs.agg(F.max("epoch")).first()[0]
    return all_epochs.where(F.col("epoch") == newest).drop("epoch")


def streamed_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    tc = latest_counts(spark, run_time_counts(spark, sf_dir))
    return sv.km_from_event_table(sv.event_table_from_counts(tc))

"""Shared pieces for registered queries: subject tables and result finishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura.sources.panels import account_panel, clean_panel, shipment_panel

DIGITS = 6


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column so both engines hash the same text."""
    cols = [F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned account panel with an integer event column."""
    p = clean_panel(account_panel(spark, sf_dir))
    return p.withColumn("event", (F.col("churn") == "Yes").cast("int"))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shipment_panel(spark, sf_dir)

"""Ordered computations over whole tables (F3, F4) without one-task windows.

Values are first reduced to (value, count); prefix sums over the value
order come from range partitioning (``global_prefix_sums``), and the
result is joined back on the value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.functions.ordinal import global_row_index
from tenura.session import cut_lineage
from tenura.functions.ordinal import global_prefix_sums


def quantile_position(df: DataFrame, id_col: str, value: str, name: str = "q") -> DataFrame:
    """share of rows strictly below the row's value, (rank-1)/n."""
    df = cut_lineage(df.select(id_col, value))  # read by the count, the per-value counts and the join back
    n = df.select(F.count(F.lit(1))).scalar()
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    below = global_prefix_sums(counts, "_v", ["_c"], suffix="_below", inclusive=False)
    j = df.select(id_col, F.col(value).alias("_v")).join(below.select("_v", "_c_below"), "_v")
    return j.select(id_col, (F.col("_c_below") / n.cast("double")).alias(name))


def dense_time_rank(df: DataFrame, time_col: str, name: str = "rank") -> DataFrame:
    """dense rank (1-based) of each distinct time among distinct times."""
    d = df.select(F.col(time_col).alias("_t")).distinct()
    r = global_row_index(d, ["_t"], "_r")
    return r.select(F.col("_t").alias(time_col), (F.col("_r") + 1).alias(name))

"""Global positions and prefix sums without a single-partition window.

``Window.orderBy(x)`` with no partition key moves every row into one
task.  These helpers range-partition on the order key instead: each
partition is numbered locally, partition totals (one row per partition)
give offsets, and a small join adds them back.  Work stays spread over
all tasks; only ``#partitions`` rows are combined centrally.

The locally numbered data is read twice (totals and the final join).
Range bounds are sampled per evaluation and a shuffled input has no
fixed row order, so the numbered data is written once with a reliable
``checkpoint`` (shared folder, survives executor loss) and both reads
see the same partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura.session import cut_lineage

_LOW33 = (1 << 33) - 1


def _range(df: DataFrame, n: int | None, *cols):
    """Range-partition on ``cols``.  Without an explicit count AQE sizes the
    partitions from the data (coalesced partitions stay contiguous ranges in
    order, so positions remain correct)."""
    return df.repartitionByRange(n, *cols) if n else df.repartitionByRange(*cols)


def global_row_index(df: DataFrame, order_cols: Sequence[str | Column], name: str = "pos",
                     n_partitions: int | None = None) -> DataFrame:
    """Add a 0-based position in ``order_cols`` order (ties broken by the
    full order key only, so make the key unique)."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    r = (_range(df, n_partitions, *cols)
         .sortWithinPartitions(*cols)
         .withColumn("_mid", F.monotonically_increasing_id()))
    r = cut_lineage(r)
    r = r.withColumn("_pid", F.shiftright(F.col("_mid"), 33)).withColumn("_loc", F.col("_mid").bitwiseAND(F.lit(_LOW33)))
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offs = counts.select("_pid", (F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
                         .alias("_off"))
    out = r.join(F.broadcast(offs), "_pid").withColumn(name, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_loc"))
    return out.drop("_mid", "_pid", "_loc", "_off")


def global_prefix_sums(df: DataFrame, order_col: str, sum_cols: Sequence[str], suffix: str = "_cum",
                       inclusive: bool = True, n_partitions: int | None = None) -> DataFrame:
    """Running sums of ``sum_cols`` in ``order_col`` order (order key unique).

    Range partitions are summed locally in Arrow batches; partition totals,
    one row each, become offsets.  The partition's number is written with the
    rows: a task's number depends on the stage it runs in (a union shifts it).
    Nulls count as zero."""
    r = cut_lineage(_range(df, n_partitions, order_col).sortWithinPartitions(order_col)
                    .withColumn("_pid", F.spark_partition_id()))
    names, scols = r.columns, list(sum_cols)
    out_schema = T.StructType([*r.schema.fields, *[T.StructField(c + suffix, T.DoubleType()) for c in scols]])

    def local(batches):
        carry = dict.fromkeys(scols, 0.0)
        for batch in batches:
            added = []
            for c in scols:
                v = pc.fill_null(batch.column(names.index(c)).cast(pa.float64()), 0.0).to_numpy()
                cs = np.cumsum(v) + carry[c]
                carry[c] = float(cs[-1]) if len(cs) else carry[c]
                added.append(pa.array(cs if inclusive else cs - v))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], out_schema.names)

    loc = r.mapInArrow(local, out_schema)
    tot = loc.groupBy("_pid").agg(
        *[F.sum(F.col(c).cast("double")).alias("_t_" + c) for c in scols])
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_pid", *[F.coalesce(F.sum("_t_" + c).over(w), F.lit(0.0)).alias("_o_" + c) for c in scols])
    j = loc.join(F.broadcast(offs), "_pid")
    return j.select(*df.columns, *[(F.col(c + suffix) + F.col("_o_" + c)).alias(c + suffix) for c in scols])


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles (same definition as
    ``percentile`` / ``quantile_cont``) without holding a value map per group.

    Rows are reduced to counts per (group, value) by a distributed
    aggregate; running counts over the (group, value) order come from
    range partitioning (``global_prefix_sums`` on a composite key); each quantile
    then needs only the two order statistics around position (n-1)p.
    Output: groups..., p, q."""
    x = F.col(value).cast("double")
    counts = df.where(x.isNotNull()).groupBy(*groups, x.alias("_v")).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    key = F.struct(*[F.col(g) for g in groups], F.col("_v")) if groups else F.col("_v")
    # the per-value counts are read several times (running counts, group totals): write once
    counts = cut_lineage(counts.withColumn("_key", key))
    cum = global_prefix_sums(counts, "_key", ["_c"], suffix="_cum", inclusive=True)
    if groups:
        # rows before each group and its size: one small row per group, joined back
        # (an aggregate, not a window, so no group is gathered into one task)
        gs = cum.groupBy(*groups).agg(F.min(F.col("_c_cum") - F.col("_c")).alias("_before"),
                                      F.max("_c_cum").alias("_last"))
        gs = gs.select(*groups, "_before", (F.col("_last") - F.col("_before")).alias("_n"))
        cum = cum.join(gs, list(groups))
    else:
        cum = cum.withColumn("_before", F.lit(0.0)).withColumn("_n", counts.select(F.sum("_c")).scalar())
    lo_idx = F.col("_c_cum") - F.col("_before") - F.col("_c")   # 0-based index of the first copy of the value
    hi_idx = F.col("_c_cum") - F.col("_before") - F.lit(1.0)    # index of the last copy
    ps = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")
    r = cum.select(*groups, "_v", "_n", lo_idx.alias("_lo"), hi_idx.alias("_hi"), ps)
    h = (F.col("_n") - 1) * F.col("p")
    r = r.select("*", F.floor(h).alias("_f"), F.ceil(h).alias("_k"), (h - F.floor(h)).alias("_frac"))
    at_f = (F.col("_f") >= F.col("_lo")) & (F.col("_f") <= F.col("_hi"))
    at_k = (F.col("_k") >= F.col("_lo")) & (F.col("_k") <= F.col("_hi"))
    g = r.where(at_f | at_k).groupBy(*groups, "p").agg(
        F.max(F.when(at_f, F.col("_v"))).alias("_vf"), F.max(F.when(at_k, F.col("_v"))).alias("_vk"),
        F.first("_frac").alias("_frac"))
    return g.select(*groups, "p", (F.col("_vf") + F.col("_frac") * (F.col("_vk") - F.col("_vf"))).alias("q"))

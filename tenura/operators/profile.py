"""Profiling.

Every profile is one scan: all per-column statistics are computed in a
single aggregate (or one unpivot + groupBy) and then turned into one row
per column.  Exact distinct counts and exact percentiles are available
for the oracle; ``approx=True`` switches to HyperLogLog++ / GK sketches,
whose memory does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura.functions.ordinal import exact_quantiles

NUMERIC = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def shape(df: DataFrame) -> DataFrame:
    """B1: (rows, cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).alias("n_cols"))


def column_info(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: position, type, non-null, missing, distinct."""
    aggs = []
    for i, c in enumerate(df.columns):
        col = F.col(f"`{c}`")
        dc = F.approx_count_distinct(col) if approx else F.count_distinct(col)
        aggs += [F.count(col).alias(f"nn_{i}"), F.count_if(col.isNull()).alias(f"na_{i}"), dc.alias(f"nd_{i}")]
    wide = df.agg(*aggs)
    types = dict(df.dtypes)
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                 F.col(f"nn_{i}").alias("non_null"), F.col(f"na_{i}").alias("n_missing"),
                 F.col(f"nd_{i}").cast("long").alias("n_distinct"))
        for i, c in enumerate(df.columns)])).alias("r")
    return wide.select(rows).select("r.*")


def _long(df: DataFrame, cols: Sequence[str], value_type: str = "double") -> DataFrame:
    """Unpivot ``cols`` to (feature, value) in one narrow projection."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast(value_type).alias("value")) for c in cols])).alias("kv")
    ).select("kv.feature", "kv.value")


def describe(df: DataFrame, cols: Sequence[str], digits: int | None = None, exact: bool = True) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max per column,
    transposed to one row per feature (optionally rounded, reference: 3)."""
    lng = _long(df, cols)
    base = lng.groupBy("feature").agg(
        F.count("value").cast("double").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        *([] if exact else [F.percentile_approx("value", p, 10000).cast("double").alias(n)
                            for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]))
    if exact:
        # distributed exact quantiles (no per-feature value map in one task)
        qs = exact_quantiles(lng, "value", [0.25, 0.5, 0.75], ["feature"])
        wide = qs.groupBy("feature").pivot("p", [0.25, 0.5, 0.75]).agg(F.first("q"))
        wide = wide.select("feature", *[F.col(f"`{c}`").alias(n) for c, n in zip(wide.columns[1:], ("p25", "p50", "p75"))])
        base = base.join(wide, "feature")
    r = base.select("feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max")
    if digits is not None:
        r = r.select("feature", *[F.round(c, digits).alias(c) for c in r.columns if c != "feature"])
    return r


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Value, n (descending, ties by value)."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def column_roles(df: DataFrame, id_col: str, target: str, max_levels: int = 6) -> DataFrame:
    """cat = distinct < max_levels (target excluded), bin = exactly two
    distinct (target included), multi = cat and not bin, num = the rest
    without id and target."""
    info = column_info(df)
    nd = F.col("n_distinct")
    is_cat = (nd < max_levels) & (F.col("column") != target)
    role = (F.when(F.col("column") == id_col, "id")
            .when(nd == 2, "bin")
            .when(is_cat, "multi")
            .when(F.col("column") == target, "target")
            .otherwise("num"))
    return info.select("column", "n_distinct", role.alias("role"),
                       is_cat.alias("is_cat"), (nd == 2).alias("is_bin"))


def zscore_outliers(df: DataFrame, id_col: str, cols: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """|z| > threshold with population std.  Means and stds are scalar
    subqueries (one row, merged by Catalyst), not a cross join."""
    stats = {c: (df.select(F.avg(F.col(c).cast("double"))).scalar(),
                 df.select(F.stddev_pop(F.col(c).cast("double"))).scalar()) for c in cols}
    zs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), ((F.col(c) - stats[c][0]) / stats[c][1]).alias("z")) for c in cols])).alias("kv")
    return (df.select(id_col, zs).select(id_col, "kv.column", "kv.z")
            .where(F.abs(F.col("z")) > threshold))


def class_distribution(df: DataFrame, label: str, split: str) -> DataFrame:
    """Counts per (split, label) plus the 'all' rollup row per label."""
    r = df.rollup(label, split).agg(F.count(F.lit(1)).alias("n"), F.grouping(split).alias("_gs"),
                                    F.grouping(label).alias("_gl"))
    return (r.where(F.col("_gl") == 0)
            .select(F.when(F.col("_gs") == 1, F.lit("all")).otherwise(F.col(split)).alias("split"),
                    F.col(label).alias("label"), "n"))

"""Exploratory series (E1-E14): the data behind the reference's charts.

Pattern: unpivot many columns once (narrow ``explode`` of a struct
array), one ``groupBy`` with partial aggregation, then shares by a window
over the *grouped* rows (small), never over raw rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.functions.stats import safe_corr



def _melt(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), value_type: str = "string") -> DataFrame:
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast(value_type).alias("value"))
                             for c in cols])).alias("kv")
    return df.select(*keep, kv).select(*keep, "kv.variable", "kv.value")


def share_of_total(df: DataFrame, col: str, target: str) -> DataFrame:
    """Share of all rows per (value, target), in percent."""
    g = df.groupBy(F.col(col).alias("value"), F.col(target).alias("target")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def target_share(df: DataFrame, target: str) -> DataFrame:
    """E2."""
    g = df.groupBy(F.col(target).alias("target")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def category_by_class(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """(column, target, value, n, pct within class) for every column."""
    g = _melt(df, cols, [target]).groupBy("variable", F.col(target).alias("target"), "value").agg(
        F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("variable", "target")))


def histogram_by_class(df: DataFrame, widths: dict[str, float], target: str) -> DataFrame:
    """Percent histogram per class with fixed bin width per column;
    bin = floor(x / w), reported by its lower edge."""
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"),
                                      (F.floor(F.col(c).cast("double") / F.lit(float(w))) * F.lit(float(w))).alias("bin_lo"))
                             for c, w in widths.items()])).alias("kv")
    g = (df.select(F.col(target).alias("target"), kv).select("target", "kv.*")
         .where(F.col("bin_lo").isNotNull())
         .groupBy("variable", "target", "bin_lo").agg(F.count(F.lit(1)).alias("n")))
    return g.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("variable", "target")))


def kernel_density(df: DataFrame, col: str, groups: Sequence[str], m: int = 50) -> DataFrame:
    """Gaussian KDE per group on an m-point grid over [min, max] of
    the column; Scott bandwidth std_samp * n^(-1/5) per group.

    Rows are first reduced to (group, value, count); each reduced row is
    then expanded over the m grid points by a narrow ``explode`` (no join),
    so the work is distinct values x m."""
    x = F.col(col).cast("double")
    if not groups:
        df, groups = df.withColumn("_all", F.lit(1)), ["_all"]
        drop = True
    else:
        drop = False
    from tenura.session import cut_lineage
    df = cut_lineage(df.select(*groups, x.alias(col)))  # four passes read it: min, max, values, bandwidths
    x = F.col(col)
    lo = df.select(F.min(x)).scalar()
    hi = df.select(F.max(x)).scalar()
    vals = df.where(x.isNotNull()).groupBy(*groups, x.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    st = df.where(x.isNotNull()).groupBy(*groups).agg(F.count(F.lit(1)).alias("n_g"), F.stddev_samp(x).alias("sd"))
    bw = st.select(*groups, "n_g", (F.col("sd") * F.pow(F.col("n_g").cast("double"), F.lit(-0.2))).alias("h"))
    j = vals.join(bw, list(groups)).select("*", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("gi"))
    gx = lo + (hi - lo) * F.col("gi") / F.lit(float(m - 1))
    u = (F.col("x") - F.col("v")) / F.col("h")
    k = F.col("c") * F.exp(-0.5 * u * u)
    out = (j.withColumn("x", gx)
           .groupBy(*groups, "gi", "x")
           .agg((F.sum(k) / (F.first("n_g") * F.first("h") * F.lit(math.sqrt(2 * math.pi)))).alias("density")))
    return out.drop("_all") if drop else out


def box_stats(df: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (most extreme data inside the
    fences) and outlier count per group."""
    from tenura.functions.ordinal import exact_quantiles
    x = F.col(value).cast("double")
    qs = exact_quantiles(df, value, [0.25, 0.5, 0.75], groups)
    q = qs.groupBy(*groups).agg(F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
                                F.max(F.when(F.col("p") == 0.5, F.col("q"))).alias("median"),
                                F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"))
    q = q.withColumn("lo_f", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("hi_f", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = df.select(*groups, x.alias("x")).join(q, list(groups))
    inside = (F.col("x") >= F.col("lo_f")) & (F.col("x") <= F.col("hi_f"))
    return j.groupBy(*groups, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("x"))).alias("whisker_lo"), F.max(F.when(inside, F.col("x"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"), F.count(F.lit(1)).alias("n"))


def rate_by_facet(df: DataFrame, facet: str, col: str, y: Column, z: float = 1.959963984540054) -> DataFrame:
    """Mean of a 0/1 target per (facet, value) with a normal interval."""
    g = df.groupBy(F.col(facet).alias("facet"), F.col(col).alias("value")).agg(
        F.avg(y.cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"), F.stddev_samp(y.cast("double")).alias("sd"))
    half = F.lit(z) * F.coalesce(F.col("sd"), F.lit(0.0)) / F.sqrt(F.col("n").cast("double"))
    return g.select("facet", "value", "rate", "n", (F.col("rate") - half).alias("lo"), (F.col("rate") + half).alias("hi"))


def melt_counts(df: DataFrame, cols: Sequence[str], where: Column | None = None) -> DataFrame:
    """Filter, unpivot, count per (variable, value)."""
    if where is not None:
        df = df.where(where)
    return _melt(df, cols).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))


def counts_by_bucket(df: DataFrame, bucket: Column, target: str, levels: Sequence[str]) -> DataFrame:
    """Bucket x class counts, classes as columns."""
    return df.groupBy(bucket.alias("bucket")).pivot(target, list(levels)).agg(F.count(F.lit(1))).fillna(0)


def binned_pairs(df: DataFrame, x: str, y: str, wx: float, wy: float, group: str) -> DataFrame:
    """2-D bin counts per group (scatter series at any size)."""
    return df.groupBy(F.col(group).alias("group"),
                      (F.floor(F.col(x) / wx) * wx).alias("bx"),
                      (F.floor(F.col(y) / wy) * wy).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def binned_scatter_matrix(df: DataFrame, widths: dict[str, float], group: str) -> DataFrame:
    """(x, y, group, bx, by, n) of every pair of the columns of ``widths``
    (their bin widths), in one aggregate; a row with a null in a pair counts
    under the null bin."""
    bins = {c: F.floor(F.col(f"`{c}`") / w) * F.lit(float(w)) for c, w in widths.items()}
    pairs = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), bins[x].alias("bx"), bins[y].alias("by"))
             for x, y in itertools.combinations(widths, 2)]
    return (df.select(F.col(f"`{group}`").alias("group"), F.explode(F.array(*pairs)).alias("p"))
            .groupBy("p.x", "p.y", "group", "p.bx", "p.by").agg(F.count(F.lit(1)).alias("n")))


def binary_ones_zeros(df: DataFrame, cols: Sequence[str], where: Column | None = None) -> DataFrame:
    """Ones and zeros per binary (0/1) feature for one class."""
    if where is not None:
        df = df.where(where)
    return _melt(df, cols, value_type="int").groupBy("variable").agg(
        F.sum("value").cast("long").alias("ones"), (F.count("value") - F.sum("value")).cast("long").alias("zeros"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r for all ordered pairs, one aggregate over the table."""
    aggs, pairs = [], []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            aggs.append(safe_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c_{i}_{j}"))
            pairs.append((i, j))
    wide = df.agg(*aggs)
    items = []
    for i, j in pairs:
        items.append(F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), F.col(f"c_{i}_{j}").alias("r")))
        if i != j:
            items.append(F.struct(F.lit(cols[j]).alias("a"), F.lit(cols[i]).alias("b"), F.col(f"c_{i}_{j}").alias("r")))
    return wide.select(F.explode(F.array(*items)).alias("p")).select("p.*")


def first_appearance_codes(df: DataFrame, cols: Sequence[str], order_key: str) -> DataFrame:
    """E14 step 1: code each value of each column by order of first
    appearance (min order key), 0-based: one row per (variable, value)."""
    first = _melt(df, cols, [order_key]).groupBy("variable", "value").agg(F.min(order_key).alias("first_seen"))
    # with a unique order key no two values share a first row, so the dense
    # rank is the position in (variable, first_seen) order minus the
    # variable's first position: range partitioning, not a per-variable window
    from tenura.functions.ordinal import global_row_index
    r = global_row_index(first, ["variable", "first_seen"], "_g")
    offs = r.groupBy("variable").agg(F.min("_g").alias("_o"))
    return (r.join(F.broadcast(offs), "variable")
            .select("variable", "value", "first_seen", (F.col("_g") - F.col("_o")).cast("int").alias("code")))


def factorized_correlation(df: DataFrame, cols: Sequence[str], order_key: str) -> DataFrame:
    """Pearson r of first-appearance codes, any number of columns.  All
    columns meet their codes in one join of (variable, value), rows come
    together again by the order key, and one aggregate has all products.  The
    order key is unique; a null is a value like any other."""
    codes = first_appearance_codes(df, cols, order_key).select(F.col("variable").alias("_var"), F.col("value").alias("_val"), "code")
    long = _melt(df, cols, [order_key])
    met = long.join(codes, (long["variable"] == codes["_var"]) & long["value"].eqNullSafe(codes["_val"]))
    coded = met.groupBy(order_key).agg(*[F.max(F.when(F.col("variable") == c, F.col("code"))).cast("double").alias(f"_k{i}")
                                         for i, c in enumerate(cols)])
    return correlation_matrix(coded.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(cols)]), cols)

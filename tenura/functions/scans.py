"""Running sums and products within groups, cut into blocks of the order.

A window over a group's distinct times is one task, however long the group
is.  Here the order is cut into blocks of about ``ROWS`` rows at quantiles of
its values.  Each (group, block) is scanned on its own, a row of totals for
each of them is scanned over the blocks, and a join puts the two together.
Short tables are one block, for which there is nothing to join.

Block bounds are literals of the plan, so every reader of a table cuts it at
the same places, also when a lost task is run again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and the most blocks; blocks grow beyond ROWS * BLOCKS rows.
ROWS = 1 << 10
BLOCKS = 1 << 12
BLOCK = "_blk"


def in_blocks(df: DataFrame, order: str, rows: int | None = None) -> tuple[DataFrame, list[str]]:
    """``df`` with its block number in ``order``, and that column's name in a
    list; both as they were when one block holds all.  ``df`` is read here, so
    it should be a written table.  Null comes first, NaN last."""
    k = min(BLOCKS, df.count() // (rows or ROWS))
    if k < 2:
        return df, []
    x = F.col(order).cast("double")
    bounds = df.where(x.isNotNull() & ~F.isnan(x)).agg(
        F.percentile_approx(x, [i / k for i in range(1, k)], max(10_000, 10 * k))).first()[0] or []
    bounds = sorted({float(b) for b in bounds if abs(b) != float("inf")})
    if not bounds:
        return df, []
    cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_x", outputCol=BLOCK, handleInvalid="keep")
    out = cut.transform(df.withColumn("_x", x)).withColumn(
        BLOCK, F.when(F.col("_x").isNull(), -1).otherwise(F.col(BLOCK).cast("int"))).drop("_x")
    return out, [BLOCK]


def same(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> Column:
    """Equality on ``cols`` in which null equals null."""
    return reduce(lambda p, q: p & q, [a[c].eqNullSafe(b[c]) for c in cols])


def running(df: DataFrame, groups: Sequence[str], order: str, block: Sequence[str], sums: Mapping[str, str] | None = None,
            products: Mapping[str, Column] | None = None, totals: Mapping[str, Column] | None = None,
            descending: bool = False) -> DataFrame:
    """Running values of each group in ``order`` (unique in a group), the row itself included.

    ``sums`` and ``products`` name a new column for each column to scan;
    ``totals`` name sums over the whole group.  ``block`` is what ``in_blocks``
    said."""
    scans = [(n, F.sum, F.col(c), lambda off, own: off + own) for n, c in (sums or {}).items()]
    scans += [(n, F.product, c, lambda off, own: off * own) for n, c in (products or {}).items()]
    wholes = dict(totals or {})
    way = F.desc if descending else F.asc
    inner = Window.partitionBy(*groups, *block).orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[f(c).over(inner).alias(n) for n, f, c, _ in scans])
    everything = Window.partitionBy(*groups).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if not block:
        return local.select("*", *[F.sum(c).over(everything).alias(n) for n, c in wholes.items()])
    per = df.groupBy(*groups, *block).agg(*[f(c).alias(n) for n, f, c, _ in scans], *[F.sum(c).alias(n) for n, c in wholes.items()])
    before = Window.partitionBy(*groups).orderBy(*[way(b) for b in block]).rowsBetween(Window.unboundedPreceding, -1)
    offs = per.select(*groups, *block, *[f(n).over(before).alias("_o_" + n) for n, f, _, _ in scans],
                      *[F.sum(n).over(everything).alias(n) for n in wholes])
    j = local.join(offs, same(local, offs, [*groups, *block]))
    return j.select(*[local[c] for c in df.columns],
                    *[F.when(F.col("_o_" + n).isNull(), local[n]).otherwise(merge(F.col("_o_" + n), local[n])).alias(n) for n, _, _, merge in scans],
                    *[offs[n] for n in wholes])

"""Cleaning, recoding and scalar column functions.

All of these are narrow projections/filters: Catalyst fuses them into a
single codegen stage next to the scan, and filters on raw columns reach
the parquet reader.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.functions.ordinal import global_row_index


def blank_rows(df: DataFrame, col: str) -> DataFrame:
    """Rows whose string field is blank (only spaces or empty)."""
    return df.where(F.trim(F.col(col)) == "")


def blank_to_null(df: DataFrame, col: str) -> DataFrame:
    """C2."""
    return df.withColumn(col, F.when(F.trim(F.col(col)) != "", F.col(col)))


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C3."""
    return df.na.drop(subset=list(cols))


def to_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C4: string/int -> double; unparsable -> null (never an exception)."""
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


def recode(df: DataFrame, mapping: Mapping[str, str], cols: Sequence[str]) -> DataFrame:
    """Replace category values on a subset of columns."""
    return df.replace(dict(mapping), subset=list(cols))


def flag_to_label(df: DataFrame, col: str, yes: str = "Yes", no: str = "No") -> DataFrame:
    """1 -> Yes, 0 -> No, anything else null."""
    return df.withColumn(col, F.when(F.col(col) == 1, yes).when(F.col(col) == 0, no))


def right_closed_bucket(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the first edge with x <= edge; last label above the last
    edge.  ``len(labels) == len(edges) + 1``."""
    assert len(labels) == len(edges) + 1
    e = F.when(x <= edges[0], labels[0])
    for edge, lab in zip(edges[1:], labels[1:-1]):
        e = e.when(x <= edge, lab)
    return e.when(x > edges[-1], labels[-1])


# Tenure groups of the reference (months, right-closed).
TENURE_EDGES = [12, 24, 48, 60]
TENURE_LABELS = ["Tenure_0-12", "Tenure_12-24", "Tenure_24-48", "Tenure_48-60", "Tenure_gt_60"]


def tenure_group(x: Column) -> Column:
    return right_closed_bucket(x, TENURE_EDGES, TENURE_LABELS)


def fixed_width_bins(x: Column, lo: float, hi: float, width: float) -> tuple[Column, Column, Column]:
    """Right-closed (lo + (k-1)w, lo + kw]; outside (lo, hi] -> null.
    Returns (bin id k >= 1, bin lower, bin upper)."""
    inside = (x > lo) & (x <= hi)
    k = F.when(inside, F.ceil((x - F.lit(lo)) / F.lit(width)).cast("int"))
    return k, (F.lit(lo) + (k - 1) * F.lit(width)).cast("double"), (F.lit(lo) + k * F.lit(width)).cast("double")


def split_by(df: DataFrame, pred: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where pred is true and rows where it is false (null in neither)."""
    return df.where(pred), df.where(~pred)


def yes_no_to_int(x: Column) -> Column:
    """C12."""
    return F.when(x == "Yes", 1).when(x == "No", 0)


def positional_rows(df: DataFrame, key: str, positions: Sequence[int] | None = None,
                    start: int | None = None, stop: int | None = None) -> DataFrame:
    """Dense 0-based position in key order, then pick a list or a
    half-open range of positions.  Positions come from range partitioning,
    not a single-task window."""
    r = global_row_index(df, [key], "pos")
    if positions is not None:
        r = r.where(F.col("pos").isin(list(positions)))
    if start is not None:
        r = r.where(F.col("pos") >= start)
    if stop is not None:
        r = r.where(F.col("pos") < stop)
    return r


def hash_uniform(*cols: Column | str) -> Column:
    """Deterministic U[0,1) from md5 of the concatenated text (first 8 hex
    digits): same value in any engine with md5, any partitioning."""
    txt = F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(txt), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """N rows by md5(key|seed) order (top-n; a sampling operator)."""
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def dummy_name(feature: str, value: Column) -> Column:
    """feature_value."""
    return F.concat_ws("_", F.lit(feature), value)

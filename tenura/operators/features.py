"""Feature engineering.

Level discovery is one aggregate (distinct values of the categorical
columns); the encodings themselves are plain
CASE expressions, so encoding is a narrow projection fused with the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.operators.clean import recode


def levels(df: DataFrame, cols: Sequence[str]) -> dict[str, list]:
    """Sorted distinct non-null values per column, in one job.  They become the
    encoding's columns or codes, so they are the model's state."""
    row = df.agg(*[F.array_sort(F.collect_set(F.col(c))).alias(c) for c in cols]).first()
    return {c: list(row[c]) for c in cols}


def label_encode(df: DataFrame, cols: Sequence[str], lv: dict[str, list] | None = None) -> DataFrame:
    """G1: alphabetical codes 0..k-1 (as the reference's label encoder)."""
    lv = lv or levels(df, cols)
    sel = []
    for c in df.columns:
        if c in cols:
            e = None
            for i, v in enumerate(lv[c]):
                e = F.when(F.col(c) == F.lit(v), F.lit(i)) if e is None else e.when(F.col(c) == F.lit(v), F.lit(i))
            sel.append(e.alias(c))
        else:
            sel.append(F.col(c))
    return df.select(*sel)


def one_hot(df: DataFrame, cols: Sequence[str], lv: dict[str, list] | None = None,
            drop_first: dict[str, str] | None = None) -> DataFrame:
    """One 0/1 column per level, named ``col_value``; originals
    dropped.  ``drop_first`` removes a chosen reference level per column."""
    lv = lv or levels(df, cols)
    keep = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    dummies = []
    for c in cols:
        for v in lv[c]:
            if drop_first and drop_first.get(c) == v:
                continue
            dummies.append((F.col(c) == F.lit(v)).cast("int").alias(f"{c}_{v}"))
    return df.select(*keep, *dummies)


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population std; the statistics are scalar
    subqueries over the same table (one row, no cross join)."""
    out = df
    for c in cols:
        x = F.col(c).cast("double")
        m = df.select(F.avg(x)).scalar()
        s = df.select(F.stddev_pop(x)).scalar()
        out = out.withColumn(c + suffix, (x - m) / s)
    return out


def hash_fraction(key: Column | str, seed: int) -> Column:
    """U[0,1) from the first 8 hex digits of md5(key|seed)."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat_ws("|", k.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_split(df: DataFrame, key: str, seed: int = 42, test_fraction: float = 0.2) -> DataFrame:
    """Stable train/test label per row (independent of partitioning
    and of executor loss; reproducible in any SQL engine with md5)."""
    return df.withColumn("split", F.when(hash_fraction(key, seed) < test_fraction, "test").otherwise("train"))


# Recoding of the reference before encoding.
NO_SERVICE_MAP = {"No internet service": "No", "No phone service": "No"}


def panel_features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Encode the cleaned account panel the way the reference encodes its
    table: recode 'No ... service', label-encode binaries (target too),
    one-hot multi-level columns.  Returns (table, feature names)."""
    d = recode(df, NO_SERVICE_MAP, ["online_security"])
    bins = ["partner", "dependents", "online_security", "churn"]
    multi = ["payment_method", "internet_service", "contract"]
    lv = levels(d, bins + multi)
    d = label_encode(d, bins, lv)
    d = one_hot(d, multi, lv)
    feats = ["senior", "partner", "dependents", "tenure", "online_security", "monthly_charges", "total_charges"]
    feats += [f"{c}_{v}" for c in multi for v in lv[c]]
    return d, feats


def assemble(df: DataFrame, feats: Sequence[str], out: str = "features") -> DataFrame:
    """VectorAssembler over the feature columns."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(feats), outputCol=out, handleInvalid="error").transform(df)


def gram_matrix(df: DataFrame, cols: Sequence[str]):
    """Uncentred X'X (p x p) in one aggregate; p(p+1)/2 sums."""
    import numpy as np
    aggs = [F.sum(F.col(f"`{a}`").cast("double") * F.col(f"`{b}`").cast("double")).alias(f"g{i}_{j}")
            for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    row = df.agg(*aggs).first()
    p = len(cols)
    G = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            G[i, j] = G[j, i] = row[f"g{i}_{j}"] or 0.0
    return G


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Uncentred VIF_j = X_j'X_j / residual of X_j on the other columns (no
    constant, as in the reference).  A column that the others determine, such
    as one of two complete dummy groups, gets +inf, the others keep theirs."""
    import numpy as np
    G = gram_matrix(df, cols)
    scale = np.sqrt(np.where(np.diag(G) > 0, np.diag(G), 1.0))
    G = G / np.outer(scale, scale)
    vals = []
    for j in range(len(cols)):
        rest = [i for i in range(len(cols)) if i != j]
        left = float(G[j, j] - G[j, rest] @ np.linalg.pinv(G[np.ix_(rest, rest)], rcond=1e-10, hermitian=True) @ G[rest, j])
        vals.append(float(G[j, j] / left) if left > 1e-9 else float("inf"))
    return df.sparkSession.createDataFrame(list(zip(cols, vals)), "feature string, vif double")

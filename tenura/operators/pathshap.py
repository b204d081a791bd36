"""Tree SHAP of fitted ensembles from a table of root-to-leaf paths.

A path is one leaf: for each distinct feature on the way its interval (lo, hi]
and the share z of cover that goes on along the path, and the leaf's value v.
With o = 1 where a row's value lies in the interval, else 0, the Shapley sum
over all subsets of the other m - 1 features of the path is

    phi_f = v (o_f - z_f) * integral over t in [0, 1] of prod_{g != f} (z_g (1 - t) + o_g t),

because the integral of t^k (1 - t)^(m-1-k) is the Shapley weight of a subset
of k features.  The integrand is a polynomial of degree m - 1, so Gauss-Legendre
with m / 2 points is exact: a path costs m * m / 2 products a row instead of
2^m.  Rows are explained in Arrow batches, one partition alone at a time; the
path table has the size of the model and travels with the task.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura.operators.trees import Ensemble

#: Numbers held for one lot of rows and one length of paths.
CELLS = 1 << 22


def path_table(ens: Ensemble, features: Sequence[str]) -> list[tuple]:
    """Paths by their number m of features: (feature places, lo, hi, z, v), arrays of (paths, m)."""
    place = {f: i for i, f in enumerate(features)}
    by_length = defaultdict(list)
    for _, _, value, cons in ens.leaf_paths():
        by_length[len(cons)].append((value, [(place[f], *c) for f, c in sorted(cons.items())]))
    out = []
    for m, paths in sorted(by_length.items()):
        cells = np.array([c for _, c in paths], float).reshape(len(paths), m, 4)
        out.append((cells[..., 0].astype(int), cells[..., 1], cells[..., 2], cells[..., 3], np.array([v for v, _ in paths])))
    return out


def explain(x: np.ndarray, paths: Sequence[tuple], n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """(phi of every row and feature, sum of leaf values of every row).  A null
    (NaN) goes right at every split, as in scoring."""
    x = np.where(np.isnan(x), np.inf, x)
    phi, margin = np.zeros((len(x), n_features)), np.zeros(len(x))
    for f, lo, hi, z, v in paths:
        n, m = f.shape
        if not m:
            margin += v.sum()
            continue
        at, weight = np.polynomial.legendre.leggauss((m + 1) // 2)
        at, weight = (at + 1) / 2, weight / 2
        to_feature = np.zeros((n * m, n_features))
        to_feature[np.arange(n * m), f.ravel()] = 1
        lot = max(1, CELLS // (n * m))
        for row in range(0, len(x), lot):
            own = x[row:row + lot][:, f]
            o = (((own > lo) | (lo == -np.inf)) & (own <= hi)).astype(float)
            margin[row:row + lot] += o.prod(2) @ v
            share = np.zeros_like(o)
            for t, w in zip(at, weight):
                factor = z * (1 - t) + o * t
                # products of the features before and after each one
                others = np.ones_like(factor)
                others[..., 1:] = np.cumprod(factor[..., :-1], 2)
                others[..., :-1] *= np.cumprod(factor[..., :0:-1], 2)[..., ::-1]
                share += w * others
            phi[row:row + lot] += ((o - z) * share * v[:, None]).reshape(len(o), -1) @ to_feature
    return phi, margin


def shap_values(df: DataFrame, ens: Ensemble, id_col: str, features: Sequence[str] | None = None) -> DataFrame:
    """Long (id, feature, value, phi, phi_prob_naive, base, margin,
    p_model), as ``explain.shap_values``, for ensembles of any size.

    ``features`` (default: those of the ensemble) are the ones returned; one that
    no split uses has phi 0.  For every row base + sum of phi over the ensemble's
    features is the margin, also where values are null.  Repeated ids are
    explained row by row."""
    wanted = list(features or ens.features())
    names = wanted + [f for f in ens.features() if f not in wanted]
    paths, base, k = path_table(ens, names), expected_margin(ens), len(wanted)
    ids = df.schema[id_col]
    schema = T.StructType([T.StructField("id", ids.dataType), T.StructField("feature", T.StringType()),
                           T.StructField("value", T.DoubleType()), T.StructField("phi", T.DoubleType()),
                           T.StructField("margin", T.DoubleType())])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], 1) if names else np.zeros((n, 0))
            phi, margin = explain(x, paths, len(names))
            row, of = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
            value = x[:, :k].ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(wanted, pa.string()).take(pa.array(of)),
                 pa.array(value, mask=np.isnan(value)), pa.array(phi[:, :k].ravel()), pa.array(margin[row] + ens.base_margin)],
                ["id", "feature", "value", "phi", "margin"])

    out = df.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(names)])
    out = out.mapInArrow(run, schema)

    def p(c):
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))
    return out.select(F.col("id").alias(id_col), "feature", "value", "phi",
                      (p(F.col("phi")) - F.lit(1.0 / (1.0 + math.exp(-base)))).alias("phi_prob_naive"),
                      F.lit(base).alias("base"), "margin", p(F.col("margin")).alias("p_model"))


def expected_margin(ens: Ensemble) -> float:
    """Leaf values weighted by their share of cover."""
    return float(ens.base_margin) + sum(v * math.prod(c[2] for c in cons.values()) for _, _, v, cons in ens.leaf_paths())

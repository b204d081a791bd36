"""Path-table SHAP against the sum over all subsets of features by tree recursion."""
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.operators import explain as ex
from tenura.operators import pathshap as ps
from tenura.operators import trees as tr

NAMES = ["a", "b", "c", "d", "e"]


def random_tree(rng, t, depth):
    """A full tree whose paths may meet a feature twice."""
    rows, cover = [], {0: 100.0}
    for i in range((2 << depth) - 1):
        if i >= (1 << depth) - 1:
            rows.append((t, i, -1, -1, None, None, float(rng.normal()), cover[i], 0.0))
            continue
        share = rng.uniform(0.1, 0.9)
        cover[2 * i + 1], cover[2 * i + 2] = cover[i] * share, cover[i] * (1 - share)
        rows.append((t, i, 2 * i + 1, 2 * i + 2, NAMES[rng.integers(0, 4)], float(np.round(rng.normal(), 1)), 0.0, cover[i], 1.0))
    return rows


@pytest.fixture(scope="module")
def ens():
    rng = np.random.default_rng(5)
    lone = [(9, 0, -1, -1, None, None, 0.25, 100.0, 0.0)]  # a tree of one leaf
    return tr.Ensemble([r for t, d in enumerate((1, 2, 3, 5)) for r in random_tree(rng, t, d)] + lone, base_margin=0.5)


def expected(ens, x, subset):
    """E[f | x_S]: splits on S follow x (null: right), others mix by cover."""
    def walk(n):
        if n.left < 0:
            return n.value
        left, right = ens.nodes[(n.tree_id, n.left)], ens.nodes[(n.tree_id, n.right)]
        if n.feature in subset:
            v = x[n.feature]
            return walk(left if v is not None and v <= n.threshold else right)
        return (left.cover * walk(left) + right.cover * walk(right)) / n.cover
    return ens.base_margin + sum(walk(ens.root(t)) for t in ens.trees)


def test_equals_all_subsets_with_nulls_ties_and_infinities(spark, ens, monkeypatch):
    rng = np.random.default_rng(6)
    edges = sorted({n.threshold for n in ens.nodes.values() if n.threshold is not None})
    rows = []
    for i in range(40):
        x = [float(rng.choice(edges)) if rng.random() < 0.4 else float(rng.normal()) for _ in NAMES]
        rows.append((f"r{i // 2}", *[None if rng.random() < 0.15 else v for v in x]))
    rows.append(("inf", -math.inf, math.inf, -math.inf, math.inf, 0.0))
    monkeypatch.setattr(ps, "CELLS", 300)
    df = spark.createDataFrame(rows, "id string, " + ", ".join(f"{f} double" for f in NAMES))
    df = df.withColumn("phi", F.lit("clash")).withColumn("margin", F.lit("clash")).coalesce(1)
    got = ps.shap_values(df, ens, "id", NAMES).collect()
    assert len(got) == len(rows) * len(NAMES)
    used = ens.features()
    want = []
    for r in rows:
        x = dict(zip(NAMES, r[1:]))
        for f in NAMES:
            phi = 0.0
            others = [g for g in used if g != f]
            for k in range(len(others) + 1):
                for s in itertools.combinations(others, k) if f in used else ():
                    w = math.factorial(k) * math.factorial(len(used) - k - 1) / math.factorial(len(used))
                    phi += w * (expected(ens, x, {*s, f}) - expected(ens, x, set(s)))
            want.append((r[0], f, x[f], phi, expected(ens, x, set(used))))
    for g, w in zip(got, want):
        assert (g["id"], g["feature"], g["value"]) == w[:3]
        assert g["phi"] == pytest.approx(w[3], abs=1e-10) and g["margin"] == pytest.approx(w[4], abs=1e-10)
        assert g["base"] == pytest.approx(expected(ens, {}, set()))


def test_same_rows_as_the_column_form(spark):
    from tenura.plans.ml_queries import encoded_all
    from tests.conftest import SF001
    d, _ = encoded_all(spark, SF001)
    ens = tr.Ensemble(tr.FROZEN_NODES)
    key = lambda r: (r["account_id"], r["feature"])
    a = sorted(ps.shap_values(d, ens, "account_id").collect(), key=key)
    b = sorted(ex.shap_values(d, ens, "account_id").collect(), key=key)
    assert len(a) == len(b) > 0 and a[0].asDict().keys() == b[0].asDict().keys()
    for x, y in zip(a, b):
        assert list(x)[:2] == list(y)[:2] and list(x)[2:] == pytest.approx(list(y)[2:], abs=1e-10)


def test_empty_table(spark, ens):
    df = spark.createDataFrame([], "id long, " + ", ".join(f"{f} double" for f in NAMES))
    assert ps.shap_values(df, ens, "id").collect() == []

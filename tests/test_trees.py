"""Tree ensemble invariants: SHAP additivity, PDP = mean ICE, H = 0 for additive pairs."""
import math

import pytest
from pyspark.sql import functions as F

from tenura.operators import explain as ex
from tenura.operators import trees as tr
from tests.conftest import SF001


@pytest.fixture(scope="module")
def enc(spark):
    from tenura.plans.model_queries import encoded
    return encoded(spark, SF001).cache()


def test_shap_additivity(enc):
    ens = tr.Ensemble(tr.FROZEN_NODES)
    s = ex.shap_values(enc, ens, "account_id")
    agg = s.groupBy("account_id").agg((F.first("base") + F.sum("phi")).alias("total"), F.first("margin").alias("m"))
    worst = agg.select(F.max(F.abs(F.col("total") - F.col("m")))).first()[0]
    assert worst < 1e-12


def test_pdp_is_mean_of_ice(enc):
    ens = tr.Ensemble(tr.FROZEN_NODES)
    grid = ex.quantile_grid(enc, "tenure", 7)
    ice = ex.ice(enc, ens, "account_id", "tenure", grid)
    p = {r["grid"]: r["pd"] for r in ex.pdp(ice).collect()}
    for g in grid:
        m = ice.where(F.col("grid") == g).agg(F.avg("yhat")).first()[0]
        assert math.isclose(p[g], m, rel_tol=1e-12)


def test_h_zero_for_pairs_without_shared_path(enc):
    ens = tr.Ensemble(tr.FROZEN_NODES)
    h = ex.h_statistic(enc, ens, [("dependents", "total_charges")]).first()
    assert h["h"] < 1e-6


def test_permuting_unused_feature_gives_zero(enc):
    ens = tr.Ensemble([r for r in tr.FROZEN_NODES if r[0] == 0])  # tree 0 does not use dependents
    d = enc
    r = ex.permutation_importance(d, ens, "account_id", "churn", ["dependents"], repeats=2).first()
    assert r["importance_mean"] == 0.0


def test_leaf_formula_equals_recursion(enc, spark):
    ens = tr.Ensemble(tr.FROZEN_NODES)
    alg = ex.LeafAlgebra(ens)
    staged = alg.with_indicators(enc)
    for subset in [set(), {"tenure"}, {"tenure", "monthly_charges"}]:
        a = alg.recursion_pd(subset)
        b = F.expr(ens.recursion_pd_sql(subset, tr.spark_ref))
        worst = staged.select(F.max(F.abs(a - b))).first()[0]
        assert worst < 1e-12

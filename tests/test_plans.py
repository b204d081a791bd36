"""Physical-plan rules from the design (checked on explain output)."""
import pytest

import __spark_entry__ as E
from tests.conftest import SF001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def q():
    return E.queries()


def test_scan_is_pruned_and_filtered(spark, q):
    import re
    p = plan(q["a1_panel_scan"](spark, SF001))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", p)
    assert schemas, p
    # columns the panel never uses are not read
    for unused in ("o_orderkey", "c_name", "n_name", "o_shippriority"):
        assert all(unused not in sc for sc in schemas), (unused, schemas)
    assert "PushedFilters: [IsNotNull(o_custkey)]" in p


def test_km_aggregates_before_window(spark, q):
    p = plan(q["k01_km_by_contract"](spark, SF001))
    assert p.index("Window") < p.rindex("HashAggregate")  # window sits above the aggregate
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["i14_ice_tenure", "i20_pdp_all", "i24_pdp_two_way", "j07_shap_values",
                                  "e05_kde_monthly_by_churn", "k25_subject_curves", "k12_smoothed_hazard_dependents"])
def test_no_cross_products(spark, q, name):
    p = plan(q[name](spark, SF001))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_scoring_stays_in_codegen(spark, q):
    df = q["h06_frozen_scores"](spark, SF001)
    df.collect()
    p = plan(df)  # final adaptive plan after execution
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "isFinalPlan=true" in p and "*(" in p  # whole-stage codegen stages are marked *(n)


def test_checkpoint_dir_read_from_session(spark):
    from tenura.session import ensure_checkpoint_dir
    d = ensure_checkpoint_dir(spark)
    assert d == spark.conf.get("spark.checkpoint.dir")

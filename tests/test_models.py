"""Models, feature checks and selections against brute force or planted structure."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.operators import explain as ex
from tenura.operators import features as fe
from tenura.operators import lime
from tenura.operators import models as mo
from tenura.operators import trees as tr


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), float(c), int(a + 0.2 * b > 0)) for i, (a, b, c) in enumerate(rng.normal(size=(300, 3)))]
    return spark.createDataFrame(rows, "id long, strong double, weak double, noise double, y int").cache()


def test_folds_are_disjoint_and_stable(planted):
    a = {r["id"]: r["fold"] for r in mo.with_folds(planted, "id", 5).collect()}
    b = {r["id"]: r["fold"] for r in mo.with_folds(planted.repartition(7), "id", 5).collect()}
    assert a == b and set(a.values()) == set(range(5)) and len(a) == 300


def test_elimination_keeps_the_planted_feature(planted):
    ranks = dict(mo.rfe_ranking(planted, ["strong", "weak", "noise"], "y", dict(maxIter=5, maxDepth=2)))
    assert ranks["strong"] == 1 and sorted(ranks.values()) == [1, 2, 3]


def test_surrogate_follows_the_black_box(planted):
    d = planted.withColumn("pred", (F.col("strong") > 0.3).cast("int"))
    t = mo.surrogate_tree(d, ["strong", "weak", "noise"], "pred", max_depth=3)
    out = t.transform(mo.assemble(d, ["strong", "weak", "noise"], "pred"))
    assert out.where("prediction <> pred").count() <= 6  # candidate splits are binned


def test_input_of_fits_and_backgrounds_is_made_once(spark, planted):
    """A fit and the many counts of a background read rows that were written, not the steps that make them."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    d = planted.mapInArrow(count, planted.schema)
    m = mo.fit(mo.gbt(dict(maxIter=2, maxDepth=2)), mo.assemble(d, ["strong", "weak"], "y"))
    assert made.value == 300 and m.getNumTrees == 2
    stats, _ = lime.background_stats(d, ["strong", "weak"], ["y"])
    assert made.value == 600 and sum(share for _, share in stats["y"][2]) == pytest.approx(1)


def test_vif_against_least_squares(planted):
    d = planted.withColumn("mixed", F.col("strong") + F.col("weak") * 0.5 + F.col("noise") * 0.1 + F.lit(0.2))
    cols = ["strong", "weak", "mixed"]
    got = {r["feature"]: r["vif"] for r in fe.vif(d, cols).collect()}
    X = np.array(d.select(cols).collect(), float)
    for j, c in enumerate(cols):
        rest = np.delete(X, j, 1)
        left = X[:, j] - rest @ np.linalg.lstsq(rest, X[:, j], rcond=None)[0]
        assert got[c] == pytest.approx(X[:, j] @ X[:, j] / (left @ left), rel=1e-8)


def test_vif_of_complete_dummies_is_infinite_for_them_alone(spark):
    rows = [(float(i % 2), float(1 - i % 2), float(i % 3 == 0), float(i % 3 > 0), float(i * 7 % 11)) for i in range(66)]
    d = spark.createDataFrame(rows, "a0 double, a1 double, b0 double, b1 double, x double")
    got = {r["feature"]: r["vif"] for r in fe.vif(d, d.columns).collect()}
    assert all(got[c] == float("inf") for c in ("a0", "a1", "b0", "b1")) and got["x"] < 10


def test_submodular_pick_is_greedy(spark):
    w = {"i1": [3.0, 0.0, 0.0], "i2": [0.0, 2.0, 0.0], "i3": [0.0, 2.0, 0.0], "i4": [1.0, 1.0, 0.0], "i5": [0.0, 0.0, 0.1]}
    e = spark.createDataFrame(list(w.items()), "id string, weights_k array<double>")
    picked = [r["id"] for r in lime.submodular_pick(e, "id", ["a", "b", "c"], 3).orderBy("rank").collect()]
    assert picked == ["i4", "i5", "i1"]


def test_permutation_is_a_bijection(spark):
    """Every permutation of a feature leaves its values as they are, in another order."""
    n = 97
    ens = tr.Ensemble(tr.FROZEN_NODES)
    d = spark.range(n).select("id", F.lit(1).alias("churn"), *[(F.col("id") * (k + 3) % 13).cast("double").alias(f)
                                                                for k, f in enumerate(ens.features())])
    rows = ex.permutation_importance(d, ens, "id", "churn", ens.features(), repeats=2, return_scores=True).collect()
    assert len(rows) == 2 * len(ens.features())
    for f in ens.features():
        for r in range(2):
            h, g = ex.shuffle_seeds(f, r, 0)
            a = h % n
            while np.gcd(a, n) != 1:
                a += 1
            assert sorted((a * k + g) % n for k in range(n)) == list(range(n))

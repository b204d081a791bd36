"""Registered queries do the whole job: every feature, row, fold and setting."""
import weakref

import pytest

import __spark_entry__ as E
from tenura.operators import boosting as bo
from tenura.operators import lime
from tenura.operators import models as mo
from tenura.operators import pathshap
from tenura.plans import ml_queries as ml
from tests.conftest import SF001


@pytest.fixture
def asked(monkeypatch):
    """Boosters that were asked for; stumps are fitted in their place."""
    seen, real = [], mo.gbt

    def stump(params=None, seed=42):
        seen.append(dict(params or {}))
        return real(dict(maxIter=1, maxDepth=1), seed)
    monkeypatch.setattr(mo, "gbt", stump)
    return seen


@pytest.fixture
def grown(monkeypatch):
    """(trees, depth, rate, left out fold) of the boosters asked for; stumps are grown in their place."""
    seen, real = [], bo.fit

    def stump(data, boosters):
        asked = [(b.trees, b.depth, b.rate, b.left_out) for b in boosters]
        seen.extend(asked)
        for b in boosters:
            b.trees = b.depth = 1
        state = real(data, boosters)
        for b, (trees, depth, *_) in zip(boosters, asked):
            b.trees, b.depth = trees, depth
        return state
    monkeypatch.setattr(bo, "fit", stump)
    return seen


def test_rfe_ranks_every_feature(spark, grown):
    feats = ml.encoded_all(spark, SF001)[1]
    ranks = {r["feature"]: r["rank"] for r in E.queries()["g09_rfe_ranking"](spark, SF001).collect()}
    assert set(ranks) == set(feats) and sorted(ranks.values()) == list(range(1, len(feats) + 1))
    assert grown == [(100, 3, 0.1, None)] * (len(feats) - 1)


def test_rfecv_scores_every_count_in_five_folds(spark, grown):
    feats = ml.encoded_all(spark, SF001)[1]
    rows = E.queries()["g10_rfecv_support"](spark, SF001).collect()
    assert sorted((r["n_features"], r["n_folds"]) for r in rows) == [(n, 5) for n in range(1, len(feats) + 1)]
    assert sum(r["is_support"] for r in rows) == 1
    assert grown == [(100, 3, 0.1, f) for _ in feats for f in range(5)]


def test_grid_search_has_the_reference_grid(spark, grown):
    rows = E.queries()["h08_grid_search_auc"](spark, SF001).collect()
    assert set(grown) == {(150, d, s, f) for d in (4, 3) for s in (0.15, 0.2) for f in range(5)} and len(grown) == 20
    assert len(rows) == 4 and sum(r["is_best"] for r in rows) == 1


def ids(df):
    return {r["account_id"] for r in df.select("account_id").distinct().collect()}


def test_shap_explains_the_tuned_model_on_the_training_rows(spark, asked, monkeypatch):
    explained, real = [], pathshap.shap_values
    monkeypatch.setattr(mo, "_FITTED", weakref.WeakKeyDictionary())  # the stump is not kept for others
    monkeypatch.setattr(pathshap, "shap_values", lambda df, *a: (explained.append(df), real(df, *a))[1])
    assert E.queries()["j07_shap_on_trained_gbt"](spark, SF001).count() == 1  # a stump's only feature
    d = ml.encoded_all(spark, SF001)[0]
    assert asked == [mo.TUNED] and ids(explained[0]) == ids(d.where("split = 'train'"))


@pytest.fixture
def few_samples(monkeypatch):
    """The rows that LIME was given; each has 20 samples in place of 5000."""
    seen, real = [], lime.explain

    def explain(rows, *a, n_samples, **k):
        seen.append(rows)
        return real(rows, *a, n_samples=20, **k)
    monkeypatch.setattr(lime, "explain", explain)
    return seen


@pytest.mark.parametrize("name", ["j02_lime_weights", "j03_lime_top_k"])
def test_lime_explains_both_parts_of_the_split(spark, few_samples, asked, name, monkeypatch):
    monkeypatch.setattr(mo, "_FITTED", weakref.WeakKeyDictionary())
    out = E.queries()[name](spark, SF001)
    assert ids(out) == ids(ml.encoded_all(spark, SF001)[0])


def test_sp_lime_picks_from_the_training_rows(spark, few_samples, asked, monkeypatch):
    monkeypatch.setattr(mo, "_FITTED", weakref.WeakKeyDictionary())
    out = E.queries()["j06_sp_lime"](spark, SF001)
    train = ids(ml.encoded_all(spark, SF001)[0].where("split = 'train'"))
    assert ids(few_samples[0]) == train and out.count() == 5 and ids(out) <= train


def test_threshold_sweep_refits_fifty_trials(spark, grown):
    rows = E.queries()["h15_threshold_sweep_refits"](spark, SF001).collect()
    assert len(rows) == 51 and len(grown) == 50
    assert {g[:3] for g in grown} == {(100, 3, 0.1)} and {g[3] for g in grown} == {bo.Draw(t, 0.1) for t in range(50)}

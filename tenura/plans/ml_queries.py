"""Registered training, tuning, surrogate, LIME and SMOTE-NC queries: these fit
models or draw samples, so there is no SQL oracle.  tests/ holds the LIME
solver, the kNN and the balance of SMOTE-NC against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenura.operators import boosting as bo
from tenura.operators import explain as ex
from tenura.operators import lime
from tenura.operators import metrics as me
from tenura.operators import models as mo
from tenura.operators import pathshap
from tenura.operators import smote
from tenura.operators import trees as tr
from tenura.operators.features import hash_split, panel_features
from tenura.plans.common import finish
from tenura.plans.sqltext import PANEL_LEVELS
from tenura.session import cut_lineage
from tenura.sources.panels import account_panel, clean_panel

QUERIES = {}
SQL = {}

# The reference's default booster.
BOOSTER = dict(trees=100, depth=3, rate=0.1)


def _reg(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def encoded_all(spark, sf):
    d, feats = panel_features(clean_panel(account_panel(spark, sf)))
    d = hash_split(d, "account_id", 42, 0.2)
    d = d.select("account_id", "churn", "split", *[F.col(f"`{c}`").cast("double").alias(c) for c in feats])
    return d, feats


def _train_test(spark, sf):
    d, feats = encoded_all(spark, sf)
    a = mo.assemble(d, feats, "churn")
    return a.where(F.col("split") == "train"), a.where(F.col("split") == "test"), feats


def _report(pred):
    pred = cut_lineage(pred.select("label", "pred", "p1"))  # four reports read it
    cm = me.confusion_matrix(pred, "label", "pred").select(
        F.concat_ws("_", F.lit("cm"), F.col("actual").cast("string"), F.col("predicted").cast("string")).alias("metric"),
        F.col("n").cast("double").alias("value"))
    acc = me.accuracy(pred, "label", "pred").select(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    ah = me.auc_hard(pred, "label", "pred").select(F.lit("auc_hard").alias("metric"), F.col("auc_hard").alias("value"))
    asc = me.auc_score(pred, "label", "p1").select(F.lit("auc_score").alias("metric"), F.col("auc_score").alias("value"))
    return cm.unionByName(acc).unionByName(ah).unionByName(asc)


@_reg("h01_gbt_default_test_report")
def h01_gbt_default_test_report(spark, sf):
    tr_, te, _ = _train_test(spark, sf)
    m = mo.fit(mo.gbt(mo.DEFAULT), tr_)
    return finish(_report(mo.predict(m, te, ["account_id"])))


@_reg("h02_gbt_tuned_test_report")
def h02_gbt_tuned_test_report(spark, sf):
    tr_, te, _ = _train_test(spark, sf)
    m = _tuned(spark, sf, tr_)
    return finish(_report(mo.predict(m, te, ["account_id"])))


@_reg("h05_second_gbt_test_report")
def h05_second_gbt_test_report(spark, sf):
    tr_, te, _ = _train_test(spark, sf)
    m = mo.fit(mo.gbt(mo.SECOND), tr_)
    return finish(_report(mo.predict(m, te, ["account_id"])))


@_reg("h04_h17_named_importance")
def h04_h17_named_importance(spark, sf):
    tr_, _, feats = _train_test(spark, sf)
    m = _tuned(spark, sf, tr_)
    return finish(mo.feature_importance(m, feats, spark))


@_reg("h07_cv_accuracy")
def h07_cv_accuracy(spark, sf):
    tr_, _, feats = _train_test(spark, sf)
    return finish(bo.cross_validate(bo.with_folds(tr_, "account_id", 10), feats, "churn", [BOOSTER], 10, "accuracy"))


@_reg("h08_grid_search_auc")
def h08_grid_search_auc(spark, sf):
    tr_, _, feats = _train_test(spark, sf)
    grid = [dict(trees=150, depth=d, rate=r) for d in (4, 3) for r in (0.15, 0.2)]
    return finish(bo.cross_validate(bo.with_folds(tr_, "account_id", 5), feats, "churn", grid, 5, "auc"))


@_reg("h15_threshold_sweep_refits")
def h15_threshold_sweep_refits(spark, sf):
    """50 trials, each with a tenth of the training rows left out and its own default booster."""
    tr_, _, feats = _train_test(spark, sf)
    return finish(bo.threshold_sweep(tr_, "account_id", feats, "churn", BOOSTER, trials=50, share=0.1, steps=50))


@_reg("i01_gbt_node_table")
def i01_gbt_node_table(spark, sf):
    tr_, _, feats = _train_test(spark, sf)
    m = _tuned(spark, sf, tr_)
    return finish(tr.node_table_from_gbt(m, feats, spark))


@_reg("i03_i05_gbt_importances")
def i03_i05_gbt_importances(spark, sf):
    tr_, _, feats = _train_test(spark, sf)
    m = _tuned(spark, sf, tr_)
    nodes = tr.node_table_from_gbt(m, feats, spark)
    out = None
    for kind in ("weight", "gain", "cover"):
        t = tr.importance(nodes, kind).select(F.lit(kind).alias("kind"), "feature", "importance", "share")
        out = t if out is None else out.unionByName(t)
    return finish(out)


@_reg("j07_shap_on_trained_gbt")
def j07_shap_on_trained_gbt(spark, sf):
    """SHAP summary (J7, J14) of the tuned GBT on its training rows, from the paths of its node table."""
    tr_, _, feats = _train_test(spark, sf)
    m = _tuned(spark, sf, tr_)
    ens = tr.Ensemble.from_table(tr.node_table_from_gbt(m, feats, spark))
    return finish(ex.shap_summary(pathshap.shap_values(tr_, ens, "account_id")))


def _tuned(spark, sf, tr_):
    return mo.fit_cached((sf, "tuned"), mo.gbt(mo.TUNED), tr_)


def _surrogate(spark, sf):
    tr_, te, feats = _train_test(spark, sf)
    m = _tuned(spark, sf, tr_)
    bb_tr = cut_lineage(mo.predict(m, tr_, ["account_id", *feats]))  # the surrogate's fit and its reports read it
    bb_te = mo.predict(m, te, ["account_id", *feats])
    sur = mo.surrogate_tree(bb_tr.drop("label"), feats, "pred", max_depth=7, min_instances=1)
    return m, sur, bb_tr, bb_te, feats


def _sur_pred(sur, bb, feats):
    a = mo.assemble(bb.withColumnRenamed("label", "y_true").withColumnRenamed("pred", "bb_pred")
                    .withColumnRenamed("p1", "bb_p1"), feats, "bb_pred")
    from pyspark.ml.functions import vector_to_array
    o = sur.transform(a)
    return o.select("account_id", "bb_pred", "bb_p1", F.col("prediction").cast("int").alias("sur_pred"),
                    vector_to_array("probability")[1].alias("sur_p1"))


@_reg("i09_i10_surrogate_fidelity")
def i09_i10_surrogate_fidelity(spark, sf):
    _, sur, bb_tr, bb_te, feats = _surrogate(spark, sf)
    out = None
    for name, bb in (("train", bb_tr), ("test", bb_te)):
        p = cut_lineage(_sur_pred(sur, bb, feats))
        r2 = me.r2_rmse(p, "bb_p1", "sur_p1")
        acc = me.accuracy(p, "bb_pred", "sur_pred")
        auc = me.auc_score(p, "bb_pred", "sur_p1")
        t = (r2.select(F.lit(name).alias("part"), "r2", "rmse")
             .join(acc.select(F.lit(name).alias("part"), "accuracy"), "part")
             .join(auc.select(F.lit(name).alias("part"), "auc_score"), "part"))
        out = t if out is None else out.unionByName(t)
    return finish(out)


@_reg("i11_surrogate_confusion")
def i11_surrogate_confusion(spark, sf):
    _, sur, bb_tr, bb_te, feats = _surrogate(spark, sf)
    out = None
    for name, bb in (("train", bb_tr), ("test", bb_te)):
        c = me.confusion_matrix(_sur_pred(sur, bb, feats), "bb_pred", "sur_pred").withColumn("part", F.lit(name))
        out = c if out is None else out.unionByName(c)
    return out


@_reg("i12_surrogate_importance")
def i12_surrogate_importance(spark, sf):
    _, sur, _, _, feats = _surrogate(spark, sf)
    return finish(mo.feature_importance(sur, feats, spark).withColumn("importance", F.round("importance", 3)))


@_reg("i13_black_box_class_counts")
def i13_black_box_class_counts(spark, sf):
    _, _, bb_tr, _, _ = _surrogate(spark, sf)
    return me.prediction_counts(bb_tr, "pred")


@_reg("g09_rfe_ranking")
def g09_rfe_ranking(spark, sf):
    tr_, _, feats = _train_test(spark, sf)
    ranks = bo.rfe(tr_, feats, "churn", BOOSTER)
    return spark.createDataFrame(ranks, "feature string, rank int")


@_reg("g10_rfecv_support")
def g10_rfecv_support(spark, sf):
    tr_, _, feats = _train_test(spark, sf)
    return finish(bo.rfecv(bo.with_folds(tr_, "account_id", 5), feats, "churn", 5, BOOSTER))


# ---------------------------------------------------------------- LIME on the tuned booster
LIME_NUM = ["tenure", "monthly_charges", "total_charges"]
LIME_CAT = ["senior", "partner", "dependents", "online_security", "contract_Month-to-month", "contract_One year", "contract_Two year",
            *[f"{c}_{v}" for c in ("payment_method", "internet_service") for v in PANEL_LEVELS[c]]]
LIME_FEATS = LIME_NUM + LIME_CAT


def _lime(spark, sf, parts, top_k=None):
    """Explanations of the tuned booster on the rows of ``parts`` of the split, with the rows."""
    d, feats = encoded_all(spark, sf)
    m = _tuned(spark, sf, _train_test(spark, sf)[0])
    ens = tr.Ensemble.from_table(tr.node_table_from_gbt(m, feats, spark))
    stats, _ = lime.background_stats(d.where(F.col("split") == "train"), LIME_NUM, LIME_CAT)
    rows = d.where(F.col("split").isin(parts))
    return lime.explain(rows, "account_id", ens, LIME_FEATS, stats, n_samples=5000, seed=0, top_k=top_k), rows


def _j01_sql():
    from tenura.plans.sqltext import with_base
    parts = []
    for c in LIME_NUM:
        q = f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM _tr)"
        g = (f"(SELECT CASE WHEN {c} <= q1 THEN 0 WHEN {c} <= q2 THEN 1 WHEN {c} <= q3 THEN 2 ELSE 3 END AS b, "
             f"COUNT(*) AS n, AVG(CAST({c} AS DOUBLE)) AS m FROM _tr, {q} GROUP BY 1)")
        parts.append(f"SELECT '{c}' AS feature, 'num' AS kind, CAST(v.b AS INTEGER) AS bin, "
                     f"round(COALESCE(g.n / (SELECT COUNT(*) FROM _tr), 0.0), 6) AS frequency, round(g.m, 6) AS value "
                     f"FROM (VALUES (0), (1), (2), (3)) v(b) LEFT JOIN {g} g ON v.b = g.b")
    for c in LIME_CAT:
        col = f'"{c}"'
        parts.append(f"SELECT '{c}' AS feature, 'cat' AS kind, CAST(ROW_NUMBER() OVER (ORDER BY v) - 1 AS INTEGER) AS bin, "
                     f"round(n / (SELECT COUNT(*) FROM _tr), 6) AS frequency, round(v, 6) AS value "
                     f"FROM (SELECT CAST({col} AS DOUBLE) AS v, COUNT(*) AS n FROM _tr GROUP BY 1)")
    return with_base("WITH _tr AS (SELECT * FROM enc WHERE split = 'train') " + " UNION ALL ".join(parts))


@_reg("j01_lime_background")
def j01_lime_background(spark, sf):
    d, _ = encoded_all(spark, sf)
    return finish(lime.background_stats(d.where(F.col("split") == "train"), LIME_NUM, LIME_CAT)[1])


@_reg("j02_lime_weights")
def j02_lime_weights(spark, sf):
    e, _ = _lime(spark, sf, ["train", "test"])
    return finish(lime.weights_long(e, "account_id", LIME_FEATS))


@_reg("j03_lime_top_k")
def j03_lime_top_k(spark, sf):
    e, _ = _lime(spark, sf, ["train", "test"], top_k=10)
    return finish(lime.weights_long(e, "account_id", LIME_FEATS, top_k=True))


@_reg("j04_lime_local_vs_model")
def j04_lime_local_vs_model(spark, sf):
    e, test = _lime(spark, sf, ["test"])
    return finish(e.join(test.select("account_id", "churn"), "account_id")
                  .select("account_id", "churn", "p_model", "local_pred", "intercept", "score"))


@_reg("j05_lime_fidelity")
def j05_lime_fidelity(spark, sf):
    e, _ = _lime(spark, sf, ["test"])
    return finish(lime.fidelity(e))


@_reg("j06_sp_lime")
def j06_sp_lime(spark, sf):
    e, _ = _lime(spark, sf, ["train"], top_k=10)
    return lime.submodular_pick(e, "account_id", LIME_FEATS, budget=5)


# ---------------------------------------------------------------- G7 / D6 SMOTE-NC on the training split
SMOTE_NUM = ["tenure", "monthly_charges", "total_charges"]
SMOTE_CAT = LIME_CAT


@_reg("g07_d06_smote_nc_balance")
def g07_d06_smote_nc_balance(spark, sf):
    d, _ = encoded_all(spark, sf)
    train = d.where(F.col("split") == "train")
    counts = {r[0]: r[1] for r in train.groupBy("churn").count().collect()}
    minority = min(counts, key=lambda c: (counts[c], c))
    out = smote.smote_nc(train, "churn", minority, SMOTE_NUM, SMOTE_CAT, k=5, seed=0)
    return finish(out.groupBy("churn", "synthetic").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in SMOTE_NUM]))


SQL["j01_lime_background"] = _j01_sql()

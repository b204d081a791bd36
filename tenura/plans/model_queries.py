"""Registered model, metric and explanation queries on the frozen ensemble.

Spark side: operators in ``tenura.operators.{trees,metrics,explain}``.
Oracle side: DuckDB text written from definitions (confusion counts,
brute-force permutation, tree-recursion partial dependence, Shapley
values by enumerating all feature subsets) - not from the Spark code.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import functions as F

from tenura.operators import explain as ex
from tenura.operators import metrics as me
from tenura.operators import trees as tr
from tenura.operators.features import hash_split, panel_features
from tenura.plans.common import finish
from tenura.plans.sqltext import with_base
from tenura.sources.panels import account_panel, clean_panel

QUERIES = {}
SQL = {}


def _reg(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_base(sql)
        return fn
    return deco


ENS = tr.Ensemble(tr.FROZEN_NODES)
FEATS = ENS.features()
DREF = tr.duck_ref
MARGIN_SQL = ENS.margin_sql(DREF)


def encoded(spark, sf):
    d, _ = panel_features(clean_panel(account_panel(spark, sf)))
    d = hash_split(d, "account_id", 42, 0.2)
    return d.select("account_id", "churn", "split", *[F.col(f"`{c}`").cast("double").alias(c) for c in FEATS])


def scored(spark, sf):
    return tr.score(encoded(spark, sf), ENS, ["account_id", "split"], "churn")


SCORED_SQL = f"""_sc AS (SELECT account_id, split, churn, m AS margin, 1.0 - 1.0 / (1.0 + exp(-m)) AS p0,
   1.0 / (1.0 + exp(-m)) AS p1, CAST(1.0 / (1.0 + exp(-m)) >= 0.5 AS INTEGER) AS pred
   FROM (SELECT *, {MARGIN_SQL} AS m FROM enc))"""
NODES_SQL = "_nodes AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else (f"'{v}'" if isinstance(v, str) else (tr.num(v) if isinstance(v, float) else repr(v)))
                    for v in row) + ")"
    for row in tr.FROZEN_NODES) + ") v(tree_id, node_id, \"left\", \"right\", feature, threshold, value, cover, gain))"


# ---------------------------------------------------------------- H3/H6, H9-H16
@_reg("h06_frozen_scores", "WITH " + SCORED_SQL + """
SELECT account_id, split, churn, round(margin, 6) AS margin, round(p0, 6) AS p0, round(p1, 6) AS p1, pred FROM _sc""")
def h06_frozen_scores(spark, sf):
    return finish(scored(spark, sf))


def _test(spark, sf):
    return scored(spark, sf).where(F.col("split") == "test")


@_reg("h09_confusion_matrix", "WITH " + SCORED_SQL + """
SELECT a.actual, a.predicted, COUNT(s.account_id) AS n, a.cell FROM (VALUES (1, 1, 0), (1, 0, 1), (0, 1, 2), (0, 0, 3)) a(actual, predicted, cell)
LEFT JOIN (SELECT * FROM _sc WHERE split = 'test') s ON s.churn = a.actual AND s.pred = a.predicted GROUP BY a.actual, a.predicted, a.cell""")
def h09_confusion_matrix(spark, sf):
    return me.confusion_matrix(_test(spark, sf), "churn", "pred")


@_reg("h10_classification_report", "WITH " + SCORED_SQL + """,
_c AS (SELECT COUNT(*) FILTER (WHERE churn = 1 AND pred = 1) AS tp, COUNT(*) FILTER (WHERE churn = 0 AND pred = 1) AS fp,
              COUNT(*) FILTER (WHERE churn = 1 AND pred = 0) AS fn, COUNT(*) FILTER (WHERE churn = 0 AND pred = 0) AS tn
       FROM _sc WHERE split = 'test'),
_k AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r1,
              CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END AS p0, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS r0,
              tp + fn AS s1, tn + fp AS s0, CAST(tp + fp + fn + tn AS DOUBLE) AS n FROM _c),
_f AS (SELECT *, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END AS f1,
              CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f0 FROM _k)
SELECT '1' AS class, round(p1, 6) AS precision, round(r1, 6) AS recall, round(f1, 6) AS f1, CAST(s1 AS BIGINT) AS support FROM _f
UNION ALL SELECT '0', round(p0, 6), round(r0, 6), round(f0, 6), CAST(s0 AS BIGINT) FROM _f
UNION ALL SELECT 'macro avg', round((p1 + p0) / 2, 6), round((r1 + r0) / 2, 6), round((f1 + f0) / 2, 6), CAST(s1 + s0 AS BIGINT) FROM _f
UNION ALL SELECT 'weighted avg', round((p1 * s1 + p0 * s0) / n, 6), round((r1 * s1 + r0 * s0) / n, 6), round((f1 * s1 + f0 * s0) / n, 6),
  CAST(s1 + s0 AS BIGINT) FROM _f
UNION ALL SELECT 'accuracy', round((tp + tn) / n, 6), round((tp + tn) / n, 6), round((tp + tn) / n, 6), CAST(s1 + s0 AS BIGINT) FROM _f""")
def h10_classification_report(spark, sf):
    return finish(me.classification_report(_test(spark, sf), "churn", "pred"))


@_reg("h11_accuracy", "WITH " + SCORED_SQL + """
SELECT round(AVG(CAST(churn = pred AS DOUBLE)), 6) AS accuracy FROM _sc WHERE split = 'test'""")
def h11_accuracy(spark, sf):
    return finish(me.accuracy(_test(spark, sf), "churn", "pred"))


@_reg("h12_auc_hard", "WITH " + SCORED_SQL + """
SELECT round((COUNT(*) FILTER (WHERE churn = 1 AND pred = 1) / COUNT(*) FILTER (WHERE churn = 1)
  + COUNT(*) FILTER (WHERE churn = 0 AND pred = 0) / COUNT(*) FILTER (WHERE churn = 0)) / 2, 6) AS auc_hard FROM _sc WHERE split = 'test'""")
def h12_auc_hard(spark, sf):
    return finish(me.auc_hard(_test(spark, sf), "churn", "pred"))


@_reg("h12_auc_score", "WITH " + SCORED_SQL + """
, _t AS (SELECT * FROM _sc WHERE split = 'test')
SELECT round((SELECT SUM(CASE WHEN a.p1 > b.p1 THEN 1.0 WHEN a.p1 = b.p1 THEN 0.5 ELSE 0.0 END)
  FROM _t a JOIN _t b ON a.churn = 1 AND b.churn = 0) / ((SELECT COUNT(*) FROM _t WHERE churn = 1) * (SELECT COUNT(*) FROM _t WHERE churn = 0)), 6) AS auc_score""")
def h12_auc_score(spark, sf):
    return finish(me.auc_score(_test(spark, sf), "churn", "p1"))


@_reg("h13_roc_curve", "WITH " + SCORED_SQL + """
, _t AS (SELECT * FROM _sc WHERE split = 'test'), _th AS (SELECT DISTINCT p1 AS threshold FROM _t)
SELECT round(threshold, 6) AS threshold,
  round((SELECT COUNT(*) FROM _t WHERE churn = 0 AND p1 >= threshold) / (SELECT COUNT(*) FROM _t WHERE churn = 0), 6) AS fpr,
  round((SELECT COUNT(*) FROM _t WHERE churn = 1 AND p1 >= threshold) / (SELECT COUNT(*) FROM _t WHERE churn = 1), 6) AS tpr FROM _th""")
def h13_roc_curve(spark, sf):
    return finish(me.roc_curve(_test(spark, sf), "churn", "p1"))


@_reg("h14_optimal_threshold", "WITH " + SCORED_SQL + """
, _t AS (SELECT * FROM _sc WHERE split = 'test'), _th AS (SELECT DISTINCT p1 AS threshold FROM _t),
_r AS (SELECT threshold,
  (SELECT COUNT(*) FROM _t WHERE churn = 1 AND p1 >= threshold) / (SELECT COUNT(*) FROM _t WHERE churn = 1)
  - (SELECT COUNT(*) FROM _t WHERE churn = 0 AND p1 >= threshold) / (SELECT COUNT(*) FROM _t WHERE churn = 0) AS j FROM _th)
SELECT round((SELECT MAX(threshold) FROM _r WHERE j = (SELECT MAX(j) FROM _r)), 6) AS threshold, round(MAX(j), 6) AS youden_j FROM _r""")
def h14_optimal_threshold(spark, sf):
    return finish(me.optimal_threshold(me.roc_curve(_test(spark, sf), "churn", "p1")))


_SWEEP_HASH = "CAST(('0x' || substr(md5((CAST(account_id AS VARCHAR) || '|' || CAST(trial AS VARCHAR)) || '|' || '0'), 1, 8)) AS BIGINT) / 4294967296.0"


@_reg("h15_threshold_sweep", "WITH " + SCORED_SQL + f"""
, _r AS (SELECT s.*, tr.trial FROM _sc s CROSS JOIN range(0, 10) tr(trial) WHERE {_SWEEP_HASH} < 0.2),
_k AS (SELECT * FROM range(0, 21) k(k)),
_m AS (SELECT trial, k.k, COUNT(*) FILTER (WHERE churn = 1) AS P, COUNT(*) AS N,
   COUNT(*) FILTER (WHERE churn = 1 AND LEAST(floor(p1 * 20), 20) >= k.k) AS tp,
   COUNT(*) FILTER (WHERE LEAST(floor(p1 * 20), 20) >= k.k) AS flagged FROM _r CROSS JOIN _k k GROUP BY trial, k.k),
_v AS (SELECT trial, k / 20.0 AS threshold, CASE WHEN flagged > 0 THEN tp / flagged ELSE 0.0 END AS precision,
   CASE WHEN P > 0 THEN tp / P ELSE 0.0 END AS recall, flagged / N AS queue_rate FROM _m),
_w AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM _v)
SELECT round(threshold, 6) AS threshold, """ + ", ".join(
    f"round(quantile_cont({c}, {q}), 6) AS {c}_{n}" for c in ("precision", "recall", "f1", "queue_rate")
    for q, n in ((0.5, "median"), (0.1, "p10"), (0.9, "p90"))) + " FROM _w GROUP BY threshold")
def h15_threshold_sweep(spark, sf):
    return finish(me.threshold_sweep(scored(spark, sf), "account_id", "churn", "p1", trials=10, steps=20, seed=0))


ENS2 = tr.Ensemble([r for r in tr.FROZEN_NODES if r[0] < 2])


@_reg("h16_r2_rmse_truncated_vs_full", f"""WITH _a AS (SELECT 1.0 / (1.0 + exp(-{MARGIN_SQL})) AS y,
  1.0 / (1.0 + exp(-{ENS2.margin_sql(DREF)})) AS p FROM enc)
SELECT round(1.0 - SUM((y - p) * (y - p)) / (SUM(y * y) - SUM(y) * SUM(y) / COUNT(*)), 6) AS r2,
  round(sqrt(SUM((y - p) * (y - p)) / COUNT(*)), 6) AS rmse FROM _a""")
def h16_r2_rmse_truncated_vs_full(spark, sf):
    d = encoded(spark, sf)
    full = F.lit(1.0) / (F.lit(1.0) + F.exp(-tr.margin_col(ENS)))
    part = F.lit(1.0) / (F.lit(1.0) + F.exp(-tr.margin_col(ENS2)))
    return finish(me.r2_rmse(d.select(full.alias("y"), part.alias("p")), "y", "p"))


@_reg("i13_prediction_counts", "WITH " + SCORED_SQL + " SELECT pred AS predicted, COUNT(*) AS n FROM _sc GROUP BY pred")
def i13_prediction_counts(spark, sf):
    return me.prediction_counts(scored(spark, sf), "pred")


# ---------------------------------------------------------------- I1-I5, H17 (node statistics from data)
def _node_paths():
    """Path predicate (DuckDB text) per node of the frozen ensemble."""
    out = []
    for t in ENS.trees:
        def walk(n, conds):
            out.append((t, n.node_id, " AND ".join(conds) if conds else "TRUE", n))
            if n.left >= 0:
                c = f"{DREF(n.feature)} <= {tr.num(n.threshold)}"
                walk(ENS.nodes[(t, n.left)], conds + [c])
                walk(ENS.nodes[(t, n.right)], conds + [f"NOT ({c})"])
        walk(ENS.root(t), [])
    return out


def _stats_sql():
    parts = []
    for t, nid, cond, n in _node_paths():
        parts.append(f"SELECT {t} AS tree_id, {nid} AS node_id, CAST(COUNT(*) AS DOUBLE) AS n, "
                     f"COALESCE(SUM(CAST(churn AS DOUBLE) * churn), 0) - COALESCE(CASE WHEN COUNT(*) > 0 THEN "
                     f"SUM(CAST(churn AS DOUBLE)) * SUM(CAST(churn AS DOUBLE)) / COUNT(*) END, 0) AS sse FROM enc WHERE {cond}")
    return "_st AS (" + " UNION ALL ".join(parts) + ")"


FITTED_SQL = "WITH " + NODES_SQL + ", " + _stats_sql() + """,
_fit AS (SELECT nd.tree_id, nd.node_id, nd."left", nd."right", nd.feature, nd.threshold, nd.value, s.n AS cover,
  CASE WHEN nd."left" >= 0 THEN s.sse - l.sse - r.sse ELSE 0.0 END AS gain
  FROM _nodes nd JOIN _st s ON nd.tree_id = s.tree_id AND nd.node_id = s.node_id
  LEFT JOIN _st l ON nd.tree_id = l.tree_id AND nd."left" = l.node_id
  LEFT JOIN _st r ON nd.tree_id = r.tree_id AND nd."right" = r.node_id)"""


def fitted_nodes(spark, sf):
    return tr.node_stats(ENS, encoded(spark, sf), "churn")


@_reg("i01_node_table_on_data", FITTED_SQL + """
SELECT tree_id, node_id, "left", "right", feature, round(threshold, 6) AS threshold, round(value, 6) AS value,
  round(cover, 6) AS cover, round(gain, 6) AS gain FROM _fit""")
def i01_node_table_on_data(spark, sf):
    return finish(fitted_nodes(spark, sf))


@_reg("i02_leaf_probability", FITTED_SQL + """
SELECT tree_id, node_id, round(value, 6) AS value, round(1.0 / (1.0 + exp(-value)), 6) AS probability,
  round(cover, 6) AS cover FROM _fit WHERE "left" < 0""")
def i02_leaf_probability(spark, sf):
    n = fitted_nodes(spark, sf)
    return finish(tr.leaf_probability(n).join(n.select("tree_id", "node_id", "cover"), ["tree_id", "node_id"]))


def _imp_sql(agg):
    return FITTED_SQL + f""", _g AS (SELECT feature, {agg} AS importance FROM _fit WHERE "left" >= 0 GROUP BY feature)
SELECT feature, round(importance, 6) AS importance, round(importance / SUM(importance) OVER (), 6) AS share FROM _g"""


@_reg("i03_importance_weight", _imp_sql("CAST(COUNT(*) AS DOUBLE)"))
def i03_importance_weight(spark, sf):
    return finish(tr.importance(fitted_nodes(spark, sf), "weight"))


@_reg("i04_importance_gain", _imp_sql("AVG(gain)"))
def i04_importance_gain(spark, sf):
    return finish(tr.importance(fitted_nodes(spark, sf), "gain"))


@_reg("i05_importance_cover", _imp_sql("AVG(cover)"))
def i05_importance_cover(spark, sf):
    return finish(tr.importance(fitted_nodes(spark, sf), "cover"))


# ---------------------------------------------------------------- I6 permutation importance
PERM_FEATS = FEATS


def _perm_sql(repeats=5, seed=0, src="enc"):
    fr = ", ".join("('{}', {}, {}, {})".format(f, r, *ex.shuffle_seeds(f, r, seed)) for f in PERM_FEATS for r in range(repeats))
    dv = "CASE m.f " + " ".join(f"WHEN '{f}' THEN CAST(d.{DREF(f)} AS DOUBLE)" for f in PERM_FEATS) + " END"

    def ref(f):
        return f"(CASE WHEN f = '{f}' THEN dv ELSE {DREF(f)} END)" if f in PERM_FEATS else DREF(f)
    m = ENS.margin_sql(ref)
    return f"""WITH _fr AS (SELECT * FROM (VALUES {fr}) v(f, r, h, g)),
_base AS (SELECT *, ROW_NUMBER() OVER (ORDER BY account_id) - 1 AS k, COUNT(*) OVER () AS n FROM {src}),
_n AS (SELECT COUNT(*) AS n FROM {src}),
_move AS (SELECT f, r, n, ANY_VALUE(g) % n AS b, MIN(x) AS a FROM (SELECT f, r, g, n, UNNEST(range(h % n, h % n + 1000)) AS x FROM _fr, _n)
          WHERE gcd(x, n) = 1 GROUP BY f, r, n),
_p AS (SELECT t.*, m.f, m.r, {dv} AS dv FROM _base t CROSS JOIN _move m JOIN _base d ON d.k = (m.a * t.k + m.b) % m.n),
_acc AS (SELECT f, r, AVG(CAST(CAST(1.0 / (1.0 + exp(-{m})) >= 0.5 AS INTEGER) = churn AS DOUBLE)) AS acc FROM _p GROUP BY f, r),
_b AS (SELECT AVG(CAST(CAST(1.0 / (1.0 + exp(-{MARGIN_SQL})) >= 0.5 AS INTEGER) = churn AS DOUBLE)) AS base_acc FROM {src})
SELECT f AS feature, round(AVG(base_acc - acc), 6) AS importance_mean, round(STDDEV_POP(base_acc - acc), 6) AS importance_std
FROM _acc, _b GROUP BY f"""


@_reg("i06_permutation_importance", _perm_sql())
def i06_permutation_importance(spark, sf):
    return finish(ex.permutation_importance(encoded(spark, sf), ENS, "account_id", "churn", PERM_FEATS, repeats=5, seed=0))


@_reg("i06_permutation_train_test", " UNION ALL ".join(
    f"SELECT '{part}' AS part, * FROM ({_perm_sql(src=f"(SELECT * FROM enc WHERE split = '{part}')")})" for part in ("train", "test")))
def i06_permutation_train_test(spark, sf):
    """I6 on the training and on the test rows, each permuted among themselves."""
    d, out = encoded(spark, sf), None
    for part in ("train", "test"):
        t = ex.permutation_importance(d.where(F.col("split") == part), ENS, "account_id", "churn", PERM_FEATS, repeats=5, seed=0)
        t = t.select(F.lit(part).alias("part"), "*")
        out = t if out is None else out.unionByName(t)
    return finish(out)


# ---------------------------------------------------------------- I7/I8 H statistic
def _h_sql(pairs):
    singles = sorted({f for p in pairs for f in p})
    cols = [f"{ENS.recursion_pd_sql({f}, DREF)} AS \"s_{f}\"" for f in singles]
    cols += [f"{ENS.recursion_pd_sql({a, b}, DREF)} AS \"p_{a}__{b}\"" for a, b in pairs]
    names = [f"s_{f}" for f in singles] + [f"p_{a}__{b}" for a, b in pairs]
    cen = ", ".join(f"\"{n}\" - AVG(\"{n}\") OVER () AS \"{n}\"" for n in names)
    parts = []
    for a, b in pairs:
        jk, j, k = f'"p_{a}__{b}"', f'"s_{a}"', f'"s_{b}"'
        h2 = f"CASE WHEN SUM({jk} * {jk}) > 0 THEN SUM(({jk} - {j} - {k}) * ({jk} - {j} - {k})) / SUM({jk} * {jk}) ELSE 0.0 END"
        parts.append(f"SELECT '{a}' AS feature_j, '{b}' AS feature_k, round({h2}, 6) AS h2, round(sqrt({h2}), 6) AS h FROM _c")
    return f"WITH _pd AS (SELECT {', '.join(cols)} FROM enc), _c AS (SELECT {cen} FROM _pd) " + " UNION ALL ".join(parts)


H_PAIR = [("contract_Month-to-month", "tenure")]
ALL_PAIRS = list(combinations(FEATS, 2))


@_reg("i07_h_statistic_pair", _h_sql(H_PAIR))
def i07_h_statistic_pair(spark, sf):
    return finish(ex.h_statistic(encoded(spark, sf), ENS, H_PAIR))


@_reg("i08_h_statistic_all_pairs", _h_sql(ALL_PAIRS))
def i08_h_statistic_all_pairs(spark, sf):
    d = encoded(spark, sf)
    inter = ex.interacting_pairs(ENS)
    h = ex.h_statistic(d, ENS, inter)
    zeros = [p for p in ALL_PAIRS if p not in inter]
    if zeros:
        z = d.sparkSession.createDataFrame([(a, b, 0.0, 0.0) for a, b in zeros], "feature_j string, feature_k string, h2 double, h double")
        h = h.unionByName(z)
    return finish(h)


# ---------------------------------------------------------------- I14-I24 ICE / PDP
def _probs(m):
    return [i / (m - 1) for i in range(m)]


def _grid_sql(f, m):
    return f"(SELECT DISTINCT unnest(quantile_cont(CAST({DREF(f)} AS DOUBLE), [{', '.join(repr(p) for p in _probs(m))}])) AS g FROM enc)"


def _ice_sql(f, grid_sql, sel="account_id, round(g, 6) AS grid, round(yhat, 6) AS yhat"):
    m = ENS.margin_sql(lambda c: "g" if c == f else DREF(c))
    return f"""WITH _gr AS {grid_sql}, _ice AS (SELECT e.account_id, g, 1.0 / (1.0 + exp(-{m})) AS yhat FROM enc e CROSS JOIN _gr)
SELECT {sel} FROM _ice"""


@_reg("i14_ice_tenure", _ice_sql("tenure", _grid_sql("tenure", 20)))
def i14_ice_tenure(spark, sf):
    d = encoded(spark, sf)
    return finish(ex.ice(d, ENS, "account_id", "tenure", ex.quantile_grid(d, "tenure", 20)))


@_reg("i15_pdp_tenure", _ice_sql("tenure", _grid_sql("tenure", 20),
                                  "round(g, 6) AS grid, round(AVG(yhat), 6) AS pd, COUNT(*) AS n") + " GROUP BY g")
def i15_pdp_tenure(spark, sf):
    d = encoded(spark, sf)
    return finish(ex.pdp(ex.ice(d, ENS, "account_id", "tenure", ex.quantile_grid(d, "tenure", 20))))


@_reg("i16_centered_ice_tenure", _ice_sql("tenure", _grid_sql("tenure", 20), "*").replace(
    "SELECT * FROM _ice", """, _q AS (SELECT g, (SELECT COUNT(*) FROM _gr o WHERE o.g < _gr.g) / (SELECT COUNT(*) FROM _gr) AS q FROM _gr),
_a AS (SELECT g AS ga FROM _q ORDER BY abs(q - 0.0), g LIMIT 1)
SELECT account_id, round(g, 6) AS grid, round(yhat, 6) AS yhat,
  round(yhat - MAX(CASE WHEN g = (SELECT ga FROM _a) THEN yhat END) OVER (PARTITION BY account_id), 6) AS yhat_c FROM _ice"""))
def i16_centered_ice_tenure(spark, sf):
    d = encoded(spark, sf)
    return finish(ex.centered_ice(d, ENS, "account_id", "tenure", ex.quantile_grid(d, "tenure", 20), q=0.0))


@_reg("i17_sampled_curves", _ice_sql("tenure", _grid_sql("tenure", 20)).replace(
    "FROM _ice", "FROM _ice WHERE CAST(('0x' || substr(md5(CAST(account_id AS VARCHAR) || '|' || '3'), 1, 8)) AS BIGINT) / 4294967296.0 < 0.1"))
def i17_sampled_curves(spark, sf):
    d = encoded(spark, sf)
    c = ex.ice(d, ENS, "account_id", "tenure", ex.quantile_grid(d, "tenure", 20))
    return finish(ex.sample_curves(c, "account_id", 0.1, 3))


@_reg("i18_quantile_axis", "WITH _gr AS " + _grid_sql("tenure", 20) + """
SELECT round(g, 6) AS grid, round((SELECT COUNT(*) FROM _gr o WHERE o.g < _gr.g) / (SELECT COUNT(*) FROM _gr), 6) AS q FROM _gr""")
def i18_quantile_axis(spark, sf):
    d = encoded(spark, sf)
    return finish(ex.grid_positions(spark, ex.quantile_grid(d, "tenure", 20)))


@_reg("i19_prediction_by_tenure", f"""SELECT round(tenure, 6) AS x, round(AVG(1.0 / (1.0 + exp(-{MARGIN_SQL}))), 6) AS yhat, COUNT(*) AS n
  FROM enc GROUP BY tenure""")
def i19_prediction_by_tenure(spark, sf):
    return finish(ex.prediction_by_value(encoded(spark, sf), ENS, "tenure"))


PDP_ALL = FEATS


@_reg("i20_pdp_all", " UNION ALL ".join(
    "(" + _ice_sql(f, _grid_sql(f, 10), f"'{f}' AS feature, round(g, 6) AS grid, round(AVG(yhat), 6) AS pd") + " GROUP BY g)"
    for f in PDP_ALL))
def i20_pdp_all(spark, sf):
    d = encoded(spark, sf)
    grids = ex.quantile_grids(d, PDP_ALL, 10)
    return finish(ex.pdp_all(d, ENS, grids))


@_reg("i21_pdp_isolate_monthly", _ice_sql("monthly_charges", _grid_sql("monthly_charges", 10),
                                          "g, AVG(yhat) AS pd, COUNT(*) AS n").replace(
    "SELECT g, AVG(yhat) AS pd, COUNT(*) AS n FROM _ice", """, _pd AS (SELECT g, AVG(yhat) AS pd, COUNT(*) AS n FROM _ice GROUP BY g),
_cell AS (SELECT g, (SELECT COUNT(*) FROM enc WHERE monthly_charges <= _gr.g AND monthly_charges > COALESCE(
   (SELECT MAX(g2.g) FROM _gr g2 WHERE g2.g < _gr.g), -1e308)) AS n_in_cell FROM _gr)
SELECT round(_pd.g, 6) AS grid, round(pd, 6) AS pd, n, n_in_cell FROM _pd JOIN _cell ON _pd.g = _cell.g"""))
def i21_pdp_isolate_monthly(spark, sf):
    d = encoded(spark, sf)
    return finish(ex.pdp_isolate(d, ENS, "account_id", "monthly_charges", ex.quantile_grid(d, "monthly_charges", 10)))


@_reg("i22_pdp_binary_dependents", _ice_sql("dependents", "(SELECT * FROM (VALUES (0.0E0), (1.0E0)) v(g))",
                                            "round(g, 6) AS grid, round(AVG(yhat), 6) AS pd, COUNT(*) AS n") + " GROUP BY g")
def i22_pdp_binary_dependents(spark, sf):
    return finish(ex.pdp(ex.ice(encoded(spark, sf), ENS, "account_id", "dependents", [0.0, 1.0])))


CONTRACT = ["contract_Month-to-month", "contract_One year", "contract_Two year"]


def _onehot_sql():
    m = ENS.margin_sql(lambda c: f"(CASE WHEN mem = '{c}' THEN 1.0 ELSE 0.0 END)" if c in CONTRACT else DREF(c))
    vals = ", ".join(f"('{c}')" for c in CONTRACT)
    return f"""SELECT mem AS member, round(AVG(1.0 / (1.0 + exp(-{m}))), 6) AS pd FROM enc CROSS JOIN (VALUES {vals}) v(mem) GROUP BY mem"""


@_reg("i23_pdp_onehot_contract", _onehot_sql())
def i23_pdp_onehot_contract(spark, sf):
    return finish(ex.pdp_onehot(encoded(spark, sf), ENS, CONTRACT))


def _pdp2_sql():
    m = ENS.margin_sql(lambda c: "ga" if c == "tenure" else ("gb" if c == "monthly_charges" else DREF(c)))
    return f"""WITH _a AS (SELECT g AS ga FROM {_grid_sql('tenure', 5)}), _b AS (SELECT g AS gb FROM {_grid_sql('monthly_charges', 5)})
SELECT round(ga, 6) AS g1, round(gb, 6) AS g2, round(AVG(1.0 / (1.0 + exp(-{m}))), 6) AS pd FROM enc CROSS JOIN _a CROSS JOIN _b GROUP BY ga, gb"""


@_reg("i24_pdp_two_way", _pdp2_sql())
def i24_pdp_two_way(spark, sf):
    d = encoded(spark, sf)
    g = ex.quantile_grids(d, ["tenure", "monthly_charges"], 5)
    return finish(ex.pdp_2d(d, ENS, "tenure", g["tenure"], "monthly_charges", g["monthly_charges"]))


# ---------------------------------------------------------------- J7-J15 SHAP
def _shap_sql():
    """Shapley values of v(S) = E[f | x_S] (tree recursion), every subset."""
    feats = FEATS
    subs = [frozenset(s) for r in range(len(feats) + 1) for s in combinations(feats, r)]
    idx = {s: i for i, s in enumerate(subs)}
    vcols = ", ".join(f"{ENS.recursion_pd_sql(set(s), DREF)} AS v{idx[s]}" for s in subs)
    n = len(feats)
    parts = []
    base = f"v{idx[frozenset()]}"
    for f in feats:
        terms = []
        for s in subs:
            if f in s:
                continue
            w = math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n)
            terms.append(f"{w!r} * (v{idx[s | {f}]} - v{idx[s]})")
        phi = "(" + " + ".join(terms) + ")"
        parts.append(f"SELECT account_id, '{f}' AS feature, CAST({DREF(f)} AS DOUBLE) AS value, {phi} AS phi, {base} AS base, margin FROM _v")
    return f"""WITH _v AS (SELECT account_id, {', '.join(DREF(f) for f in feats)}, {MARGIN_SQL} AS margin, {vcols} FROM enc),
_s AS ({' UNION ALL '.join(parts)})"""


SHAP_SQL = _shap_sql()
SHAP_SEL = """SELECT account_id, feature, round(value, 6) AS value, round(phi, 6) AS phi,
  round(1.0 / (1.0 + exp(-phi)) - 1.0 / (1.0 + exp(-base)), 6) AS phi_prob_naive, round(base, 6) AS base,
  round(margin, 6) AS margin, round(1.0 / (1.0 + exp(-margin)), 6) AS p_model FROM _s"""


def shap_long(spark, sf):
    return ex.shap_values(encoded(spark, sf), ENS, "account_id")


@_reg("j07_shap_values", SHAP_SQL + "\n" + SHAP_SEL)
def j07_shap_values(spark, sf):
    return finish(shap_long(spark, sf))


@_reg("j08_shap_base_value", f"SELECT round({ENS.recursion_pd_sql(set(), DREF)}, 6) AS base_value, round(AVG({MARGIN_SQL}), 6) AS mean_margin FROM enc")
def j08_shap_base_value(spark, sf):
    d = encoded(spark, sf)
    return finish(d.agg(F.avg(tr.margin_col(ENS)).alias("mean_margin"))
                  .select(F.lit(ex.shap_base_value(ENS)).alias("base_value"), "mean_margin"))


@_reg("j10_contribution_list", SHAP_SQL + """, _one AS (SELECT account_id FROM enc ORDER BY account_id LIMIT 1 OFFSET 10)
SELECT account_id, feature, round(value, 6) AS value, round(phi, 6) AS phi,
  ROW_NUMBER() OVER (ORDER BY phi DESC, feature) AS rank FROM _s WHERE account_id = (SELECT account_id FROM _one)""")
def j10_contribution_list(spark, sf):
    from tenura.operators.clean import positional_rows
    d = encoded(spark, sf)
    one = positional_rows(d.select("account_id"), "account_id", positions=[10]).first()["account_id"]
    return finish(ex.contribution_list(shap_long(spark, sf), "account_id", one).withColumn("rank", F.col("rank").cast("long")))


@_reg("j11_force_series", SHAP_SQL + """
SELECT account_id, feature, round(phi, 6) AS phi,
  round(base + SUM(phi) OVER w - phi, 6) AS from_value, round(base + SUM(phi) OVER w, 6) AS to_value FROM _s
WINDOW w AS (PARTITION BY account_id, phi >= 0 ORDER BY abs(phi) DESC, feature ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def j11_force_series(spark, sf):
    return finish(ex.force_series(shap_long(spark, sf), "account_id"))


@_reg("j12_dependence_tenure", SHAP_SQL + " SELECT account_id, round(value, 6) AS x, round(phi, 6) AS phi FROM _s WHERE feature = 'tenure'")
def j12_dependence_tenure(spark, sf):
    return finish(ex.dependence(shap_long(spark, sf), "account_id", "tenure"))


J13_OTHERS = [f for f in FEATS if f != "tenure"]


_J13_SQL = SHAP_SQL + """, _d AS (SELECT s.account_id, s.value AS x, s.phi FROM _s s WHERE feature = 'tenure'),
_n AS (SELECT COUNT(*) AS n FROM _d),
_b AS (SELECT d.*, CAST(floor((SELECT COUNT(*) FROM _d d2 WHERE d2.x < d.x) * 10 / CAST((SELECT n FROM _n) AS DOUBLE)) AS INTEGER) AS bin FROM _d d),
_j AS (SELECT b.*, e.* EXCLUDE (account_id) FROM _b b JOIN enc e ON b.account_id = e.account_id),
_r AS (SELECT bin, """ + ", ".join(
    f"CASE WHEN stddev_pop(phi) * stddev_pop(CAST({DREF(z)} AS DOUBLE)) > 0 THEN covar_pop(phi, CAST({DREF(z)} AS DOUBLE)) "
    f"/ (stddev_pop(phi) * stddev_pop(CAST({DREF(z)} AS DOUBLE))) END AS r{i}" for i, z in enumerate(J13_OTHERS)) + """ FROM _j GROUP BY bin),
_sc AS (""" + " UNION ALL ".join(f"SELECT '{z}' AS other, SUM(COALESCE(abs(r{i}), 0.0)) AS score FROM _r" for i, z in enumerate(J13_OTHERS)) + ")\n"


@_reg("j13_dependence_on_strongest", _J13_SQL + """, _best AS (SELECT other FROM _sc ORDER BY round(score, 9) DESC, other LIMIT 1)
SELECT account_id, round(x, 6) AS x, round(phi, 6) AS phi, other,
  round(CASE other """ + " ".join(f"WHEN '{z}' THEN CAST({DREF(z)} AS DOUBLE)" for z in J13_OTHERS) + """ END, 6) AS z FROM _j, _best""")
def j13_dependence_on_strongest(spark, sf):
    return finish(ex.strongest_dependence(shap_long(spark, sf), encoded(spark, sf), "account_id", "tenure", J13_OTHERS))


@_reg("j13_strongest_interaction", _J13_SQL + "SELECT other, round(score, 6) AS score FROM _sc")
def j13_strongest_interaction(spark, sf):
    return finish(ex.strongest_interaction(shap_long(spark, sf), encoded(spark, sf), "account_id", "tenure", J13_OTHERS))


@_reg("j14_shap_summary", SHAP_SQL + """, _g AS (SELECT feature, SUM(abs(phi)) AS sum_abs, AVG(abs(phi)) AS mean_abs,
  quantile_cont(phi, 0.25) AS phi_p25, quantile_cont(phi, 0.5) AS phi_p50, quantile_cont(phi, 0.75) AS phi_p75 FROM _s GROUP BY feature)
SELECT feature, round(sum_abs, 6) AS sum_abs, round(mean_abs, 6) AS mean_abs, round(phi_p25, 6) AS phi_p25, round(phi_p50, 6) AS phi_p50,
  round(phi_p75, 6) AS phi_p75, CAST(ROW_NUMBER() OVER (ORDER BY sum_abs DESC, feature) AS INTEGER) AS rank FROM _g""")
def j14_shap_summary(spark, sf):
    return finish(ex.shap_summary(shap_long(spark, sf)))


@_reg("j15_shap_importance", SHAP_SQL + " SELECT feature, round(AVG(abs(phi)), 6) AS mean_abs FROM _s GROUP BY feature")
def j15_shap_importance(spark, sf):
    return finish(shap_long(spark, sf).groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs")))

"""Global and local explanation of tree ensembles.

Everything is an expression over the rows being explained plus a
model-sized constant (the node table compiled on the driver):

* ICE/PDP: each row is expanded over a bounded grid by a narrow
  ``explode`` of a literal array (no join), scored by the CASE
  expression with the feature overridden, then averaged per grid point.
* Partial dependence for H (tree recursion) and path-dependent Tree SHAP
  are closed-form column expressions built from the leaf paths.
* Permutation importance uses one long table over (feature, repeat);
  row positions come from range partitioning, never a one-task window.
"""

from __future__ import annotations

import hashlib
import math
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.functions.stats import safe_corr

from tenura.functions.ordinal import global_row_index
from tenura.session import cut_lineage
from tenura.operators.trees import Ensemble, in_interval, shapley_weight, spark_ref, subsets


def _p(m: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-m))


def margin_with(ens: Ensemble, ref) -> Column:
    return F.expr(ens.margin_sql(ref))


# ------------------------------------------------------------------ grids
def quantile_grid(df: DataFrame, feature: str, m: int) -> list[float]:
    """Quantiles 0..1 in m steps (linear interpolation), de-duplicated."""
    from tenura.functions.ordinal import exact_quantiles
    ps = [i / (m - 1) for i in range(m)] if m > 1 else [0.5]
    qs = [r["q"] for r in exact_quantiles(df, feature, ps).orderBy("p").collect()]  # m values
    out = []
    for q in qs:
        if not out or q != out[-1]:
            out.append(float(q))
    return out


def quantile_grids(df: DataFrame, features: Sequence[str], m: int) -> dict[str, list[float]]:
    """Quantile grids of several features in one pass (feature = group key
    of one exact-quantile job over the unpivoted columns)."""
    from tenura.functions.ordinal import exact_quantiles
    ps = [i / (m - 1) for i in range(m)] if m > 1 else [0.5]
    lng = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"`{f}`").cast("double").alias("v"))
                                          for f in features])).alias("x")).select("x.*")
    rows = exact_quantiles(lng, "v", ps, ["f"]).orderBy("f", "p").collect()  # len(features) * m rows
    out = {f: [] for f in features}
    for r in rows:
        g = out[r["f"]]
        if not g or r["q"] != g[-1]:
            g.append(float(r["q"]))
    return out


def ice(df: DataFrame, ens: Ensemble, id_col: str, feature: str, grid: Sequence[float]) -> DataFrame:
    """(id, grid, yhat) with the feature set to each grid value."""
    g = F.explode(F.array(*[F.lit(float(v)) for v in grid])).alias("_g")
    r = df.select("*", g)
    m = margin_with(ens, lambda f: "`_g`" if f == feature else spark_ref(f))
    return r.select(id_col, F.col("_g").alias("grid"), _p(m).alias("yhat"))


def pdp(ice_df: DataFrame) -> DataFrame:
    """Mean of ICE per grid point."""
    return ice_df.groupBy("grid").agg(F.avg("yhat").alias("pd"), F.count(F.lit(1)).alias("n"))


def grid_positions(spark, grid: Sequence[float]) -> DataFrame:
    """Share of grid points strictly below each grid value."""
    rows = [(float(v), sum(x < v for x in grid) / len(grid)) for v in grid]
    return spark.createDataFrame(rows, "grid double, q double")


def quantile_positions(df: DataFrame, feature: str, grid: Sequence[float]) -> DataFrame:
    """F3 for grid points: share of rows strictly below each grid value."""
    x = F.col(f"`{feature}`").cast("double")
    aggs = [(F.count_if(x < F.lit(float(v))) / F.count(F.lit(1))).alias(f"q{i}") for i, v in enumerate(grid)]
    row = df.agg(*aggs)
    items = [F.struct(F.lit(float(v)).alias("grid"), F.col(f"q{i}").alias("q")) for i, v in enumerate(grid)]
    return row.select(F.explode(F.array(*items)).alias("s")).select("s.*")


def centered_ice(df: DataFrame, ens: Ensemble, id_col: str, feature: str, grid: Sequence[float],
                 q: float = 0.0) -> DataFrame:
    """I16: subtract, per curve, its value at the grid point whose
    quantile position is nearest q (first such point on ties)."""
    anchor = float(min(grid, key=lambda v: (abs(sum(x < v for x in grid) / len(grid) - q), v)))
    # the anchor's value is one more prediction of the row itself, so no curve is gathered
    at = _p(margin_with(ens, lambda f: "`_at`" if f == feature else spark_ref(f)))
    r = df.withColumn("_at", F.lit(anchor)).select("*", at.alias("_y_at"))
    g = F.explode(F.array(*[F.lit(float(v)) for v in grid])).alias("_g")
    y = _p(margin_with(ens, lambda f: "`_g`" if f == feature else spark_ref(f)))
    c = r.select("*", g).select(id_col, F.col("_g").alias("grid"), y.alias("yhat"), "_y_at")
    return c.select(id_col, "grid", "yhat", (F.col("yhat") - F.col("_y_at")).alias("yhat_c"))


def sample_curves(curves: DataFrame, id_col: str, fraction: float, seed: int = 0) -> DataFrame:
    """Keep a fraction of curves by a hash of the id (whole curves)."""
    from tenura.operators.features import hash_fraction
    return curves.where(hash_fraction(id_col, seed) < fraction)


def prediction_by_value(df: DataFrame, ens: Ensemble, feature: str) -> DataFrame:
    """Mean prediction and count per raw feature value."""
    m = margin_with(ens, spark_ref)
    return df.groupBy(F.col(f"`{feature}`").cast("double").alias("x")).agg(
        F.avg(_p(m)).alias("yhat"), F.count(F.lit(1)).alias("n"))


def pdp_all(df: DataFrame, ens: Ensemble, grids: dict[str, Sequence[float]]) -> DataFrame:
    """PDP of many features in one pass: rows x (feature, grid) pairs."""
    items = [F.struct(F.lit(f).alias("_f"), F.lit(float(v)).alias("_g")) for f, gs in grids.items() for v in gs]
    r = df.select("*", F.explode(F.array(*items)).alias("_fg")).select("*", "_fg._f", "_fg._g")

    def ref(f):
        return f"(CASE WHEN `_f` = '{f}' THEN `_g` ELSE {spark_ref(f)} END)" if f in grids else spark_ref(f)
    return r.groupBy(F.col("_f").alias("feature"), F.col("_g").alias("grid")).agg(
        F.avg(_p(margin_with(ens, ref))).alias("pd"))


def pdp_isolate(df: DataFrame, ens: Ensemble, id_col: str, feature: str, grid: Sequence[float],
                center: bool = False) -> DataFrame:
    """PDP plus how many rows fall in each grid cell
    (g[k-1], g[k]] (first cell closed at its lower end)."""
    p = pdp(ice(df, ens, id_col, feature, grid))
    x = F.col(f"`{feature}`").cast("double")
    aggs = []
    for i, g in enumerate(grid):
        lo = grid[i - 1] if i > 0 else None
        cond = (x <= F.lit(float(g))) if lo is None else ((x > F.lit(float(lo))) & (x <= F.lit(float(g))))
        aggs.append(F.count_if(cond).alias(f"c{i}"))
    cnt = df.agg(*aggs).select(F.explode(F.array(*[
        F.struct(F.lit(float(g)).alias("grid"), F.col(f"c{i}").alias("n_in_cell")) for i, g in enumerate(grid)])).alias("s")
    ).select("s.*")
    out = p.join(cnt, "grid")
    if center:
        first = F.first("pd").over(Window.orderBy("grid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        out = out.withColumn("pd", F.col("pd") - first)
    return out


def pdp_onehot(df: DataFrame, ens: Ensemble, members: Sequence[str]) -> DataFrame:
    """Set one member of a one-hot group to 1 and the others to 0."""
    r = df.select("*", F.explode(F.array(*[F.lit(m) for m in members])).alias("_m"))

    def ref(f):
        return f"(CASE WHEN `_m` = '{f}' THEN 1.0E0 ELSE 0.0E0 END)" if f in members else spark_ref(f)
    return r.groupBy(F.col("_m").alias("member")).agg(F.avg(_p(margin_with(ens, ref))).alias("pd"))


def pdp_2d(df: DataFrame, ens: Ensemble, f1: str, g1: Sequence[float], f2: str, g2: Sequence[float]) -> DataFrame:
    """Two-way PDP on the grid product (the caller's len(g1) * len(g2) points)."""
    items = [F.struct(F.lit(float(a)).alias("_a"), F.lit(float(b)).alias("_b")) for a in g1 for b in g2]
    r = df.select("*", F.explode(F.array(*items)).alias("_ab")).select("*", "_ab._a", "_ab._b")

    def ref(f):
        return "`_a`" if f == f1 else ("`_b`" if f == f2 else spark_ref(f))
    return r.groupBy(F.col("_a").alias("g1"), F.col("_b").alias("g2")).agg(F.avg(_p(margin_with(ens, ref))).alias("pd"))


# ------------------------------------------------------------------ leaf-path algebra
def bsum(cols: list[Column]) -> Column:
    """Balanced sum (shallow expression tree for many terms)."""
    if not cols:
        return F.lit(0.0)
    while len(cols) > 1:
        cols = [cols[i] + cols[i + 1] if i + 1 < len(cols) else cols[i] for i in range(0, len(cols), 2)]
    return cols[0]


class LeafAlgebra:
    """Leaf paths of an ensemble with each distinct interval indicator
    o = 1[x_f in (lo, hi]] computed ONCE as a column ``_o<k>``; SHAP and
    recursion-PD expressions then only reference those columns, so the
    plan stays small even for hundreds of leaves."""

    def __init__(self, ens: Ensemble):
        self.ens = ens
        self.ind = {}
        self.terms = []
        for (_t, _leaf, v, cons) in ens.leaf_paths():
            feats = sorted(cons)
            o = {}
            for f in feats:
                key = (f, cons[f][0], cons[f][1])
                if key not in self.ind:
                    self.ind[key] = f"_o{len(self.ind)}"
                o[f] = F.col(self.ind[key])
            self.terms.append((v, feats, o, {f: cons[f][2] for f in feats}))

    def indicator_cols(self) -> list[Column]:
        return [in_interval(F.col(f"`{f}`").cast("double"), lo, hi).alias(name)
                for (f, lo, hi), name in self.ind.items()]

    def with_indicators(self, df: DataFrame) -> DataFrame:
        return df.select("*", *self.indicator_cols())

    def recursion_pd(self, subset: set[str]) -> Column:
        parts = [F.lit(float(self.ens.base_margin))]
        for v, feats, o, z in self.terms:
            e = F.lit(float(v))
            for f in feats:
                e = e * (o[f] if f in subset else F.lit(z[f]))
            parts.append(e)
        return bsum(parts)

    def shap(self, feature: str) -> Column:
        parts = []
        for v, feats, o, z in self.terms:
            if feature not in feats:
                continue
            others = [f for f in feats if f != feature]
            m = len(feats)
            acc = []
            for s in subsets(others):
                term = F.lit(shapley_weight(len(s), m))
                for f in others:
                    term = term * (o[f] if f in s else F.lit(z[f]))
                acc.append(term)
            parts.append(F.lit(float(v)) * (o[feature] - F.lit(z[feature])) * bsum(acc))
        return bsum(parts)


def recursion_pd_col(ens: Ensemble, subset: set[str], alg: LeafAlgebra | None = None) -> Column:
    """E[f | x_S] by the leaf-path product (splits outside S weighted by
    cover).  Needs the indicator columns of ``alg`` on the input."""
    return (alg or LeafAlgebra(ens)).recursion_pd(subset)


def shap_base_value(ens: Ensemble) -> float:
    """Expected margin under the cover distribution."""
    b = float(ens.base_margin)
    for (_t, _leaf, v, cons) in ens.leaf_paths():
        w = 1.0
        for f in cons:
            w *= cons[f][2]
        b += v * w
    return b


def shap_values(df: DataFrame, ens: Ensemble, id_col: str, features: Sequence[str] | None = None) -> DataFrame:
    """Long (id, feature, value, phi, phi_prob_naive, base, margin, p_model)."""
    feats = list(features or ens.features())
    alg = LeafAlgebra(ens)
    base = shap_base_value(ens)
    m = margin_with(ens, spark_ref)
    staged = alg.with_indicators(df.select(id_col, *[F.col(f"`{f}`") for f in ens.features()
                                                      if f not in feats] + [F.col(f"`{f}`") for f in feats]))
    items = [F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("value"),
                      alg.shap(f).alias("phi")) for f in feats]
    r = staged.select(id_col, m.alias("margin"), F.explode(F.array(*items)).alias("s")).select(id_col, "margin", "s.*")
    return r.select(id_col, "feature", "value", "phi",
                    (_p(F.col("phi")) - F.lit(1.0 / (1.0 + math.exp(-base)))).alias("phi_prob_naive"),
                    F.lit(base).alias("base"), "margin", _p(F.col("margin")).alias("p_model"))


def contribution_list(shap_long: DataFrame, id_col: str, id_value, descending: bool = True) -> DataFrame:
    """One instance's signed contributions, ranked."""
    o = F.desc("phi") if descending else F.asc("phi")
    r = shap_long.where(F.col(id_col) == F.lit(id_value))
    return r.select(id_col, "feature", "value", "phi",
                    F.row_number().over(Window.partitionBy(id_col).orderBy(o, "feature")).alias("rank"))


def force_series(shap_long: DataFrame, id_col: str, link: str = "identity") -> DataFrame:
    """Running path from base to output per instance: positive parts
    stacked upward from base (largest first), negative parts downward."""
    w = Window.partitionBy(id_col, F.col("phi") >= 0).orderBy(F.desc(F.abs("phi")), "feature").rowsBetween(
        Window.unboundedPreceding, 0)
    run = F.sum("phi").over(w)
    frm, to = F.col("base") + run - F.col("phi"), F.col("base") + run
    if link == "logit":
        frm, to = _p(frm), _p(to)
    return shap_long.select(id_col, "feature", "phi", frm.alias("from_value"), to.alias("to_value"))


def dependence(shap_long: DataFrame, id_col: str, feature: str) -> DataFrame:
    """(id, x, phi) for one feature."""
    return shap_long.where(F.col("feature") == feature).select(id_col, F.col("value").alias("x"), "phi")


def strongest_interaction(shap_long: DataFrame, data: DataFrame, id_col: str, feature: str,
                          others: Sequence[str], n_bins: int = 10) -> DataFrame:
    """Rank candidate features z by sum over equal-count bins of x of
    |corr(phi_x, z)| (bins from the quantile position of x)."""
    d = dependence(shap_long, id_col, feature)
    n = d.select(F.count(F.lit(1))).scalar()
    below = d.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    from tenura.functions.ordinal import global_prefix_sums
    pos = global_prefix_sums(below, "x", ["c"], suffix="_below", inclusive=False)
    binned = d.join(pos.select("x", "c_below"), "x").withColumn(
        "bin", F.floor(F.col("c_below") * n_bins / n.cast("double")).cast("int"))
    j = binned.join(data.select(id_col, *[F.col(f"`{z}`").cast("double").alias(f"z_{i}") for i, z in enumerate(others)]), id_col)
    per = j.groupBy("bin").agg(*[safe_corr(F.col("phi"), F.col(f"z_{i}")).alias(f"r_{i}") for i in range(len(others))])
    tot = per.agg(*[F.sum(F.coalesce(F.abs(F.col(f"r_{i}")), F.lit(0.0))).alias(f"s_{i}") for i in range(len(others))])
    return tot.select(F.explode(F.array(*[F.struct(F.lit(z).alias("other"), F.col(f"s_{i}").alias("score"))
                                          for i, z in enumerate(others)])).alias("s")).select("s.*")


def strongest_dependence(shap_long: DataFrame, data: DataFrame, id_col: str, feature: str,
                         others: Sequence[str], n_bins: int = 10) -> DataFrame:
    """(id, x, phi, other, z): the dependence rows of a feature with the
    value of the candidate of highest ``strongest_interaction`` score, by name
    among scores alike to 9 digits.  The choice is a scalar subquery of the
    same plan, and its value is looked up by name, so no trip to the driver."""
    scores = strongest_interaction(shap_long, data, id_col, feature, others, n_bins)
    best = scores.select(F.min_by("other", F.struct(-F.round("score", 9), F.col("other")))).scalar()
    values = F.create_map(*[v for z in others for v in (F.lit(z), F.col(f"`{z}`").cast("double"))])
    rows = dependence(shap_long, id_col, feature).join(data.select(id_col, values.alias("_values")), id_col)
    return (rows.withColumn("other", best)
            .select(id_col, "x", "phi", "other", F.element_at("_values", F.col("other")).alias("z")))


def shap_summary(shap_long: DataFrame) -> DataFrame:
    """Per feature sum and mean |phi|, rank, and phi quartiles."""
    from tenura.functions.ordinal import exact_quantiles
    g = shap_long.groupBy("feature").agg(F.sum(F.abs("phi")).alias("sum_abs"), F.avg(F.abs("phi")).alias("mean_abs"))
    qs = exact_quantiles(shap_long, "phi", [0.25, 0.5, 0.75], ["feature"]).groupBy("feature").agg(
        *[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for p, n in ((0.25, "phi_p25"), (0.5, "phi_p50"),
                                                                            (0.75, "phi_p75"))])
    g = g.join(qs, "feature")
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sum_abs"), "feature")))


# ------------------------------------------------------------------ H statistic
def h_statistic(df: DataFrame, ens: Ensemble, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Friedman's H for feature pairs, PDs by tree recursion at the
    data points, centred; H^2 = sum (PDjk - PDj - PDk)^2 / sum PDjk^2."""
    alg = LeafAlgebra(ens)
    singles = sorted({f for p in pairs for f in p})
    cols = {f"s_{f}": alg.recursion_pd({f}) for f in singles}
    for a, b in pairs:
        cols[f"p_{a}__{b}"] = alg.recursion_pd({a, b})
    df = alg.with_indicators(df)
    names = list(cols)
    pd_df = df.select(*[c.alias(f"_c{i}") for i, c in enumerate(cols.values())])
    means = pd_df.agg(*[F.avg(f"_c{i}").alias(f"_c{i}") for i in range(len(names))]).first()
    idx = {n: i for i, n in enumerate(names)}

    def cen(n):
        i = idx[n]
        return F.col(f"_c{i}") - F.lit(means[f"_c{i}"])
    aggs = []
    for k, (a, b) in enumerate(pairs):
        jk, j, kk = cen(f"p_{a}__{b}"), cen(f"s_{a}"), cen(f"s_{b}")
        aggs += [F.sum((jk - j - kk) * (jk - j - kk)).alias(f"num{k}"), F.sum(jk * jk).alias(f"den{k}")]
    s = pd_df.agg(*aggs)
    items = []
    for k, (a, b) in enumerate(pairs):
        h2 = F.when(F.col(f"den{k}") > 0, F.col(f"num{k}") / F.col(f"den{k}")).otherwise(F.lit(0.0))
        items.append(F.struct(F.lit(a).alias("feature_j"), F.lit(b).alias("feature_k"), h2.alias("h2"),
                              F.sqrt(h2).alias("h")))
    return s.select(F.explode(F.array(*items)).alias("s")).select("s.*")


def interacting_pairs(ens: Ensemble) -> list[tuple[str, str]]:
    """Pairs of features sharing a root-to-leaf path; all other pairs have
    H = 0 exactly and are reported as such."""
    out = set()
    for (_t, _l, _v, cons) in ens.leaf_paths():
        fs = sorted(cons)
        for i in range(len(fs)):
            for j in range(i + 1, len(fs)):
                out.add((fs[i], fs[j]))
    return sorted(out)


# ------------------------------------------------------------------ permutation importance
def shuffle_seeds(feature: str, repeat: int, seed: int) -> tuple[int, int]:
    """Two hash values that fix the permutation of one feature and repeat."""
    h = hashlib.md5(f"{feature}|{repeat + seed}".encode()).hexdigest()
    return int(h[:12], 16), int(h[12:24], 16)


def permutation_importance(df: DataFrame, ens: Ensemble, id_col: str, label: str, features: Sequence[str],
                           repeats: int = 5, seed: int = 0, threshold: float = 0.5,
                           return_scores: bool = False) -> DataFrame:
    """Accuracy drop when one feature's column is permuted, mean and
    population std over repeats.

    Rows are numbered once by id; row k gets the value of row (a k + b) mod n,
    a bijection as a is coprime to n, with a and b from a hash of feature and
    repeat.  Just the donated values move, in one join on the number."""
    feats = list(features)
    used = ens.features()
    rows = df.select(id_col, label, *[F.col(f"`{c}`").cast("double").alias(c) for c in sorted(set(used) | set(feats))])
    rows = cut_lineage(global_row_index(rows, [id_col], "_k"))  # read by the count, the donors and the recipients
    n = rows.count()
    pred = (_p(margin_with(ens, spark_ref)) >= threshold).cast("int")
    base_acc = rows.select(F.avg((pred == F.col(label)).cast("double"))).scalar()
    moves = []
    for f in feats:
        for r in range(repeats if n else 0):
            h, g = shuffle_seeds(f, r, seed)
            a = h % n
            while math.gcd(a, n) != 1:
                a += 1
            moves.append(F.struct(F.lit(f).alias("_f"), F.lit(r).alias("_r"), F.lit(pow(a, -1, n)).cast("decimal(19,0)").alias("inv"),
                                  F.lit(g % n).cast("long").alias("b"), F.col(f"`{f}`").alias("_dv")))
    fr = F.explode(F.array(*moves)) if moves else F.explode(F.array().cast("array<struct<_f:string,_r:int,inv:decimal(19,0),b:bigint,_dv:double>>"))
    x = F.col("x")
    goes_to = F.pmod((F.col("_k") - x["b"]).cast("decimal(19,0)") * x["inv"], F.lit(max(n, 1)).cast("decimal(19,0)")).cast("long")
    donated = rows.select("_k", fr.alias("x")).select(x["_f"].alias("_f"), x["_r"].alias("_r"), x["_dv"].alias("_dv"), goes_to.alias("_k"))
    j = rows.join(donated, "_k")

    def ref(f):
        return f"(CASE WHEN `_f` = '{f}' THEN `_dv` ELSE {spark_ref(f)} END)" if f in feats else spark_ref(f)
    ppred = (_p(margin_with(ens, ref)) >= threshold).cast("int")
    acc = j.groupBy("_f", "_r").agg(F.avg((ppred == F.col(label)).cast("double")).alias("acc"))
    if return_scores:
        return acc.withColumn("base_acc", F.lit(base_acc))
    return acc.groupBy(F.col("_f").alias("feature")).agg(
        F.avg(F.lit(base_acc) - F.col("acc")).alias("importance_mean"),
        F.stddev_pop(F.lit(base_acc) - F.col("acc")).alias("importance_std"))

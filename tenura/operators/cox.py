"""Cox proportional hazards (K19-K41) on Spark.

Fit: Newton-Raphson on the driver over a p-vector.  The rows are sorted by
(stratum, time) once; every iteration is two narrow passes over the cached
blocks (``risksets``), whose risk-set sums carry over partitions.  Efron terms
of a time need only sums over its tied events (closed forms when there are
many), combined with the vectors.  Only p + p(p+1)/2 numbers an iteration, and
a few such vectors a partition, reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.functions.ordinal import global_prefix_sums, global_row_index
from tenura.functions.scans import BLOCK, in_blocks, running
from tenura.functions.stats import Z_95, chi2_sf_df1, efron_sums_sql
from tenura.operators import risksets
from tenura.session import cut_lineage

#: Share of a log-likelihood that rounding can change.
RISE = 1e-12


@dataclass
class CoxFit:
    covariates: list[str]
    strata: list[str]
    beta: np.ndarray
    cov: np.ndarray
    loglik: float
    loglik_null: float
    means: np.ndarray
    n_iter: int
    n_obs: int
    n_events: int
    ties: str
    duration: str = ""
    event: str = ""
    start: str | None = None
    history: list = field(default_factory=list)

    @property
    def se(self):
        return np.sqrt(np.diag(self.cov))


def prepare(df: DataFrame, duration: str, event: str, covariates: Sequence[str], strata: Sequence[str] = (),
            start: str | None = None, standardize: bool = True):
    """Standardised working table and the scaling used.  A null (or NaN) time,
    event or covariate is an error, as no risk set could hold its row."""
    xs = [F.col(f"`{c}`").cast("double") for c in covariates]
    names = [duration, event, *covariates, *([start] if start else [])]
    needed = [F.col(f"`{c}`") for c in names]
    st = df.agg(*[F.avg(x).alias(f"m{j}") for j, x in enumerate(xs)],
                *[F.stddev_samp(x).alias(f"s{j}") for j, x in enumerate(xs)],
                F.count(F.lit(1)).alias("n"), F.count_if(F.col(event) == 1).alias("ne"),
                *[F.count_if(c.isNull() | F.isnan(c.cast("double"))).alias(f"null{j}") for j, c in enumerate(needed)]).first()
    for j, name in enumerate(names):
        if st[f"null{j}"]:
            raise ValueError(f"{name} has {st[f'null{j}']} nulls")
    p = len(covariates)
    means = np.array([st[f"m{j}"] for j in range(p)], dtype=float)
    sds = np.array([(st[f"s{j}"] or 1.0) if standardize else 1.0 for j in range(p)], dtype=float)
    sds[sds == 0] = 1.0
    cols = [*[F.col(f"`{s}`") for s in strata], F.col(duration).cast("double").alias("_t"),
            F.col(event).cast("int").alias("_e")]
    if start:
        cols.append(F.col(start).cast("double").alias("_s"))
    cols += [((x - F.lit(means[j])) / F.lit(sds[j])).alias(f"_x{j}") for j, x in enumerate(xs)]
    return df.select(*cols), means, sds, int(st["n"]), int(st["ne"])


def cox_fit(df: DataFrame, duration: str, event: str, covariates: Sequence[str], strata: Sequence[str] = (),
            start: str | None = None, ties: str = "efron", max_iter: int = 50, tol: float = 1e-7) -> CoxFit:
    """Newton-Raphson with step halving."""
    covariates, strata = list(covariates), list(strata)
    p = len(covariates)
    work, means, sds, n, ne = prepare(df, duration, event, covariates, strata, start)
    blocks = risksets.sorted_blocks(work, "_t", "_e", [f"_x{j}" for j in range(p)], strata, "_s" if start else None)

    def evaluate(b):
        return risksets.evaluate(blocks, b, ties)
    try:
        beta = np.zeros(p)
        ll, g, H = evaluate(beta)
        ll0 = ll
        hist = [ll]
        it = 0
        for it in range(1, max_iter + 1):
            try:
                step = np.linalg.solve(H, g)
            except np.linalg.LinAlgError as e:
                raise ValueError(f"singular information matrix; collinear covariates among {covariates}") from e
            new = beta - step
            ll_new, g_new, H_new = evaluate(new)
            halv = 0
            # sums of many rows differ in their last digits: less than RISE of the whole is no fall;
            # a step so long that its sums overflow has no likelihood, or no information
            while not (ll_new >= ll - RISE * abs(ll) and np.isfinite(g_new).all() and np.isfinite(H_new).all()) and halv < 30:
                step = step / 2
                new = beta - step
                ll_new, g_new, H_new = evaluate(new)
                halv += 1
            beta, ll, g, H = new, ll_new, g_new, H_new
            hist.append(ll)
            if np.max(np.abs(step)) < tol:
                break
        else:
            raise RuntimeError(f"Cox fit did not converge in {max_iter} iterations")
        cov_std = np.linalg.inv(-H)
        beta_o = beta / sds
        cov_o = cov_std / np.outer(sds, sds)
        return CoxFit(covariates, strata, beta_o, cov_o, ll, ll0, means, it, n, ne, ties, duration, event, start, hist)
    finally:
        blocks.unpersist()


def summary(fit: CoxFit, spark, confidence_z: float = Z_95) -> DataFrame:
    """Coef, exp(coef), se, z, p, 95% CI per covariate."""
    rows = [(c, float(b), float(s)) for c, b, s in zip(fit.covariates, fit.beta, fit.se)]
    d = spark.createDataFrame(rows, "covariate string, coef double, se double")
    z = F.col("coef") / F.col("se")
    return d.select("covariate", "coef", F.exp("coef").alias("exp_coef"), "se", z.alias("z"),
                    chi2_sf_df1(z * z).alias("p"),
                    (F.col("coef") - confidence_z * F.col("se")).alias("lower_95"),
                    (F.col("coef") + confidence_z * F.col("se")).alias("upper_95"))


def fit_stats(fit: CoxFit, spark) -> DataFrame:
    """Log-likelihoods and iteration count."""
    lr = 2 * (fit.loglik - fit.loglik_null)
    return spark.createDataFrame([(fit.loglik, fit.loglik_null, lr, len(fit.covariates), fit.n_iter, fit.n_obs,
                                   fit.n_events)],
                                 "log_likelihood double, log_likelihood_null double, lr_chi2 double, dof int, "
                                 "n_iter int, n_obs long, n_events long")


# ------------------------------------------------------------------ prediction
def linear_predictor(covariates: Sequence[str], beta: Sequence[float], means: Sequence[float]) -> Column:
    return sum(((F.col(f"`{c}`").cast("double") - F.lit(float(m))) * F.lit(float(b))
                for c, b, m in zip(covariates, beta, means)), F.lit(0.0))


def data_means(df: DataFrame, covariates: Sequence[str]) -> list[float]:
    r = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{j}") for j, c in enumerate(covariates)]).first()
    return [float(r[f"m{j}"]) for j in range(len(covariates))]


def partial_hazard(df: DataFrame, id_col: str, covariates, beta, means) -> DataFrame:
    """exp((x - mean) beta) per subject."""
    return df.select(id_col, F.exp(linear_predictor(covariates, beta, means)).alias("partial_hazard"))


def baseline_hazard(df: DataFrame, duration: str, event: str, covariates, beta, means,
                    strata: Sequence[str] = ()) -> DataFrame:
    """Breslow h0(t) = d(t) / sum_{T >= t} exp((x - mean) beta), its
    cumulative sum and survival, per stratum, on every observed time."""
    w = F.exp(linear_predictor(covariates, beta, means))
    tt = df.groupBy(*strata, F.col(duration).alias("t")).agg(
        F.count_if(F.col(event) == 1).alias("d"), F.sum(w).alias("w"))
    tt, block = in_blocks(cut_lineage(tt), "t")
    h = running(tt, strata, "t", block, {"r0": "w"}, descending=True).select(
        *strata, *block, "t", "d", (F.col("d") / F.col("r0")).alias("h0"))
    h = running(h, strata, "t", block, {"cum_h0": "h0"})
    return h.select(*strata, "t", "d", "h0", "cum_h0", F.exp(-F.col("cum_h0")).alias("s0"))


@dataclass
class _Curves:
    """Baselines cut into blocks of times: ``blocks`` (strata..., _blk, _curve)
    holds the sorted (t, cum_h0) of one block, ``directory`` (strata..., _dir)
    the first time and last hazard of each block of a stratum.  A lookup finds
    the block in the directory and joins just that block; short baselines are
    one block, without a directory or a block column."""
    blocks: DataFrame
    directory: DataFrame | None
    strata: list[str]
    base: DataFrame

    @classmethod
    def of(cls, base: DataFrame, strata: Sequence[str]) -> _Curves:
        base, block = in_blocks(cut_lineage(base.select(*strata, "t", "cum_h0")), "t")
        blocks = base.groupBy(*strata, *block).agg(F.array_sort(F.collect_list(F.struct("t", "cum_h0"))).alias("_curve"))
        directory = None
        if block:
            ends = base.groupBy(*strata, *block).agg(F.min("t").alias("t"), F.max("cum_h0").alias("h"))
            directory = ends.groupBy(*strata).agg(F.array_sort(F.collect_list(F.struct(BLOCK, "t", "h"))).alias("_dir"))
        return cls(blocks, directory, list(strata), base)

    def _attach(self, subj: DataFrame, side: DataFrame, name: str) -> DataFrame:
        """One row per stratum beside its subjects; without strata it is a scalar."""
        return subj.join(side, self.strata) if self.strata else subj.withColumn(name, side.select(name).scalar())

    def every(self, subj: DataFrame) -> DataFrame:
        """Each subject beside each block of its baseline."""
        if self.directory is None:
            return self._attach(subj, self.blocks, "_curve")
        own = self._attach(subj, self.directory, "_dir").withColumn(BLOCK, F.explode(F.transform("_dir", lambda d: d[BLOCK]))).drop("_dir")
        return own.join(self.blocks, [*self.strata, BLOCK])

    def _one(self, subj: DataFrame, block) -> DataFrame:
        """Each subject beside the block that ``block`` picks from its directory (null if none)."""
        if self.directory is None:
            return self._attach(subj, self.blocks, "_curve")
        own = self._attach(subj, self.directory, "_dir").withColumn(BLOCK, block(F.col("_dir"))[BLOCK]).drop("_dir")
        return own.join(self.blocks, [*self.strata, BLOCK], "left").drop(BLOCK)

    def hazard_at(self, subj: DataFrame, time: str, name: str) -> DataFrame:
        """Adds the cumulative hazard as-of ``time`` (0 before the first time)."""
        def last(a):
            return F.try_element_at(F.filter(a, lambda s: s["t"] <= F.col(time)), F.lit(-1))
        return self._one(subj, last).withColumn(name, F.coalesce(last(F.col("_curve"))["cum_h0"], F.lit(0.0))).drop("_curve")

    def first_time(self, subj: DataFrame, reached, name: str) -> DataFrame:
        """Adds the first time whose cumulative hazard has ``reached`` what it must (null = never);
        hazards only grow, so a block's last one tells whether the time is in it or before."""
        j = self._one(subj, lambda a: F.get(F.filter(a, lambda d: reached(d["h"])), F.lit(0)))
        return j.withColumn(name, F.get(F.filter(F.col("_curve"), lambda s: reached(s["cum_h0"])), F.lit(0))["t"]).drop("_curve")


def subject_curves(df: DataFrame, id_col: str, covariates, beta, means, base: DataFrame,
                   strata: Sequence[str] = (), times: Sequence[float] | None = None) -> DataFrame:
    """Per subject and time, cumulative hazard H0(t) * ph and
    survival exp(-that).  With ``times`` the baseline is looked up as-of
    (last baseline time <= requested time), once for each stratum."""
    ph = F.exp(linear_predictor(covariates, beta, means))
    subj = df.select(id_col, *strata, ph.alias("ph"))
    if times is None:
        j = _Curves.of(base, strata).every(subj).select(id_col, *strata, "ph", F.explode("_curve").alias("_c")).select(
            id_col, *strata, "ph", F.col("_c.t").alias("t"), F.col("_c.cum_h0").alias("_h"))
    else:
        # hazards only grow, so the last one up to a time is the largest
        at = base.groupBy(*strata).agg(F.array(*[
            F.struct(F.lit(float(t)).alias("t"), F.coalesce(F.max(F.when(F.col("t") <= t, F.col("cum_h0"))), F.lit(0.0)).alias("_h"))
            for t in times]).alias("_at"))
        j = subj.join(at, list(strata)) if strata else subj.withColumn("_at", at.select("_at").scalar())
        j = j.select(id_col, *strata, "ph", F.inline("_at"))
    return j.select(id_col, *strata, "t", (F.col("_h") * F.col("ph")).alias("cum_hazard"),
                    F.exp(-F.col("_h") * F.col("ph")).alias("survival"))


def expected_lifetime(df: DataFrame, id_col: str, covariates, beta, means, base: DataFrame,
                      strata: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area under each subject's survival curve over the
    baseline time grid, block by block (array functions); a block begins at the
    last point of the one before.  ``id_col`` is unique."""
    ph = F.exp(linear_predictor(covariates, beta, means))
    curves = _Curves.of(base, strata)
    j = curves.every(df.select(id_col, *strata, ph.alias("ph")))
    c = F.col("_curve")
    if curves.directory is not None:
        before = curves.base.groupBy(*strata, BLOCK).agg(F.max_by(F.struct("t", "cum_h0"), "t").alias("_end"))
        before = before.select(*strata, BLOCK, F.lag("_end").over(Window.partitionBy(*strata).orderBy(BLOCK)).alias("_end"))
        j = j.join(before, [*strata, BLOCK])
        j = j.withColumn("_curve", F.when(F.col("_end").isNull(), c).otherwise(F.concat(F.array("_end"), c)))
    n = F.size(c)
    area = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0.0),
                       lambda acc, i: acc + F.when(n > 1, (c[i]["t"] - c[i - 1]["t"]) *
                                                   (F.exp(-c[i]["cum_h0"] * F.col("ph")) + F.exp(-c[i - 1]["cum_h0"] * F.col("ph"))) / 2)
                       .otherwise(F.lit(0.0)))
    j = j.select(id_col, *strata, area.alias("expected_lifetime"))
    if curves.directory is not None:
        j = j.groupBy(id_col, *strata).agg(F.sum("expected_lifetime").alias("expected_lifetime"))
    return j


def percentile_lifetime(df: DataFrame, id_col: str, covariates, beta, means, base: DataFrame,
                        strata: Sequence[str] = (), p: float = 0.5) -> DataFrame:
    """First baseline time where the subject's survival <= p (null = never)."""
    ph = F.exp(linear_predictor(covariates, beta, means))
    name = f"t_{int(round(p * 100))}"
    j = _Curves.of(base, strata).first_time(df.select(id_col, *strata, ph.alias("_ph")),
                                            lambda h: F.exp(-h * F.col("_ph")) <= F.lit(p), name)
    return j.select(id_col, *strata, name)


def _censored(df: DataFrame, id_col: str, duration: str, event: str, covariates, beta, means, curves: _Curves) -> DataFrame:
    """Censored subjects: hazard ratio and own baseline hazard as-of their duration."""
    ph = F.exp(linear_predictor(covariates, beta, means))
    subj = df.where(F.col(event) == 0).select(id_col, *curves.strata, F.col(duration).cast("double").alias("_T"), ph.alias("_ph"))
    return curves.hazard_at(subj, "_T", "_h_own")


def _conditional(h):
    """min(1, S(t) / S(T)) of a censored subject at the cumulative baseline hazard ``h``."""
    return F.least(F.lit(1.0), F.exp(-h * F.col("_ph")) / F.exp(-F.col("_h_own") * F.col("_ph")))


def conditional_survival(df: DataFrame, id_col: str, duration: str, event: str, covariates, beta, means,
                         base: DataFrame, strata: Sequence[str] = ()) -> DataFrame:
    """For censored subjects, S(t) and min(1, S(t) / S(T_i)) where
    S(T_i) is the subject's own curve as-of its duration."""
    curves = _Curves.of(base, strata)
    j = curves.every(_censored(df, id_col, duration, event, covariates, beta, means, curves))
    j = j.select("*", F.explode("_curve").alias("_c"))
    h = F.col("_c.cum_h0")
    return j.select(id_col, *strata, F.col("_c.t").alias("t"), F.exp(-h * F.col("_ph")).alias("survival"),
                    _conditional(h).alias("survival_cond"))


def conditional_quantiles(df: DataFrame, id_col: str, duration: str, event: str, covariates, beta, means,
                          base: DataFrame, strata: Sequence[str] = (), levels=(0.5, 0.75)) -> DataFrame:
    """For censored subjects, the first time whose conditional survival
    (K29) is <= each level (null = never); looked up, without their curves."""
    curves = _Curves.of(base, strata)
    j = _censored(df, id_col, duration, event, covariates, beta, means, curves)
    names = [f"t_{int(lv * 100)}" for lv in levels]
    for lv, name in zip(levels, names, strict=True):
        j = curves.first_time(j, lambda h, lv=lv: _conditional(h) <= F.lit(lv), name)
    return j.select(id_col, *names)


def covariate_profiles(base: DataFrame, covariates, beta, means, column: str, values: Sequence[float],
                       strata: Sequence[str] = ()) -> DataFrame:
    """Survival curves with one covariate set to each value and the
    others at their means: S0(t)^exp((v - mean) beta_j)."""
    j = list(covariates).index(column)
    vals = F.explode(F.array(*[F.lit(float(v)) for v in values])).alias("value")
    b = base.select(*strata, "t", "cum_h0", vals)
    ph = F.exp((F.col("value") - F.lit(float(means[j]))) * F.lit(float(beta[j])))
    return b.select(*strata, "value", "t", F.exp(-F.col("cum_h0") * ph).alias("survival"))


# ------------------------------------------------------------------ concordance
def concordance_index(df: DataFrame, duration: str, event: str, risk: str) -> DataFrame:
    """Harrell's C with the higher ``risk`` expected to fail first.

    Pair (i, j) is comparable when i has an event and T_j > T_i, or
    T_j = T_i with j censored; tied risks count one half.  With the key
    2 * rank(T) for events and one more for censored rows, j is comparable
    to the event i just when its key is larger.  Two keys differ first at
    one bit: every row goes to one group for each bit (the bits above it),
    where events with a 0 meet rows with a 1, and running counts over the
    risk order of all groups at once tell how many of these have less risk."""
    rows = (df.select(F.col(duration).cast("double").alias("t"), (F.col(event) == 1).alias("e"), F.col(risk).cast("double").alias("s"))
            .where("t is not null and s is not null").groupBy("t", "e", "s").agg(F.count(F.lit(1)).alias("m")))
    rows = cut_lineage(rows)
    ranks = global_row_index(rows.select("t").distinct(), ["t"], "rank")
    rows = rows.join(ranks, "t").select("e", "s", "m", (2 * F.col("rank") + F.when(F.col("e"), 0).otherwise(1)).alias("key"))
    n_times = ranks.count()
    levels = max(1, (2 * n_times).bit_length())
    # one row for each (bit, bits above, risk): rows with the bit, and events without it
    split = (rows.select("*", F.explode(F.array(*[F.lit(k) for k in range(levels)])).alias("level"))
             .select("level", F.expr("shiftright(key, level + 1)").alias("above"), "s",
                     F.expr("CASE WHEN shiftright(key, level) & 1 = 1 THEN m ELSE 0 END").alias("hi"),
                     F.expr("CASE WHEN e AND shiftright(key, level) & 1 = 0 THEN m ELSE 0 END").alias("lo"))
             .groupBy("level", "above", "s").agg(F.sum("hi").cast("double").alias("hi"), F.sum("lo").cast("double").alias("lo")))
    cum = global_prefix_sums(split.withColumn("_key", F.struct("level", "above", "s")), "_key", ["hi"], suffix="_lt", inclusive=False)
    groups = cum.groupBy("level", "above").agg(
        F.sum(F.col("lo") * F.col("hi_lt")).alias("below"), F.min("hi_lt").alias("base"), F.sum("lo").alias("lo"),
        F.sum("hi").alias("hi"), F.sum(F.col("lo") * F.col("hi")).alias("ties"))
    total = groups.agg(F.sum(F.col("below") - F.col("base") * F.col("lo")).alias("concordant"),
                       F.sum("ties").alias("tied_risk"), F.sum(F.col("lo") * F.col("hi")).alias("comparable"))
    return total.select(((F.col("concordant") + 0.5 * F.col("tied_risk")) / F.col("comparable")).alias("c_index"),
                        "concordant", "tied_risk", "comparable")


# ------------------------------------------------------------------ residuals
def _risk_means(df: DataFrame, duration: str, event: str, covariates, beta, means, strata=(),
                ties: str = "efron") -> DataFrame:
    """Per (stratum, t), for residuals: the mean ``xbar`` of the risk set over
    the tied events; hazard ``h`` and hazard-weighted means ``hm`` of that time
    (``he``, ``hme`` for its own events, which Efron's form weighs down); and the
    running sums C0 and C1 of h and hm."""
    w = F.exp(linear_predictor(covariates, beta, means))
    ev = F.when(F.col(event) == 1, w).otherwise(F.lit(0.0))
    xs = [F.col(f"`{c}`").cast("double") for c in covariates]
    p = range(len(xs))
    tt = df.groupBy(*strata, F.col(duration).cast("double").alias("t")).agg(
        F.count_if(F.col(event) == 1).alias("d"), F.sum(w).alias("w0"), F.sum(ev).alias("b0"),
        *[F.sum(w * x).alias(f"w1_{j}") for j, x in enumerate(xs)], *[F.sum(ev * x).alias(f"b1_{j}") for j, x in enumerate(xs)])
    tt, block = in_blocks(cut_lineage(tt), "t")
    r = running(tt, strata, "t", block, {"R0": "w0"} | {f"R1_{j}": f"w1_{j}" for j in p}, descending=True)
    if ties == "efron":
        sums = F.expr(efron_sums_sql("R0", "b0", "d"))
    else:
        zero = F.lit(0.0)
        sums = F.struct((F.col("d") / F.col("R0")).alias("A"), zero.alias("B"),
                        (F.col("d") / (F.col("R0") * F.col("R0"))).alias("C"), zero.alias("D"), zero.alias("E"))
    r = r.withColumn("_s", sums)
    A, B, C, D, E = (F.col("_s")[k] for k in "ABCDE")
    R1, b1 = [F.col(f"R1_{j}") for j in p], [F.col(f"b1_{j}") for j in p]
    r = r.select(*strata, *block, "t", A.alias("h"), (A - B).alias("he"),
                 *[F.when(F.col("d") > 0, (R1[j] * A - b1[j] * B) / F.col("d")).alias(f"xbar_{j}") for j in p],
                 *[(R1[j] * C - b1[j] * D).alias(f"hm_{j}") for j in p],
                 *[(R1[j] * (C - D) - b1[j] * (D - E)).alias(f"hme_{j}") for j in p])
    return running(r, strata, "t", block, {"C0": "h"} | {f"C1_{j}": f"hm_{j}" for j in p}).drop(*block)


def martingale_residuals(df: DataFrame, id_col: str, duration: str, event: str, covariates, beta, means,
                         strata: Sequence[str] = ()) -> DataFrame:
    """M = E - H0(T) exp((x - mean) beta); deviance
    sign(M) sqrt(-2 (M + E log(E - M))) with 0 log 0 = 0.  H0(T) is the
    subject's own stratum baseline at its own time (equi-join: T is on
    the grid of observed times)."""
    base = baseline_hazard(df, duration, event, covariates, beta, means, strata)
    ph = F.exp(linear_predictor(covariates, beta, means))
    subj = df.select(id_col, *strata, F.col(duration).alias("t"), F.col(event).cast("double").alias("E"), ph.alias("ph"))
    j = subj.join(base.select(*strata, "t", "cum_h0"), [*strata, "t"])
    m = F.col("E") - F.col("cum_h0") * F.col("ph")
    elog = F.when(F.col("E") > 0, F.col("E") * F.log(F.col("E") - m)).otherwise(F.lit(0.0))
    dev = F.signum(m) * F.sqrt(F.greatest(F.lit(0.0), F.lit(-2.0) * (m + elog)))
    return j.select(id_col, *strata, F.col("t").alias(duration), F.col("E").cast("int").alias(event),
                    m.alias("martingale"), dev.alias("deviance"))


def score_residuals(df: DataFrame, id_col: str, duration: str, event: str, covariates, beta, means,
                    strata: Sequence[str] = (), ties: str = "efron") -> DataFrame:
    """Score residuals L0, L1, ... of every row: what it adds to the gradient,
    E_i (x_i - xbar(T_i)) - w_i (x_i H_i - M_i), with the hazard H_i and the
    hazard-weighted means M_i that the row was at risk for."""
    rm = _risk_means(df, duration, event, covariates, beta, means, strata, ties)
    w = F.exp(linear_predictor(covariates, beta, means))
    subj = df.select(id_col, *strata, F.col(duration).cast("double").alias("t"), F.col(event).cast("double").alias("E"),
                     w.alias("w"), *[F.col(f"`{c}`").cast("double").alias(f"x{j}") for j, c in enumerate(covariates)])
    failed = F.col("E") == 1
    H = F.col("C0") + F.when(failed, F.col("he") - F.col("h")).otherwise(0.0)
    score = []
    for k in range(len(covariates)):
        x = F.col(f"x{k}")
        M = F.col(f"C1_{k}") + F.when(failed, F.col(f"hme_{k}") - F.col(f"hm_{k}")).otherwise(0.0)
        own = F.when(failed, x - F.col(f"xbar_{k}")).otherwise(0.0)
        score.append((own - F.col("w") * (x * H - M)).alias(f"L{k}"))
    return subj.join(rm, [*strata, "t"]).select(id_col, F.col("t").alias(duration), F.col("E").cast("int").alias(event), *score)


def delta_beta(df: DataFrame, id_col: str, duration: str, event: str, fit: CoxFit, strata=None) -> DataFrame:
    """Influence of each row on each coefficient = its score residuals x
    covariance (p x p, shipped as literals), in one projection."""
    strata = fit.strata if strata is None else strata
    sr = score_residuals(df, id_col, duration, event, fit.covariates, fit.beta, fit.means, strata, fit.ties)
    items = []
    for k, c in enumerate(fit.covariates):
        v = sum((F.col(f"L{i}") * F.lit(float(fit.cov[i, k])) for i in range(len(fit.covariates))), F.lit(0.0))
        items.append(F.struct(F.lit(c).alias("covariate"), v.alias("delta_beta")))
    return sr.select(id_col, duration, event, F.explode(F.array(*items)).alias("s")).select(id_col, duration, event, "s.*")


def ph_test(df: DataFrame, duration: str, event: str, fit: CoxFit) -> DataFrame:
    """Grambsch-Therneau test per covariate with the rank time
    transform (average ranks among event times).  Schoenfeld residuals
    r_i = x_i - xbar(T_i) use the fit's risk-set means; only p sums and
    the covariance matrix enter the statistic."""
    strata = fit.strata
    rm = _risk_means(df, duration, event, fit.covariates, fit.beta, fit.means, strata, fit.ties)
    p = len(fit.covariates)
    evd = df.where(F.col(event) == 1)
    m = evd.count()
    # average rank of each distinct event time among all event times
    et = evd.groupBy(F.col(duration).cast("double").alias("t")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    rk = global_prefix_sums(et, "t", ["c"], suffix="_lt", inclusive=False).select(
        "t", (F.col("c_lt") + (F.col("c") + 1) / 2).alias("g"))
    gbar = (m + 1) / 2.0
    e = evd.select(*strata, F.col(duration).cast("double").alias("t"),
                   *[F.col(f"`{c}`").cast("double").alias(f"x{j}") for j, c in enumerate(fit.covariates)])
    j = e.join(rm.select(*strata, "t", *[f"xbar_{k}" for k in range(p)]), [*strata, "t"]).join(rk, "t")
    gc = F.col("g") - F.lit(gbar)
    s = j.agg(*[F.sum(gc * (F.col(f"x{k}") - F.col(f"xbar_{k}"))).alias(f"s{k}") for k in range(p)],
              F.sum(gc * gc).alias("sgg")).first()
    S = np.array([s[f"s{k}"] for k in range(p)])
    V = fit.cov
    num = m * (V @ S)
    rows = []
    for k, c in enumerate(fit.covariates):
        chi2 = float(num[k] ** 2 / (m * V[k, k] * s["sgg"]))
        rows.append((c, chi2))
    out = df.sparkSession.createDataFrame(rows, "covariate string, chi2 double")
    return out.select("covariate", "chi2", chi2_sf_df1(F.col("chi2")).alias("p"))


# ------------------------------------------------------------------ episodic format
def episodic(df: DataFrame, id_col: str, duration: str, event: str, gap: float = 1.0) -> DataFrame:
    """(start, stop] rows of width ``gap`` up to each duration; the
    event only on the last row; duration 0 gives no rows.  Subjects are dealt over
    the slots first: small as they are, AQE would leave them, and all their rows, in one task."""
    df = df.repartition(df.sparkSession.sparkContext.defaultParallelism, id_col)
    T = F.col(duration).cast("double")
    n = F.ceil(T / F.lit(gap)).cast("int")
    k = F.explode(F.sequence(F.lit(0), n - 1)).alias("_k")
    cols = [c for c in df.columns if c not in (duration,)]
    r = df.where(T > 0).select(*[F.col(f"`{c}`") for c in cols], T.alias("_T"), n.alias("_n"), k)
    start = F.col("_k") * F.lit(gap)
    stop = F.least(start + F.lit(gap), F.col("_T"))
    last = F.col("_k") == F.col("_n") - 1
    out = r.select(*[F.col(f"`{c}`") for c in cols if c != event], start.alias("start"), stop.alias("stop"),
                   F.when(last, F.col(event)).otherwise(F.lit(0)).cast("int").alias(event))
    return out


def interaction(df: DataFrame, a: str, b: str, name: str | None = None) -> DataFrame:
    """A * b as a new column (e.g. a time-varying covariate x * stop)."""
    return df.withColumn(name or f"{a}*{b}", F.col(f"`{a}`") * F.col(f"`{b}`"))


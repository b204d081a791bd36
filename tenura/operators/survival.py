"""Non-parametric and simple parametric survival.

Plan rule: subjects are aggregated to one row per (group..., t) first
(partial aggregation, so a hot group is combined map-side).  That table is
written once; running sums and products go over it in blocks of times
(``functions/scans``), so times as fine as seconds spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.functions.scans import in_blocks, running
from tenura.functions.stats import chi2_sf, chi2_sf_df1, tie_sum_sql, z_quantile
from tenura.session import cut_lineage


def time_counts(df: DataFrame, duration: str, event: str, groups: Sequence[str] = (),
                origin: bool = False) -> DataFrame:
    """(groups..., t, removed, observed): one row per distinct time.

    With ``origin`` the counts are written and each contributes a zero-count
    (group, t=0) entry too, so every group has an origin row without a second
    pass over the input."""
    counts = df.groupBy(*groups, F.col(duration).alias("t")).agg(
        F.count(F.lit(1)).alias("removed"),
        F.sum(F.col(event).cast("long")).alias("observed"))
    if not origin:
        return counts
    entries = F.explode(F.array(
        F.struct("t", F.col("removed").alias("r"), F.col("observed").alias("o")),
        F.struct(F.lit(0).cast(df.schema[duration].dataType).alias("t"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("o"))))
    x = cut_lineage(counts).select(*groups, entries.alias("_x"))
    return x.groupBy(*groups, F.col("_x.t").alias("t")).agg(
        F.sum("_x.r").alias("removed"), F.sum("_x.o").alias("observed"))


def event_table(df: DataFrame, duration: str, event: str, groups: Sequence[str] = (),
                add_origin: bool = True) -> DataFrame:
    """K4: removed, observed, censored, entrance and at-risk per time.

    A t=0 row is added per group when no subject has duration 0, so the
    table starts where the curve starts (S(0)=1)."""
    tc = time_counts(df, duration, event, groups, origin=add_origin)
    return _event_columns(tc if add_origin else cut_lineage(tc), groups)


def event_table_from_counts(tc: DataFrame, groups: Sequence[str] = (), add_origin: bool = True) -> DataFrame:
    """K4 from pre-aggregated (groups..., t, removed, observed) counts, e.g.
    the state table maintained by the streaming job."""
    tc = cut_lineage(tc)
    if add_origin:
        origin = tc.select(*groups).distinct().select(*groups, F.lit(0).cast(tc.schema["t"].dataType).alias("t"),
                                                      F.lit(0).cast("long").alias("removed"),
                                                      F.lit(0).cast("long").alias("observed"))
        tc = tc.unionByName(origin).groupBy(*groups, "t").agg(
            F.sum("removed").alias("removed"), F.sum("observed").alias("observed"))
    return _event_columns(tc, groups)


def _event_columns(tc: DataFrame, groups: Sequence[str]) -> DataFrame:
    return _event_table(tc, groups)[0].select(*groups, "t", "removed", "observed", "censored", "entrance", "at_risk")


def _event_table(tc: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The event table of counts that come from written ones, with its block column, if it has one."""
    tc, block = in_blocks(tc, "t")
    # the first time of a group is the last one from the end
    r = running(tc.withColumn("_one", F.lit(1)), groups, "t", block, {"at_risk": "removed", "_no": "_one"},
                totals={"_total": F.col("removed"), "_n": F.lit(1)}, descending=True)
    return r.select(*groups, *block, "t", "removed", "observed", (F.col("removed") - F.col("observed")).alias("censored"),
                    F.when(F.col("_no") == F.col("_n"), F.col("_total")).otherwise(F.lit(0).cast("long")).alias("entrance"),
                    "at_risk"), block


def kaplan_meier(df: DataFrame, duration: str, event: str, groups: Sequence[str] = (),
                 confidence: float = 0.95) -> DataFrame:
    """K1/K2/K7/K8: product-limit curve with Greenwood log(-log) band."""
    ev, block = _event_table(time_counts(df, duration, event, groups, origin=True), groups)
    return _product_limit(ev, block, groups, confidence)


def km_from_event_table(ev: DataFrame, groups: Sequence[str] = (), confidence: float = 0.95) -> DataFrame:
    """Product-limit curve and band from an event table."""
    return _product_limit(*in_blocks(cut_lineage(ev), "t"), groups, confidence)


def _product_limit(ev: DataFrame, block: Sequence[str], groups: Sequence[str], confidence: float) -> DataFrame:
    z = z_quantile(confidence)
    n, d = F.col("at_risk"), F.col("observed")
    ev = ev.withColumn("_gw", F.when(n > d, d / (n * (n - d))).otherwise(F.lit(0.0)))
    out = running(ev, groups, "t", block, {"greenwood": "_gw"}, {"survival": F.lit(1.0) - d / n})
    ln_s = F.log(F.col("survival"))
    theta = F.lit(z) * F.sqrt(F.col("greenwood")) / ln_s
    valid = (F.col("survival") > 0) & (F.col("survival") < 1)
    lo = F.when(valid, F.pow(F.col("survival"), F.exp(-theta))).when(F.col("survival") == 1, F.lit(1.0))
    hi = F.when(valid, F.pow(F.col("survival"), F.exp(theta))).when(F.col("survival") == 1, F.lit(1.0))
    return out.select(*groups, "t", "at_risk", "observed", "censored", "survival",
                      lo.alias("ci_lower"), hi.alias("ci_upper"), "greenwood")


def survival_at_level(km: DataFrame, level: float = 0.5, groups: Sequence[str] = ()) -> DataFrame:
    """K3/K9: first time the curve is at or below ``level`` (null = never);
    ``diff_prev`` is the gap to the previous group in group order."""
    r = km.groupBy(*groups).agg(F.min(F.when(F.col("survival") <= level, F.col("t"))).alias("t_level"))
    if groups:
        r = r.withColumn("diff_prev", F.col("t_level") - F.lag("t_level").over(Window.orderBy(*groups)))
    return r


def at_risk_at_ticks(df: DataFrame, duration: str, ticks: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """K6: subjects still at risk (duration >= tick) at each tick; one pass."""
    aggs = [F.count_if(F.col(duration) >= F.lit(tk)).alias(f"n_{i}") for i, tk in enumerate(ticks)]
    wide = df.groupBy(*groups).agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(tk).alias("tick"), F.col(f"n_{i}").alias("at_risk"))
                                for i, tk in enumerate(ticks)])).alias("s")
    return wide.select(*groups, stack).select(*groups, "s.tick", "s.at_risk")


def naive_mean_lifetime(df: DataFrame, duration: str, event: str) -> DataFrame:
    """Mean duration over all rows and over event rows."""
    return df.agg(F.avg(F.col(duration).cast("double")).alias("mean_duration"),
                  F.avg(F.when(F.col(event) == 1, F.col(duration).cast("double"))).alias("mean_event_duration"),
                  F.count(F.lit(1)).alias("n"), F.count_if(F.col(event) == 1).alias("n_events"))


def censor_at(df: DataFrame, duration: str, tau: float, event: str | None = None, id_col: str | None = None) -> DataFrame:
    """C17: administrative censoring at tau.  Without ``event`` the event is
    ``T < tau`` as in the reference; with it, ``event AND T < tau``."""
    t = F.col(duration)
    ev = (t < tau) if event is None else ((F.col(event) == 1) & (t < tau))
    cols = ([id_col] if id_col else []) + [F.least(t.cast("double"), F.lit(float(tau))).alias("duration"),
                                           ev.cast("int").alias("event")]
    return df.select(*cols)


def nelson_aalen(df: DataFrame, duration: str, event: str, groups: Sequence[str] = (),
                 confidence: float = 0.95) -> DataFrame:
    """Tie-corrected cumulative hazard and log-transformed band."""
    z = z_quantile(confidence)
    ev, block = _event_table(time_counts(df, duration, event, groups, origin=True), groups)
    inc = ev.select(*groups, *block, "t", "at_risk", "observed", F.expr(tie_sum_sql("at_risk", "observed", 1)).alias("dh"),
                    F.expr(tie_sum_sql("at_risk", "observed", 2)).alias("dv"))
    out = running(inc, groups, "t", block, {"cum_hazard": "dh", "variance": "dv"})
    h = F.col("cum_hazard")
    band = F.lit(z) * F.sqrt(F.col("variance")) / h
    return out.select(*groups, "t", "at_risk", "observed", "dh", "cum_hazard", "variance",
                      F.when(h > 0, h * F.exp(-band)).otherwise(F.lit(0.0)).alias("ci_lower"),
                      F.when(h > 0, h * F.exp(band)).otherwise(F.lit(0.0)).alias("ci_upper"))


def smoothed_hazard(df: DataFrame, duration: str, event: str, bandwidth: float,
                    groups: Sequence[str] = ()) -> DataFrame:
    """Epanechnikov-smoothed hazard on the time grid, |t-s| < b.

    Band join done as an equi-join on a bandwidth-wide time bucket and
    its neighbours (no nested-loop join)."""
    na = nelson_aalen(df, duration, event, groups).select(*groups, "t", "dh")
    b = float(bandwidth)
    grid = na.select(*groups, "t", F.floor(F.col("t") / b).cast("long").alias("bk"))
    incs = (na.where(F.col("dh") != 0)
            .select(*groups, F.col("t").alias("s"), "dh",
                    F.explode(F.array(*[F.floor(F.col("t") / b).cast("long") + k for k in (-1, 0, 1)])).alias("bk")))
    g, i = grid.alias("g"), incs.alias("i")
    cond = [F.col(f"g.{c}") == F.col(f"i.{c}") for c in [*groups, "bk"]]
    cond.append(F.abs(F.col("g.t") - F.col("i.s")) < b)
    j = g.join(i, on=cond, how="left").select(*[F.col(f"g.{c}") for c in groups], "g.t", "i.s", "i.dh")
    u = (F.col("t") - F.col("s")) / b
    k = F.lit(0.75) * (F.lit(1.0) - u * u)
    return (j.groupBy(*groups, "t")
            .agg((F.coalesce(F.sum(k * F.col("dh")), F.lit(0.0)) / b).alias("hazard")))


def logrank_two_sample(df: DataFrame, duration: str, event: str, group_a: Column,
                       confidence: float = 0.95) -> DataFrame:
    """Two-sample log-rank; group A = rows where ``group_a`` is true.

    One groupBy(t) with conditional counts, running sums over blocks of
    distinct times, one final aggregate.  ``hazard_ratio`` uses the signed root z;
    ``hazard_ratio_chi2_form`` reproduces the reference's use of chi2."""
    tc = df.groupBy(F.col(duration).alias("t")).agg(
        F.count(F.lit(1)).alias("r"), F.sum(F.col(event).cast("long")).alias("d"),
        F.count_if(group_a).alias("r1"), F.sum(F.when(group_a, F.col(event)).otherwise(0).cast("long")).alias("d1"))
    tc, block = in_blocks(cut_lineage(tc), "t")
    per_t = running(tc, [], "t", block, {"n": "r", "n1": "r1"}, descending=True)
    n, d, n1, d1 = (F.col(c).cast("double") for c in ("n", "d", "n1", "d1"))
    e1 = d * n1 / n
    v = F.when(n > 1, d * (n1 / n) * (F.lit(1.0) - n1 / n) * (n - d) / (n - 1)).otherwise(F.lit(0.0))
    s = per_t.agg(F.sum(d1 - e1).alias("o_minus_e"), F.sum(v).alias("variance"),
                  F.sum("d").alias("total_events"), F.sum("d1").alias("observed_a"), F.sum(e1).alias("expected_a"))
    chi2 = F.col("o_minus_e") * F.col("o_minus_e") / F.col("variance")
    zc = F.col("o_minus_e") / F.sqrt(F.col("variance"))
    return s.select("total_events", "observed_a", "expected_a", "o_minus_e", "variance",
                    chi2.alias("chi2"), chi2_sf_df1(chi2).alias("p_value"), zc.alias("z"),
                    F.exp(zc * F.sqrt(F.lit(4.0) / F.col("total_events"))).alias("hazard_ratio"),
                    F.exp(chi2 * F.sqrt(F.lit(4.0) / F.col("total_events"))).alias("hazard_ratio_chi2_form"))


def logrank_k_sample(df: DataFrame, duration: str, event: str, group: str) -> DataFrame:
    """K-sample log-rank, chi2 with k-1 df.

    Counts are pivoted to one row per distinct time (a column pair per
    group; null groups are left out), at-risk is a reverse running sum over times, and the O-E
    vector and k x k covariance are one aggregate.  Only that bounded
    (k-1)x(k-1) system is solved on the driver."""
    import numpy as np

    tc = time_counts(df.where(F.col(group).isNotNull()), duration, event, [group])
    lv = [r[0] for r in tc.select(group).distinct().orderBy(group).collect()]
    if len(lv) < 2:
        raise ValueError(f"k-sample log-rank needs two groups or more, got {len(lv)}")
    k = len(lv)
    # groups get dense codes, so that column names don't depend on their values
    codes = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(lv)], tc.select(group, F.lit(0).alias("_g")).schema)
    wide = (tc.join(codes, group).groupBy("t").pivot("_g", list(range(k)))
            .agg(F.sum("removed").alias("r"), F.sum("observed").alias("d")).fillna(0))
    wide, block = in_blocks(cut_lineage(wide), "t")
    per = running(wide, [], "t", block, {f"_n{i}": f"{i}_r" for i in range(k)}, descending=True).select(
        *[F.col(f"{i}_d").cast("double").alias(f"d{i}") for i in range(k)], *[F.col(f"_n{i}").cast("double").alias(f"n{i}") for i in range(k)])
    n = sum((F.col(f"n{i}") for i in range(k)), F.lit(0.0))
    d = sum((F.col(f"d{i}") for i in range(k)), F.lit(0.0))
    per = per.select("*", n.alias("n"), d.alias("d"))
    n, d = F.col("n"), F.col("d")
    fac = F.when(n > 1, d * (n - d) / (n - 1)).otherwise(F.lit(0.0))
    aggs = [F.sum(F.col(f"d{i}") - d * F.col(f"n{i}") / n).alias(f"oe{i}") for i in range(k)]
    for i in range(k):
        for j in range(k):
            delta = 1.0 if i == j else 0.0
            aggs.append(F.sum(fac * (F.col(f"n{i}") / n) * (F.lit(delta) - F.col(f"n{j}") / n)).alias(f"v{i}_{j}"))
    row = per.agg(*aggs).first()
    x = np.array([row[f"oe{i}"] for i in range(k)])[:-1]
    V = np.array([[row[f"v{i}_{j}"] for j in range(k)] for i in range(k)])[:-1, :-1]
    chi2 = float(x @ np.linalg.solve(V, x))
    res = df.sparkSession.createDataFrame([(chi2, k - 1)], "chi2 double, dof int")
    return res.select("chi2", "dof", chi2_sf(F.col("chi2"), F.col("dof")).alias("p_value"))


def survival_difference_at(df: DataFrame, duration: str, event: str, group_a: Column, at: float) -> DataFrame:
    """log(-log S) contrast of two KM curves at a fixed time (as-of)."""
    g = df.withColumn("_g", F.when(group_a, 1).otherwise(0))
    km = kaplan_meier(g, duration, event, ["_g"]).where(F.col("t") <= at)
    last = km.groupBy("_g").agg(F.max_by("survival", "t").alias("s"), F.max_by("greenwood", "t").alias("v"))
    p = last.groupBy().pivot("_g", [0, 1]).agg(F.first("s").alias("s"), F.first("v").alias("v"))
    l1, l0 = F.log(F.col("1_s")), F.log(F.col("0_s"))
    ok = (F.col("1_s") > 0) & (F.col("1_s") < 1) & (F.col("0_s") > 0) & (F.col("0_s") < 1)
    x2 = F.when(ok, F.pow(F.log(-l1) - F.log(-l0), 2)
                / (F.col("1_v") / (l1 * l1) + F.col("0_v") / (l0 * l0)))
    return p.select(F.col("1_s").alias("survival_a"), F.col("0_s").alias("survival_b"),
                    x2.alias("chi2"), chi2_sf_df1(x2).alias("p_value"))


def exponential_fit(df: DataFrame, duration: str, event: str) -> DataFrame:
    """lambda = sum(d) / sum(T); mean lifetime 1/lambda."""
    s = df.agg(F.sum(F.col(event).cast("double")).alias("events"), F.sum(F.col(duration).cast("double")).alias("exposure"))
    lam = F.col("events") / F.col("exposure")
    return s.select("events", "exposure", lam.alias("rate"), (F.lit(1.0) / lam).alias("mean_lifetime"))


def weibull_fit(df: DataFrame, duration: str, event: str, max_iter: int = 200, tol: float = 1e-9) -> DataFrame:
    """Weibull S(t)=exp(-(t/lam)^rho) by maximum likelihood in
    (a, b) = (log lam, log rho).

    Each evaluation is one aggregate over the (t, d, n) table (cached;
    distinct times, not subjects) returning three sums.  Newton steps are
    used where the Hessian is negative definite, scaled gradient steps
    elsewhere, always with backtracking on the log-likelihood.
    Durations must be > 0."""
    import numpy as np

    tc = (df.where(F.col(duration) > 0)
          .groupBy(F.col(duration).cast("double").alias("t"))
          .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(event).cast("double")).alias("d"))
          .persist())
    base = tc.agg(F.sum("d").alias("D"), F.sum(F.col("d") * F.log("t")).alias("DL"),
                  F.sum(F.col("n") * F.col("t")).alias("ST")).first()
    D, DL = float(base["D"]), float(base["DL"])

    def evaluate(theta):
        a, b = float(theta[0]), float(theta[1])
        r = float(np.exp(b))
        lt = F.log(F.col("t")) - F.lit(a)
        u = F.exp(F.lit(r) * lt)
        row = tc.agg(F.sum(F.col("n") * u).alias("s0"), F.sum(F.col("n") * u * lt).alias("s1"),
                     F.sum(F.col("n") * u * lt * lt).alias("s2")).first()
        s0, s1, s2 = row["s0"], row["s1"], row["s2"]
        ll = D * b + (r - 1) * DL - r * D * a - s0
        g = np.array([-D * r + r * s0, D + r * (DL - D * a) - r * s1])
        H = np.array([[-r * r * s0, -D * r + r * s0 + r * r * s1],
                      [-D * r + r * s0 + r * r * s1, r * (DL - D * a) - r * s1 - r * r * s2]])
        return ll, g, H

    theta = np.array([np.log(float(base["ST"]) / max(D, 1.0)), 0.0])  # exponential fit start
    ll, g, H = evaluate(theta)
    for _ in range(max_iter):
        if np.all(np.linalg.eigvalsh(H) < 0):
            step = -np.linalg.solve(H, g)
        else:
            step = g / (np.abs(np.diag(H)) + 1.0)
        t_new = theta + step
        ll_new, g_new, H_new = evaluate(t_new)
        k = 0
        while (not np.isfinite(ll_new) or ll_new < ll) and k < 40:
            step = step / 2
            t_new = theta + step
            ll_new, g_new, H_new = evaluate(t_new)
            k += 1
        theta, ll, g, H = t_new, ll_new, g_new, H_new
        if np.max(np.abs(step)) < tol:
            break
    else:
        tc.unpersist()
        raise RuntimeError(f"Weibull fit did not converge in {max_iter} iterations")
    tc.unpersist()
    return df.sparkSession.createDataFrame([(float(np.exp(theta[0])), float(np.exp(theta[1])), float(ll))],
                                           "lambda_ double, rho double, log_likelihood double")

"""Registered Cox queries.

Queries with a constant coefficient table (K21, K23-K31, K38, K39, K41)
have DuckDB oracles; fitted-model queries (K19, K20, K22, K32-K35, K37,
K40) are rows-only here; tests/test_cox.py holds the operators against
brute force (Efron likelihood, score residuals, PH test, leave-one-out).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tenura.operators import clean as cl
from tenura.operators import cox
from tenura.plans.common import finish, subjects
from tenura.plans.sqltext import with_base

QUERIES = {}
SQL = {}


def _reg(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_base(sql)
        return fn
    return deco


# Constant coefficient table for the SQL-checked prediction queries.
COVS = ["senior", "partner_i", "dependents_i", "mc"]
BETA = [0.25, -0.35, -0.30, 0.40]
# Category levels of the panel, without one reference level per group.
LEVELS = {"contract": ["One year", "Two year"], "payment_method": ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
          "internet_service": ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]}
FIT_COVS = ["senior", "partner_i", "dependents_i", "security_i", "mc", *[f"{c}_{v}" for c, vs in LEVELS.items() for v in vs]]


def cox_subjects(spark, sf):
    s = subjects(spark, sf)
    return s.select("account_id", "tenure", "event", "contract", "total_charges",
                    F.col("senior").cast("double").alias("senior"),
                    (F.col("partner") == "Yes").cast("double").alias("partner_i"),
                    (F.col("dependents") == "Yes").cast("double").alias("dependents_i"),
                    (F.col("online_security") == "Yes").cast("double").alias("security_i"),
                    (F.col("monthly_charges") / 100000.0).alias("mc"),
                    *[(F.col(c) == v).cast("double").alias(f"{c}_{v}") for c, vs in LEVELS.items() for v in vs])


CX = """_cx AS (SELECT account_id, tenure, event, contract, total_charges, CAST(senior AS DOUBLE) AS senior,
  CAST(partner = 'Yes' AS DOUBLE) AS partner_i, CAST(dependents = 'Yes' AS DOUBLE) AS dependents_i, monthly_charges / 100000.0 AS mc FROM subj),
_mean AS (SELECT AVG(senior) AS m0, AVG(partner_i) AS m1, AVG(dependents_i) AS m2, AVG(mc) AS m3 FROM _cx),
_ph AS (SELECT _cx.*, exp((senior - m0) * 0.25 + (partner_i - m1) * -0.35 + (dependents_i - m2) * -0.3 + (mc - m3) * 0.4) AS ph
  FROM _cx, _mean)"""


def _base_sql(strata):
    g = "".join(f"{s}, " for s in strata)
    part = f"PARTITION BY {', '.join(strata)} " if strata else ""
    return CX + f""",
_tt AS (SELECT {g}tenure AS t, COUNT(*) FILTER (WHERE event = 1) AS d, SUM(ph) AS w FROM _ph GROUP BY {g}tenure),
_bh AS (SELECT *, d / SUM(w) OVER ({part}ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h0 FROM _tt),
_base AS (SELECT {g}t, d, h0, SUM(h0) OVER ({part}ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_h0 FROM _bh)"""


def _means(df):
    return cox.data_means(df, COVS)


def _baseline(spark, sf, strata=()):
    d = cox_subjects(spark, sf)
    m = _means(d)
    return d, m, cox.baseline_hazard(d, "tenure", "event", COVS, BETA, m, strata)


# ---------------------------------------------------------------- K21 / K24
@_reg("k21_baseline_hazard", "WITH " + _base_sql([]) + """
SELECT t, d, round(h0, 6) AS h0, round(cum_h0, 6) AS cum_h0, round(exp(-cum_h0), 6) AS s0 FROM _base""")
def k21_baseline_hazard(spark, sf):
    return finish(_baseline(spark, sf)[2])


@_reg("k21_baseline_hazard_by_contract", "WITH " + _base_sql(["contract"]) + """
SELECT contract, t, d, round(h0, 6) AS h0, round(cum_h0, 6) AS cum_h0, round(exp(-cum_h0), 6) AS s0 FROM _base""")
def k21_baseline_hazard_by_contract(spark, sf):
    return finish(_baseline(spark, sf, ["contract"])[2])


@_reg("k24_partial_hazard", "WITH " + CX + " SELECT account_id, round(ph, 6) AS partial_hazard FROM _ph")
def k24_partial_hazard(spark, sf):
    d = cox_subjects(spark, sf)
    return finish(cox.partial_hazard(d, "account_id", COVS, BETA, _means(d)))


# ---------------------------------------------------------------- K25 / K26
@_reg("k25_subject_curves", "WITH " + _base_sql(["contract"]) + """
SELECT p.account_id, p.contract, b.t, round(b.cum_h0 * p.ph, 6) AS cum_hazard, round(exp(-b.cum_h0 * p.ph), 6) AS survival
FROM _ph p JOIN _base b ON p.contract = b.contract""")
def k25_subject_curves(spark, sf):
    d, m, base = _baseline(spark, sf, ["contract"])
    return finish(cox.subject_curves(d, "account_id", COVS, BETA, m, base, ["contract"]))


@_reg("f08_curves_by_subject", "WITH " + _base_sql(["contract"]) + """
SELECT p.account_id, b.t, round(exp(-b.cum_h0 * p.ph), 6) AS survival
FROM _ph p JOIN _base b ON p.contract = b.contract ORDER BY p.account_id, b.t""")
def f08_curves_by_subject(spark, sf):
    d, m, base = _baseline(spark, sf, ["contract"])
    c = cox.subject_curves(d, "account_id", COVS, BETA, m, base, ["contract"])
    return finish(c.select("account_id", "t", "survival").orderBy("account_id", "t"))


TIMES = [6.0, 12.0, 24.0, 36.0, 48.0, 60.0, 72.0]


@_reg("k26_survival_at_times", "WITH " + _base_sql([]) + """, _tm AS (SELECT * FROM (VALUES """ + ", ".join(
    f"({t}E0)" for t in TIMES) + """) v(tm)),
_h AS (SELECT tm, COALESCE((SELECT arg_max(cum_h0, t) FROM _base WHERE t <= tm), 0.0) AS h FROM _tm)
SELECT p.account_id, round(_h.tm, 6) AS t, round(_h.h * p.ph, 6) AS cum_hazard, round(exp(-_h.h * p.ph), 6) AS survival
FROM _ph p, _h""")
def k26_survival_at_times(spark, sf):
    d, m, base = _baseline(spark, sf)
    return finish(cox.subject_curves(d, "account_id", COVS, BETA, m, base, (), times=TIMES))


# ---------------------------------------------------------------- K27 / K28
EXP_SQL = "WITH " + _base_sql(["contract"]) + """, _c AS (SELECT p.account_id, p.contract, b.t, exp(-b.cum_h0 * p.ph) AS s FROM _ph p JOIN _base b ON p.contract = b.contract),
_l AS (SELECT *, LAG(t) OVER (PARTITION BY account_id ORDER BY t) AS t_prev, LAG(s) OVER (PARTITION BY account_id ORDER BY t) AS s_prev FROM _c),
_e AS (SELECT account_id, contract, COALESCE(SUM(CASE WHEN t_prev IS NOT NULL THEN (t - t_prev) * (s + s_prev) / 2 END), 0.0) AS expected_lifetime
       FROM _l GROUP BY account_id, contract)"""


@_reg("k27_expected_lifetime", EXP_SQL + " SELECT account_id, contract, round(expected_lifetime, 6) AS expected_lifetime FROM _e")
def k27_expected_lifetime(spark, sf):
    d, m, base = _baseline(spark, sf, ["contract"])
    return finish(cox.expected_lifetime(d, "account_id", COVS, BETA, m, base, ["contract"]))


@_reg("k27_mean_expected_lifetime", EXP_SQL + " SELECT round(AVG(expected_lifetime), 6) AS mean_expected_lifetime, COUNT(*) AS n FROM _e")
def k27_mean_expected_lifetime(spark, sf):
    d, m, base = _baseline(spark, sf, ["contract"])
    e = cox.expected_lifetime(d, "account_id", COVS, BETA, m, base, ["contract"])
    return finish(e.agg(F.avg("expected_lifetime").alias("mean_expected_lifetime"), F.count(F.lit(1)).alias("n")))


@_reg("k28_median_lifetime", "WITH " + _base_sql(["contract"]) + """
SELECT p.account_id, p.contract, MIN(CASE WHEN exp(-b.cum_h0 * p.ph) <= 0.5 THEN b.t END) AS t_50
FROM _ph p JOIN _base b ON p.contract = b.contract GROUP BY p.account_id, p.contract""")
def k28_median_lifetime(spark, sf):
    d, m, base = _baseline(spark, sf, ["contract"])
    return cox.percentile_lifetime(d, "account_id", COVS, BETA, m, base, ["contract"], 0.5)


# ---------------------------------------------------------------- K29 / K30
COND_SQL = "WITH " + _base_sql(["contract"]) + """, _own AS (SELECT p.account_id, p.contract, p.ph, b.cum_h0 AS h_own FROM _ph p
  JOIN _base b ON p.contract = b.contract AND b.t = p.tenure WHERE p.event = 0),
_cs AS (SELECT o.account_id, o.contract, b.t, exp(-b.cum_h0 * o.ph) AS survival, LEAST(1.0, exp(-b.cum_h0 * o.ph) / exp(-o.h_own * o.ph)) AS survival_cond
  FROM _own o JOIN _base b ON o.contract = b.contract)"""


@_reg("k29_conditional_survival", COND_SQL + """
SELECT account_id, contract, t, round(survival, 6) AS survival, round(survival_cond, 6) AS survival_cond FROM _cs""")
def k29_conditional_survival(spark, sf):
    d, m, base = _baseline(spark, sf, ["contract"])
    return finish(cox.conditional_survival(d, "account_id", "tenure", "event", COVS, BETA, m, base, ["contract"]))


@_reg("k30_conditional_quantiles", COND_SQL + """
SELECT account_id, MIN(CASE WHEN survival_cond <= 0.5 THEN t END) AS t_50, MIN(CASE WHEN survival_cond <= 0.75 THEN t END) AS t_75
FROM _cs GROUP BY account_id""")
def k30_conditional_quantiles(spark, sf):
    d, m, base = _baseline(spark, sf, ["contract"])
    return cox.conditional_quantiles(d, "account_id", "tenure", "event", COVS, BETA, m, base, ["contract"], (0.5, 0.75))


# ---------------------------------------------------------------- K31
PROFILE_VALUES = [0.5, 1.0, 2.0, 4.0]


@_reg("k31_covariate_profiles", "WITH " + _base_sql([]) + """, _v AS (SELECT * FROM (VALUES """ + ", ".join(
    f"({v}E0)" for v in PROFILE_VALUES) + """) v(value))
SELECT round(value, 6) AS value, t, round(exp(-cum_h0 * exp((value - (SELECT m3 FROM _mean)) * 0.4)), 6) AS survival FROM _base, _v""")
def k31_covariate_profiles(spark, sf):
    d, m, base = _baseline(spark, sf)
    return finish(cox.covariate_profiles(base, COVS, BETA, m, "mc", PROFILE_VALUES))


# ---------------------------------------------------------------- K23
@_reg("k23_concordance", "WITH " + CX + """, _pairs AS (SELECT a.ph AS ra, b.ph AS rb FROM _ph a JOIN _ph b
  ON a.event = 1 AND (b.tenure > a.tenure OR (b.tenure = a.tenure AND b.event = 0)))
SELECT round((SUM(CASE WHEN ra > rb THEN 1.0E0 ELSE 0.0E0 END) + 0.5 * SUM(CASE WHEN ra = rb THEN 1.0E0 ELSE 0.0E0 END)) / COUNT(*), 6) AS c_index,
  round(SUM(CASE WHEN ra > rb THEN 1.0E0 ELSE 0.0E0 END), 6) AS concordant, round(SUM(CASE WHEN ra = rb THEN 1.0E0 ELSE 0.0E0 END), 6) AS tied_risk,
  round(CAST(COUNT(*) AS DOUBLE), 6) AS comparable FROM _pairs""")
def k23_concordance(spark, sf):
    d = cox_subjects(spark, sf)
    ph = cox.partial_hazard(d, "account_id", COVS, BETA, _means(d))
    j = d.select("account_id", "tenure", "event").join(ph, "account_id")
    return finish(cox.concordance_index(j, "tenure", "event", "partial_hazard"))


# ---------------------------------------------------------------- K38 / K39 / K41 / D3
RES_SQL = "WITH " + _base_sql(["contract"]) + """, _r AS (SELECT p.account_id, p.contract, p.tenure, p.event, p.mc,
  p.event - b.cum_h0 * p.ph AS m FROM _ph p JOIN _base b ON p.contract = b.contract AND b.t = p.tenure),
_rd AS (SELECT *, sign(m) * sqrt(GREATEST(0.0, -2.0 * (m + CASE WHEN event > 0 THEN event * ln(event - m) ELSE 0.0 END))) AS dev FROM _r)"""


@_reg("k38_k39_residuals", RES_SQL + """
SELECT account_id, contract, tenure, event, round(m, 6) AS martingale, round(dev, 6) AS deviance FROM _rd""")
def k38_k39_residuals(spark, sf):
    d = cox_subjects(spark, sf)
    return finish(cox.martingale_residuals(d, "account_id", "tenure", "event", COVS, BETA, _means(d), ["contract"]))


@_reg("k38_mean_martingale", RES_SQL + " SELECT round(AVG(m), 6) + 0.0E0 AS mean_martingale, round(SUM(m), 6) + 0.0E0 AS sum_martingale FROM _rd")
def k38_mean_martingale(spark, sf):
    d = cox_subjects(spark, sf)
    r = cox.martingale_residuals(d, "account_id", "tenure", "event", COVS, BETA, _means(d), ["contract"])
    return finish(r.agg(F.avg("martingale").alias("mean_martingale"), F.sum("martingale").alias("sum_martingale")))


@_reg("k41_residual_outliers", RES_SQL + """
SELECT account_id, round(mc, 6) AS mc, round(m, 6) AS martingale, round(dev, 6) AS deviance FROM _rd
ORDER BY abs(dev) DESC, account_id LIMIT 15""")
def k41_residual_outliers(spark, sf):
    # D3 (join residuals to covariates by subject) + top-k listing (the limit is the report)
    d = cox_subjects(spark, sf)
    r = cox.martingale_residuals(d, "account_id", "tenure", "event", COVS, BETA, _means(d), ["contract"])
    j = r.join(d.select("account_id", "mc"), "account_id", "left")
    return finish(j.select("account_id", "mc", "martingale", "deviance")
                  .orderBy(F.desc(F.abs("deviance")), "account_id").limit(15))


# ---------------------------------------------------------------- K36 / C13
@_reg("k36_episodic_rows", """SELECT account_id, CAST(k AS DOUBLE) AS start, LEAST(CAST(k + 1 AS DOUBLE), CAST(tenure AS DOUBLE)) AS stop,
  CAST(CASE WHEN k = CAST(ceil(tenure / 1.0) AS INTEGER) - 1 THEN event ELSE 0 END AS INTEGER) AS event,
  round(total_charges, 6) AS total_charges, round(total_charges * LEAST(CAST(k + 1 AS DOUBLE), CAST(tenure AS DOUBLE)), 6) AS "tc_x_stop"
FROM (SELECT *, unnest(range(0, CAST(ceil(tenure / 1.0) AS INTEGER))) AS k FROM subj WHERE tenure > 0)""")
def k36_episodic_rows(spark, sf):
    s = subjects(spark, sf).select("account_id", "tenure", "event", "total_charges")
    e = cox.episodic(s, "account_id", "tenure", "event", 1.0)
    e = cox.interaction(e, "total_charges", "stop", "tc_x_stop")
    return finish(e.select("account_id", "start", "stop", "event", "total_charges", "tc_x_stop"))


@_reg("k36_episodic_count", "SELECT CAST(SUM(CAST(ceil(tenure / 1.0) AS BIGINT)) AS BIGINT) AS n_rows, CAST(SUM(event) AS BIGINT) AS n_events FROM subj WHERE tenure > 0")
def k36_episodic_count(spark, sf):
    s = subjects(spark, sf).select("account_id", "tenure", "event")
    e = cox.episodic(s, "account_id", "tenure", "event", 1.0)
    return e.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("event").cast("long").alias("n_events"))


# ---------------------------------------------------------------- fitted models (rows-only)
def _fit(spark, sf, strata=(), covs=None, ties="efron"):
    d = cox_subjects(spark, sf)
    return d, cox.cox_fit(d, "tenure", "event", covs or FIT_COVS, strata=strata, ties=ties)


@_reg("k19_k20_cox_summary")
def k19_k20_cox_summary(spark, sf):
    _, f = _fit(spark, sf)
    return finish(cox.summary(f, spark))


@_reg("k22_cox_fit_stats")
def k22_cox_fit_stats(spark, sf):
    _, f = _fit(spark, sf)
    return finish(cox.fit_stats(f, spark))


@_reg("k32_k33_ph_test")
def k32_k33_ph_test(spark, sf):
    d, f = _fit(spark, sf)
    t = cox.ph_test(d, "tenure", "event", f)
    return finish(t.withColumn("violates", F.col("p") < 0.05))


STRAT_COVS = ["senior", "partner_i", "dependents_i", "security_i", "mc"]


@_reg("k34_stratified_cox")
def k34_stratified_cox(spark, sf):
    _, f = _fit(spark, sf, strata=["contract"], covs=STRAT_COVS)
    return finish(cox.summary(f, spark))


# Nine two-valued strata at once, as the reference stratifies; the covariates are all others.
NINE_STRATA = ["contract_Two year", "contract_One year", "internet_service_ASIA", "partner_i", "dependents_i", "security_i", "senior",
               "payment_method_HOUSEHOLD", "payment_method_MACHINERY"]


@_reg("k34_nine_strata_cox")
def k34_nine_strata_cox(spark, sf):
    _, f = _fit(spark, sf, strata=NINE_STRATA, covs=[c for c in FIT_COVS if c not in NINE_STRATA])
    return finish(cox.summary(f, spark))


@_reg("k35_binned_stratum_cox")
def k35_binned_stratum_cox(spark, sf):
    d = cox_subjects(spark, sf)
    k, _, _ = cl.fixed_width_bins(F.col("total_charges"), 0.0, 9_000_000.0, 500_000.0)
    d = d.withColumn("tc_stratum", F.coalesce(k, F.lit(-1)))
    f = cox.cox_fit(d, "tenure", "event", STRAT_COVS, strata=["contract_Two year", "tc_stratum"])
    return finish(cox.summary(f, spark))


@_reg("k27_fitted_mean_expected_lifetime")
def k27_fitted_mean_expected_lifetime(spark, sf):
    d, f = _fit(spark, sf, strata=["contract"], covs=STRAT_COVS)
    base = cox.baseline_hazard(d, "tenure", "event", f.covariates, f.beta, f.means, ["contract"])
    e = cox.expected_lifetime(d, "account_id", f.covariates, f.beta, f.means, base, ["contract"])
    return finish(e.agg(F.avg("expected_lifetime").alias("mean_expected_lifetime")))


@_reg("k37_time_varying_cox")
def k37_time_varying_cox(spark, sf):
    s = cox_subjects(spark, sf)
    e = cox.episodic(s, "account_id", "tenure", "event", 1.0)
    e = cox.interaction(e, "total_charges", "stop", "tc_x_stop").withColumn("tc_x_stop", F.col("tc_x_stop") / 1e8)
    f = cox.cox_fit(e, "stop", "event", ["senior", "partner_i", "mc", "tc_x_stop"], strata=["contract"], start="start")
    return finish(cox.summary(f, spark))


@_reg("k40_delta_beta")
def k40_delta_beta(spark, sf):
    d, f = _fit(spark, sf, covs=["senior", "partner_i", "dependents_i", "mc"])
    return finish(cox.delta_beta(d, "account_id", "tenure", "event", f))

"""Registered survival queries (K1-K18, E15, C17) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenura.functions.stats import Z_95, chi2_sf_df1_sql
from tenura.operators import survival as sv
from tenura.plans.common import finish, shipments, subjects
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


# ---------------------------------------------------------------- SQL builders
def _g(groups, prefix=""):
    return "".join(f"{prefix}{g}, " for g in groups)


def _part(groups):
    return f"PARTITION BY {', '.join(groups)} " if groups else ""


def event_table_sql(src, dur, ev, groups):
    g = _g(groups)
    return f"""
_tc AS (SELECT {g}{dur} AS t, COUNT(*) AS removed, SUM({ev}) AS observed FROM {src} GROUP BY {g}{dur}),
_to AS (SELECT * FROM _tc UNION ALL SELECT DISTINCT {g}0, 0, 0 FROM _tc),
_te AS (SELECT {g}t, CAST(SUM(removed) AS BIGINT) AS removed, CAST(SUM(observed) AS BIGINT) AS observed FROM _to GROUP BY {g}t),
_ev AS (SELECT {g}t, removed, observed, removed - observed AS censored,
        CAST(CASE WHEN t = MIN(t) OVER ({_part(groups)}) THEN SUM(removed) OVER ({_part(groups)}) ELSE 0 END AS BIGINT) AS entrance,
        CAST(SUM(removed) OVER ({_part(groups)}ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS at_risk
        FROM _te)"""


def km_sql(src, dur, ev, groups):
    g = _g(groups)
    cum = f"({_part(groups)}ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return event_table_sql(src, dur, ev, groups) + f""",
_km0 AS (SELECT {g}t, at_risk, observed, censored,
         PRODUCT(1.0 - CAST(observed AS DOUBLE) / at_risk) OVER {cum} AS survival,
         SUM(CASE WHEN at_risk > observed THEN CAST(observed AS DOUBLE) / (CAST(at_risk AS DOUBLE) * (at_risk - observed)) ELSE 0.0 END) OVER {cum} AS greenwood
         FROM _ev),
_km AS (SELECT *,
        CASE WHEN survival > 0 AND survival < 1 THEN pow(survival, exp(-({Z_95} * sqrt(greenwood) / ln(survival))))
             WHEN survival = 1 THEN 1.0 END AS ci_lower,
        CASE WHEN survival > 0 AND survival < 1 THEN pow(survival, exp({Z_95} * sqrt(greenwood) / ln(survival)))
             WHEN survival = 1 THEN 1.0 END AS ci_upper
        FROM _km0)"""


def _km_select(groups):
    g = _g(groups)
    return (f"SELECT {g}t, at_risk, observed, censored, round(survival, 6) AS survival, round(ci_lower, 6) AS ci_lower, "
            f"round(ci_upper, 6) AS ci_upper, round(greenwood, 6) AS greenwood FROM _km")


def na_sql(src, dur, ev, groups):
    g = _g(groups)
    cum = f"({_part(groups)}ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return event_table_sql(src, dur, ev, groups) + f""",
_inc AS (SELECT {g}t, at_risk, observed,
         CASE WHEN observed > 0 THEN list_sum(list_transform(range(observed), lambda i: 1.0 / (at_risk - i))) ELSE 0.0 END AS dh,
         CASE WHEN observed > 0 THEN list_sum(list_transform(range(observed), lambda i: pow(1.0 / (at_risk - i), 2.0))) ELSE 0.0 END AS dv
         FROM _ev),
_na AS (SELECT {g}t, at_risk, observed, dh, SUM(dh) OVER {cum} AS cum_hazard, SUM(dv) OVER {cum} AS variance FROM _inc)"""


# ---------------------------------------------------------------- K1/K2/K7
@_reg("k01_km_by_contract", "WITH " + km_sql("subj", "tenure", "event", ["contract"]) + "\n" + _km_select(["contract"]))
def k01_km_by_contract(spark, sf):
    return finish(sv.kaplan_meier(subjects(spark, sf), "tenure", "event", ["contract"]))


@_reg("k01_km_all", "WITH " + km_sql("subj", "tenure", "event", []) + "\n" + _km_select([]))
def k01_km_all(spark, sf):
    return finish(sv.kaplan_meier(subjects(spark, sf), "tenure", "event"))


@_reg("k07_km_by_dependents", "WITH " + km_sql("subj", "tenure", "event", ["dependents"]) + "\n" + _km_select(["dependents"]))
def k07_km_by_dependents(spark, sf):
    return finish(sv.kaplan_meier(subjects(spark, sf), "tenure", "event", ["dependents"]))


@_reg("k01_km_shipments", "WITH " + km_sql("ship", "t", "e", []) + "\n" + _km_select([]))
def k01_km_shipments(spark, sf):
    return finish(sv.kaplan_meier(shipments(spark, sf), "t", "e"))


# ---------------------------------------------------------------- K3/K9
@_reg("k03_median_by_contract", "WITH " + km_sql("subj", "tenure", "event", ["contract"]) + """
, _lv AS (SELECT contract, MIN(CASE WHEN survival <= 0.5 THEN t END) AS t_level FROM _km GROUP BY contract)
SELECT contract, t_level, t_level - LAG(t_level) OVER (ORDER BY contract) AS diff_prev FROM _lv""")
def k03_median_by_contract(spark, sf):
    km = sv.kaplan_meier(subjects(spark, sf), "tenure", "event", ["contract"])
    return finish(sv.survival_at_level(km, 0.5, ["contract"]))


@_reg("k09_level75_by_internet", "WITH " + km_sql("subj", "tenure", "event", ["internet_service"]) + """
, _lv AS (SELECT internet_service, MIN(CASE WHEN survival <= 0.75 THEN t END) AS t_level FROM _km GROUP BY internet_service)
SELECT internet_service, t_level, t_level - LAG(t_level) OVER (ORDER BY internet_service) AS diff_prev FROM _lv""")
def k09_level75_by_internet(spark, sf):
    km = sv.kaplan_meier(subjects(spark, sf), "tenure", "event", ["internet_service"])
    return finish(sv.survival_at_level(km, 0.75, ["internet_service"]))


# ---------------------------------------------------------------- K4/K5/K6
@_reg("k04_event_table", "WITH " + event_table_sql("subj", "tenure", "event", []) +
      "\nSELECT t, removed, observed, censored, entrance, at_risk FROM _ev")
def k04_event_table(spark, sf):
    return sv.event_table(subjects(spark, sf), "tenure", "event")


@_reg("k05_life_table_head", "WITH " + event_table_sql("subj", "tenure", "event", []) +
      "\nSELECT t, removed, observed, censored, entrance, at_risk FROM _ev ORDER BY t LIMIT 20")
def k05_life_table_head(spark, sf):
    # the first-n rows are the feature of this report (reference prints a head)
    return sv.event_table(subjects(spark, sf), "tenure", "event").orderBy("t").limit(20)


TICKS = [0, 10, 20, 30, 40, 50, 60, 70]


@_reg("k06_at_risk_ticks",
      "SELECT v.tick, CAST((SELECT COUNT(*) FROM subj WHERE tenure >= v.tick) AS BIGINT) AS at_risk FROM (VALUES "
      + ", ".join(f"({t})" for t in TICKS) + ") v(tick)")
def k06_at_risk_ticks(spark, sf):
    return sv.at_risk_at_ticks(subjects(spark, sf), "tenure", TICKS)


# ---------------------------------------------------------------- K10/K11/K12
@_reg("k10_nelson_aalen_by_dependents", "WITH " + na_sql("subj", "tenure", "event", ["dependents"]) + f"""
SELECT dependents, t, at_risk, observed, round(dh, 6) AS dh, round(cum_hazard, 6) AS cum_hazard, round(variance, 6) AS variance,
  round(CASE WHEN cum_hazard > 0 THEN cum_hazard * exp(-{Z_95} * sqrt(variance) / cum_hazard) ELSE 0.0 END, 6) AS ci_lower,
  round(CASE WHEN cum_hazard > 0 THEN cum_hazard * exp({Z_95} * sqrt(variance) / cum_hazard) ELSE 0.0 END, 6) AS ci_upper
FROM _na""")
def k10_nelson_aalen_by_dependents(spark, sf):
    return finish(sv.nelson_aalen(subjects(spark, sf), "tenure", "event", ["dependents"]))


@_reg("k10_nelson_aalen_shipments", "WITH " + na_sql("ship", "t", "e", []) + """
SELECT t, at_risk, observed, round(dh, 6) AS dh, round(cum_hazard, 6) AS cum_hazard FROM _na""")
def k10_nelson_aalen_shipments(spark, sf):
    return finish(sv.nelson_aalen(shipments(spark, sf), "t", "e").select("t", "at_risk", "observed", "dh", "cum_hazard"))


@_reg("k12_smoothed_hazard_dependents", "WITH " + na_sql("subj", "tenure", "event", ["dependents"]) + """
SELECT g.dependents, g.t, round(COALESCE(SUM(0.75 * (1 - ((g.t - s.t) / 2.5) * ((g.t - s.t) / 2.5)) * s.dh), 0.0) / 2.5, 6) AS hazard
FROM _na g LEFT JOIN _na s ON g.dependents = s.dependents AND s.dh <> 0 AND abs(g.t - s.t) < 2.5
GROUP BY g.dependents, g.t""")
def k12_smoothed_hazard_dependents(spark, sf):
    return finish(sv.smoothed_hazard(subjects(spark, sf), "tenure", "event", 2.5, ["dependents"]))


# ---------------------------------------------------------------- K13/K14
def _logrank_sql(src, dur, ev, cond):
    return f"""WITH _lt AS (SELECT {dur} AS t, COUNT(*) AS r, SUM({ev}) AS d,
        SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS r1, SUM(CASE WHEN {cond} THEN {ev} ELSE 0 END) AS d1 FROM {src} GROUP BY {dur}),
_lp AS (SELECT t, CAST(d AS DOUBLE) AS d, CAST(d1 AS DOUBLE) AS d1,
        CAST(SUM(r) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS n,
        CAST(SUM(r1) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS n1 FROM _lt),
_ls AS (SELECT SUM(d1 - d * n1 / n) AS o_minus_e,
        SUM(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0.0 END) AS variance,
        CAST(SUM(d) AS BIGINT) AS total_events, CAST(SUM(d1) AS BIGINT) AS observed_a, SUM(d * n1 / n) AS expected_a FROM _lp),
_lc AS (SELECT *, o_minus_e * o_minus_e / variance AS chi2, o_minus_e / sqrt(variance) AS z FROM _ls)
SELECT total_events, observed_a, round(expected_a, 6) AS expected_a, round(o_minus_e, 6) AS o_minus_e,
  round(variance, 6) AS variance, round(chi2, 6) AS chi2, round({chi2_sf_df1_sql('chi2')}, 6) AS p_value,
  round(z, 6) AS z, round(exp(z * sqrt(4.0 / total_events)), 6) AS hazard_ratio,
  round(exp(chi2 * sqrt(4.0 / total_events)), 6) AS hazard_ratio_chi2_form FROM _lc"""


@_reg("k13_logrank_partner", _logrank_sql("subj", "tenure", "event", "partner = 'Yes'"))
def k13_logrank_partner(spark, sf):
    s = subjects(spark, sf)
    return finish(sv.logrank_two_sample(s, "tenure", "event", F.col("partner") == "Yes"))


@_reg("k13_logrank_shipments_bigqty", _logrank_sql("ship", "t", "e", "q > 25"))
def k13_logrank_shipments_bigqty(spark, sf):
    return finish(sv.logrank_two_sample(shipments(spark, sf), "t", "e", F.col("q") > 25))


# ---------------------------------------------------------------- K15
@_reg("k15_survival_difference_at_30", "WITH " + km_sql(
    "(SELECT *, CASE WHEN dependents = 'Yes' THEN 1 ELSE 0 END AS _g FROM subj)", "tenure", "event", ["_g"]) + f""",
_l AS (SELECT _g, arg_max(survival, t) AS s, arg_max(greenwood, t) AS v FROM _km WHERE t <= 30 GROUP BY _g),
_p AS (SELECT MAX(CASE WHEN _g = 1 THEN s END) AS s1, MAX(CASE WHEN _g = 1 THEN v END) AS v1,
              MAX(CASE WHEN _g = 0 THEN s END) AS s0, MAX(CASE WHEN _g = 0 THEN v END) AS v0 FROM _l),
_x AS (SELECT *, CASE WHEN s1 > 0 AND s1 < 1 AND s0 > 0 AND s0 < 1 THEN
        pow(ln(-ln(s1)) - ln(-ln(s0)), 2) / (v1 / (ln(s1) * ln(s1)) + v0 / (ln(s0) * ln(s0))) END AS chi2 FROM _p)
SELECT round(s1, 6) AS survival_a, round(s0, 6) AS survival_b, round(chi2, 6) AS chi2,
       round({chi2_sf_df1_sql('chi2')}, 6) AS p_value FROM _x""")
def k15_survival_difference_at_30(spark, sf):
    s = subjects(spark, sf)
    return finish(sv.survival_difference_at(s, "tenure", "event", F.col("dependents") == "Yes", 30))


# ---------------------------------------------------------------- K16
@_reg("k16_logrank_contract", """WITH _c AS (SELECT tenure AS t,
   SUM(CASE WHEN contract='Month-to-month' THEN 1 ELSE 0 END) AS r0, SUM(CASE WHEN contract='Month-to-month' THEN event ELSE 0 END) AS d0,
   SUM(CASE WHEN contract='One year' THEN 1 ELSE 0 END) AS r1, SUM(CASE WHEN contract='One year' THEN event ELSE 0 END) AS d1,
   SUM(CASE WHEN contract='Two year' THEN 1 ELSE 0 END) AS r2, SUM(CASE WHEN contract='Two year' THEN event ELSE 0 END) AS d2
   FROM subj GROUP BY tenure),
_w AS (SELECT t, CAST(d0 AS DOUBLE) d0, CAST(d1 AS DOUBLE) d1, CAST(d2 AS DOUBLE) d2,
   CAST(SUM(r0) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS n0,
   CAST(SUM(r1) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS n1,
   CAST(SUM(r2) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS n2 FROM _c),
_x AS (SELECT *, n0 + n1 + n2 AS n, d0 + d1 + d2 AS d FROM _w),
_f AS (SELECT *, CASE WHEN n > 1 THEN d * (n - d) / (n - 1) ELSE 0.0 END AS fac FROM _x),
_s AS (SELECT SUM(d0 - d * n0 / n) AS x0, SUM(d1 - d * n1 / n) AS x1,
   SUM(fac * (n0 / n) * (1 - n0 / n)) AS v00, SUM(fac * (n0 / n) * (0 - n1 / n)) AS v01, SUM(fac * (n1 / n) * (1 - n1 / n)) AS v11 FROM _f),
_r AS (SELECT (x0 * x0 * v11 - 2 * x0 * x1 * v01 + x1 * x1 * v00) / (v00 * v11 - v01 * v01) AS chi2 FROM _s)
SELECT round(chi2, 6) AS chi2, CAST(2 AS INTEGER) AS dof, round(exp(-chi2 / 2), 6) AS p_value FROM _r""")
def k16_logrank_contract(spark, sf):
    return finish(sv.logrank_k_sample(subjects(spark, sf), "tenure", "event", "contract"))


# ---------------------------------------------------------------- K17/K18/E15/C17
@_reg("k17_exponential_fit", """SELECT round(SUM(CAST(event AS DOUBLE)), 6) AS events, round(SUM(CAST(tenure AS DOUBLE)), 6) AS exposure,
  round(SUM(CAST(event AS DOUBLE)) / SUM(CAST(tenure AS DOUBLE)), 6) AS rate,
  round(SUM(CAST(tenure AS DOUBLE)) / SUM(CAST(event AS DOUBLE)), 6) AS mean_lifetime FROM subj""")
def k17_exponential_fit(spark, sf):
    return finish(sv.exponential_fit(subjects(spark, sf), "tenure", "event"))


@_reg("k18_weibull_fit")
def k18_weibull_fit(spark, sf):
    return finish(sv.weibull_fit(subjects(spark, sf), "tenure", "event"))


@_reg("e15_naive_mean_lifetime", """SELECT round(AVG(CAST(tenure AS DOUBLE)), 6) AS mean_duration,
  round(AVG(CASE WHEN event = 1 THEN CAST(tenure AS DOUBLE) END), 6) AS mean_event_duration,
  COUNT(*) AS n, COUNT(*) FILTER (WHERE event = 1) AS n_events FROM subj""")
def e15_naive_mean_lifetime(spark, sf):
    return finish(sv.naive_mean_lifetime(subjects(spark, sf), "tenure", "event"))


@_reg("c17_censor_at_24", """SELECT account_id, round(LEAST(CAST(tenure AS DOUBLE), 24.0), 6) AS duration,
  CAST(tenure < 24 AS INTEGER) AS event FROM subj""")
def c17_censor_at_24(spark, sf):
    return finish(sv.censor_at(subjects(spark, sf), "tenure", 24, id_col="account_id"))


# ---------------------------------------------------------------- streaming form of K1 (same oracle as k01_km_shipments)
@_reg("s01_streamed_km_shipments", "WITH " + km_sql("ship", "t", "e", []) + "\n" + _km_select([]))
def s01_streamed_km_shipments(spark, sf):
    from tenura.streaming.survival_stream import streamed_km
    return finish(streamed_km(spark, sf))

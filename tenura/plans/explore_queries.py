"""Registered profiling, cleaning and EDA queries (A, B, C, E, F, G) with oracles."""

from __future__ import annotations

import uuid

from itertools import combinations

from pyspark.sql import functions as F

from tenura.operators import clean as cl
from tenura.operators import eda
from tenura.operators import features as fe
from tenura.operators import profile as pr
from tenura.plans.common import finish, subjects
from tenura.plans.sqltext import with_base
from tenura.session import ensure_checkpoint_dir
from tenura.sources.panels import account_panel, clean_panel
from tenura.sources.tables import read_csv_with_schema

QUERIES = {}
SQL = {}


def _reg(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_base(sql)
        return fn
    return deco


PANEL_COLS = ["account_id", "senior", "partner", "dependents", "tenure", "payment_method", "internet_service",
              "online_security", "contract", "monthly_charges", "total_charges", "churn"]
PANEL_TYPES = ["bigint", "int", "string", "string", "int", "string", "string", "string", "string", "double",
               "string", "string"]
NUM = ["tenure", "monthly_charges", "total_charges"]
CATS = ["senior", "partner", "dependents", "payment_method", "internet_service", "online_security", "contract"]
HASH_SQL = "CAST(('0x' || substr(md5(CAST({k} AS VARCHAR) || '|' || '{seed}'), 1, 8)) AS BIGINT) / 4294967296.0"


# ---------------------------------------------------------------- A1/A2, B
@_reg("a1_panel_scan", "SELECT * FROM panel")
def a1_panel_scan(spark, sf):
    return finish(account_panel(spark, sf))


@_reg("a1_csv_scan", "SELECT * FROM panel")
def a1_csv_scan(spark, sf):
    """The panel written as CSV into the shared folder and read with its declared schema (blanks kept)."""
    panel = account_panel(spark, sf)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/panel-csv-{uuid.uuid4().hex}"
    (panel.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false")
     .option("ignoreTrailingWhiteSpace", "false").csv(path))
    return finish(read_csv_with_schema(spark, path, panel.schema))


@_reg("b01_shape", "SELECT COUNT(*) AS n_rows, 12 AS n_cols FROM panel")
def b01_shape(spark, sf):
    return pr.shape(account_panel(spark, sf))


def _info_sql(src):
    parts = []
    for i, (c, t) in enumerate(zip(PANEL_COLS, PANEL_TYPES)):
        parts.append(f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, COUNT({c}) AS non_null, "
                     f"COUNT(*) FILTER (WHERE {c} IS NULL) AS n_missing, COUNT(DISTINCT {c}) AS n_distinct FROM {src}")
    return " UNION ALL ".join(parts)


@_reg("b02_column_info", "WITH _nb AS (SELECT * REPLACE (CASE WHEN TRIM(total_charges) <> '' THEN total_charges END "
      "AS total_charges) FROM panel) " + _info_sql("_nb"))
def b02_column_info(spark, sf):
    return pr.column_info(cl.blank_to_null(account_panel(spark, sf), "total_charges"))


def _describe_sql(cols, digits):
    r = (lambda e: f"round({e}, {digits})") if digits is not None else (lambda e: f"round({e}, 6)")
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS feature, {r(f'CAST(COUNT({x}) AS DOUBLE)')} AS count, {r(f'AVG({x})')} AS mean, "
            f"{r(f'STDDEV_SAMP({x})')} AS std, {r(f'MIN({x})')} AS min, {r(f'quantile_cont({x}, 0.25)')} AS p25, "
            f"{r(f'quantile_cont({x}, 0.5)')} AS p50, {r(f'quantile_cont({x}, 0.75)')} AS p75, {r(f'MAX({x})')} AS max FROM cpanel")
    return " UNION ALL ".join(parts)


@_reg("b05_describe_numeric", _describe_sql(NUM, None))
def b05_describe_numeric(spark, sf):
    return finish(pr.describe(clean_panel(account_panel(spark, sf)), NUM))


@_reg("b06_variable_summary", _describe_sql(["senior"] + NUM, 3))
def b06_variable_summary(spark, sf):
    return finish(pr.describe(clean_panel(account_panel(spark, sf)), ["senior"] + NUM, digits=3))


@_reg("b07_value_counts_payment", "SELECT payment_method AS value, COUNT(*) AS n FROM panel GROUP BY payment_method")
def b07_value_counts_payment(spark, sf):
    return pr.value_counts(account_panel(spark, sf), "payment_method")


def _roles_sql():
    parts = []
    for c in PANEL_COLS:
        nd = f"COUNT(DISTINCT {c})"
        is_cat = f"({nd} < 6 AND '{c}' <> 'churn')"
        role = (f"CASE WHEN '{c}' = 'account_id' THEN 'id' WHEN {nd} = 2 THEN 'bin' WHEN {is_cat} THEN 'multi' "
                f"WHEN '{c}' = 'churn' THEN 'target' ELSE 'num' END")
        parts.append(f"SELECT '{c}' AS \"column\", {nd} AS n_distinct, {role} AS role, {is_cat} AS is_cat, "
                     f"({nd} = 2) AS is_bin FROM cpanel")
    return " UNION ALL ".join(parts)


@_reg("b08_column_roles", _roles_sql())
def b08_column_roles(spark, sf):
    return pr.column_roles(clean_panel(account_panel(spark, sf)), "account_id", "churn")


@_reg("b09_zscore_outliers", " UNION ALL ".join(
    f"SELECT account_id, '{c}' AS \"column\", round(z, 6) AS z FROM (SELECT account_id, "
    f"({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER () AS z FROM cpanel) WHERE abs(z) > 3.0" for c in NUM))
def b09_zscore_outliers(spark, sf):
    return finish(pr.zscore_outliers(clean_panel(account_panel(spark, sf)), "account_id", NUM, 3.0))


@_reg("b10_class_distribution", f"""WITH _s AS (SELECT churn, CASE WHEN {HASH_SQL.format(k='account_id', seed=42)} < 0.2
   THEN 'test' ELSE 'train' END AS split FROM cpanel)
SELECT split, churn AS label, COUNT(*) AS n FROM _s GROUP BY split, churn
UNION ALL SELECT 'all', churn, COUNT(*) FROM _s GROUP BY churn""")
def b10_class_distribution(spark, sf):
    d = fe.hash_split(clean_panel(account_panel(spark, sf)), "account_id", 42, 0.2)
    return pr.class_distribution(d, "churn", "split")


# ---------------------------------------------------------------- C
@_reg("c01_blank_rows", "SELECT * FROM panel WHERE TRIM(total_charges) = ''")
def c01_blank_rows(spark, sf):
    return finish(cl.blank_rows(account_panel(spark, sf), "total_charges"))


@_reg("c04_clean_cast", "SELECT * FROM cpanel")
def c04_clean_cast(spark, sf):
    p = account_panel(spark, sf)
    p = cl.to_double(cl.drop_null(cl.blank_to_null(p, "total_charges"), ["total_charges"]), ["total_charges"])
    return finish(p)


@_reg("c05_recode_no_service", """SELECT account_id, CASE WHEN online_security = 'No internet service' THEN 'No'
  ELSE online_security END AS online_security FROM panel""")
def c05_recode_no_service(spark, sf):
    p = account_panel(spark, sf).select("account_id", "online_security")
    return cl.recode(p, fe.NO_SERVICE_MAP, ["online_security"])


@_reg("c06_flag_label", "SELECT account_id, CASE WHEN senior = 1 THEN 'Yes' WHEN senior = 0 THEN 'No' END AS senior FROM panel")
def c06_flag_label(spark, sf):
    return cl.flag_to_label(account_panel(spark, sf).select("account_id", "senior"), "senior")


@_reg("c07_tenure_group", """SELECT account_id, tenure, CASE WHEN tenure <= 12 THEN 'Tenure_0-12' WHEN tenure <= 24 THEN 'Tenure_12-24'
  WHEN tenure <= 48 THEN 'Tenure_24-48' WHEN tenure <= 60 THEN 'Tenure_48-60' WHEN tenure > 60 THEN 'Tenure_gt_60' END AS tenure_group
  FROM panel""")
def c07_tenure_group(spark, sf):
    return account_panel(spark, sf).select("account_id", "tenure", cl.tenure_group(F.col("tenure")).alias("tenure_group"))


@_reg("c08_fixed_bins", """SELECT account_id, total_charges,
  CASE WHEN total_charges > 0 AND total_charges <= 9000000 THEN CAST(ceil(total_charges / 500000.0) AS INTEGER) END AS bin,
  CASE WHEN total_charges > 0 AND total_charges <= 9000000 THEN (ceil(total_charges / 500000.0) - 1) * 500000.0 END AS bin_lo,
  CASE WHEN total_charges > 0 AND total_charges <= 9000000 THEN ceil(total_charges / 500000.0) * 500000.0 END AS bin_hi
  FROM cpanel""")
def c08_fixed_bins(spark, sf):
    p = clean_panel(account_panel(spark, sf))
    k, lo, hi = cl.fixed_width_bins(F.col("total_charges"), 0.0, 9_000_000.0, 500_000.0)
    return finish(p.select("account_id", "total_charges", k.alias("bin"), lo.alias("bin_lo"), hi.alias("bin_hi")))


@_reg("c09_filter_churners", "SELECT account_id, tenure, contract FROM panel WHERE churn = 'Yes'")
def c09_filter_churners(spark, sf):
    return account_panel(spark, sf).where(F.col("churn") == "Yes").select("account_id", "tenure", "contract")


@_reg("c10_mask_and_negation", """SELECT 'dependents' AS side, COUNT(*) AS n, CAST(SUM(tenure) AS BIGINT) AS sum_tenure FROM subj WHERE dependents = 'Yes'
  UNION ALL SELECT 'no_dependents', COUNT(*), CAST(SUM(tenure) AS BIGINT) FROM subj WHERE NOT (dependents = 'Yes')""")
def c10_mask_and_negation(spark, sf):
    a, b = cl.split_by(subjects(spark, sf), F.col("dependents") == "Yes")
    agg = [F.count(F.lit(1)).alias("n"), F.sum("tenure").cast("long").alias("sum_tenure")]
    return (a.agg(*agg).select(F.lit("dependents").alias("side"), "n", "sum_tenure")
            .unionByName(b.agg(*agg).select(F.lit("no_dependents").alias("side"), "n", "sum_tenure")))


@_reg("c11_slice_drop_rename", "SELECT account_id AS id, tenure, contract AS plan FROM panel")
def c11_slice_drop_rename(spark, sf):
    p = account_panel(spark, sf).select("account_id", "tenure", "contract", "churn").drop("churn")
    return p.withColumnRenamed("account_id", "id").withColumnRenamed("contract", "plan")


@_reg("c12_c13_derived_columns", """SELECT account_id, CAST(CASE WHEN churn = 'Yes' THEN 1 WHEN churn = 'No' THEN 0 END AS INTEGER) AS churn_num,
  round(tenure * total_charges, 6) AS tenure_x_tc FROM cpanel""")
def c12_c13_derived_columns(spark, sf):
    p = clean_panel(account_panel(spark, sf))
    return finish(p.select("account_id", cl.yes_no_to_int(F.col("churn")).alias("churn_num"),
                           (F.col("tenure") * F.col("total_charges")).alias("tenure_x_tc")))


POSITIONS = [0, 1, 5, 10, 100, 1000]


@_reg("c14_positional_rows", f"""SELECT * FROM (SELECT account_id, tenure, CAST(ROW_NUMBER() OVER (ORDER BY account_id) - 1 AS BIGINT) AS pos
  FROM panel) WHERE pos IN ({', '.join(map(str, POSITIONS))}) OR (pos >= 20 AND pos < 30)""")
def c14_positional_rows(spark, sf):
    r = cl.positional_rows(account_panel(spark, sf).select("account_id", "tenure"), "account_id")
    return r.where(F.col("pos").isin(POSITIONS) | ((F.col("pos") >= 20) & (F.col("pos") < 30)))


@_reg("c15_dense_reindex", """SELECT account_id, CAST(ROW_NUMBER() OVER (ORDER BY account_id) - 1 AS BIGINT) AS pos FROM cpanel""")
def c15_dense_reindex(spark, sf):
    return cl.positional_rows(clean_panel(account_panel(spark, sf)).select("account_id"), "account_id")


@_reg("c16_seeded_sample", """SELECT account_id, tenure FROM panel ORDER BY md5(CAST(account_id AS VARCHAR) || '|' || '7'), account_id LIMIT 25""")
def c16_seeded_sample(spark, sf):
    return cl.seeded_sample(account_panel(spark, sf).select("account_id", "tenure"), "account_id", 25, 7)


@_reg("c18_scalar_math", """SELECT account_id, round(abs(monthly_charges - 100000), 6) AS abs_dev, round(exp(-tenure / 12.0), 6) AS decay,
  round(sqrt(total_charges), 6) AS sqrt_tc, round(monthly_charges, -3) AS mc_thousands,
  round(1.0 / (1.0 + exp(-(tenure - 24) / 6.0)), 6) AS sig, LEAST(tenure, 24) AS tenure_cap FROM cpanel""")
def c18_scalar_math(spark, sf):
    from tenura.functions.stats import sigmoid
    p = clean_panel(account_panel(spark, sf))
    return finish(p.select("account_id", F.abs(F.col("monthly_charges") - 100000).alias("abs_dev"),
                           F.exp(-F.col("tenure") / 12.0).alias("decay"), F.sqrt("total_charges").alias("sqrt_tc"),
                           F.round("monthly_charges", -3).alias("mc_thousands"),
                           sigmoid((F.col("tenure") - 24) / 6.0).alias("sig"),
                           F.least(F.col("tenure"), F.lit(24)).alias("tenure_cap")))


@_reg("c19_dummy_names", """SELECT DISTINCT 'contract' || '_' || contract AS dummy FROM panel
  UNION ALL SELECT DISTINCT 'internet_service' || '_' || internet_service FROM panel""")
def c19_dummy_names(spark, sf):
    p = account_panel(spark, sf)
    return (p.select(cl.dummy_name("contract", F.col("contract")).alias("dummy")).distinct()
            .unionByName(p.select(cl.dummy_name("internet_service", F.col("internet_service")).alias("dummy")).distinct()))


# ---------------------------------------------------------------- E
@_reg("e01_share_contract_churn", """SELECT contract AS value, churn AS target, COUNT(*) AS n,
  round(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 6) AS pct FROM cpanel GROUP BY contract, churn""")
def e01_share_contract_churn(spark, sf):
    return finish(eda.share_of_total(clean_panel(account_panel(spark, sf)), "contract", "churn"))


@_reg("e02_target_share", """SELECT churn AS target, COUNT(*) AS n, round(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 6) AS pct
  FROM cpanel GROUP BY churn""")
def e02_target_share(spark, sf):
    return finish(eda.target_share(clean_panel(account_panel(spark, sf)), "churn"))


def _melt_sql(cols, keep, src, vtype="VARCHAR"):
    return " UNION ALL ".join(f"SELECT {''.join(k + ', ' for k in keep)}'{c}' AS variable, CAST({c} AS {vtype}) AS value FROM {src}"
                              for c in cols)


@_reg("e03_category_by_class", f"""WITH _m AS ({_melt_sql(CATS, ['churn'], 'cpanel')})
SELECT variable, churn AS target, value, COUNT(*) AS n,
  round(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (PARTITION BY variable, churn), 6) AS pct FROM _m GROUP BY variable, churn, value""")
def e03_category_by_class(spark, sf):
    return finish(eda.category_by_class(clean_panel(account_panel(spark, sf)), CATS, "churn"))


HIST_W = {"tenure": 6.0, "monthly_charges": 50000.0, "total_charges": 500000.0}


@_reg("e04_histogram_by_class", "WITH _m AS (" + " UNION ALL ".join(
    f"SELECT churn AS target, '{c}' AS variable, floor(CAST({c} AS DOUBLE) / {w}) * {w} AS bin_lo FROM cpanel"
    for c, w in HIST_W.items()) + """)
SELECT variable, target, bin_lo, COUNT(*) AS n, round(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (PARTITION BY variable, target), 6) AS pct
FROM _m WHERE bin_lo IS NOT NULL GROUP BY variable, target, bin_lo""")
def e04_histogram_by_class(spark, sf):
    return finish(eda.histogram_by_class(clean_panel(account_panel(spark, sf)), HIST_W, "churn"))


def _kde_sql(col, groups, m=50):
    g = "".join(f"{x}, " for x in groups)
    on = " AND ".join(f"v.{x} = b.{x}" for x in groups)
    return f"""WITH _r AS (SELECT MIN(CAST({col} AS DOUBLE)) AS lo, MAX(CAST({col} AS DOUBLE)) AS hi FROM cpanel),
_v AS (SELECT {g}CAST({col} AS DOUBLE) AS v, COUNT(*) AS c FROM cpanel WHERE {col} IS NOT NULL GROUP BY {g}CAST({col} AS DOUBLE)),
_b AS (SELECT {g}COUNT(*) AS n_g, STDDEV_SAMP(CAST({col} AS DOUBLE)) * pow(CAST(COUNT(*) AS DOUBLE), -0.2) AS h
       FROM cpanel WHERE {col} IS NOT NULL GROUP BY {"ALL" if groups else "()"}),
_g AS (SELECT CAST(gi AS INTEGER) AS gi, lo + (hi - lo) * gi / {float(m - 1)} AS x FROM range(0, {m}) t(gi), _r)
SELECT {''.join('v.' + x + ', ' for x in groups)}_g.gi, round(_g.x, 6) AS x,
  round(SUM(v.c * exp(-0.5 * ((_g.x - v.v) / b.h) * ((_g.x - v.v) / b.h))) / (MIN(b.n_g) * MIN(b.h) * sqrt(2 * pi())), 6) AS density
FROM _v v JOIN _b b ON {on if groups else 'TRUE'} CROSS JOIN _g
GROUP BY {''.join('v.' + x + ', ' for x in groups)}_g.gi, _g.x"""


@_reg("e05_kde_monthly_by_churn", _kde_sql("monthly_charges", ["churn"]))
def e05_kde_monthly_by_churn(spark, sf):
    return finish(eda.kernel_density(clean_panel(account_panel(spark, sf)), "monthly_charges", ["churn"]))


@_reg("e06_kde_tenure_by_contract_churn", _kde_sql("tenure", ["contract", "churn"]))
def e06_kde_tenure_by_contract_churn(spark, sf):
    return finish(eda.kernel_density(clean_panel(account_panel(spark, sf)), "tenure", ["contract", "churn"]))


@_reg("e07_box_monthly_by_contract", """WITH _q AS (SELECT contract, quantile_cont(monthly_charges, 0.25) AS q1,
  quantile_cont(monthly_charges, 0.5) AS median, quantile_cont(monthly_charges, 0.75) AS q3 FROM cpanel GROUP BY contract),
_f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM _q)
SELECT p.contract, round(f.q1, 6) AS q1, round(f.median, 6) AS median, round(f.q3, 6) AS q3,
  round(MIN(CASE WHEN monthly_charges BETWEEN lo_f AND hi_f THEN monthly_charges END), 6) AS whisker_lo,
  round(MAX(CASE WHEN monthly_charges BETWEEN lo_f AND hi_f THEN monthly_charges END), 6) AS whisker_hi,
  COUNT(*) FILTER (WHERE NOT (monthly_charges BETWEEN lo_f AND hi_f)) AS n_outliers, COUNT(*) AS n
FROM cpanel p JOIN _f f ON p.contract = f.contract GROUP BY p.contract, f.q1, f.median, f.q3""")
def e07_box_monthly_by_contract(spark, sf):
    return finish(eda.box_stats(clean_panel(account_panel(spark, sf)), "monthly_charges", ["contract"]))


@_reg("e08_rate_by_facet", """SELECT contract AS facet, internet_service AS value, round(AVG(CAST(event AS DOUBLE)), 6) AS rate, COUNT(*) AS n,
  round(AVG(CAST(event AS DOUBLE)) - 1.959963984540054 * COALESCE(STDDEV_SAMP(CAST(event AS DOUBLE)), 0.0) / sqrt(CAST(COUNT(*) AS DOUBLE)), 6) AS lo,
  round(AVG(CAST(event AS DOUBLE)) + 1.959963984540054 * COALESCE(STDDEV_SAMP(CAST(event AS DOUBLE)), 0.0) / sqrt(CAST(COUNT(*) AS DOUBLE)), 6) AS hi
  FROM subj GROUP BY contract, internet_service""")
def e08_rate_by_facet(spark, sf):
    return finish(eda.rate_by_facet(subjects(spark, sf), "contract", "internet_service", F.col("event")))


MELT_COLS = ["partner", "dependents", "online_security"]


@_reg("e09_melt_counts_churners", f"""WITH _m AS ({_melt_sql(MELT_COLS, [], "(SELECT * FROM cpanel WHERE churn = 'Yes')")})
SELECT variable, value, COUNT(*) AS n FROM _m GROUP BY variable, value""")
def e09_melt_counts_churners(spark, sf):
    return eda.melt_counts(clean_panel(account_panel(spark, sf)), MELT_COLS, F.col("churn") == "Yes")


@_reg("e10_tenure_group_by_churn", """SELECT CASE WHEN tenure <= 12 THEN 'Tenure_0-12' WHEN tenure <= 24 THEN 'Tenure_12-24'
  WHEN tenure <= 48 THEN 'Tenure_24-48' WHEN tenure <= 60 THEN 'Tenure_48-60' WHEN tenure > 60 THEN 'Tenure_gt_60' END AS bucket,
  COUNT(*) FILTER (WHERE churn = 'No') AS "No", COUNT(*) FILTER (WHERE churn = 'Yes') AS "Yes" FROM cpanel GROUP BY 1""")
def e10_tenure_group_by_churn(spark, sf):
    return eda.counts_by_bucket(clean_panel(account_panel(spark, sf)), cl.tenure_group(F.col("tenure")), "churn", ["No", "Yes"])


@_reg("e11_binned_pairs", """SELECT churn AS "group", floor(tenure / 12.0) * 12.0 AS bx, floor(monthly_charges / 100000.0) * 100000.0 AS by,
  COUNT(*) AS n FROM cpanel GROUP BY 1, 2, 3""")
def e11_binned_pairs(spark, sf):
    return finish(eda.binned_pairs(clean_panel(account_panel(spark, sf)), "tenure", "monthly_charges", 12.0, 100000.0, "churn"))


SCATTER = {"tenure": 12.0, "monthly_charges": 100000.0, "total_charges": 500000.0}


@_reg("e11_scatter_matrix", " UNION ALL ".join(
    f"""SELECT '{x}' AS x, '{y}' AS y, churn AS "group", floor({x} / {SCATTER[x]}) * {SCATTER[x]} AS bx, floor({y} / {SCATTER[y]}) * {SCATTER[y]} AS by,
  COUNT(*) AS n FROM cpanel GROUP BY 3, 4, 5""" for x, y in combinations(SCATTER, 2)))
def e11_scatter_matrix(spark, sf):
    return finish(eda.binned_scatter_matrix(clean_panel(account_panel(spark, sf)), SCATTER, "churn"))


@_reg("e12_binary_ones_zeros", """WITH _e AS (SELECT senior, CASE WHEN partner = 'Yes' THEN 1 ELSE 0 END AS partner,
  CASE WHEN dependents = 'Yes' THEN 1 ELSE 0 END AS dependents FROM cpanel WHERE churn = 'Yes'),
_m AS (SELECT 'senior' AS variable, senior AS value FROM _e UNION ALL SELECT 'partner', partner FROM _e
  UNION ALL SELECT 'dependents', dependents FROM _e)
SELECT variable, CAST(SUM(value) AS BIGINT) AS ones, CAST(COUNT(value) - SUM(value) AS BIGINT) AS zeros FROM _m GROUP BY variable""")
def e12_binary_ones_zeros(spark, sf):
    p = clean_panel(account_panel(spark, sf)).where(F.col("churn") == "Yes")
    p = p.select("senior", cl.yes_no_to_int(F.col("partner")).alias("partner"),
                 cl.yes_no_to_int(F.col("dependents")).alias("dependents"))
    return eda.binary_ones_zeros(p, ["senior", "partner", "dependents"])


CORR_COLS = ["senior", "tenure", "monthly_charges", "total_charges", "event"]


def _corr_sql(cols, src):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
            r = f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 0 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, round({r}, 6) AS r FROM {src}")
    return " UNION ALL ".join(parts)


@_reg("e13_correlation_matrix", _corr_sql(CORR_COLS, "subj"))
def e13_correlation_matrix(spark, sf):
    return finish(eda.correlation_matrix(subjects(spark, sf), CORR_COLS))


FACT_COLS = ["contract", "internet_service", "payment_method", "partner"]
ALL_COLS = [*FACT_COLS, "senior", "dependents", "tenure", "online_security", "monthly_charges", "total_charges", "churn"]


def _fact_sql(cols):
    return "WITH " + ", ".join(
        f"_c{i} AS (SELECT {c} AS value, DENSE_RANK() OVER (ORDER BY MIN(account_id)) - 1 AS code FROM cpanel GROUP BY {c})"
        for i, c in enumerate(cols)) + ", _k AS (SELECT " + ", ".join(
        f"(SELECT code FROM _c{i} WHERE _c{i}.value = p.{c}) AS {c}" for i, c in enumerate(cols)) + " FROM cpanel p) " + _corr_sql(cols, "_k")


@_reg("e14_factorized_correlation_all", _fact_sql(ALL_COLS))
def e14_factorized_correlation_all(spark, sf):
    return finish(eda.factorized_correlation(clean_panel(account_panel(spark, sf)), ALL_COLS, "account_id"))


@_reg("e14_factorized_correlation", _fact_sql(FACT_COLS))
def e14_factorized_correlation(spark, sf):
    return finish(eda.factorized_correlation(clean_panel(account_panel(spark, sf)), FACT_COLS, "account_id"))


# ---------------------------------------------------------------- G (encoding)
@_reg("g01_g02_encoded_panel", """SELECT account_id, senior,
  CASE WHEN partner = 'No' THEN 0 WHEN partner = 'Yes' THEN 1 END AS partner,
  CASE WHEN dependents = 'No' THEN 0 WHEN dependents = 'Yes' THEN 1 END AS dependents, tenure,
  CASE WHEN online_security IN ('No', 'No internet service') THEN 0 WHEN online_security = 'Yes' THEN 1 END AS online_security,
  round(monthly_charges, 6) AS monthly_charges, round(total_charges, 6) AS total_charges,
  CASE WHEN churn = 'No' THEN 0 WHEN churn = 'Yes' THEN 1 END AS churn,
  CAST(payment_method = 'AUTOMOBILE' AS INTEGER) AS payment_method_AUTOMOBILE, CAST(payment_method = 'BUILDING' AS INTEGER) AS payment_method_BUILDING,
  CAST(payment_method = 'FURNITURE' AS INTEGER) AS payment_method_FURNITURE, CAST(payment_method = 'HOUSEHOLD' AS INTEGER) AS payment_method_HOUSEHOLD,
  CAST(payment_method = 'MACHINERY' AS INTEGER) AS payment_method_MACHINERY,
  CAST(internet_service = 'AFRICA' AS INTEGER) AS internet_service_AFRICA, CAST(internet_service = 'AMERICA' AS INTEGER) AS internet_service_AMERICA,
  CAST(internet_service = 'ASIA' AS INTEGER) AS internet_service_ASIA, CAST(internet_service = 'EUROPE' AS INTEGER) AS internet_service_EUROPE,
  CAST(internet_service = 'MIDDLE EAST' AS INTEGER) AS "internet_service_MIDDLE EAST",
  CAST(contract = 'Month-to-month' AS INTEGER) AS "contract_Month-to-month", CAST(contract = 'One year' AS INTEGER) AS "contract_One year",
  CAST(contract = 'Two year' AS INTEGER) AS "contract_Two year"
  FROM cpanel""")
def g01_g02_encoded_panel(spark, sf):
    d, _ = fe.panel_features(clean_panel(account_panel(spark, sf)))
    return finish(d)


@_reg("g03_drop_reference_level", """SELECT account_id, CAST(contract = 'One year' AS INTEGER) AS "contract_One year",
  CAST(contract = 'Two year' AS INTEGER) AS "contract_Two year" FROM cpanel""")
def g03_drop_reference_level(spark, sf):
    p = clean_panel(account_panel(spark, sf)).select("account_id", "contract")
    return fe.one_hot(p, ["contract"], drop_first={"contract": "Month-to-month"})


@_reg("g04_standardize", """SELECT account_id, round((tenure - AVG(tenure) OVER ()) / STDDEV_POP(tenure) OVER (), 6) AS tenure_z,
  round((monthly_charges - AVG(monthly_charges) OVER ()) / STDDEV_POP(monthly_charges) OVER (), 6) AS monthly_charges_z FROM cpanel""")
def g04_standardize(spark, sf):
    p = clean_panel(account_panel(spark, sf)).select("account_id", "tenure", "monthly_charges")
    return finish(fe.standardize(p, ["tenure", "monthly_charges"], "_z").select("account_id", "tenure_z", "monthly_charges_z"))


@_reg("g05_hash_split", f"""SELECT account_id, CASE WHEN {HASH_SQL.format(k='account_id', seed=42)} < 0.2 THEN 'test' ELSE 'train' END AS split
  FROM cpanel""")
def g05_hash_split(spark, sf):
    return fe.hash_split(clean_panel(account_panel(spark, sf)).select("account_id"), "account_id", 42, 0.2)


@_reg("f03_quantile_position", """SELECT account_id, round((RANK() OVER (ORDER BY monthly_charges) - 1) / CAST(COUNT(*) OVER () AS DOUBLE), 6) AS q
  FROM cpanel""")
def f03_quantile_position(spark, sf):
    from tenura.operators.windows import quantile_position
    return finish(quantile_position(clean_panel(account_panel(spark, sf)), "account_id", "monthly_charges"))


@_reg("f05_f06_top_accounts", """SELECT account_id, monthly_charges FROM cpanel ORDER BY monthly_charges DESC, account_id LIMIT 10""")
def f05_f06_top_accounts(spark, sf):
    # top-k report: the limit is the feature
    return finish(clean_panel(account_panel(spark, sf)).select("account_id", "monthly_charges")
                  .orderBy(F.desc("monthly_charges"), "account_id").limit(10))


@_reg("f07_argmax_argmin", """SELECT arg_max(account_id, monthly_charges) AS id_max, arg_min(account_id, monthly_charges) AS id_min FROM
  (SELECT * FROM cpanel WHERE monthly_charges = (SELECT MAX(monthly_charges) FROM cpanel) OR monthly_charges = (SELECT MIN(monthly_charges) FROM cpanel))""")
def f07_argmax_argmin(spark, sf):
    p = clean_panel(account_panel(spark, sf))
    return p.agg(F.max_by("account_id", "monthly_charges").alias("id_max"), F.min_by("account_id", "monthly_charges").alias("id_min"))


@_reg("g08_vif")
def g08_vif(spark, sf):
    d, feats = fe.panel_features(clean_panel(account_panel(spark, sf)))
    return finish(fe.vif(d, feats))


# ---------------------------------------------------------------- A2, D2, F4
@_reg("a2_raw_beside_clean", """SELECT p.account_id, p.total_charges AS total_charges_raw, round(c.total_charges, 6) AS total_charges
  FROM panel p LEFT JOIN cpanel c ON p.account_id = c.account_id""")
def a2_raw_beside_clean(spark, sf):
    raw = account_panel(spark, sf)
    cleaned = clean_panel(raw)
    return finish(raw.select("account_id", F.col("total_charges").alias("total_charges_raw"))
                  .join(cleaned.select("account_id", "total_charges"), "account_id", "left"))


@_reg("d02_scaled_join_back", """WITH _z AS (SELECT account_id, (monthly_charges - AVG(monthly_charges) OVER ()) / STDDEV_POP(monthly_charges) OVER () AS z
  FROM cpanel) SELECT c.account_id, c.contract, round(_z.z, 6) AS monthly_charges_z FROM cpanel c LEFT JOIN _z ON c.account_id = _z.account_id""")
def d02_scaled_join_back(spark, sf):
    c = clean_panel(account_panel(spark, sf))
    z = fe.standardize(c.select("account_id", "monthly_charges"), ["monthly_charges"], "_z").select("account_id", "monthly_charges_z")
    return finish(c.select("account_id", "contract").join(z, "account_id", "left"))


@_reg("f04_event_time_rank", """SELECT tenure, CAST(DENSE_RANK() OVER (ORDER BY tenure) AS BIGINT) AS rank
  FROM (SELECT DISTINCT tenure FROM subj WHERE event = 1)""")
def f04_event_time_rank(spark, sf):
    from tenura.operators.windows import dense_time_rank
    return dense_time_rank(subjects(spark, sf).where(F.col("event") == 1), "tenure")

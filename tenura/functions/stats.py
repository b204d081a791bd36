"""Statistical column functions that stay inside the JVM.

Spark has no ``erfc`` or chi-square tail; both are expressed here as
plain column arithmetic so p-values are computed where the statistic is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-sided 95% normal quantile.
Z_95 = 1.959963984540054

# Chebyshev fit of erfc (Numerical Recipes "erfcc"), fractional error < 1.2e-7.
ERFC_COEFFS = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
               0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def z_quantile(confidence: float) -> float:
    """Two-sided normal quantile for ``confidence`` via bisection on erfc."""
    if abs(confidence - 0.95) < 1e-12:
        return Z_95
    target = 1.0 - confidence
    lo, hi = 0.0, 10.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if math.erfc(mid / math.sqrt(2)) > target:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def erfc_col(x: Column) -> Column:
    ax = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * ax)
    poly = F.lit(ERFC_COEFFS[-1])
    for c in reversed(ERFC_COEFFS[:-1]):
        poly = F.lit(c) + t * poly
    ans = t * F.exp(-ax * ax + poly)
    return F.when(x >= 0, ans).otherwise(F.lit(2.0) - ans)


def erfc_sql(x: str) -> str:
    """Same approximation as SQL text (DuckDB and Spark SQL)."""
    t = f"(1.0/(1.0+0.5*abs({x})))"
    poly = f"({ERFC_COEFFS[-1]})"
    for c in reversed(ERFC_COEFFS[:-1]):
        poly = f"({c}+{t}*{poly})"
    ans = f"({t}*exp(-abs({x})*abs({x})+{poly}))"
    return f"(CASE WHEN {x} >= 0 THEN {ans} ELSE 2.0-{ans} END)"


def chi2_sf_df1(chi2: Column) -> Column:
    """P(X > chi2) for one degree of freedom = erfc(sqrt(chi2/2))."""
    return erfc_col(F.sqrt(chi2 / 2.0))


def chi2_sf_df1_sql(chi2: str) -> str:
    return erfc_sql(f"sqrt(({chi2})/2.0)")


def chi2_sf(x: Column, df: Column) -> Column:
    """Upper tail of chi-square with integer ``df`` >= 1 (closed forms).

    even df=2m: exp(-x/2) * sum_{i<m} (x/2)^i / i!
    odd  df=2m+1: erfc(sqrt(x/2)) + exp(-x/2) * sum_{i=1..m} (x/2)^(i-1/2) / Gamma(i+1/2)
    """
    h = x / 2.0
    m_even = (df / 2).cast("int")
    even_terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(m_even - 1, F.lit(0))),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("acc")),
        lambda s, i: F.struct((s["term"] * h / i).alias("term"), (s["acc"] + s["term"] * h / i).alias("acc")),
    )["acc"]
    even_terms = F.when(m_even - 1 >= 1, even_terms).otherwise(F.lit(1.0))
    m_odd = ((df - 1) / 2).cast("int")
    first = F.sqrt(h) / (F.lit(math.sqrt(math.pi)) / 2.0)
    odd_terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(m_odd, F.lit(1))),
        F.struct(first.alias("term"), F.lit(0.0).alias("acc")),
        lambda s, i: F.struct((s["term"] * h / (i + 0.5)).alias("term"), (s["acc"] + s["term"]).alias("acc")),
    )["acc"]
    odd_terms = F.when(m_odd >= 1, odd_terms).otherwise(F.lit(0.0))
    even = F.exp(-h) * even_terms
    odd = erfc_col(F.sqrt(h)) + F.exp(-h) * odd_terms
    return F.when(df % 2 == 0, even).otherwise(odd)


#: Tied events up to this many are summed term by term; more in closed form.
FEW_TIES = 64
_LOOSE = 16  # smallest terms summed one by one before the Euler-Maclaurin tail


def reciprocal_sums_sql(a: str, d: str) -> tuple[str, str, str]:
    """SQL for the sums of 1/m, 1/m^2 and ln(m) over m = a-d+1, ..., a (a real,
    d > FEW_TIES): the smallest terms one by one, the rest by Euler-Maclaurin,
    so the work does not grow with d."""
    y = f"({a} - {d} + {_LOOSE + 1})"
    loose = (f"aggregate(sequence(0, {_LOOSE - 1}), named_struct('p', 0e0, 'q', 0e0, 'r', 0e0), (s, i) -> named_struct("
             f"'p', s.p + 1e0 / ({a} - {d} + 1 + i), 'q', s.q + 1e0 / pow({a} - {d} + 1 + i, 2), "
             f"'r', s.r + ln({a} - {d} + 1 + i)))")

    def gap(n):
        return f"(1e0 / pow({y}, {n}) - 1e0 / pow({a}, {n}))"
    one = (f"{loose}.p - ln({y} / {a}) + (1e0 / {y} + 1e0 / {a}) / 2 + {gap(2)} / 12 - {gap(4)} / 120 + {gap(6)} / 252")
    two = f"{loose}.q + {gap(1)} + (1e0 / pow({y}, 2) + 1e0 / pow({a}, 2)) / 2 + {gap(3)} / 6 - {gap(5)} / 30 + {gap(7)} / 42"
    log = (f"{loose}.r + {a} * ln({a}) - {y} * ln({y}) - ({a} - {y}) + (ln({a}) + ln({y})) / 2 - {gap(1)} / 12 "
           f"+ {gap(3)} / 360 - {gap(5)} / 1260")
    return f"({one})", f"({two})", f"({log})"


def tie_sum_sql(n: str, d: str, power: int) -> str:
    """SQL for the sum of 1/(n-i)^power over i = 0..d-1 (0 when d = 0)."""
    n, d = f"CAST({n} AS DOUBLE)", f"CAST({d} AS BIGINT)"
    loop = f"aggregate(sequence(0L, {d} - 1L), 0e0, (s, i) -> s + 1e0 / pow({n} - i, {power}))"
    return (f"CASE WHEN {d} <= 0 THEN 0e0 WHEN {d} <= {FEW_TIES} THEN {loop} "
            f"ELSE {reciprocal_sums_sql(n, d)[power - 1]} END")


def efron_sums_sql(r: str, b: str, d: str) -> str:
    """SQL struct of the Efron sums over l = 0..d-1, with c = l/d and den = r - c b:
    A = 1/den, B = c/den, C = 1/den^2, D = c/den^2, E = (c/den)^2, L = ln(den).

    Few ties are summed one by one.  Many are summed by the tail of a reciprocal
    series where the tied part b is a large share of r, else by the power series
    in b/r, whose power sums of c have closed forms; neither cancels."""
    c = f"(CAST(l AS DOUBLE) / {d})"
    den = f"({r} - {c} * {b})"
    zero = "named_struct('A', 0e0, 'B', 0e0, 'C', 0e0, 'D', 0e0, 'E', 0e0, 'L', 0e0)"
    loop = (f"aggregate(sequence(0L, CAST({d} AS BIGINT) - 1L), {zero}, (s, l) -> named_struct("
            f"'A', s.A + 1e0 / {den}, 'B', s.B + {c} / {den}, 'C', s.C + 1e0 / ({den} * {den}), "
            f"'D', s.D + {c} / ({den} * {den}), 'E', s.E + {c} * {c} / ({den} * {den}), 'L', s.L + ln({den})))")
    x, n = f"(CAST({d} AS DOUBLE) * {r} / {b})", f"CAST({d} AS DOUBLE)"
    p, q, g = reciprocal_sums_sql(x, n)
    closed = (f"named_struct('A', {n} / {b} * {p}, 'B', ({x} * {p} - {n}) / {b}, 'C', pow({n} / {b}, 2) * {q}, "
              f"'D', {n} / ({b} * {b}) * ({x} * {q} - {p}), 'E', ({x} * {x} * {q} - 2 * {x} * {p} + {n}) / ({b} * {b}), "
              f"'L', {n} * ln({b} / {n}) + {g})")

    def power_sum(k):  # of c^k over l < d
        # each correction is the difference of a derivative at both ends, 0 where it is constant
        return (f"(CASE WHEN {k} = 0 THEN {n} ELSE {n} / ({k} + 1) - 0.5e0 + CASE WHEN {k} > 1 THEN {k} / (12 * {n}) ELSE 0e0 END "
                f"- CASE WHEN {k} > 3 THEN CAST({k} AS DOUBLE) * ({k} - 1) * ({k} - 2) / (720 * pow({n}, 3)) ELSE 0e0 END "
                f"+ CASE WHEN {k} > 5 THEN CAST({k} AS DOUBLE) * ({k} - 1) * ({k} - 2) * ({k} - 3) * ({k} - 4) "
                f"/ (30240 * pow({n}, 5)) ELSE 0e0 END END)")
    u = f"({b} / {r})"
    series = (f"aggregate(sequence(0, 48), {zero}, (s, i) -> named_struct("
              f"'A', s.A + pow({u}, i) * {power_sum('i')} / {r}, 'B', s.B + pow({u}, i) * {power_sum('(i + 1)')} / {r}, "
              f"'C', s.C + (i + 1) * pow({u}, i) * {power_sum('i')} / ({r} * {r}), "
              f"'D', s.D + (i + 1) * pow({u}, i) * {power_sum('(i + 1)')} / ({r} * {r}), "
              f"'E', s.E + (i + 1) * pow({u}, i) * {power_sum('(i + 2)')} / ({r} * {r}), "
              f"'L', s.L + CASE WHEN i = 0 THEN {n} * ln({r}) ELSE -pow({u}, i) / i * {power_sum('i')} END))")
    return (f"CASE WHEN {d} <= 0 THEN {zero} WHEN {d} <= {FEW_TIES} THEN {loop} "
            f"WHEN {b} >= 0.5e0 * {r} THEN {closed} ELSE {series} END")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson r as an aggregate that is NULL (not an ANSI divide-by-zero
    error) when either column is constant in the group."""
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when(sa * sb > 0, F.covar_pop(a, b) / (sa * sb))

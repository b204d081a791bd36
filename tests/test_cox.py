"""Cox fit against a brute-force numpy Efron likelihood maximised by Newton."""
import numpy as np
import pytest

from tenura.operators import cox


def efron_loglik(beta, X, T, E, strata=None):
    strata = np.zeros(len(T)) if strata is None else strata
    ll = 0.0
    for s in np.unique(strata):
        m = strata == s
        Xs, Ts, Es = X[m], T[m], E[m]
        xb = Xs @ beta
        w = np.exp(xb)
        for t in np.unique(Ts[Es == 1]):
            D = (Ts == t) & (Es == 1)
            R = Ts >= t
            d = D.sum()
            r0, d0 = w[R].sum(), w[D].sum()
            ll += xb[D].sum()
            for l in range(d):
                ll -= np.log(r0 - l / d * d0)
    return ll


def num_grad_hess(f, b, h=1e-5):
    p = len(b)
    g = np.zeros(p)
    H = np.zeros((p, p))
    for i in range(p):
        e = np.zeros(p); e[i] = h
        g[i] = (f(b + e) - f(b - e)) / (2 * h)
        for j in range(p):
            e2 = np.zeros(p); e2[j] = h
            H[i, j] = (f(b + e + e2) - f(b + e - e2) - f(b - e + e2) + f(b - e - e2)) / (4 * h * h)
    return g, H


def brute_fit(X, T, E, strata=None):
    b = np.zeros(X.shape[1])
    f = lambda bb: efron_loglik(bb, X, T, E, strata)
    for _ in range(30):
        g, H = num_grad_hess(f, b)
        step = np.linalg.solve(H, g)
        b = b - step
        if np.abs(step).max() < 1e-9:
            break
    return b, f(b)


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(7)
    n = 120
    x1 = rng.normal(size=n)
    x2 = rng.integers(0, 2, size=n).astype(float)
    g = rng.integers(0, 2, size=n)
    T = np.ceil(rng.exponential(10 * np.exp(-0.5 * x1 + 0.3 * x2))).astype(int)  # ties on purpose
    E = (rng.random(n) < 0.7).astype(int)
    rows = [(i, int(T[i]), int(E[i]), float(x1[i]), float(x2[i]), int(g[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, t int, e int, x1 double, x2 double, g int")
    return df, np.column_stack([x1, x2]), T, E, g


def test_efron_matches_bruteforce(small):
    df, X, T, E, _ = small
    fit = cox.cox_fit(df, "t", "e", ["x1", "x2"])
    b, ll = brute_fit(X, T, E)
    assert np.allclose(fit.beta, b, atol=1e-5)
    assert abs(fit.loglik - ll) < 1e-6


def test_stratified_matches_bruteforce(small):
    df, X, T, E, g = small
    fit = cox.cox_fit(df, "t", "e", ["x1", "x2"], strata=["g"])
    b, ll = brute_fit(X, T, E, g)
    assert np.allclose(fit.beta, b, atol=1e-5)
    assert abs(fit.loglik - ll) < 1e-6


def test_many_strata_columns_are_one_stratum_each_combination(small):
    from pyspark.sql import functions as F
    df, X, T, E, g = small
    df = df.withColumn("odd", F.col("id") % 2).withColumn("third", F.when(F.col("id") % 3 > 0, F.col("id") % 3))  # a null level
    fit = cox.cox_fit(df, "t", "e", ["x1", "x2"], strata=["g", "odd", "third"])
    i = np.arange(len(T))
    b, ll = brute_fit(X, T, E, g * 6 + i % 2 * 3 + i % 3)
    assert np.allclose(fit.beta, b, atol=1e-5)
    assert abs(fit.loglik - ll) < 1e-6


def test_counting_process_equals_plain(small, spark):
    """Episodic (start, stop] rows with constant covariates give the same fit."""
    df, *_ = small
    plain = cox.cox_fit(df, "t", "e", ["x1", "x2"])
    ep = cox.episodic(df, "id", "t", "e", 1.0)
    tv = cox.cox_fit(ep, "stop", "e", ["x1", "x2"], start="start")
    assert np.allclose(plain.beta, tv.beta, atol=1e-6)


def test_martingale_sum_zero(small):
    df, *_ = small
    fit = cox.cox_fit(df, "t", "e", ["x1", "x2"], ties="breslow")
    r = cox.martingale_residuals(df, "id", "t", "e", fit.covariates, fit.beta, fit.means)
    s = r.agg({"martingale": "sum"}).first()[0]
    assert abs(s) < 1e-6


def test_concordance_bruteforce(small):
    df, X, T, E, _ = small
    from pyspark.sql import functions as F
    d = df.withColumn("risk", F.round(F.col("x1"), 1))
    c = cox.concordance_index(d, "t", "e", "risk").first()
    r = np.round(X[:, 0], 1)
    num = den = 0.0
    for i in range(len(T)):
        if E[i] != 1:
            continue
        for j in range(len(T)):
            if T[j] > T[i] or (T[j] == T[i] and E[j] == 0):
                den += 1
                num += 1.0 if r[i] > r[j] else (0.5 if r[i] == r[j] else 0.0)
    assert abs(c["c_index"] - num / den) < 1e-12


def test_concordance_with_many_times(spark):
    """No bound on distinct event times: 20,000 of them against a sorted count."""
    rng = np.random.default_rng(11)
    n = 20000
    T, E, R = rng.permutation(n).astype(float), rng.random(n) < 0.6, np.round(rng.normal(size=n), 2)
    df = spark.createDataFrame([(float(t), int(e), float(r)) for t, e, r in zip(T, E, R)], "t double, e int, r double")
    c = cox.concordance_index(df, "t", "e", "r").first()
    order = np.argsort(-T)
    seen, conc, ties, pairs = np.zeros(2001), 0, 0, 0
    code = np.round(R * 100).astype(int)
    code -= code.min()
    for k in order:  # from the latest time: everything seen is comparable to an event
        if E[k]:
            conc += seen[:code[k]].sum()
            ties += seen[code[k]]
            pairs += seen.sum()
        seen[code[k]] += 1
    assert (c["concordant"], c["tied_risk"], c["comparable"]) == (conc, ties, pairs)


def brute_scores(X, T, E, beta):
    """Score residuals from Efron's definition, one tied event after the other."""
    w, n = np.exp((X - X.mean(0)) @ beta), len(T)
    L = np.zeros(X.shape)
    for t in np.unique(T[E == 1]):
        at, tied = T >= t, (T == t) & (E == 1)
        d = tied.sum()
        for k in range(d):
            part = np.where(tied, 1 - k / d, 1.0) * at * w
            mean = part @ X / part.sum()
            L += np.where(tied, 1 / d, 0.0)[:, None] * (X - mean) - part[:, None] * (X - mean) / part.sum()
    assert n
    return L


@pytest.fixture(scope="module")
def fitted(small):
    df, X, T, E, _ = small
    return df, X, T, E, cox.cox_fit(df, "t", "e", ["x1", "x2"])


def test_score_residuals_are_those_of_the_fit(fitted):
    df, X, T, E, fit = fitted
    rows = cox.score_residuals(df, "id", "t", "e", fit.covariates, fit.beta, fit.means).orderBy("id").collect()
    got = np.array([[r["L0"], r["L1"]] for r in rows])
    assert np.allclose(got, brute_scores(X, T, E, fit.beta), atol=1e-8)
    assert np.abs(got.sum(0)).max() < 1e-5  # the gradient at the maximum


def test_delta_beta_approximates_leaving_one_out(fitted):
    df, X, T, E, fit = fitted
    rows = cox.delta_beta(df, "id", "t", "e", fit).collect()
    got = {(r["id"], r["covariate"]): r["delta_beta"] for r in rows}
    for i in (3, 50):
        keep = np.arange(len(T)) != i
        b, _ = brute_fit(X[keep], T[keep], E[keep])
        for k, c in enumerate(fit.covariates):
            assert abs(got[i, c] - (fit.beta[k] - b[k])) < 0.15 * fit.se[k]


def test_ph_test_bruteforce(fitted):
    df, X, T, E, fit = fitted
    w = np.exp((X - X.mean(0)) @ fit.beta)
    times = np.sort(T[E == 1])
    g = np.array([(np.searchsorted(times, t) + np.searchsorted(times, t, "right") + 1) / 2 for t in T])
    m, S, sgg = int(E.sum()), np.zeros(2), 0.0
    for i in np.flatnonzero(E == 1):
        at, tied = T >= T[i], (T == T[i]) & (E == 1)
        d = tied.sum()
        mean = np.mean([(p := np.where(tied, 1 - k / d, 1.0) * at * w) @ X / p.sum() for k in range(d)], axis=0)
        S += (g[i] - (m + 1) / 2) * (X[i] - mean)
        sgg += (g[i] - (m + 1) / 2) ** 2
    want = {c: (m * fit.cov @ S)[k] ** 2 / (m * fit.cov[k, k] * sgg) for k, c in enumerate(fit.covariates)}
    got = {r["covariate"]: r["chi2"] for r in cox.ph_test(df, "t", "e", fit).collect()}
    assert got == pytest.approx(want, rel=1e-8)


def test_fit_that_cannot_converge_says_so(small):
    df, *_ = small
    with pytest.raises(RuntimeError, match="converge"):
        cox.cox_fit(df, "t", "e", ["x1", "x2"], max_iter=1, tol=1e-30)


def test_tie_sums_in_closed_form(spark):
    from pyspark.sql import functions as F

    from tenura.functions import stats
    pairs = ((10.0, 10.0), (10.0, 9.0), (10.0, 4.99), (10.0, 1.0), (1e6, 2.0), (123.4, 0.01))
    rows = [(r, b, d) for d in (1, 64, 65, 1000, 10000) for r, b in pairs]
    df = spark.createDataFrame(rows, "r double, b double, d long").select("*", F.expr(stats.efron_sums_sql("r", "b", "d")).alias("s"))
    for x in df.select("r", "b", "d", "s.*").collect():
        c = np.arange(x["d"], dtype=np.longdouble) / x["d"]
        den = x["r"] - c * np.longdouble(x["b"])
        want = {"A": 1 / den, "B": c / den, "C": 1 / den**2, "D": c / den**2, "E": c * c / den**2, "L": np.log(den)}
        for k, v in want.items():
            assert x[k] == pytest.approx(float(v.sum()), rel=1e-11)
    big = spark.createDataFrame([(3 * 10**9, 10**9)], "n long, d long")
    got = big.select(F.expr(stats.tie_sum_sql("n", "d", 1)).alias("a"), F.expr(stats.tie_sum_sql("n", "d", 2)).alias("b"),
                     F.expr(stats.efron_sums_sql("CAST(n AS DOUBLE)", "CAST(d AS DOUBLE)", "d")).alias("e")).first()
    assert got["a"] == pytest.approx(np.log(1.5), rel=1e-8) and got["b"] == pytest.approx(1 / 2e9 - 1 / 3e9, rel=1e-8)
    assert got["e"]["A"] == pytest.approx(np.log(1.5), rel=1e-8)


def _concave(calls, noise):
    """A log-likelihood 1000 b - exp(b), null where it overflows, with wrong last digits."""
    def evaluate(blocks, beta, ties):
        b = float(beta[0])
        calls.append(b)
        if b > 50:
            return float("nan"), np.full(1, np.nan), np.full((1, 1), np.nan)
        ll = 1000 * b - np.exp(b) - 5e4 - noise * len(calls)
        return ll, np.array([1000 - np.exp(b)]), np.array([[-np.exp(b)]])
    return evaluate


@pytest.mark.parametrize("noise", [0.0, 1e-9])
def test_fit_halves_steps_that_overflow_and_ignores_rounding(spark, monkeypatch, noise):
    calls = []
    monkeypatch.setattr(cox.risksets, "evaluate", _concave(calls, noise))
    df = spark.createDataFrame([(1.0, 1, 0.0), (2.0, 1, 1.0)], "t double, e int, x double")
    f = cox.cox_fit(df, "t", "e", ["x"])
    assert f.beta[0] * np.sqrt(0.5) == pytest.approx(np.log(1000))  # beta is of the standardised x
    assert np.isfinite(f.loglik) and max(calls) > 50
    assert len(calls) <= 4 + 5 + f.n_iter  # the overflow's halvings, and none for the last digits

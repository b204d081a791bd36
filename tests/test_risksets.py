"""Cox likelihood over sorted blocks against sums over every risk set in plain numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.operators import cox, risksets


def plain(x, start, t, e, g, beta, ties):
    """Log-likelihood, gradient and Hessian, one tied event at a time."""
    p, w, xb = x.shape[1], np.exp(x @ beta), x @ beta
    ll, grad, hess = 0.0, np.zeros(p), np.zeros((p, p))
    for s in np.unique(g):
        for time in np.unique(t[(g == s) & (e == 1)]):
            risk = (g == s) & (t >= time) & (start < time)
            dead = (g == s) & (t == time) & (e == 1)
            ll, grad = ll + xb[dead].sum(), grad + x[dead].sum(0)
            for k in range(dead.sum()):
                c = k / dead.sum() if ties == "efron" else 0.0
                v = w * risk - c * w * dead
                s0, s1, s2 = v.sum(), v @ x, (x * v[:, None]).T @ x
                ll, grad, hess = ll - np.log(s0), grad - s1 / s0, hess - s2 / s0 + np.outer(s1, s1) / s0 ** 2
    return ll, grad, hess


@pytest.fixture(scope="module")
def episodes(spark):
    """A third of all rows in one stratum at one time, null strata, late entries."""
    rng = np.random.default_rng(11)
    n = 600
    x, t, e = rng.normal(size=(n, 3)), rng.integers(4, 16, n).astype(float), rng.integers(0, 2, n)
    g = rng.integers(0, 4, n)
    start = np.where(rng.random(n) < 0.4, rng.integers(0, 4, n), -1).astype(float)
    t[:200], g[:200] = 9.0, 1
    rows = [(*map(float, x[i]), float(start[i]), float(t[i]), int(e[i]), None if g[i] == 3 else f"s{g[i]}") for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, s double, t double, e int, g string")
    return df.repartition(5), x, start, t, e, g


@pytest.mark.parametrize("ties", ["efron", "breslow"])
@pytest.mark.parametrize("late", [False, True])
@pytest.mark.parametrize("strata", [[], ["g"]])
def test_sums_over_blocks_and_partitions(spark, episodes, monkeypatch, ties, late, strata):
    df, x, start, t, e, g = episodes
    monkeypatch.setattr(risksets, "BLOCK", 7)
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = risksets.sorted_blocks(df, "t", "e", ["a", "b", "c"], strata, "s" if late else None)
        beta = np.array([0.3, -0.2, 0.5])
        ll, grad, hess = risksets.evaluate(blocks, beta, ties)
        parts = blocks.mapPartitions(lambda p: [[(labels[k], u) for labels, c, v, *_ in p for k, u in zip(c, v)]]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    hot = ('{"g":"s1"}' if strata else "", 9.0)
    assert sum(hot in p for p in parts) > 1  # the hot time is cut over partitions
    want = plain(x, start if late else np.full(len(t), -np.inf), t, e, g if strata else np.zeros(len(t)), beta, ties)
    for got, w in zip((ll, grad, hess), want):
        np.testing.assert_allclose(got, w, rtol=1e-9, atol=1e-8)


@pytest.mark.parametrize("d", [1, 3, 256, 257, 1000, 200_000])
@pytest.mark.parametrize("share", [1e-9, 0.3, 0.999, 1.0])
def test_tie_sums(d, share):
    r, b = 1000.0, 1000.0 * share
    c = np.arange(d) / d
    den = (r - b) + b * (d - np.arange(d)) / d
    want = [np.sum(v) for v in (1 / den, c / den, 1 / den ** 2, c / den ** 2, (c / den) ** 2, np.log(den))]
    np.testing.assert_allclose(risksets.efron_sums(np.array([r, r]), np.array([b, b]), np.array([d, 2]))[0], want, rtol=1e-9)


def test_a_tie_of_a_thousand_million_is_summed():
    out = risksets.efron_sums(np.array([3e9]), np.array([1e9]), np.array([1e9]))[0]
    assert out[0] == pytest.approx(np.log(1.5), rel=1e-8)  # integral of 1 / (3 - c)


def test_nulls_and_no_events(spark, episodes):
    df, *_ = episodes
    with pytest.raises(ValueError, match="a has"):
        cox.cox_fit(df.withColumn("a", F.when(F.col("a") > 0, F.col("a"))), "t", "e", ["a", "b"])
    blocks = risksets.sorted_blocks(df.where("false"), "t", "e", ["a"], ["g"])
    assert risksets.evaluate(blocks, np.zeros(1), "efron")[0] == 0.0
    blocks = risksets.sorted_blocks(df.withColumn("e", F.lit(0)), "t", "e", ["a"], ["g"])
    assert risksets.evaluate(blocks, np.zeros(1), "efron")[0] == 0.0


@pytest.mark.parametrize("late", [False, True])
def test_weights_of_any_size(spark, monkeypatch, late):
    """Rows whose weights are thousands of powers apart, as hot accounts have them: a sum at one scale has none."""
    rng = np.random.default_rng(5)
    n = 90
    x, t, e = rng.normal(size=(n, 2)), rng.integers(3, 30, n).astype(float), rng.integers(0, 2, n)
    x[::9, 0] += 400 * np.arange(10)  # early or late ones are far above the others
    t[::9], e[::9] = np.arange(29, 19, -1), 1
    start = np.zeros(n) if late else np.full(n, -np.inf)
    beta = np.array([3.0, -0.5])
    ll, grad, hess = 0.0, np.zeros(2), np.zeros((2, 2))
    for time in np.unique(t[e == 1]):
        risk, dead = (t >= time) & (start < time), (t == time) & (e == 1)
        top = (x @ beta)[risk].max()
        w = np.where(risk, np.exp(np.where(risk, x @ beta - top, 0)), 0)
        ll, grad = ll + (x @ beta - top)[dead].sum(), grad + x[dead].sum(0)
        for k in range(dead.sum()):
            v = w * risk - k / dead.sum() * w * dead
            s0, s1, s2 = v.sum(), v @ x, (x * v[:, None]).T @ x
            ll, grad, hess = ll - np.log(s0), grad - s1 / s0, hess - s2 / s0 + np.outer(s1, s1) / s0 ** 2
    monkeypatch.setattr(risksets, "BLOCK", 7)
    df = spark.createDataFrame([(*map(float, x[i]), 0.0, float(t[i]), int(e[i])) for i in range(n)], "a double, b double, s double, t double, e int")
    blocks = risksets.sorted_blocks(df.repartition(3), "t", "e", ["a", "b"], [], "s" if late else None)
    for got, w in zip(risksets.evaluate(blocks, beta, "efron"), (ll, grad, hess)):
        np.testing.assert_allclose(got, w, rtol=1e-9, atol=1e-6)


def test_sums_of_long_and_short_runs(monkeypatch):
    rng = np.random.default_rng(2)
    w, x, starts = rng.normal(size=50), rng.normal(size=(50, 3)), np.array([0, 1, 30])
    short = risksets._sums(w, x, starts)
    monkeypatch.setattr(risksets, "LONG", 1)
    np.testing.assert_allclose(risksets._sums(w, x, starts), short, rtol=1e-12)


def test_a_fit_with_a_hot_row_converges(spark):
    """A covariate with one value far above the others, whose own scale is far below the deviation."""
    rng = np.random.default_rng(8)
    n = 4000
    t = rng.integers(1, 40, n).astype(float)
    a = (60 - t) / 40 + rng.normal(size=n) / 50
    a[:4], t[:4] = [30_000.0, 40_000.0, 50_000.0, 60_000.0], 40.0
    e = rng.integers(0, 2, n)
    e[:4] = 0, 1, 0, 1
    g = rng.integers(0, 2, n)
    df = spark.createDataFrame([(float(a[i]), float(t[i]), int(e[i]), int(g[i])) for i in range(n)], "a double, t double, e int, g int")
    f = cox.cox_fit(df, "t", "e", ["a"], strata=["g"])
    blocks = risksets.sorted_blocks(df, "t", "e", ["a"], ["g"])
    _, grad, hess = risksets.evaluate(blocks, f.beta, "efron")
    assert abs(grad[0] / np.sqrt(-hess[0, 0])) < 1e-4 and f.n_iter < 50


def test_episodes_are_one_row_each(spark):
    """Episodes without an event time inside: no row is taken off again, so one far above the others leaves nothing behind."""
    rng = np.random.default_rng(4)
    n, m = 60, 9
    x = rng.normal(size=(n, m))
    x[:3] += 500 * np.arange(m)  # far above the others, more so at late times
    last = rng.integers(2, m + 1, n)
    rows = [(float(x[k, u]), float(u), float(u + 1), int(u + 1 == last[k])) for k in range(n) for u in range(last[k])]
    blocks = risksets.sorted_blocks(spark.createDataFrame(rows, "a double, s double, t double, e int").repartition(4), "t", "e", ["a"], [], "s")
    signs = np.concatenate([b[4] for b in blocks.collect()])
    assert len(signs) == len(rows) and not signs.any()
    ll = 0.0
    for u in range(m):
        w = np.array([r[0] for r in rows if r[1] == u])
        dead = np.array([r[3] for r in rows if r[1] == u]) == 1
        top, k = w.max(), dead.sum()
        v, d = np.exp(w - top).sum(), np.exp(w - top)[dead].sum()
        ll += (w - top)[dead].sum() - sum(np.log(v - c / k * d) for c in range(k))
    assert risksets.evaluate(blocks, np.ones(1), "efron")[0] == pytest.approx(ll, rel=1e-10)


def test_rows_of_an_episode_table_are_dealt_over_the_slots(spark):
    subjects = spark.range(50).coalesce(1).selectExpr("id", "id % 7 as t", "1 as e")
    e = cox.episodic(subjects, "id", "t", "e")
    assert e.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and e.count() == sum(k % 7 for k in range(50))

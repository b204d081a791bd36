"""Hand-worked survival examples and properties."""
import math

from pyspark.sql import functions as F

from tenura.operators import survival as sv


def _df(spark, rows, schema="t int, e int, g string"):
    return spark.createDataFrame(rows, schema)


def test_km_hand_example(spark):
    # times 1,2,2,3,4(censored),5 ; events at 1,2,2,3,5
    rows = [(1, 1, "a"), (2, 1, "a"), (2, 1, "a"), (3, 1, "a"), (4, 0, "a"), (5, 1, "a")]
    km = {r["t"]: r for r in sv.kaplan_meier(_df(spark, rows), "t", "e").collect()}
    assert km[0]["survival"] == 1.0
    assert math.isclose(km[1]["survival"], 5 / 6)
    assert math.isclose(km[2]["survival"], 5 / 6 * 3 / 5)
    assert math.isclose(km[3]["survival"], 5 / 6 * 3 / 5 * 2 / 3)
    assert math.isclose(km[4]["survival"], km[3]["survival"])
    assert km[5]["survival"] == 0.0 and km[5]["ci_lower"] is None  # d = n: band undefined


def test_km_without_censoring_is_one_minus_ecdf(spark):
    rows = [(t, 1, "a") for t in [1, 1, 2, 3, 3, 3, 7]]
    km = sv.kaplan_meier(_df(spark, rows), "t", "e").collect()
    n = len(rows)
    for r in km:
        below = sum(1 for t, _, _ in rows if t <= r["t"])
        assert math.isclose(r["survival"], 1 - below / n, abs_tol=1e-12)


def test_nelson_aalen_ties(spark):
    rows = [(2, 1, "a"), (2, 1, "a"), (5, 0, "a")]
    na = {r["t"]: r for r in sv.nelson_aalen(_df(spark, rows), "t", "e").collect()}
    assert math.isclose(na[2]["cum_hazard"], 1 / 3 + 1 / 2)


def test_logrank_symmetric(spark):
    rows = [(t, e, g) for t, e, g in [(1, 1, "a"), (3, 1, "a"), (4, 0, "a"), (2, 1, "b"), (5, 1, "b"), (6, 1, "b"), (6, 0, "a")]]
    df = _df(spark, rows)
    a = sv.logrank_two_sample(df, "t", "e", F.col("g") == "a").first()
    b = sv.logrank_two_sample(df, "t", "e", F.col("g") == "b").first()
    assert math.isclose(a["chi2"], b["chi2"], rel_tol=1e-12)
    assert math.isclose(a["z"], -b["z"], rel_tol=1e-12)
    assert math.isclose(a["p_value"], math.erfc(math.sqrt(a["chi2"] / 2)), rel_tol=1e-6)


def test_empty_group_has_origin_only(spark):
    rows = [(3, 0, "a"), (4, 0, "a")]
    km = sv.kaplan_meier(_df(spark, rows), "t", "e").collect()
    assert all(r["survival"] == 1.0 for r in km)


def test_chi2_sf_matches_closed_forms(spark):
    from tenura.functions.stats import chi2_sf
    df = spark.createDataFrame([(3.0, 1), (3.0, 2), (5.0, 3), (7.5, 4)], "x double, k int")
    got = [r[0] for r in df.select(chi2_sf(F.col("x"), F.col("k"))).collect()]
    exp = [math.erfc(math.sqrt(1.5)), math.exp(-1.5),
           math.erfc(math.sqrt(2.5)) + math.exp(-2.5) * math.sqrt(2.5) / (math.sqrt(math.pi) / 2),
           math.exp(-3.75) * (1 + 3.75)]
    for g, e in zip(got, exp):
        assert math.isclose(g, e, rel_tol=1e-6)


def test_weibull_matches_numpy_optimum(spark):
    import numpy as np
    rng = np.random.default_rng(11)
    T = np.ceil(60 * rng.weibull(2.5, size=400)).astype(int) + 1
    E = (rng.random(400) < 0.6).astype(int)
    df = spark.createDataFrame([(int(t), int(e), "a") for t, e in zip(T, E)], "t int, e int, g string")
    r = sv.weibull_fit(df, "t", "e").first()

    def ll(a, b):
        rr = np.exp(b)
        lt = np.log(T) - a
        return np.sum(E * (b - a + (rr - 1) * lt)) - np.sum(np.exp(rr * lt))
    # Newton in numpy with numeric derivatives from the Spark optimum must not improve it
    a, b = math.log(r["lambda_"]), math.log(r["rho"])
    h = 1e-5
    ga = (ll(a + h, b) - ll(a - h, b)) / (2 * h)
    gb = (ll(a, b + h) - ll(a, b - h)) / (2 * h)
    assert abs(ga) < 1e-3 and abs(gb) < 1e-3
    assert math.isclose(r["log_likelihood"], ll(a, b), rel_tol=1e-9)

"""Scans and lookups in many blocks of times against one block and plain numpy."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.functions import scans
from tenura.operators import cox
from tenura.operators import survival as sv


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(scans, "ROWS", 7)


@pytest.fixture(scope="module")
def subjects(spark):
    """Times as fine as seconds: a hot stratum, a small one, one subject, a null stratum."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(260):
        g = None if i % 20 == 7 else "hot" if i % 3 else "cold" if i != 3 else "one"
        rows.append((i, g, float(np.round(rng.exponential(1000.0), int(rng.integers(0, 4)))), int(rng.random() < 0.6), float(rng.normal())))
    df = spark.createDataFrame(rows, "id int, g string, t double, e int, x double").persist()
    return df, rows


def _rows(df, n_keys):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r[:n_keys]))


def _close(a, b, n_keys):
    assert len(a) == len(b) and a
    for p, q in zip(a, b):
        assert p[:n_keys] == q[:n_keys]
        for u, v in zip(p[n_keys:], q[n_keys:]):
            assert u == v or (u is not None and v is not None and math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-12))


def test_blocks_of_odd_values(spark, small_blocks):
    values = [None, float("nan"), float("-inf"), float("inf"), *[float(i) for i in range(40)]]
    df, block = scans.in_blocks(spark.createDataFrame([(v,) for v in values], "t double"), "t")
    assert block == [scans.BLOCK]
    by = {str(r["t"]): r[scans.BLOCK] for r in df.collect()}
    assert by["None"] < by["-inf"] <= by["0.0"] <= by["20.0"] <= by["39.0"] <= by["inf"] < by["nan"]
    assert len(set(by.values())) > 4
    empty, block = scans.in_blocks(df.where("false"), "t")
    assert block == [] and empty.count() == 0
    same, block = scans.in_blocks(spark.createDataFrame([(None,)] * 30, "t double"), "t")
    assert block == [] and same.count() == 30


def test_running_values_against_numpy(spark, subjects, small_blocks):
    _, rows = subjects
    uniq = {(g, t): (e, x) for _, g, t, e, x in rows}
    df = spark.createDataFrame([(g, t, e, x) for (g, t), (e, x) in uniq.items()], "g string, t double, e long, x double")
    df, block = scans.in_blocks(df, "t")
    assert block
    for descending in (False, True):
        out = scans.running(df, ["g"], "t", block, {"s": "e"}, {"p": F.lit(1.0) + F.col("x") / 10}, {"n": F.lit(1)}, descending=descending)
        got = {(r["g"], r["t"]): (r["s"], r["p"], r["n"]) for r in out.collect()}
        assert len(got) == len(uniq)
        for g in {k[0] for k in uniq}:
            ts = sorted((t for h, t in uniq if h == g), reverse=descending)
            s, p = 0, 1.0
            for t in ts:
                s, p = s + uniq[g, t][0], p * (1 + uniq[g, t][1] / 10)
                assert got[g, t][0] == s and math.isclose(got[g, t][1], p, rel_tol=1e-9) and got[g, t][2] == len(ts)


def test_survival_is_the_same_in_many_blocks(subjects, monkeypatch):
    df, _ = subjects

    def results():
        return [(_rows(sv.kaplan_meier(df, "t", "e", ["g"]), 2), 2), (_rows(sv.event_table(df, "t", "e"), 1), 1),
                (_rows(sv.nelson_aalen(df, "t", "e", ["g"]), 2), 2),
                (_rows(sv.logrank_two_sample(df, "t", "e", F.col("x") > 0), 0), 0),
                (_rows(sv.logrank_k_sample(df, "t", "e", "g"), 0), 0)]

    whole = results()
    monkeypatch.setattr(scans, "ROWS", 7)
    for (a, k), (b, _) in zip(whole, results(), strict=True):
        _close(a, b, k)


@pytest.mark.parametrize("strata", [[], ["g"]])
def test_subject_curves_are_the_same_in_many_blocks(subjects, monkeypatch, strata):
    df = subjects[0].where("g is not null")
    args = (["x"], [0.4], [0.0])

    def results():
        base = cox.baseline_hazard(df, "t", "e", *args, strata)
        n = 1 + len(strata)
        return [(_rows(base, n), n), (_rows(cox.subject_curves(df, "id", *args, base, strata), n + 1), n + 1),
                (_rows(cox.subject_curves(df, "id", *args, base, strata, times=[0.0, 300.0, 5000.0]), n + 1), n + 1),
                (_rows(cox.expected_lifetime(df, "id", *args, base, strata), n), n),
                (_rows(cox.percentile_lifetime(df, "id", *args, base, strata, 0.5), n), n),
                (_rows(cox.conditional_survival(df, "id", "t", "e", *args, base, strata), n + 1), n + 1),
                (_rows(cox.conditional_quantiles(df, "id", "t", "e", *args, base, strata), 1), 1),
                (_rows(cox.score_residuals(df, "id", "t", "e", *args, strata), 1), 1)]

    whole = results()
    monkeypatch.setattr(scans, "ROWS", 7)
    for (a, k), (b, _) in zip(whole, results(), strict=True):
        _close(a, b, k)


def test_lookups_against_whole_curves(subjects, small_blocks):
    """Quantiles looked up in blocks are those of the curves written out."""
    df = subjects[0].where("g is not null")
    args = (["x"], [0.4], [0.0])
    base = cox.baseline_hazard(df, "t", "e", *args, ["g"])
    curves = cox.subject_curves(df, "id", *args, base, ["g"]).groupBy("id").agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("m"))
    got = {r["id"]: r["t_50"] for r in cox.percentile_lifetime(df, "id", *args, base, ["g"], 0.5).collect()}
    assert got == {r["id"]: r["m"] for r in curves.collect()} and any(got.values())
    assert {r["t_0"] for r in cox.percentile_lifetime(df, "id", *args, base, ["g"], 0.0).collect()} == {None}
    cond = cox.conditional_survival(df, "id", "t", "e", *args, base, ["g"]).groupBy("id").agg(
        F.min(F.when(F.col("survival_cond") <= 0.75, F.col("t"))).alias("m"))
    got = {r["id"]: r["t_75"] for r in cox.conditional_quantiles(df, "id", "t", "e", *args, base, ["g"]).collect()}
    assert got == {r["id"]: r["m"] for r in cond.collect()}

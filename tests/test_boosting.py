"""Boosters grown side by side against one at a time in plain numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.operators import boosting as bo
from tenura.operators import metrics as me
from tenura.operators import trees as tr

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 3)), 1)
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=400) > 0).astype(int)
    rows = [(i, *map(float, v), int(t), int(i % 3)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int, fold int").repartition(3).cache(), x, y


def plain(x, y, edges, trees, depth, rate, features):
    """Margins of every row of a booster fit on ``y`` where it is not None."""
    known = np.array([t is not None for t in y])
    target = np.array([t or 0 for t in y], float)
    margin, gains = np.zeros(len(x)), np.zeros(x.shape[1])

    def grow(rows, depth, g, h):
        G, H = g[rows & known].sum(), h[rows & known].sum()
        best = 0.0, None
        for f in features if depth else ():
            for e in edges[f]:
                left = rows & (x[:, f] <= e)
                gl, hl = g[left & known].sum(), h[left & known].sum()
                if hl >= 1 and H - hl >= 1:
                    gain = round((gl ** 2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G ** 2 / (H + 1)) / 2, 9)
                    if gain > best[0]:
                        best = gain, (f, left)
        if best[1] is None:
            margin[rows] += -rate * G / (H + 1)
            return
        f, left = best[1]
        gains[f] += best[0]
        grow(left, depth - 1, g, h)
        grow(rows & ~left, depth - 1, g, h)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grow(np.ones(len(x), bool), depth, p - target, p * (1 - p))
    return margin, gains


def test_side_by_side_equals_one_at_a_time(spark, table):
    df, x, y = table
    data = bo.binned(df, NAMES, "y", "fold")
    boosters = [bo.Booster(3, 2, 0.3), bo.Booster(2, 3, 0.1, features=[1, 2], left_out=1), bo.Booster(4, 1, 0.5, left_out=0)]
    state = bo.fit(data, boosters)
    got = sorted(tuple(r) for _, _, _, m in state.collect() for r in m.round(9).tolist())
    want = []
    for b in boosters:
        labels = [None if i % 3 == b.left_out else t for i, t in enumerate(y.tolist())]
        margin, gains = plain(x, labels, data.edges, b.trees, b.depth, b.rate, b.features or range(3))
        want.append(margin)
        assert b.gains(3) == pytest.approx(gains)
    np.testing.assert_allclose(got, sorted(tuple(r) for r in np.stack(want, 1).round(9).tolist()), atol=1e-8)
    # the node table scores like the margins
    ens = tr.Ensemble([tuple(r) for r in boosters[0].node_table(NAMES, data.edges)])
    scored = [r["m"] for r in df.select(tr.margin_col(ens).alias("m")).collect()]
    np.testing.assert_allclose(sorted(scored), sorted(want[0].tolist()), atol=1e-8)


def test_auc_of_many_models_equals_one(spark, table):
    df, _, _ = table
    scores = df.select(F.explode(F.array(F.lit(4), F.lit(7))).alias("model"), "y", F.col("a").alias("s"), F.col("b").alias("t"))
    scores = scores.select("model", "y", F.when(F.col("model") == 4, F.col("s")).otherwise(F.col("t")).alias("p"))
    got = {r["model"]: r["auc"] for r in bo.auc_by_model(scores).collect()}
    for m in (4, 7):
        assert got[m] == pytest.approx(me.auc_score(scores.where(f"model = {m}"), "y", "p").first()[0])


def test_search_and_elimination(spark, table):
    df, _, _ = table
    rows = bo.cross_validate(df, NAMES, "y", [dict(trees=1, depth=1, rate=0.1), dict(trees=8, depth=2, rate=0.3)], 3).collect()
    best = [r for r in rows if r["is_best"]]
    assert len(rows) == 2 and len(best) == 1 and best[0]["params"] == "depth=2,rate=0.3,trees=8" and best[0]["mean_score"] > 0.9
    assert dict(bo.rfe(df, NAMES, "y", dict(trees=3, depth=2))) == {"a": 1, "b": 2, "c": 3}
    out = {r["n_features"]: r for r in bo.rfecv(df, NAMES, "y", 3, dict(trees=3, depth=2)).collect()}
    assert set(out) == {1, 2, 3} and all(r["n_folds"] == 3 for r in out.values()) and out[2]["mean_auc"] > out[1]["mean_auc"]


def test_nulls_and_one_class(spark):
    df = spark.createDataFrame([(float(i) if i % 4 else None, 1, i % 2) for i in range(40)], "a double, y int, fold int")
    data = bo.binned(df, ["a"], "y", "fold")
    bo.fit(data, [b := bo.Booster(2, 2, left_out=0)])
    assert len(b.grown) == 2 and all(t.feature[0] == -1 for t in b.grown)
    with pytest.raises(Exception, match="null"):
        bo.binned(df.withColumn("y", F.lit(None).cast("int")), ["a"], "y").blocks.count()


def test_sweep_refits_every_trial(spark, table):
    df, x, y = table
    trials, share, steps = 6, 0.3, 10
    got = {round(r["threshold"], 6): r for r in bo.threshold_sweep(df, "id", NAMES, "y", dict(trees=3, depth=2, rate=0.3),
                                                                  trials, share, steps).collect()}
    rows = df.select("id", F.xxhash64("id").alias("key")).orderBy("id").collect()
    key = np.array([r["key"] for r in rows])
    edges = bo.split_points(df, NAMES)
    curves, drawn = [], []
    for t in range(trials):
        out = bo.Draw(t, share).of(key)
        drawn.append(out)
        margin, _ = plain(x, [None if o else v for o, v in zip(out.tolist(), y.tolist())], edges, 3, 2, 0.3, range(3))
        p, truth = 1 / (1 + np.exp(-margin[out])), y[out]
        curve = []
        for k in range(steps + 1):
            flag = np.minimum(np.floor(p * steps), steps) >= k
            prec = truth[flag].mean() if flag.any() else 0.0
            rec = truth[flag].sum() / truth.sum()
            curve.append((prec, rec, 2 * prec * rec / (prec + rec) if prec + rec else 0.0, flag.mean()))
        curves.append(curve)
    curves = np.array(curves)
    assert len(got) == steps + 1
    for k in range(steps + 1):
        r = got[round(k / steps, 6)]
        for j, c in enumerate(("precision", "recall", "f1", "queue_rate")):
            for q, n in ((0.5, "median"), (0.1, "p10"), (0.9, "p90")):
                assert r[f"{c}_{n}"] == pytest.approx(np.quantile(curves[:, k, j], q)), (k, c, n)
    drawn = np.array(drawn)
    assert abs(drawn.mean() - share) < 0.05 and len({d.tobytes() for d in drawn}) == trials and (drawn.sum(0) > 1).any()


def test_last_margins_are_made_once(spark, table):
    """The margins that ``fit`` returns are stored, not left to a chain of steps since the last checkpoint."""
    d, x, _ = table
    data = bo.binned(d, NAMES, "y", "fold")
    state = bo.fit(data, [bo.Booster(4, 2, left_out=0), bo.Booster(3, 2)])
    stored = {i.id(): i.numCachedPartitions() for i in spark.sparkContext._jsc.sc().getRDDStorageInfo()}
    assert stored.get(state.id()) == state.getNumPartitions()
    assert sum(len(s[1]) for s in state.collect()) == len(x)


def test_elimination_grows_only_trees_that_change(spark, table, monkeypatch):
    """Trees before the first split on the feature that goes are kept; results are those of fits from the start."""
    df, x, y = table
    settings = dict(trees=6, depth=2)
    passes, real = [], bo._split

    def counted(booster, tree, level, sums, offsets):
        passes.append(len(booster.features))
        real(booster, tree, level, sums, offsets)

    monkeypatch.setattr(bo, "_split", counted)
    names = [*NAMES, "d"]  # d never splits, so the fit without it is there already
    wide = df.withColumn("d", F.lit(1.0))
    ranks = dict(bo.rfe(wide, names, "y", settings))
    edges = bo.split_points(wide, names)
    own, want = list(range(4)), {}
    x4 = np.column_stack([x, np.ones(len(x))])
    while len(own) > 1:
        gains = plain(x4, y.tolist(), edges, 6, 2, 0.1, own)[1]
        worst = min(own, key=lambda f: (gains[f], names[f]))
        want[names[worst]] = len(own)
        own.remove(worst)
    assert ranks == want | {names[own[0]]: 1}
    assert passes.count(4) == 12 and passes.count(3) == 0 and passes.count(2) <= 12
    # a fit that keeps trees has the trees and margins of a fit from the start
    data = bo.binned(df, NAMES, "y", "fold")
    a, b = (bo.Booster(12, 3, features=[0, 1, 2], left_out=1) for _ in range(2))
    bo.fit(data, [a])
    worst = bo._drop_least(a, NAMES)
    kept = len(a.kept)
    margins = bo.fit(data, [a]).collect()
    b.features = [f for f in range(3) if f != worst]
    plainly = bo.fit(data, [b]).collect()
    assert 0 < kept < 12 == len(a.grown) == len(b.grown) and a.node_table(NAMES, data.edges) == b.node_table(NAMES, data.edges)
    for s, t in zip(margins, plainly):
        assert np.array_equal(s[3], t[3])


def test_rows_for_many_tasks_are_dealt_over_slots(spark, monkeypatch):
    from tenura.session import spread
    d = spark.range(1000).coalesce(1)
    got = spread(d, "id", 200).rdd.glom().map(lambda p: [r[0] for r in p]).collect()
    assert len(got) == min(spark.sparkContext.defaultParallelism, 5) and all(p == sorted(p) for p in got)
    assert sorted(sum(got, [])) == list(range(1000))
    assert spread(d, "id", 1000) is d
    plain = bo.binned(d.select("id", (F.col("id") % 2).alias("y")), ["id"], "y")
    monkeypatch.setattr(bo, "TASK_ROWS", 200)
    dealt = bo.binned(d.select("id", (F.col("id") % 2).alias("y")), ["id"], "y")
    assert plain.blocks.getNumPartitions() == 1 < dealt.blocks.getNumPartitions()
    a, b = bo.Booster(5, 2), bo.Booster(5, 2)
    bo.fit(plain, [a])
    bo.fit(dealt, [b])
    assert np.allclose(a.gains(1), b.gains(1))


def test_sums_are_of_the_features_that_a_booster_may_use():
    """Features that are gone have no sums, but the first, from which a node's own come."""
    rng = np.random.default_rng(6)
    sizes = np.array([2, 64, 2, 2, 63, 2, 2, 300, 2, 2, 1])
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    n = 500
    bins = np.stack([rng.integers(0, s, n) for s in sizes], 1).astype(np.int32)
    y, fold, margin = (rng.random(n) < 0.4).astype(float), rng.integers(0, 3, n), rng.normal(size=(n, 2))
    tree = bo._Tree(2)
    tree.feature[0], tree.bin[0] = 1, 30
    own = [8, 1, 3, 4, 7]
    got = next(bo._sums([(bins[:200], y[:200], fold[:200], margin[:200]), (bins[200:], y[200:], fold[200:], margin[200:])],
                        [(tree, 1, None), (tree, None, own)], 1, offsets))
    for k in range(2):
        p = 1 / (1 + np.exp(-margin[:, k]))
        for f in range(len(sizes)):
            for node in range(2):
                at = ((bins[:, 1] > 30) == node) & ((fold != 1) | (k == 1)) & (k == 0 or f in [0, *own])
                want = [np.bincount(bins[at, f], w[at], sizes[f]) for w in (p - y, p * (1 - p))]
                np.testing.assert_allclose(got[k, node, offsets[f]:offsets[f + 1]].T, want, atol=1e-12)

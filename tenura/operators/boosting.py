"""Many boosters in one pass.

Features are binned once.  All boosters of a search (settings, folds and
feature subsets) then grow side by side: one pass over the data a tree level
sums gradients and hessians by (booster, node, feature, bin) in numpy blocks,
the sums are added up as a tree, and the driver picks every booster's splits
from sums whose size is that of the models.  The first pass of a tree also
adds the tree before to the margins, so a search of trees of depth d costs
d passes a tree, however many boosters it has.

Log-loss, Newton leaf values, L2 penalty and least child weight (sum of
hessians) as boosters of this kind have them.  A held-out row keeps its margin
like any other, so scores out of fold are there when the last tree is.

Margins are cached with the blocks and written to the checkpoint folder every
``CHECKPOINT`` trees: a lost executor repeats those at most.  A null feature
goes right at every split, a null label is an error.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.functions.ordinal import global_prefix_sums
from tenura.operators.features import hash_fraction
from tenura.operators.metrics import threshold_bands, threshold_counts
from tenura.session import cut_lineage, ensure_checkpoint_dir, spread

#: Split points tried for a feature, at most; fewer where it has fewer values.
EDGES = 63
#: Rows of a block.
BLOCK = 1 << 16
CHECKPOINT = 25
#: Rows for which a pass of their own pays a task.
TASK_ROWS = 1 << 17


@dataclass(frozen=True)
class Draw:
    """Rows left out at random in one trial; draws of different trials are
    independent, so a row can be left out of several."""
    trial: int
    share: float

    def of(self, key: np.ndarray) -> np.ndarray:
        """Whether the row of each 64-bit key is drawn (splitmix64 of key and trial)."""
        z = key.astype(np.int64).view(np.uint64) + np.uint64((self.trial + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53 < self.share


def _left_out(fold: np.ndarray, left_out: int | Draw | None) -> np.ndarray:
    """Whether each row is left out; ``fold`` holds folds, or keys for draws."""
    if left_out is None:
        return np.zeros(len(fold), bool)
    return left_out.of(fold) if isinstance(left_out, Draw) else fold == left_out


@dataclass
class Booster:
    """Settings of one booster, the fold it leaves out, and its trees."""
    trees: int = 100
    depth: int = 3
    rate: float = 0.1
    penalty: float = 1.0
    child_weight: float = 1.0
    features: Sequence[int] | None = None  # places of the features it may use; None: all
    left_out: int | Draw | None = None  # rows of this fold or draw are not trained on
    grown: list = field(default_factory=list, repr=False)
    kept: list = field(default_factory=list, repr=False)  # the first trees, where they are known before a fit

    def gains(self, n_features: int) -> np.ndarray:
        """Sum of gains of each feature."""
        total = np.zeros(n_features)
        for t in self.grown:
            np.add.at(total, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
        return total

    def node_table(self, names: Sequence[str], edges: Sequence[np.ndarray]) -> list[tuple]:
        """Rows of ``trees.NODE_SCHEMA``; cover is the sum of hessians."""
        rows = []
        for k, t in enumerate(self.grown):
            for i in np.flatnonzero(t.used).tolist():
                if t.feature[i] >= 0:
                    f = int(t.feature[i])
                    rows.append((k, i, 2 * i + 1, 2 * i + 2, names[f], float(edges[f][t.bin[i]]), 0.0, float(t.cover[i]), float(t.gain[i])))
                else:
                    rows.append((k, i, -1, -1, None, None, float(t.value[i]), float(t.cover[i]), 0.0))
        return rows


class _Tree:
    """Nodes in heap order: the children of node i are 2i + 1 and 2i + 2."""

    def __init__(self, depth: int):
        n = (2 << depth) - 1
        self.feature, self.bin = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        self.value, self.gain, self.cover = np.zeros(n), np.zeros(n), np.zeros(n)
        self.used = np.zeros(n, bool)
        self.used[0] = True

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of every row after ``levels`` splits; rows stay in leaves."""
        node, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (bins[row, f] > self.bin[node]), node)
        return node


def split_points(df: DataFrame, features: Sequence[str], most: int = EDGES) -> list[np.ndarray]:
    """Ascending candidate thresholds of each feature: quantiles, or all values
    but the largest where there are few."""
    probs = [(i + 1) / (most + 1) for i in range(most)]
    row = df.agg(*[F.percentile_approx(F.col(f"`{f}`").cast("double"), probs, 10000).alias(str(i)) for i, f in enumerate(features)],
                 *[F.max(F.col(f"`{f}`").cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    return [np.array(sorted({x for x in row[str(i)] or [] if x < row[f"m{i}"]})) for i in range(len(features))]


@dataclass
class Binned:
    """The blocks of a table, cached: (bins, label, fold) arrays."""
    blocks: object
    features: list[str]
    edges: list[np.ndarray]
    spark: object

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum([len(e) + 1 for e in self.edges])))


def binned(df: DataFrame, features: Sequence[str], label: str, fold: str | Column | None = None, most: int = EDGES) -> Binned:
    """``df`` with every feature as the number of split points below its value;
    ``fold`` has the rows' folds, or their keys for draws.  Rows are dealt over
    the slots by a hash of all that a block keeps of them."""
    edges = split_points(df, features, most)
    kind = np.uint8 if all(len(e) < 256 for e in edges) else np.int32
    d = df.select(*[F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)],
                  F.col(f"`{label}`").cast("double").alias("y"), (F.lit(-1) if fold is None else F.col(fold) if isinstance(fold, str) else fold).cast("long").alias("fold"))
    d = spread(d.withColumn("place", F.xxhash64(*d.columns)), "place", TASK_ROWS).drop("place")

    def pack(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                lot = batch.slice(i, BLOCK)
                bins = np.stack([np.searchsorted(e, c.to_numpy(zero_copy_only=False), "left").astype(kind)
                                 for e, c in zip(edges, lot.columns)], 1) if edges else np.zeros((lot.num_rows, 0), kind)
                y = lot.column(len(edges)).to_numpy(zero_copy_only=False)
                if np.isnan(y).any():
                    raise ValueError("a label is null")
                block = bins, y, lot.column(len(edges) + 1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    blocks = d.mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
    return Binned(blocks, list(features), edges, df.sparkSession)


def _sums(states: Iterator, growing, level: int, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Gradients and hessians (booster, node, bin of a feature, which) of the rows of one level;
    ``growing`` has for each booster its tree (None: done), left out fold and own features (None:
    all).  Others than these and the first, from which the sums of a node come, have no sums."""
    width, first = int(offsets[-1]), (1 << level) - 1
    total = np.zeros((len(growing), 1 << level, width, 2))
    for bins, y, fold, margin in states:
        for k, (tree, left_out, own) in enumerate(growing):
            if tree is None:
                continue
            node = tree.nodes(bins, level) - first
            rows = np.flatnonzero((node >= 0) & ~_left_out(fold, left_out))
            p = 1 / (1 + np.exp(-margin[rows, k]))
            node, weights = node[rows], (p - y[rows], p * (1 - p))
            of_feature = np.ascontiguousarray(bins[rows].T)
            for f in sorted({0, *_own(own, len(offsets) - 1).tolist()}):
                lo, hi = offsets[f:f + 2].tolist()
                at = node * (hi - lo) + of_feature[f]
                for which, w in enumerate(weights):
                    total[k, :, lo:hi, which] += np.bincount(at, w, (hi - lo) << level).reshape(1 << level, hi - lo)
    yield total


def _own(features: Sequence[int] | None, n: int) -> np.ndarray:
    """The places of a booster's features, ascending."""
    return np.arange(n) if features is None else np.sort(np.asarray(features, int))


def _split(booster: Booster, tree: _Tree, level: int, sums: np.ndarray, offsets: np.ndarray) -> None:
    """Best split of every node of a level; nodes without one are leaves."""
    own = _own(booster.features, len(offsets) - 1)
    first, lam = (1 << level) - 1, booster.penalty
    # the split points of all features side by side, short features padded at their end
    points = np.diff(offsets)[own] - 1
    at = np.arange(max(points, default=0))
    inside = at < points[:, None]
    cells = np.where(inside, offsets[own][:, None] + at, 0)
    for i in range(1 << level):
        node = first + i
        if not tree.used[node]:
            continue
        best = 0.0, -1, 0
        g, h = sums[i, offsets[0]:offsets[1]].sum(0)
        if cells.size:
            gl, hl = np.moveaxis(np.cumsum(sums[i][cells], 1), 2, 0)
            gr, hr = g - gl, h - hl
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (gl ** 2 / (hl + lam) + gr ** 2 / (hr + lam) - g ** 2 / (h + lam)) / 2
            # sums of floats differ in their last digits from run to run: gains alike to 9 digits are ties,
            # and the first feature and the lowest point of them wins
            gain = np.where(inside & (hl >= booster.child_weight) & (hr >= booster.child_weight), np.round(gain, 9), -np.inf)
            f, point = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[f, point] > 0:
                best = float(gain[f, point]), int(own[f]), int(point)
        tree.cover[node] = h
        tree.value[node] = -booster.rate * g / (h + lam)
        if best[1] < 0:
            continue
        tree.gain[node], tree.feature[node], tree.bin[node] = best
        tree.used[[2 * node + 1, 2 * node + 2]] = True
        gl, hl = sums[i, offsets[best[1]]:offsets[best[1]] + best[2] + 1].sum(0)
        for child, (a, b) in ((2 * node + 1, (gl, hl)), (2 * node + 2, (g - gl, h - hl))):
            tree.value[child], tree.cover[child] = -booster.rate * a / (b + lam), b


def fit(data: Binned, boosters: Sequence[Booster]):
    """Grow all boosters; returns the blocks (bins, label, fold, margins), whose
    margins have a column for each booster.  Trees that a booster has kept
    count among its own."""
    ensure_checkpoint_dir(data.spark)
    offsets, n = data.offsets, len(boosters)
    for b in boosters:
        b.grown = list(b.kept)
    begun, depth = [list(b.kept) for b in boosters], [b.depth for b in boosters]
    steps = max(b.trees - len(have) for b, have in zip(boosters, begun))

    def start(s):
        bins, y, fold = s
        margin = np.zeros((len(y), n))
        for k, have in enumerate(begun):
            for tree in have:
                margin[:, k] += tree.value[tree.nodes(bins, depth[k])]
        return bins, y, fold, margin

    state = data.blocks.map(start)
    for t in range(steps + 1):
        last = [b.grown[-1] if 0 < t <= b.trees - len(have) else None for b, have in zip(boosters, begun)]
        old = state
        if t:
            def add(s, last=last):
                bins, y, fold, margin = s
                margin = margin.copy()
                for k, tree in enumerate(last):
                    if tree is not None:
                        margin[:, k] += tree.value[tree.nodes(bins, depth[k])]
                return bins, y, fold, margin
            state = old.map(add)
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        if t and t % CHECKPOINT == 0:
            state.checkpoint()
        trees = [_Tree(b.depth) if len(b.grown) < b.trees else None for b in boosters]
        for level in range(max(b.depth for b in boosters)):
            growing = [(tree if tree is not None and level < b.depth and tree.used[(1 << level) - 1:(2 << level) - 1].any() else None, b.left_out, b.features)
                       for b, tree in zip(boosters, trees)]
            if all(tree is None for tree, *_ in growing):
                break
            sums = state.mapPartitions(lambda s, g=growing, v=level: _sums(s, g, v, offsets)).treeReduce(np.add)
            for k, (tree, *_) in enumerate(growing):
                if tree is not None:
                    _split(boosters[k], tree, level, sums[k], offsets)
        for b, tree in zip(boosters, trees):
            if tree is not None:
                b.grown.append(tree)
        if t == steps:
            # the last margins are made while those before are there: else each of the steps since
            # the last checkpoint runs again, with a Python worker of its own in every task
            state.count()
        if t:
            old.unpersist()
    return state


def held_out(data: Binned, state, boosters: Sequence[Booster]) -> DataFrame:
    """(model, y, p): every booster's probabilities on the rows that it left out."""
    left_out = [b.left_out for b in boosters]

    def pack(s):
        _, y, fold, margin = s
        rows, model = np.nonzero(np.stack([_left_out(fold, f) for f in left_out], 1))
        return (pickle.dumps((model.astype(np.int32), y[rows].astype(np.int32), 1 / (1 + np.exp(-margin[rows, model])))),)

    def unpack(batches):
        for batch in batches:
            for block in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pickle.loads(block.as_py())], ["model", "y", "p"])

    return data.spark.createDataFrame(state.map(pack), "block binary").mapInArrow(unpack, "model int, y int, p double")


def auc_by_model(scores: DataFrame) -> DataFrame:
    """(model, auc) of scores (model, y, p): Mann-Whitney U, ties one half."""
    counts = cut_lineage(scores.groupBy("model", "p").agg(F.count_if(F.col("y") == 1).cast("double").alias("pos"),
                                                          F.count_if(F.col("y") == 0).cast("double").alias("neg"))
                         .withColumn("k", F.struct("model", "p")))
    below = global_prefix_sums(counts, "k", ["neg"], suffix="_below", inclusive=False)
    one = below.groupBy("model").agg(F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("u"),
                                     F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # the models before are in the running sums; one row a model
    before = F.coalesce(F.sum("neg").over(Window.orderBy("model").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return one.select("model", ((F.col("u") - before * F.col("pos")) / F.nullif(F.col("pos") * F.col("neg"), F.lit(0.0))).alias("auc"))


def accuracy_by_model(scores: DataFrame) -> DataFrame:
    """(model, accuracy) at probability one half."""
    return scores.groupBy("model").agg(F.avg((F.col("y") == (F.col("p") >= 0.5).cast("int")).cast("double")).alias("accuracy"))


def with_folds(df: DataFrame, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """``fold``: k folds by a hash of the id."""
    return df.withColumn("fold", F.floor(hash_fraction(id_col, seed) * k).cast("int"))


def cross_validate(df: DataFrame, features: Sequence[str], label: str, settings: Sequence[dict], k: int, metric: str = "auc") -> DataFrame:
    """H7/H8: (params, mean_score, std_score, is_best) of settings over the k folds
    of ``fold``, all settings and folds at once."""
    data = binned(df, features, label, "fold")
    boosters = [Booster(**s, left_out=f) for s in settings for f in range(k)]
    scores = held_out(data, fit(data, boosters), boosters)
    by_model = auc_by_model(scores) if metric == "auc" else accuracy_by_model(scores)
    names = [",".join(f"{n}={v}" for n, v in sorted(s.items())) or "default" for s in settings]
    out = (by_model.withColumn("params", F.element_at(F.array(*map(F.lit, names)), (F.col("model") / k).cast("int") + 1))
           .groupBy("params").agg(F.avg(metric).alias("mean_score"), F.stddev_samp(metric).alias("std_score")))
    best = F.max_by("params", F.struct("mean_score", "params")).over(Window.partitionBy())  # one row a setting
    return cut_lineage(out.withColumn("is_best", F.col("params") == best))


def threshold_sweep(df: DataFrame, id_col: str, features: Sequence[str], label: str, settings: dict, trials: int = 50,
                    share: float = 0.1, steps: int = 50) -> DataFrame:
    """H15 with refits: every trial leaves out its own random ``share`` of the
    rows, fits its own booster on the rest and scores what it left out; all
    trials grow side by side.  Returns ``metrics.threshold_bands`` of them.

    A row's draws follow from its id alone: rows of one id go together, and a
    repeated run draws alike.  A trial that leaves out no row has no curve."""
    data = binned(df, features, label, F.xxhash64(F.col(f"`{id_col}`")))
    boosters = [Booster(**settings, left_out=Draw(t, share)) for t in range(trials)]
    state = fit(data, boosters)
    scores = held_out(data, state, boosters).withColumnRenamed("model", "trial")
    # trials x (steps + 1) counts at most; written, as the margins go
    counts = cut_lineage(threshold_counts(scores, "trial", "y", "p", steps))
    state.unpersist()
    data.blocks.unpersist()
    return threshold_bands(counts, steps)


def _drop_least(booster: Booster, names: Sequence[str]) -> int:
    """The feature of least gain leaves the booster's own; ties by name.  The trees
    before the first that splits on it are kept: a fit without it grows the same."""
    gains = booster.gains(len(names))
    worst = min(booster.features, key=lambda f: (gains[f], names[f]))
    booster.features = [f for f in booster.features if f != worst]
    same = next((i for i, t in enumerate(booster.grown) if (t.feature == worst).any()), len(booster.grown))
    booster.kept = booster.grown[:same]
    return worst


def rfe(df: DataFrame, features: Sequence[str], label: str, settings: dict, n_select: int = 1) -> list[tuple[str, int]]:
    """Features by rank; the least important one goes after every fit, and
    the ``n_select`` left share rank 1."""
    data, own = binned(df, features, label), Booster(**settings, features=list(range(len(features))))
    ranks = {}
    while len(own.features) > n_select:
        state = fit(data, [own])
        state.unpersist()
        worst = _drop_least(own, features)
        ranks[features[worst]] = len(own.features) - n_select + 2
    data.blocks.unpersist()
    return sorted((ranks | {features[f]: 1 for f in own.features}).items(), key=lambda kv: (kv[1], kv[0]))


def rfecv(df: DataFrame, features: Sequence[str], label: str, k: int, settings: dict) -> DataFrame:
    """(n_features, mean_auc, n_folds, is_support): every fold eliminates
    features on its training part, all folds at once, and scores its own rows."""
    data = binned(df, features, label, "fold")
    boosters = [Booster(**settings, features=list(range(len(features))), left_out=f) for f in range(k)]
    scores = []
    for n in range(len(features), 0, -1):
        state = fit(data, boosters)
        # the scores of each count are written, as the margins make way for the next count's
        scores.append(cut_lineage(held_out(data, state, boosters).withColumn("model", F.col("model") + n * k)))
        state.unpersist()
        for b in boosters:
            if n > 1:
                _drop_least(b, features)
    data.blocks.unpersist()
    every = scores[0]
    for s in scores[1:]:
        every = every.union(s)
    out = (auc_by_model(every).groupBy(F.floor(F.col("model") / k).cast("int").alias("n_features"))
           .agg(F.avg("auc").alias("mean_auc"), F.count(F.lit(1)).cast("int").alias("n_folds")))
    best = F.max_by("n_features", F.struct("mean_auc", -F.col("n_features"))).over(Window.partitionBy())  # one row a count
    return cut_lineage(out.withColumn("is_support", F.col("n_features") == best))

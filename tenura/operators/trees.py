"""Tree ensembles as data (I1-I5, H3/H6 scoring, H17).

A model is a *node table* DataFrame
``(tree_id, node_id, left, right, feature, threshold, value, cover, gain)``;
a split sends ``x <= threshold`` left (nulls right), leaves have
``left = right = -1`` and ``value`` in margin (log-odds) units, so
``p = sigmoid(sum of leaf values)``.

The node table is model-sized (trees x nodes), never data-sized; it is
collected once (after a size check) to generate scoring *expressions*,
so scoring a table is a projection inside whole-stage codegen.
"""

from __future__ import annotations

import itertools
import math
import os
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODE_SCHEMA = ("tree_id int, node_id int, left int, right int, feature string, threshold double, "
               "value double, cover double, gain double")

# The frozen test ensemble (FIXTURES.md section 5) over encoded panel columns.
# (tree_id, node_id, left, right, feature, threshold, value, cover, gain)
FROZEN_NODES = [
    (0, 0, 1, 2, "tenure", 30.0, 0.0, 1000.0, 120.0),
    (0, 1, 3, 4, "contract_Month-to-month", 0.5, 0.0, 400.0, 45.0),
    (0, 2, 5, 6, "monthly_charges", 200000.0, 0.0, 600.0, 30.0),
    (0, 3, -1, -1, None, None, -0.2, 150.0, 0.0),
    (0, 4, -1, -1, None, None, 0.6, 250.0, 0.0),
    (0, 5, -1, -1, None, None, -0.5, 350.0, 0.0),
    (0, 6, -1, -1, None, None, -0.1, 250.0, 0.0),
    (1, 0, 1, 2, "dependents", 0.5, 0.0, 1000.0, 60.0),
    (1, 1, 3, 4, "tenure", 12.0, 0.0, 700.0, 40.0),
    (1, 2, 5, 6, "online_security", 0.5, 0.0, 300.0, 15.0),
    (1, 3, -1, -1, None, None, 0.3, 200.0, 0.0),
    (1, 4, -1, -1, None, None, -0.05, 500.0, 0.0),
    (1, 5, -1, -1, None, None, 0.1, 180.0, 0.0),
    (1, 6, -1, -1, None, None, -0.25, 120.0, 0.0),
    (2, 0, 1, 2, "total_charges", 2000000.0, 0.0, 1000.0, 80.0),
    (2, 1, 3, 4, "tenure", 6.0, 0.0, 450.0, 35.0),
    (2, 2, 5, 6, "monthly_charges", 100000.0, 0.0, 550.0, 25.0),
    (2, 3, -1, -1, None, None, 0.4, 120.0, 0.0),
    (2, 4, 7, 8, "contract_Two year", 0.5, 0.0, 330.0, 20.0),
    (2, 5, -1, -1, None, None, -0.35, 300.0, 0.0),
    (2, 6, -1, -1, None, None, -0.1, 250.0, 0.0),
    (2, 7, -1, -1, None, None, 0.05, 250.0, 0.0),
    (2, 8, -1, -1, None, None, -0.3, 80.0, 0.0),
]


def frozen_node_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FROZEN_NODES, NODE_SCHEMA)


def num(v: float) -> str:
    """Double literal valid in Spark SQL and DuckDB (a bare ``0.6`` would be
    DECIMAL in Spark)."""
    r = repr(float(v))
    return r if ("e" in r or "E" in r) else r + "E0"


@dataclass
class Node:
    tree_id: int
    node_id: int
    left: int
    right: int
    feature: str | None
    threshold: float | None
    value: float
    cover: float
    gain: float


class Ensemble:
    """Driver-side view of a node table (model-sized, checked)."""

    def __init__(self, rows, base_margin: float = 0.0):
        self.nodes = {}
        for r in rows:
            n = Node(*[r[k] for k in ("tree_id", "node_id", "left", "right", "feature", "threshold",
                                       "value", "cover", "gain")]) if not isinstance(r, tuple) else Node(*r)
            self.nodes[(n.tree_id, n.node_id)] = n
        self.trees = sorted({k[0] for k in self.nodes})
        self.base_margin = base_margin

    @classmethod
    def from_table(cls, nodes: DataFrame, base_margin: float = 0.0) -> "Ensemble":
        # a fitted model: its size is the trees' and not the data's
        return cls(nodes.collect(), base_margin)

    def root(self, t):
        return self.nodes[(t, 0)]

    def features(self) -> list[str]:
        return sorted({n.feature for n in self.nodes.values() if n.feature is not None})

    # ------------------------------------------------------------- scoring text
    def margin_sql(self, ref: Callable[[str], str]) -> str:
        """Nested CASE text; ``ref(feature)`` renders a column reference."""
        def walk(n: Node) -> str:
            if n.left < 0:
                return num(n.value)
            lt = walk(self.nodes[(n.tree_id, n.left)])
            rt = walk(self.nodes[(n.tree_id, n.right)])
            return f"(CASE WHEN {ref(n.feature)} <= {num(n.threshold)} THEN {lt} ELSE {rt} END)"
        parts = [walk(self.root(t)) for t in self.trees]
        return "(" + " + ".join([num(self.base_margin)] + parts) + ")"

    def recursion_pd_sql(self, subset: set[str], ref: Callable[[str], str]) -> str:
        """Tree-recursion partial dependence E[f | x_S]: splits on S follow x,
        other splits mix children by cover share (independent of the
        leaf-path formula used on the Spark side)."""
        def walk(n: Node) -> str:
            if n.left < 0:
                return num(n.value)
            L, R = self.nodes[(n.tree_id, n.left)], self.nodes[(n.tree_id, n.right)]
            lt, rt = walk(L), walk(R)
            if n.feature in subset:
                return f"(CASE WHEN {ref(n.feature)} <= {num(n.threshold)} THEN {lt} ELSE {rt} END)"
            return f"(({num(L.cover)} * {lt} + {num(R.cover)} * {rt}) / {num(n.cover)})"
        parts = [walk(self.root(t)) for t in self.trees]
        return "(" + " + ".join([num(self.base_margin)] + parts) + ")"

    # ------------------------------------------------------------- leaf paths
    def leaf_paths(self):
        """Per leaf: value, and per distinct path feature its interval
        (lo, hi] and cover-ratio product z."""
        out = []
        for t in self.trees:
            def walk(n: Node, cons: dict):
                if n.left < 0:
                    out.append((t, n.node_id, n.value, cons))
                    return
                L, R = self.nodes[(t, n.left)], self.nodes[(t, n.right)]
                for child, is_left in ((L, True), (R, False)):
                    c = {k: list(v) for k, v in cons.items()}
                    lo, hi, z = c.get(n.feature, [-math.inf, math.inf, 1.0])
                    if is_left:
                        hi = min(hi, n.threshold)
                    else:
                        lo = max(lo, n.threshold)
                    c[n.feature] = [lo, hi, z * child.cover / n.cover]
                    walk(child, c)
            walk(self.root(t), {})
        return out


def in_interval(x: Column, lo: float, hi: float) -> Column:
    """1.0 when x in (lo, hi], else 0.0 (null x counts as outside)."""
    c = F.lit(True)
    if lo != -math.inf:
        c = c & (x > F.lit(lo))
    if hi != math.inf:
        c = c & (x <= F.lit(hi))
    return F.coalesce(c, F.lit(False)).cast("double")


def spark_ref(name: str) -> str:
    return f"`{name}`"


def duck_ref(name: str) -> str:
    return '"' + name + '"'


def margin_col(ens: Ensemble, overrides: dict[str, str] | None = None) -> Column:
    """Margin as a Spark column; ``overrides`` maps a feature to another
    column name (used for grids and permutations)."""
    ov = overrides or {}
    return F.expr(ens.margin_sql(lambda f: spark_ref(ov.get(f, f))))


def score(df: DataFrame, ens: Ensemble, id_cols: Sequence[str], label: str | None = None,
          threshold: float = 0.5) -> DataFrame:
    """H3/H6: (ids, label, margin, p0, p1, pred)."""
    m = margin_col(ens)
    cols = [*id_cols] + ([label] if label else [])
    r = df.select(*cols, m.alias("margin"))
    p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
    return r.select(*cols, "margin", (F.lit(1.0) - p1).alias("p0"), p1.alias("p1"),
                    (p1 >= threshold).cast("int").alias("pred"))


def leaf_probability(nodes: DataFrame) -> DataFrame:
    """Leaf value -> sigmoid."""
    return nodes.where(F.col("left") < 0).select(
        "tree_id", "node_id", "value", (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("value")))).alias("probability"))


def importance(nodes: DataFrame, kind: str = "weight") -> DataFrame:
    """Split count, mean gain or mean cover per feature,
    normalised share, sorted descending (ties by name)."""
    sp = nodes.where(F.col("left") >= 0)
    agg = {"weight": F.count(F.lit(1)).cast("double"), "gain": F.avg("gain"), "cover": F.avg("cover")}[kind]
    g = sp.groupBy("feature").agg(agg.alias("importance"))
    return g.withColumn("share", F.col("importance") / F.sum("importance").over(Window.partitionBy()))


def node_table_from_gbt(model, feature_names: Sequence[str], spark: SparkSession) -> DataFrame:
    """Flatten a fitted ``GBTClassificationModel`` into the node table.

    The model is saved under the session's checkpoint folder (a shared
    folder on a cluster) and its node parquet is read back as a DataFrame.
    Leaf value in margin units = 2 * tree weight * prediction (log-loss GBT).
    """
    from tenura.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"gbt-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    data = spark.read.parquet(os.path.join(path, "data"))
    meta = spark.read.parquet(os.path.join(path, "treesMetadata")).select(
        F.col("_1").cast("int").alias("tree_id"), F.col("_3").cast("double").alias("weight"))
    names = F.array(*[F.lit(n) for n in feature_names])
    nd = data.select(F.col("treeID").cast("int").alias("tree_id"), "nodeData.*")
    nd = nd.join(F.broadcast(meta), "tree_id")
    is_leaf = F.col("leftChild") < 0
    return nd.select(
        "tree_id", F.col("id").cast("int").alias("node_id"),
        F.col("leftChild").cast("int").alias("left"), F.col("rightChild").cast("int").alias("right"),
        F.when(~is_leaf, F.element_at(names, F.col("split.featureIndex") + 1)).alias("feature"),
        F.when(~is_leaf, F.element_at(F.col("split.leftCategoriesOrThreshold"), 1)).alias("threshold"),
        F.when(is_leaf, 2.0 * F.col("weight") * F.col("prediction")).otherwise(F.lit(0.0)).alias("value"),
        F.element_at(F.col("impurityStats"), 1).alias("cover"),
        F.when(~is_leaf, F.col("gain")).otherwise(F.lit(0.0)).alias("gain"))


def shapley_weight(s: int, m: int) -> float:
    return math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m)


def subsets(items: Sequence[str]):
    for r in range(len(items) + 1):
        yield from itertools.combinations(items, r)


def leaf_id_sql(ens: Ensemble, tree: int, ref: Callable[[str], str]) -> str:
    """CASE text returning the leaf node id reached in one tree."""
    def walk(n: Node) -> str:
        if n.left < 0:
            return str(n.node_id)
        lt = walk(ens.nodes[(tree, n.left)])
        rt = walk(ens.nodes[(tree, n.right)])
        return f"(CASE WHEN {ref(n.feature)} <= {num(n.threshold)} THEN {lt} ELSE {rt} END)"
    return walk(ens.root(tree))


def node_stats(ens: Ensemble, df: DataFrame, label: str) -> DataFrame:
    """I1 on data: the ensemble's node table with ``cover`` = rows of ``df``
    reaching each node and ``gain`` = drop in label sum of squares at each
    split.  Rows are reduced to (tree, leaf) sums in one pass; internal
    nodes are sums over their leaves (model-sized ancestor list)."""
    y = F.col(label).cast("double")
    per_tree = F.explode(F.array(*[F.struct(F.lit(t).alias("tree_id"),
                                            F.expr(leaf_id_sql(ens, t, spark_ref)).alias("leaf"))
                                   for t in ens.trees])).alias("tl")
    leaves = (df.select(y.alias("_y"), per_tree).select("tl.*", "_y")
              .groupBy("tree_id", "leaf").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("_y").alias("sy"),
                                              F.sum(F.col("_y") * F.col("_y")).alias("syy")))
    anc = []
    for t in ens.trees:
        def walk(n: Node, path: list[int]):
            p = path + [n.node_id]
            if n.left < 0:
                for a in p:
                    anc.append((t, n.node_id, a))
                return
            walk(ens.nodes[(t, n.left)], p)
            walk(ens.nodes[(t, n.right)], p)
        walk(ens.root(t), [])
    spark = df.sparkSession
    anc_df = F.broadcast(spark.createDataFrame(anc, "tree_id int, leaf int, node_id int"))
    st = leaves.join(anc_df, ["tree_id", "leaf"]).groupBy("tree_id", "node_id").agg(
        F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"))
    sse = F.col("syy") - F.when(F.col("n") > 0, F.col("sy") * F.col("sy") / F.col("n")).otherwise(F.lit(0.0))
    st = st.select("tree_id", "node_id", "n", sse.alias("sse"))
    nodes = spark.createDataFrame([(n.tree_id, n.node_id, n.left, n.right, n.feature, n.threshold, n.value)
                                   for n in ens.nodes.values()],
                                  "tree_id int, node_id int, left int, right int, feature string, threshold double, value double")
    j = nodes.join(st, ["tree_id", "node_id"], "left")
    lch = st.select("tree_id", F.col("node_id").alias("left"), F.col("sse").alias("sse_l"))
    rch = st.select("tree_id", F.col("node_id").alias("right"), F.col("sse").alias("sse_r"))
    j = j.join(lch, ["tree_id", "left"], "left").join(rch, ["tree_id", "right"], "left")
    gain = F.when(F.col("left") >= 0, F.coalesce(F.col("sse"), F.lit(0.0)) - F.coalesce(F.col("sse_l"), F.lit(0.0))
                  - F.coalesce(F.col("sse_r"), F.lit(0.0))).otherwise(F.lit(0.0))
    return j.select("tree_id", "node_id", "left", "right", "feature", "threshold", "value",
                    F.coalesce(F.col("n"), F.lit(0.0)).alias("cover"), gain.alias("gain"))

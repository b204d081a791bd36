"""Classification and regression metrics (H9-H16) as aggregates.

Rank-based metrics (AUC on scores, ROC) reduce rows to one row per
distinct score first and take running sums over the score order with
range partitioning, so no step sees all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.functions.ordinal import global_prefix_sums
from tenura.session import cut_lineage


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    """H9: all four (actual, predicted) cells, label order [1, 0]."""
    y, p = F.col(label), F.col(pred)
    row = df.agg(F.count_if((y == 1) & (p == 1)).alias("n11"), F.count_if((y == 1) & (p == 0)).alias("n10"),
                 F.count_if((y == 0) & (p == 1)).alias("n01"), F.count_if((y == 0) & (p == 0)).alias("n00"))
    cells = [(1, 1, "n11", 0), (1, 0, "n10", 1), (0, 1, "n01", 2), (0, 0, "n00", 3)]
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(c).alias("n"), F.lit(o).alias("cell"))
        for a, b, c, o in cells])).alias("s")).select("s.actual", "s.predicted", "s.n", "s.cell")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, f1, support per class, accuracy,
    macro and support-weighted averages."""
    y, p = F.col(label), F.col(pred)
    c = df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
               F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))

    def cls(t, f_p, f_n):
        pr, rc = _ratio(t, t + f_p), _ratio(t, t + f_n)
        return pr, rc, F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(F.lit(0.0)), (t + f_n)

    p1, r1, f1, s1 = cls(tp, fp, fn)
    p0, r0, f0, s0 = cls(tn, fn, fp)
    n = (tp + fp + fn + tn).cast("double")
    acc = _ratio(tp + tn, tp + fp + fn + tn)
    rows = [
        ("1", p1, r1, f1, s1), ("0", p0, r0, f0, s0),
        ("macro avg", (p1 + p0) / 2, (r1 + r0) / 2, (f1 + f0) / 2, s1 + s0),
        ("weighted avg", (p1 * s1 + p0 * s0) / n, (r1 * s1 + r0 * s0) / n, (f1 * s1 + f0 * s0) / n, s1 + s0),
        ("accuracy", acc, acc, acc, s1 + s0),
    ]
    return c.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("class"), a.alias("precision"), b.alias("recall"), d.alias("f1"), e.cast("long").alias("support"))
        for k, a, b, d, e in rows])).alias("s")).select("s.*")


def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    """H11."""
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def auc_hard(df: DataFrame, label: str, pred: str) -> DataFrame:
    """H12 (as printed by the reference): AUC of 0/1 predictions = (TPR + TNR) / 2."""
    y, p = F.col(label), F.col(pred)
    c = df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if(y == 1).alias("pos"),
               F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if(y == 0).alias("neg"))
    return c.select(((_ratio(F.col("tp"), F.col("pos")) + _ratio(F.col("tn"), F.col("neg"))) / 2).alias("auc_hard"))


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row per distinct score, written once (it is read by several
    passes: size check, totals, running sums)."""
    sc = df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(label) == 1).cast("double").alias("pos"), F.count_if(F.col(label) == 0).cast("double").alias("neg"))
    return cut_lineage(sc)


def auc_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """H12 on scores: Mann-Whitney U / (P N), ties counted one half."""
    sc = score_counts(df, label, score)
    cum = global_prefix_sums(sc, "s", ["neg"], suffix="_below", inclusive=False)
    return cum.agg((F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg")))
                    / (F.sum("pos") * F.sum("neg"))).alias("auc_score"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """One point per distinct score used as threshold (score >= thr
    is positive): (threshold, fpr, tpr)."""
    sc = score_counts(df, label, score).withColumn("neg_s", -F.col("s"))
    # class totals from the (small) per-score table, not from the rows again
    P = sc.select(F.sum("pos")).scalar()
    N = sc.select(F.sum("neg")).scalar()
    cum = global_prefix_sums(sc, "neg_s", ["pos", "neg"], suffix="_cum", inclusive=True)
    return cum.select(F.col("s").alias("threshold"), (F.col("neg_cum") / N.cast("double")).alias("fpr"),
                      (F.col("pos_cum") / P.cast("double")).alias("tpr"))


def optimal_threshold(roc: DataFrame) -> DataFrame:
    """argmax(tpr - fpr); among ties the highest threshold."""
    key = F.struct((F.col("tpr") - F.col("fpr")).alias("j"), F.col("threshold").alias("t"))
    return roc.agg(F.max_by("threshold", key).alias("threshold"), F.max(F.col("tpr") - F.col("fpr")).alias("youden_j"))


def threshold_sweep(df: DataFrame, id_col: str, label: str, score: str, trials: int = 10, test_fraction: float = 0.2,
                    steps: int = 20, seed: int = 0) -> DataFrame:
    """Per threshold k/steps, precision, recall, F1 and queue rate on
    the test part of ``trials`` hash splits; median and 10/90 band over
    trials.  Rows are reduced to (trial, threshold bucket) counts first."""
    from tenura.operators.features import hash_fraction
    tr = F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")
    r = df.select(id_col, label, score, tr).where(hash_fraction(F.concat_ws("|", F.col(id_col).cast("string"),
                                                                              F.col("trial").cast("string")), seed)
                                                   < test_fraction)
    return threshold_bands(threshold_counts(r, "trial", label, score, steps), steps)


def threshold_counts(df: DataFrame, trial: str, label: str, score: str, steps: int) -> DataFrame:
    """(trial, bk, pos, all): rows of each trial by the highest threshold bk/steps that their score reaches."""
    b = F.least(F.floor(F.col(score) * steps), F.lit(steps)).cast("int")
    return df.groupBy(F.col(trial).alias("trial"), b.alias("bk")).agg(F.count_if(F.col(label) == 1).alias("pos"),
                                                                      F.count(F.lit(1)).alias("all"))


def threshold_bands(g: DataFrame, steps: int) -> DataFrame:
    """Per threshold k/steps the median and 10/90 band over the trials of
    ``threshold_counts``: precision, recall, F1 and queue rate."""
    th = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k")
    tot = g.groupBy("trial").agg(F.sum("pos").alias("P"), F.sum("all").alias("N"))
    # counts with bucket >= k for each threshold k (buckets and thresholds both bounded by steps)
    grid = tot.select("trial", "P", "N", th)
    j = grid.join(g, "trial").where(F.col("bk") >= F.col("k")).groupBy("trial", "k", "P", "N").agg(
        F.sum("pos").alias("tp"), F.sum("all").alias("flagged"))
    full = grid.join(j.select("trial", "k", "tp", "flagged"), ["trial", "k"], "left").fillna(0, ["tp", "flagged"])
    prec = F.when(F.col("flagged") > 0, F.col("tp") / F.col("flagged")).otherwise(F.lit(0.0))
    rec = F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(F.lit(0.0))
    m = full.select("trial", (F.col("k") / F.lit(float(steps))).alias("threshold"), prec.alias("precision"),
                    rec.alias("recall"), (F.col("flagged") / F.col("N")).alias("queue_rate"))
    m = m.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall")
                                  / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))
    aggs = []
    for c in ("precision", "recall", "f1", "queue_rate"):
        aggs += [F.percentile(c, 0.5).alias(f"{c}_median"), F.percentile(c, 0.1).alias(f"{c}_p10"),
                 F.percentile(c, 0.9).alias(f"{c}_p90")]
    return m.groupBy("threshold").agg(*aggs)


def r2_rmse(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """R^2 = 1 - SSE/SST and RMSE."""
    y, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    s = df.agg(F.sum((y - p) * (y - p)).alias("sse"), F.avg(y).alias("ybar"), F.count(F.lit(1)).alias("n"),
               F.sum(y * y).alias("syy"), F.sum(y).alias("sy"))
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return s.select((F.lit(1.0) - F.col("sse") / sst).alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def prediction_counts(df: DataFrame, pred: str) -> DataFrame:
    """Class counts of predictions."""
    return df.groupBy(F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


"""Sums over the lots of a fit."""

import numpy as np

from tenura.llm import toxicity as T


def _rows(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} " * (i % 5) + "end") for i in range(60)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")


def test_all_lots_are_added(spark, monkeypatch):
    monkeypatch.setattr(T, "LOT", 4)
    docs, labels = _rows(spark)
    rows = T.training_rows(docs, labels, lots=9)
    lots = T._lots(rows)
    n, toxic, words, each = T._added(lots, lambda lot, rows, label, language, held: [
        np.array(len(rows)), np.array(label).sum(), np.array(sum(len(r) for r in rows)), np.bincount(label, minlength=2)])
    found = rows.collect()
    assert n == len(found) and toxic == sum(r.toxic for r in found) and each.tolist() == [n - toxic, toxic]
    assert words == sum(len(r.text.split()) for r in found)
    assert T._added(lots.where("false"), lambda *lot: [np.array(1)]) is None


def test_a_fit_makes_no_second_kind_of_worker(spark, monkeypatch):
    """Passes run as Arrow maps; RDD passes have Python workers of their own beside them."""
    ran = []
    monkeypatch.setattr("pyspark.RDD.treeReduce", lambda *a: ran.append(a))
    kind = type(spark.range(1))
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **k: ran.append("arrow") or plain(self, *a, **k))
    model = T.train(*_rows(spark))
    assert model.constant is None and set(ran) == {"arrow"}

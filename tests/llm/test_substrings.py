"""Substring dedup against brute force over all 50-word windows."""
import hashlib
import random

import numpy as np
import pytest

from tenura.llm import substrings as S

W = 50


def brute(rows):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - W + 1):
            key = tuple(w[k:k + W])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - W + 1):
            if i is not None and first[tuple(w[k:k + W])] < i:
                gone[k:k + W] = [True] * W
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.remove_repeats(df).select("doc_id", "__repeats.*").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def texts(seed, n, vocabulary):
    rng = random.Random(seed)
    word = [f"w{k}" for k in range(vocabulary)]
    passages = [[rng.choice(word) for _ in range(rng.choice((49, 50, 51, 60, 90, 140)))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [rng.choice(word) for _ in range(rng.randint(0, 90))]
            if rng.random() < 0.7:
                p = list(rng.choice(passages))
                if rng.random() < 0.4:
                    p[rng.randrange(len(p))] = "edit"
                a = rng.randint(0, 20)
                w += p[a:]
        rows.append((i, rng.choice((" ", "\n", "  \t")).join(w)))
    return rows


@pytest.mark.parametrize("seed,vocabulary", [(1, 4000), (2, 300), (3, 2)])
def test_random_passages(spark, seed, vocabulary):
    check(spark, texts(seed, 60, vocabulary))


def test_parts_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_WORDS", 130)
    rows = texts(9, 12, 900)
    long = " ".join(t for _, t in rows)
    check(spark, [*rows, (50, long), (51, long + " more words"), (7, "x " * 500), (52, "x " * 400)])


def test_edge_cases(spark):
    p = " ".join(f"p{k}" for k in range(70))
    check(spark, [(1, None), (2, ""), (3, " \n "), (4, p), (5, p), (5, p), (6, "p1 p2"), (None, p), (8, "é " + p),
                  (9, "y " * 49), (10, "y " * 49)])


def test_copies_with_one_id_are_not_each_other(spark):
    p = " ".join(f"p{k}" for k in range(60))
    check(spark, [(3, p), (3, p), (3, p + " end")])


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, doc string, n int, symbol string")
    out = S.remove_repeats(df)
    assert out.count() == 0 and out.columns[:-1] == df.columns
    p = " ".join(f"p{k}" for k in range(60))
    rows = [(1, "start\n" + p + "\nend", "a", 1, None), (2, "other\n" + p + "\ntail  words", "b", None, "c")]
    kept = S.remove_repeats(spark.createDataFrame(rows, df.schema)).orderBy("doc_id").collect()
    assert [r["text"] for r in kept] == [rows[0][1], "other\ntail  words"]
    assert kept[1]["doc"] == "b" and kept[1]["symbol"] == "c"


def test_equal_windows_choose_equal_rows():
    """A passage gets the same symbols wherever it stands."""
    rng = np.random.default_rng(4)
    passage = rng.integers(1, 2**63, 400).astype(np.uint64)
    passage[100:180] = passage[100]
    alone = S.windows(passage, np.array([0, 400]))
    framed = np.concatenate([rng.integers(1, 2**63, 33).astype(np.uint64), passage, rng.integers(1, 2**63, 41).astype(np.uint64)])
    inside = S.windows(framed, np.array([0, len(framed)]))

    def by_window(rows, shift):
        return {int(p) + k - shift: int(s) for s, _, _, p, n in zip(*rows) for k in range(int(n))}
    a, b = by_window(alone, 0), by_window(inside, 33)
    assert all(a[k] == b[k] for k in range(351))
    assert set(a) == set(range(351))

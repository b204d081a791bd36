"""Product codes against a search over all entries."""

import hashlib
import math

import numpy as np
import pytest

from tenura.llm import vectorcodes as V


def brute(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error, sha) by plain loops over integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], l) for i, v, l in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def find(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [find(c[p], books[p])[1] for c in cut]
            for k in set(own):
                mine = [c[p] for c, o in zip(cut, own) if o == k]
                books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [[find(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, l), e in zip(kept, error):
        by_label[l] = by_label.get(l, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), e, by_label[l], sha) for (i, _, l), f, e in zip(kept, found, error)]


def got(df, **more):
    return sorted(map(tuple, V.compress(df, **more).collect()), key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int, code string"


@pytest.mark.parametrize("n, entries", [(40, 256), (300, 16), (90, 5)])
def test_codes_equal_brute_force(spark, n, entries):
    rng = np.random.default_rng(n)
    # coarse values make ties, repeats make equal entries
    rows = [(int(i), (rng.integers(-4, 5, 8) / 4).astype(np.float32).tolist(), int(rng.integers(0, 3)) or None, "x") for i in rng.permutation(n)]
    rows += rows[:5] + [(None, rows[3][1], 2, "x"), (n, None, 1, "x"), (n + 1, [float("nan")] * 8, 1, "x"),
                        (n + 2, [float("inf")] + [0.0] * 7, 1, "x"), (n + 3, [None] + [0.0] * 7, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(df, entries=entries) == sorted(brute([r[:3] for r in rows], entries=entries), key=repr)


def test_nearest_visits_few_and_finds_all():
    rng = np.random.default_rng(2)
    centres = rng.integers(-5000, 5000, (64, 6))
    x = centres[rng.integers(0, 64, 500)] + rng.integers(-40, 40, (500, 6))
    order, apart = V.neighbour_lists(centres)
    best, far = V.nearest(x, centres, order, apart)
    every = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (far == every.min(1)).all()


def test_empty_and_refused(spark):
    assert V.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    assert V.compress(spark.createDataFrame([(1, None, 1, "x")], SCHEMA)).count() == 0
    for rows in ([(1, [1.0] * 8, 1, "x"), (2, [1.0] * 4, 1, "x")], [(1, [1.0] * 6, 1, "x")], [(1, [float(1 << 20)] * 4, 1, "x")]):
        with pytest.raises(ValueError):
            V.compress(spark.createDataFrame(rows, SCHEMA))

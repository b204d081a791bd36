"""MinHash groups against the Jaccard similarity of all pairs."""

import random

import numpy as np
import pytest

from tenura.llm import minhash as M


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) from all pairs of sets."""
    sets = []
    for _, t in rows:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets.append({" ".join(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {" ".join(w)} - {""})
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                group[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    found = [(d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]
    return sorted(((*f, f[2] == f[0] if None not in (f[0], f[2]) else None) for f in found), key=repr)


def got(df):
    return sorted(map(tuple, M.near_duplicates(df).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, node int, bands string").repartition(3)


def family(rng, n, edits, words=80, vocabulary=3000):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base if not out or rng.random() < .5 else rng.choice(out))
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"w{rng.randrange(vocabulary)}"
        out.append(own)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("centres", [4])
def test_families_of_all_similarities(spark, monkeypatch, centres):
    monkeypatch.setattr(M, "CENTRES", centres)
    rng = random.Random(centres)
    texts = [t for edits in (2, 4, 7) for t in family(rng, 40, edits)] + family(rng, 30, 3, words=8) + family(rng, 30, 2, words=300)
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts))
    assert got(frame(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a B"), (6, "a b c d e"), (6, "a b c d e"), (6, "other words stand right here"),
            (None, "a b c d e"), (None, "nobody else has these words"), (7, "é É x y"), (8, "É É x y"), (9, "a\x0bb\x1cc d"), (10, "z " * 40000),
            (11, "z z z z")]
    assert got(frame(spark, rows)) == brute(rows)
    assert got(frame(spark, rows).where("false")) == []


def test_a_common_passage_and_a_chain(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 30)))) for i in range(150)]
    step = [f"c{i}" for i in range(60)]
    for i in range(40):  # neighbours are similar, the ends are not
        rows.append((1000 - i, " ".join(step[i:] + [f"c{k}" for k in range(60, 60 + i)])))
    assert got(frame(spark, rows)) == brute(rows)


def test_signatures_agree_as_sets_do():
    rng = np.random.default_rng(1)
    for n in (5, 60, 2000):
        h = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2))
        a, b = np.sort(h[: n]), np.sort(h[n // 10: n + n // 10])
        sig = M.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - j) < .12
        assert np.isin(sig[0], a).all()


def test_parities_differ_by_no_more_than_the_sets():
    rng = np.random.default_rng(4)
    for n in (3, 90, 900):
        h = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))
        for cut in (0, 1, n // 3, n):
            a, b = h[:n], h[cut:n + cut]
            x, y = M.parities(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])).view(np.uint8)
            assert np.unpackbits(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_pairs_well_below_the_threshold_are_no_candidates(spark, monkeypatch):
    tested, plain = [], M.confirmed
    monkeypatch.setattr(M, "confirmed", lambda edges, *more: tested.append(edges) or plain(edges, *more))
    rng = random.Random(2)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for d in range(60):  # five of 87 shingles are a text's own, so two texts share 0.63 to 0.65 of theirs
        own = list(base)
        for i in rng.sample(range(4, 86, 4), 5):
            own[i] = f"own{d}"
        rows.append((d, " ".join(own)))
    assert got(frame(spark, rows)) == brute(rows)
    assert sum(t.count() for t in tested) < 60 * 59 / 2 / 10

"""SimHash near-duplicates against brute force."""
import numpy as np
import pytest
import xxhash

from tenura.llm import simhash as S
from tenura.llm.graph import components


def brute_fp(text, k=4):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in zip(ids, fps):
        for j, b in zip(ids, fps):
            if bin(a ^ b).count("1") <= radius:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.near_duplicates(df).collect()}
    fps = [brute_fp(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], fps)
    assert got == {i: (f"{f:016x}", want[i]) for (i, _), f in zip(rows, fps)}


def test_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    check(spark, [(r["doc_id"], r["text"]) for r in d])


def test_edge_cases(spark):
    check(spark, [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "É"), (7, "x " * 70000)])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = S.near_duplicates(df)
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


@pytest.mark.parametrize("most", [1 << 25, 2000])
def test_links_are_exact(spark, monkeypatch, most):
    """Clusters around centres: every link within 4 bits, whole and in parts."""
    monkeypatch.setattr(S, "MOST_VALUES", most)
    monkeypatch.setattr(S, "VALUES_PER_BLOCK", 1 << 12)
    rng = np.random.default_rng(5)
    fps = []
    for c in rng.integers(0, 2**63, 12):
        for _ in range(25):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, node long")
    got = {r["node"]: r["component"] for r in components(S.links(nodes)).collect()}
    want = brute_components(range(len(fps)), fps)
    assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_keep_one(spark):
    rows = [(3, "a b c d e", "x"), (1, "a b c d e", "y"), (1, "a b c d e", "y"), (9, "quite other words stand here", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = S.keep_one(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 9]


def test_keep_one_of_an_id_on_several_texts(spark):
    """Id 5 stands on a copy of document 3 and on a text of its own, id 7 on two texts and on one text with two notes."""
    rows = [(3, "a b c d e", "x"), (5, "a b c d e", "y"), (5, "quite other words stand here", "z"),
            (7, "one more text of some words", "v"), (7, "one more text of some words", "u"), (7, "nothing like the others at all", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string")
    want = [rows[0], rows[2], rows[4], rows[5]]
    assert sorted(map(tuple, S.keep_one(df).collect())) == sorted(want)
    assert sorted(map(tuple, S.keep_one(df.orderBy("note").repartition(3)).collect())) == sorted(want)

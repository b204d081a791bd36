"""Token files, packing and edit-aware counts against the tokenizers library."""
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenura.llm import packing as P
from tenura.llm import tokencounts as C
from tenura.llm import tokenfile as O
from tenura.llm.scratch import shared_path
from tenura.llm.tokens import encoder, vocabulary

PLAIN = Tokenizer.from_file(vocabulary())
ODD = [None, "", " ", "\n\n", "a    b", "it's <|endoftext|> here", "x" * 3000, "tab\t \tend ", "漢字\U0001f600 　z",
       "word " * 2500]


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sample(spark, n=120):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(n).collect()
    return [(r["doc_id"], r["text"]) for r in rows] + [(1000 + k, t) for k, t in enumerate(ODD)] + [(3, "again")]


def test_encoder_equals_the_library():
    own, rng = encoder(vocabulary()), random.Random(1)
    letters = "ab éßñ'st\n\t\r  \x85\xa0 　\x1c漢\U0001f60012²ªǅ,.!|<>endoftext́​"
    for _ in range(4000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert own.ids(s).tolist() == plain(s), repr(s)


def test_token_files_round_trip(spark):
    rows = sample(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = shared_path(spark, "t")
    O.write_tokens(df, path)
    tokens = O.read_tokens(spark, path)
    got = (O.checksums(tokens).join(O.starts(tokens), "segment")
           .select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32").collect())
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*plain(t), 2]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(tuple(r) for r in got) == sorted(want)
    # files hold ascending ids, and a filter on doc_id reaches the reader
    one = tokens.where("doc_id = 1001")
    assert "doc_id,1001" in one._jdf.queryExecution().toString().replace(" ", "").replace("EqualTo(", "")
    assert one.first()["ids"] == [2]


def test_token_file_of_nothing(spark):
    path = shared_path(spark, "t")
    O.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path)
    assert O.read_tokens(spark, path).count() == 0


def test_packing(spark):
    rows = sample(spark)
    got = P.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), with_ids=True).collect()
    want = []
    for i, t in rows:
        ids = [*plain(t), 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want += [(i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert all(crc(r["ids"]) == r["ids_crc32"] for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(w[3] for w in want)
    assert -(-total // 1024) <= len(bins) <= 1.03 * total / 1024 + 2


def test_packing_of_nothing(spark):
    out = P.pack_documents(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and "sequence_id" in out.columns


def fewest(sizes, capacity):
    """Fewest bins by exhaustive search."""
    best = len(sizes)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[k] <= capacity and bins[b] not in bins[:b]:
                go(k + 1, bins[:b] + [bins[b] + sizes[k]] + bins[b + 1:])
        go(k + 1, [*bins, sizes[k]])
    go(0, [])
    return best


def test_plan_against_exhaustive_search():
    rng = random.Random(2)
    more = 0
    for _ in range(60):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = np.bincount(sizes, minlength=21)
        plan = P.plan(counts, 20)
        used = np.zeros(21, int)
        for f, n in plan:
            assert sum(f) <= 20
            for s in f:
                used[s] += n
        assert (used == counts).all()
        n, least = sum(n for _, n in plan), fewest(sizes, 20)
        assert P.lower_bound(counts * (np.arange(21) < 20), 20) + counts[20] <= least <= n
        more += n - least
    assert more <= 1


def test_search_beats_best_fit():
    sizes = np.random.default_rng(0).integers(250, 500, 3000)
    counts = np.bincount(sizes, minlength=1025)
    assert sum(n for _, n in P.plan(counts)) < sum(n for _, n in P.best_fit(counts, 1024))


def test_edits_keep_counts_exact(monkeypatch):
    monkeypatch.setattr(C, "LEAF", 4)
    own, rng = encoder(vocabulary()), random.Random(3)
    part = ["a", "b", " ", "  ", "\n", "the", " of", ".", "é", "'s", "\xa0", "　", "12", "word ", " thing"]
    for _ in range(1500):
        t = "".join(rng.choice(part) for _ in range(rng.randint(0, 60)))
        tree = C.Tree.of(t, own)
        for _ in range(3):
            a, b, c, d = sorted(rng.randint(0, len(t)) for _ in range(4))
            edits = [(a, b - a, "".join(rng.choice(part) for _ in range(rng.randint(0, 3))))]
            if b < c:
                edits.append((c, d - c, rng.choice(part)))
            want = t
            for p, n, new in reversed(edits):
                want = want[:p] + new + want[p + n:]
            t, _ = C.edit(t, tree, edits, own)
            assert t == want and tree.tokens[1] == len(plain(t)) and tree.chars[1] == len(t)
            assert all(tree.tokens[i] == tree.tokens[2 * i] + tree.tokens[2 * i + 1] for i in range(1, tree.width))


def test_edits_encode_only_what_they_touch(spark):
    t = "word " * 5000 + "x me@mail.org y " + "more " * 5000
    df = spark.createDataFrame([(1, t), (2, None), (3, "plain text")], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in C.apply_edits(C.count(df), C.Redact()).collect()}
    after = t.replace("me@mail.org", "<email>")
    assert rows[1]["text"] == after and rows[1]["__tokens"][1] == len(plain(after))
    assert rows[1]["__edits"] == 1 and rows[1]["__encoded"] < 200
    assert rows[2]["text"] is None and rows[2]["__tokens"][1] == 0 and rows[3]["__encoded"] == 0


@pytest.mark.parametrize("name", ["op4_token_counts"])
def test_count_query(spark, name):
    rows = {r["doc_id"]: r for r in C.QUERIES[name](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    find = C.Redact()
    assert len(rows) == len(docs)
    for d in docs:
        t = d["text"]
        for p, n, new in reversed(list(find(t))):
            t = t[:p] + new + t[p + n:]
        r = rows[d["doc_id"]]
        assert (r["n_tokens"], r["n_tokens_after"]) == (len(plain(d["text"])), len(plain(t)))
    assert sum(r["n_edits"] for r in rows.values()) > 0

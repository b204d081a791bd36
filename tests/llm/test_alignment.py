"""Cross-tokenizer alignment against token by token counting."""

import collections
import hashlib

import numpy as np

from tenura.llm import alignment as A
from tenura.llm.tokens import PieceEncoder, vocabulary
from tests.conftest import SF001

ODD = ["", None, "a", " a", "a  b\t c\n\nd ", "  ", "\n", "x\x00y z", "it's <|endoftext|> no<|endoftext|> <s> </s> <0x41>", "é  ü　x",
       "\n\n a", "naïve\r\nx", "a\n", "\nword two", "▁a b", "日本語 テキスト 🙂", "▁", "the cat the cat\nthe dog", "word " * 3000, "x" * 5000]


def plain(al, text):
    """n_a, n_b, n_groups, digest and links of one text, from its tokens."""
    nothing = 0, 0, 0, "", collections.Counter()
    if not text:
        return nothing
    ids = al.a.tokenizer.encode(" " + text, add_special_tokens=False).ids, al.b.model.encode(text)
    ends = []
    for side, own in zip((al.a, al.b), ids):
        raw = [side.bytes[i] for i in own]
        if b"".join(raw) != (" " + text).encode():
            return nothing
        ends.append(np.cumsum(list(map(len, raw))).tolist())
    links, groups, i, j, x, y = collections.Counter(), [], 0, 0, 0, 0
    (a, b), (end_a, end_b) = ids, ends
    while i < len(a):
        links[a[i] << 32 | b[j]] += 1
        if end_a[i] == end_b[j]:
            groups.append(",".join(map(str, a[x:i + 1])) + "|" + ",".join(map(str, b[y:j + 1])))
            i, j = i + 1, j + 1
            x, y = i, j
        elif end_a[i] < end_b[j]:
            i += 1
        else:
            j += 1
    return len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def expected(texts):
    al = A.aligner(vocabulary(), vocabulary(A.PIECES))
    found = [plain(al, t) for t in texts]
    count = collections.Counter(p for f in found for p in f[4])
    best = collections.defaultdict(int)
    for p, n in count.items():
        best[p >> 32] = max(best[p >> 32], n)
    return [(n_a, n_b, g, sum(links.values()), sum(k for p, k in links.items() if count[p] == best[p >> 32]),
             sum(k * count[p] for p, k in links.items()), sha) for n_a, n_b, g, sha, links in found]


def rows(df):
    return [tuple(r)[1:] for r in df.orderBy("doc_id").collect()]


def test_odd_texts(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, pairs string")
    assert rows(A.align_documents(df)) == expected(ODD)
    # with few pairs broadcast, the others meet their counts in the join
    monkeypatch.setattr(A, "HEAVY", 3)
    assert rows(A.align_documents(df.repartition(3))) == expected(ODD)
    assert A.align_documents(df.where("false")).count() == 0


def test_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").orderBy("doc_id")
    assert rows(A.align_documents(docs)) == expected([r["text"] for r in docs.collect()])


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b c")], "doc_id long, text string")
    got = sorted((r["n_links"], r["count_sum"]) for r in A.align_documents(df).collect())
    want = expected(["a b", "a b", "a b c"])
    assert got == sorted((w[3], w[5]) for w in want)


def test_windows_that_share_a_name_are_kept_apart(monkeypatch):
    al = A.aligner(vocabulary(), vocabulary(A.PIECES))
    text = "one two one three two one four"
    want = al.texts([text])[4]
    monkeypatch.setattr(A, "span_names", lambda v, a, b: np.zeros(len(a), np.uint64))
    assert al.texts([text])[4] == want


def test_piece_encoder_equals_the_library():
    own = PieceEncoder(vocabulary())
    texts = [t or "" for t in ODD]
    ids, ends = own.ids(texts)
    assert [ids[x:y].tolist() for x, y in zip(ends[:-1], ends[1:])] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

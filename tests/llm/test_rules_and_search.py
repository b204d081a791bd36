"""Quality rules and decontamination against brute force."""
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tenura.llm import decontam as D
from tenura.llm import quality as Q


def brute_measures(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t ", "one", "a b c", "a b c a b c", "x " * 30, "a\n\na\n a\nb \nb", "é#ü *|\n<b>\n\n", "a b a b a b a",
         "\x0bq\x0cq q q\r\nq q", " ".join(f"w{k % 7}" for k in range(80))]


@pytest.mark.parametrize("few", [48, 0])
def test_measures(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "FEW", few)
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 120))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    m = Q.measures(F.col("text"))
    got = df.select("doc_id", m.alias("m")).select("doc_id", "m.*").orderBy("doc_id").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(r[c] for c in names) for r in got] == [brute_measures(t) for t in texts]


def test_keep_good_keeps_columns_and_rows(spark):
    good = " ".join(f"the word{k} of t{k} and" for k in range(20))
    rows = [(1, good, "x"), (1, good, "x"), (2, None, None), (3, "short", "y"), (4, good.replace("word", "#$"), "z")]
    df = spark.createDataFrame(rows, "doc_id int, text string, __quality string")
    out = Q.keep_good(df)
    assert out.columns == df.columns and [r["doc_id"] for r in out.collect()] == [1, 1]
    assert Q.keep_good(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = Q.op9_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def brute_found(text, items):
    def words(t):
        t = (t or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)
    w, hit, found = words(text), set(), set()
    for i, t in items:
        b = words(t)
        m = min(13, len(b))
        for k in range(len(b) - m + 1 if m else 0):
            for s in range(len(w) - m + 1):
                if w[s:s + m] == b[k:k + m]:
                    hit |= set(range(s, s + m))
                    found.add(str(i))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def result(docs, items):
    f = F.col("__found")
    rows = D.occurrences(docs, items).select("doc_id", f["n_words"], F.size(f["places"]), F.size(f["items"]),
                                             F.sha2(F.array_join(f["items"], ","), 256), D.contaminated(f)).collect()
    return sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("per_pass", [20_000, 3])
def test_search(spark, monkeypatch, per_pass):
    monkeypatch.setattr(D, "ITEMS_PER_PASS", per_pass)
    rng = random.Random(8)
    word = [f"w{k}" for k in range(5)] + ["Über", "The", "x1"]
    items = [(10, None), (2, ""), (3, "...")] + [
        (k, " ".join(rng.choice(word) for _ in range(rng.choice((1, 2, 3, 12, 13, 14, 30))))) for k in range(20, 34)]
    items += [(21, items[5][1]), items[6]]
    docs = [(0, None), (1, ""), (2, "- ,")]
    for k in range(3, 40):
        t = " ".join(rng.choice(word) for _ in range(rng.randint(1, 60)))
        if k % 2:
            t += "; " + (items[rng.randrange(3, len(items))][1] or "").upper().replace(" ", " - ")
        docs.append((k, t))
    docs.append(docs[5])
    d = spark.createDataFrame(docs, "doc_id int, text string")
    i = spark.createDataFrame(items, "item_id int, text string")
    assert result(d, i) == sorted((k, *brute_found(t, items)) for k, t in docs)


def test_items_without_an_id_are_searched(spark):
    d = spark.createDataFrame([(1, "x a b c y"), (2, "a b c d e"), (3, "z")], "doc_id int, text string")
    i = spark.createDataFrame([(None, "A b C"), (7, "d e")], "item_id int, text string")
    none, seven = (hashlib.sha256(x).hexdigest() for x in (b"", b"7"))
    assert result(d, i) == [(1, 5, 3, 1, none, True), (2, 5, 5, 2, seven, True), (3, 1, 0, 0, none, False)]


def test_passes_are_cut_by_words(spark, monkeypatch):
    monkeypatch.setattr(D, "WORDS_PER_PASS", 40)
    i = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(30 if k % 3 else 50))) for k in range(9)],
                              "item_id int, text string")
    blocks = [[(r["i"], len(D.words_of(r["t"]))) for r in b] for b in D._passes(i, "item_id", "text")]
    assert sorted(k for b in blocks for k, _ in b) == list(range(9))
    assert all(len(b) == 1 or sum(n for _, n in b) <= 40 for b in blocks)


def test_empty_sides_and_own_columns(spark):
    d = spark.createDataFrame([(1, "a b c", 5, "q")], "doc_id int, text string, item_id int, __found string")
    none = spark.createDataFrame([], "item_id int, text string")
    one = spark.createDataFrame([(7, "B c")], "item_id int, text string")
    assert D.drop_contaminated(d, none).collect() == d.collect()
    assert D.drop_contaminated(d, one).count() == 0
    assert D.drop_contaminated(d.limit(0), one).columns == d.columns

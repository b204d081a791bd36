"""Every stage of the pipeline against brute force on its own input."""
import re

import corpus_pipeline as pipeline
from tenura.llm import quality
from tests.llm.test_rules_and_search import brute_found, brute_measures
from tests.llm.test_simhash import brute_components, brute_fp
from tests.llm.test_substrings import W
from tests.llm.test_tokens import plain

SF = "/root/testdata/sf0.001"


def kept_words(rows):
    """Words left in each text, rows being (doc_id, text)."""
    words = {i: (t or "").split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - W + 1):
            first.setdefault(tuple(words[i][k:k + W]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - W + 1):
            if first[tuple(w[k:k + W])] < i:
                gone |= set(range(k, k + W))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before, docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns
            assert len({r["doc_id"] for r in seen[name][1]}) == len(seen[name][1])

    before, after = seen["quality_rules"]
    good = set()
    for i, r in before.items():
        n, chars, symbols, dup, repeat = brute_measures(r["text"])
        lines = [x for x in (r["text"] or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
        stops = sum(w in quality.STOP_FORMS for w in re.findall("[^\x20\x09-\x0D]+", r["text"] or ""))
        loud = sum("!!" in x and x.upper() == x for x in lines)
        if (n >= 50 and 100 * repeat <= 50 * n and 2.5 <= chars / n <= 12 and symbols <= 0.1 * n and stops >= 0.02 * n
                and dup <= 0.5 * len(lines) and loud <= 0.5 * len(lines)):
            good.add(i)
    assert {r["doc_id"] for r in after} == good and all(r == before[r["doc_id"]] for r in after)

    before, after = seen["simhash_near_dedup"]
    ids = sorted(before)
    group = brute_components(ids, [brute_fp(before[i]["text"]) for i in ids])
    assert {r["doc_id"] for r in after} == set(group.values()) and all(r == before[r["doc_id"]] for r in after)

    before, after = seen["substring_dedup"]
    left = kept_words([(i, r["text"]) for i, r in before.items()])
    assert {r["doc_id"]: r["text"].split() for r in after} == left
    assert all(r["n_chars"] == len(r["text"]) and r["source"] == before[r["doc_id"]]["source"] for r in after)
    assert all(r["text"] == before[r["doc_id"]]["text"] for r in after if len(left[r["doc_id"]]) == len(before[r["doc_id"]]["text"].split()))

    before, after = seen["benchmark_decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, r in before.items() if not brute_found(r["text"], items)[-1]}
    assert {r["doc_id"] for r in after} == clean and len(clean) < len(before)

    before, after = seen["best_fit_packing"]
    assert {i: len(plain(r["text"])) + 1 for i, r in before.items()} == {
        i: sum(r["length"] for r in after if r["doc_id"] == i) for i in before}


def test_run_equals_the_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, docs.select(key).collect())) == sorted(map(tuple, pipeline.run(spark, SF).select(key).collect()))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_nulls_repeats_and_other_columns(spark):
    text = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id = 89").first()["text"]
    rows = [(1, text, None, "a", None, 1), (1, text, None, "a", None, 1), (2, text, "en", None, 5, 2), (None, None, None, None, None, None),
            (None, text + " and it goes on", "en", "b", 7, 3), (3, "", "en", "c", 0, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __kept int")
    sizes = []
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        sizes.append(docs.count())
    # the two rows of document 1 and the row without an id pass the rules; of the group 1 and 2 one row stays
    assert sizes[:2] == [4, 2] and sizes[2] == 2

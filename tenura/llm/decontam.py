"""Benchmark decontamination: Wu-Manber search for item windows in documents.

Items are cut into windows of ``WINDOW`` words (an item of fewer words is one
window).  A shift table over blocks of two words says how far the search may
jump; where the jump is zero, the bucket of that block's windows is compared
word by word.  Documents are only scanned: no shuffle, and a task holds one
Arrow batch and the tables of one block of items.

Null texts have no words, and an item without words is never found.  Repeated
document rows are judged alike; a repeated item id counts once.  Items without an
id are searched too: their words are hits, and together they are one item, which
the list of ids leaves out.  Long texts are searched whole.  An empty benchmark finds nothing.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm.scratch import free_name

WINDOW = 13
#: Contaminated: at least one word in 20 is hit.
SHARE = 20
#: Items handled in one pass over the documents; a larger benchmark takes more passes.
ITEMS_PER_PASS = 20_000
#: Words of the items of one pass; a single longer item is a pass of its own.
WORDS_PER_PASS = 400_000
#: Words of two neighbours form a block of the shift table.
BLOCK = 2

# A-Z become a-z; other ASCII characters than letters and digits separate words.
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20)
              for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text."""
    return text.encode().translate(_FOLD).split() if text else []


class Searcher:
    """Wu-Manber tables of all windows of one length."""

    def __init__(self, length: int, windows: dict[tuple, list]):
        self.length = length
        self.block = min(BLOCK, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[tuple, list]] = defaultdict(dict)
        for w, items in windows.items():
            for end in range(self.block, length + 1):
                key = w[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.bucket[w[length - self.block:]][w] = items

    def search(self, words: list[bytes]):
        """Start and items of every occurrence in ``words``."""
        n, m, block, far, shift, bucket = len(words), self.length, self.block, self.far, self.shift.get, self.bucket
        end = m
        while end <= n:
            key = tuple(words[end - block:end])
            jump = shift(key, far)
            if jump:
                end += jump
                continue
            items = bucket[key].get(tuple(words[end - m:end]))
            if items is not None:
                yield end - m, items
            end += 1


def searchers(items) -> list[Searcher]:
    """Tables for (item id, text) pairs, one for each window length that occurs."""
    by_length: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = words_of(text)
        if words:
            m = min(WINDOW, len(words))
            for i in range(len(words) - m + 1):
                by_length[m][tuple(words[i:i + m])].add(item)
    return [Searcher(m, {w: _sorted(found) for w, found in windows.items()}) for m, windows in sorted(by_length.items())]


def _sorted(items) -> list:
    """Ids in order, null (which joins of ids leave out) last."""
    return sorted(items, key=lambda i: (i is None, i or ""))


def _passes(benchmark: DataFrame, item_id: str, text: str):
    """The items in blocks of at most ITEMS_PER_PASS and WORDS_PER_PASS, one part at the driver at a time."""
    items = benchmark.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t")).dropDuplicates()
    # a word takes a byte and a separator, so a text has at most half as many words as bytes
    total = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t") + 1).alias("bytes")).first()
    n = max(1, -(-total["n"] // ITEMS_PER_PASS), -(-(total["bytes"] or 0) // (2 * WORDS_PER_PASS)))
    if n == 1:
        yield items.collect()
        return
    # twice as many parts as needed by the mean, and each is split again by its own counts
    parts = items.withColumn("p", F.pmod(F.xxhash64("i", "t"), F.lit(2 * n)))
    for p in range(2 * n):
        block, held = [], 0
        for row in parts.where(F.col("p") == p).select("i", "t").collect():
            words = len(words_of(row["t"]))
            if block and (len(block) == ITEMS_PER_PASS or held + words > WORDS_PER_PASS):
                yield block
                block, held = [], 0
            block.append(row)
            held += words
        if block:
            yield block


def occurrences(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                item_id: str = "item_id", item_text: str = "text", found: str = "__found") -> DataFrame:
    """``docs`` with a struct column ``found``: n_words, the hit word places and
    the items found.  Each pass over the items adds to the arrays of the last."""
    spark = docs.sparkSession
    schema = docs.withColumn(found, F.lit(None).cast("struct<n_words:bigint,places:array<int>,items:array<string>>"))
    out = schema
    for rows in _passes(benchmark, item_id, item_text):
        tables = spark.sparkContext.broadcast(searchers([(None if r["i"] is None else str(r["i"]), r["t"]) for r in rows]))
        out = out.mapInArrow(_search(tables, text, found), schema.schema)
    return out


def _search(tables, text: str, found: str):
    kind = pa.struct([("n_words", pa.int64()), ("places", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(found)
            results = []
            for t, before in zip(batch.column(batch.schema.get_field_index(text)), batch.column(at).to_pylist(), strict=True):
                words = words_of(t.as_py())
                hit = np.zeros(len(words), bool)
                items = set(before["items"]) if before else set()
                if before:
                    hit[before["places"]] = True
                for s in tables.value:
                    for start, ids in s.search(words):
                        hit[start:start + s.length] = True
                        items.update(ids)
                results.append({"n_words": len(words), "places": np.flatnonzero(hit), "items": _sorted(items)})
            yield batch.set_column(at, pa.field(found, kind), pa.array(results, kind))
    return run


def contaminated(found: Column) -> Column:
    n_hit = F.size(found["places"]).cast("long")
    return (n_hit > 0) & (SHARE * n_hit >= found["n_words"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    f = free_name(docs, "__found")
    return occurrences(docs, benchmark, text, found=f).where(~contaminated(F.col(f))).drop(f)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    f = F.col("__found")
    found = occurrences(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", f["n_words"].alias("n_words"), F.size(f["places"]).cast("long").alias("n_hit"),
                        F.size(f["items"]).cast("long").alias("n_items"),
                        F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"),
                        contaminated(f).alias("contaminated"))


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, len(x) AS m, array_to_string(x, ' ') AS g FROM (
        SELECT item_id, w[i:i + {WINDOW - 1}] AS x FROM (
          SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0))),
k AS (SELECT DISTINCT m FROM p),
s AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (
        SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, k WHERE len(w) >= m)),
o AS (SELECT doc_id, i, s.m, item_id FROM s JOIN p ON s.m = p.m AND s.g = p.g),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM o) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)"""

QUERIES = {"op10_benchmark_decontamination": op10_benchmark_decontamination}
SQL = {"op10_benchmark_decontamination": ORACLE}

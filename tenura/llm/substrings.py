"""Substring dedup by recompression.

Rounds name neighbouring words and runs: every symbol falls into a left or a
right set by a hash that the whole corpus shares, a left symbol followed by a
right one becomes a new symbol named after both, and a run of one symbol that
no pair took becomes a symbol named after it and its length.  Names are 64-bit
hashes of what they stand for, so they are global without a dictionary, and
equal passages get equal symbols except near their edges.  Each symbol carries
the words on which its forming depended, so it is known for any window whether
its symbols are a matter of the window alone.

A window of ``WINDOW`` words is filed under the longest such symbol in it: equal
windows choose the same symbol at the same place.  Consecutive windows with
one symbol form one row (symbol, name of all their words).  Symbols of one
document only are dropped; equal rows prove equal passages outright, and just
where a symbol's surroundings differ are single windows compared by name.

Per document the tables grow with its words, whatever repeats; groups are
formed by aggregates and joins that Spark can split, so a passage that a third
of all documents share gathers nowhere.  Null texts have no words.  A row
with a null doc_id keeps its words and removes none elsewhere; rows that
repeat a doc_id are judged each by its own text, and never against each other.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura.llm.scratch import free_name, stored
from tenura.llm.texts import chunks, mix, span_names, utf8, word_names, word_spans

WINDOW = 50
#: After so many rounds a symbol's surroundings no longer fit into a window.
ROUNDS = 9
#: A longer document is parsed in parts that overlap by a window less one word.
PART_WORDS = 1 << 18

_SIDE = np.random.default_rng(0x51DE).integers(1, 2**63, 64, dtype=np.uint64)
_PAIR = np.uint64(0xA24BAED4963EE407)
_RUN = np.uint64(0x9FB21C651E98DF25)


def _round(sym, start, end, left, right, part, salt):
    """One round of pairs and runs over the symbols of several parts.

    ``left`` and ``right`` bound the words that a symbol's forming depended on;
    where that includes a part's own edge they lie outside the part."""
    n = len(sym)
    is_left = (mix(sym ^ salt) & np.uint64(1)).astype(bool)
    joined = part[1:] == part[:-1]
    pair = np.zeros(n + 1, bool)  # pair[i]: symbol i and the next become one
    pair[:n - 1] = is_left[:-1] & ~is_left[1:] & joined
    taken = pair[:n].copy()
    taken[1:] |= pair[:n - 1]
    run = np.zeros(n, bool)  # run[i]: symbol i goes on from the one before
    run[1:] = joined & (sym[1:] == sym[:-1]) & ~taken[1:] & ~taken[:-1]
    second = np.zeros(n, bool)
    second[1:] = pair[:n - 1]
    head = np.flatnonzero(~(run | second))
    last = np.concatenate((head[1:], [n])) - 1
    length = last - head + 1
    new_left, new_right = np.minimum.reduceat(left, head), np.maximum.reduceat(right, head)
    is_pair = pair[head]
    # what is left over depends on its neighbours, and on theirs where a pair took an equal symbol
    alone = np.flatnonzero(~is_pair)
    a, b = head[alone], last[alone]
    before = np.maximum(a - 1, 0)
    edge = (a == 0) | (part[before] != part[a])
    beyond = np.where(sym[before] == sym[a], np.minimum(left[before], left[np.maximum(a - 2, 0)]), left[before])
    new_left[alone] = np.where(edge, start[a] - 1, np.minimum(new_left[alone], beyond))
    after = np.minimum(b + 1, n - 1)
    edge = (b == n - 1) | (part[after] != part[b])
    beyond = np.where(sym[after] == sym[b], np.maximum(right[after], right[np.minimum(b + 2, n - 1)]), right[after])
    new_right[alone] = np.where(edge, end[b] + 1, np.maximum(new_right[alone], beyond))
    name = sym[head].copy()
    p = head[is_pair]
    name[is_pair] = mix(mix(sym[p] + salt) ^ (sym[p + 1] * _PAIR))
    r = (~is_pair) & (length > 1)
    name[r] = mix(mix(sym[head[r]] + salt) ^ (length[r].astype(np.uint64) * _RUN))
    return name, start[head], end[last], new_left, new_right, part[head], is_pair | r


def windows(words: np.ndarray, first: np.ndarray):
    """Rows for the windows of several parts; ``words`` are the word names and
    part k has words first[k] up to first[k + 1].

    Returns symbol, passage name, part, first window's place in the part and
    number of windows: consecutive windows filed under one symbol, and the same
    again where just that passage follows."""
    n, k = len(words), len(first) - 1
    part = np.repeat(np.arange(k), np.diff(first))
    at = np.arange(n)
    state = words, at, at + 1, at, at + 1, part
    found = [(words, at, at + 1, at, at + 1, part)]
    for r in range(ROUNDS):
        if len(state[0]) < 2:
            break
        *state, new = _round(*state, _SIDE[r])
        fits = new & (state[4] - state[3] <= WINDOW)
        found.append(tuple(x[fits] for x in state))
        if not len(found[-1][0]) and not (state[4] - state[3] <= WINDOW).any():
            break
    sym, start, end, left, right, part = (np.concatenate(x) for x in zip(*found))
    # a symbol serves the window starts from ``low`` to ``high``
    low = np.maximum(right - WINDOW, first[part])
    high = np.minimum(left, first[part + 1] - WINDOW)
    ok = np.flatnonzero(low <= high)
    low, high = low[ok], high[ok]
    order = ((np.minimum(end - start, 63)[ok].astype(np.int64) << 57)
             | ((sym[ok] >> np.uint64(39)).astype(np.int64) << 32) | ok)
    span = np.frexp((high - low + 1).astype(float))[1] - 1  # log2 of the largest power within
    best = np.full((6, n), -1, np.int64)
    for s in range(6):
        rows = span == s
        np.maximum.at(best[s], low[rows], order[rows])
        np.maximum.at(best[s], high[rows] + 1 - (1 << s), order[rows])
    for s in range(5, 0, -1):
        half = 1 << s - 1
        np.maximum(best[s - 1], best[s], out=best[s - 1])
        np.maximum(best[s - 1][half:], best[s][:n - half], out=best[s - 1][half:])
    chosen = best[0]
    head = np.flatnonzero((chosen >= 0) & (np.concatenate(([-2], chosen[:-1])) != chosen))
    if not len(head):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    change = np.flatnonzero(np.concatenate((chosen[1:] != chosen[:-1], [True])))
    count = change[np.searchsorted(change, head)] - head + 1
    symbol = (chosen[head] & 0xFFFFFFFF).astype(np.int64)
    passage = span_names(words, head, head + count - 1 + WINDOW)
    passage = mix(passage ^ (start[symbol] - head).astype(np.uint64))
    which, name = part[symbol], sym[symbol]
    # in periodic text one passage follows itself again and again: one row for all of them
    new = np.concatenate(([True], (name[1:] != name[:-1]) | (passage[1:] != passage[:-1]) | (which[1:] != which[:-1])
                          | (head[1:] != head[:-1] + count[:-1])))
    row = np.flatnonzero(new)
    return name[row], passage[row], which[row], head[row] - first[which[row]], np.add.reduceat(count, row)


def _parts(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and end word of the parts of rows with so many words."""
    row, begin, end = [], [], []
    for i in np.flatnonzero(n_words >= WINDOW).tolist():
        n = int(n_words[i])
        for a in range(0, n - WINDOW + 1, PART_WORDS):
            row.append(i)
            begin.append(a)
            end.append(min(n, a + PART_WORDS + WINDOW - 1))
    return np.array(row, np.int64), np.array(begin, np.int64), np.array(end, np.int64)


def _batch_words(column):
    """Word names of a text column: (first row, row bounds in words, names) for
    lots of rows of bounded size."""
    data, offsets = utf8(column)
    for i, j in chunks(offsets):
        o = offsets[i:j + 1]
        start, end, first = word_spans(data, o)
        yield i, first, word_names(data[o[0]:o[-1]], start, end)


_FILED = "doc bigint, tid bigint, symbol bigint, passage bigint, place int, n int"


def _file(batches):
    """Rows (doc, tid, symbol, passage, place, n) of the windows of each text."""
    for batch in batches:
        doc, tid = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        for i, first, words in _batch_words(batch.column(2)):
            row, begin, end = _parts(np.diff(first))
            lots = np.cumsum(end - begin) // PART_WORDS
            for lot in np.unique(lots):
                r, a, b = (x[lots == lot] for x in (row, begin, end))
                bounds = np.concatenate(([0], np.cumsum(b - a)))
                own = np.concatenate([words[first[x] + y:first[x] + z] for x, y, z in zip(r.tolist(), a.tolist(), b.tolist())])
                symbol, passage, which, place, n = windows(own, bounds)
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc[i + r[which]]), pa.array(tid[i + r[which]]), pa.array(symbol.view(np.int64)),
                    pa.array(passage.view(np.int64)), pa.array((a[which] + place).astype(np.int32)),
                    pa.array(n.astype(np.int32))], ["doc", "tid", "symbol", "passage", "place", "n"])


def _single(batches):
    """Rows (doc, tid, symbol, name, place, n) of the single windows asked for."""
    for batch in batches:
        doc, tid = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        asked = batch.column(3)
        for i, first, words in _batch_words(batch.column(2)):
            lists = asked.slice(i, len(first) - 1)
            flat, bound = lists.flatten(), np.frombuffer(lists.buffers()[1], np.int32)[lists.offset:lists.offset + len(lists) + 1]
            symbol, place, n = (flat.field(k).to_numpy() for k in range(3))
            row = np.repeat(np.arange(len(lists)), np.diff(bound))
            each = np.repeat(np.arange(len(n)), n)
            at = place[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            begin = first[row[each]] + at
            name = span_names(words, begin, begin + WINDOW)
            # neighbours with one name, as in a run of one word, share a row
            own = row[each]
            new = np.concatenate(([True], (name[1:] != name[:-1]) | (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])
                                  | (symbol[each][1:] != symbol[each][:-1])))[:len(name)]
            head = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([
                pa.array(doc[i + own[head]]), pa.array(tid[i + own[head]]), pa.array(symbol[each[head]]),
                pa.array(name[head].view(np.int64)), pa.array(at[head].astype(np.int32)),
                pa.array(np.diff(np.concatenate((head, [len(name)]))).astype(np.int32))],
                ["doc", "tid", "symbol", "name", "place", "n"])


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, tid, place, n): windows place .. place + n - 1 of the text with hash
    ``tid`` of document ``doc`` also start in a document with a smaller id."""
    d = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("tid"), F.col(text).cast("string").alias("text"))
    filed = stored(d.mapInArrow(_file, _FILED), "windows")
    # what is joined below is stored first: Spark can then split the side of a frequent symbol
    known = (filed.groupBy("symbol").agg(F.min("doc").alias("doc0"), F.max("doc").alias("doc1"),
                                         F.min("passage").alias("p0"), F.max("passage").alias("p1"))
             .where("doc0 < doc1").select("symbol", "doc0", (F.col("p0") == F.col("p1")).alias("alike")))
    shared = stored(filed.join(stored(known, "symbols"), "symbol"), "shared")
    spans = shared.where("alike and doc > doc0").select("doc", "tid", "place", "n")
    # symbols in several passages: equal passages first, then the windows of one document for each passage
    mixed = shared.where("not alike").select("symbol", "passage", "doc", "tid", "place", "n")
    kinds = mixed.groupBy("symbol", "passage").agg(F.min("doc").alias("doc2"))
    mixed = stored(mixed.join(stored(kinds, "passages"), ["symbol", "passage"]), "mixed")
    spans = spans.union(mixed.where("doc > doc2").select("doc", "tid", "place", "n"))
    asked = (mixed.where("doc = doc2").groupBy("doc", "tid")
             .agg(F.collect_list(F.struct("symbol", "place", "n")).alias("asked")))
    single = d.join(asked, ["doc", "tid"]).select("doc", "tid", "text", "asked")
    single = stored(single.mapInArrow(_single, "doc bigint, tid bigint, symbol bigint, name bigint, place int, n int"), "single")
    least = (single.groupBy("symbol", "name").agg(F.min("doc").alias("doc0"), F.max("doc").alias("doc1"))
             .where("doc0 < doc1").select("symbol", "name", "doc0"))
    return spans.union(single.join(stored(least, "least"), ["symbol", "name"]).where("doc > doc0")
                       .select("doc", "tid", "place", "n"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: str = "__repeats") -> DataFrame:
    """``docs`` without the repeated words, each cut with the white space that
    follows it, and a struct column ``counts``: n_words, n_removed and kept_sha256,
    the SHA-256 of the kept words joined by one space.

    Texts without a repeat stay as they are; a null text stays null."""
    spans = (repeats(docs, doc_id, text).groupBy("doc", "tid")
             .agg(F.collect_list(F.struct("place", "n")).alias("spans")))
    d = docs.join(spans, (docs[doc_id].cast("long") == spans["doc"]) & (F.xxhash64(docs[text]) == spans["tid"]), "left")
    out = T.StructType([*docs.schema.fields, T.StructField(counts, T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]))])
    own = spans["spans"].alias(free_name(docs, "__spans"))
    return d.select(*[docs[c] for c in docs.columns], own).mapInArrow(_cut(docs.columns.index(text), counts), out)


def _cut(at: int, counts: str):
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            texts, found = [], []
            for t, spans in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                t = t.as_py()
                raw = (t or "").encode()
                words = raw.split()
                n, removed = len(words), 0
                if spans.is_valid:
                    places, lengths = (spans.values.field(k).to_numpy() for k in range(2))  # this row's own
                    turn = np.zeros(n + 1, np.int64)
                    np.add.at(turn, places, 1)
                    np.add.at(turn, places + lengths + WINDOW - 1, -1)
                    keep = np.cumsum(turn[:n]) == 0
                    removed = n - int(keep.sum())
                    words = list(compress(words, keep.tolist()))
                    t = _without(raw, keep)
                texts.append(t)
                found.append((n, removed, hashlib.sha256(b" ".join(words)).hexdigest()))
            n, removed, sha = zip(*found) if found else ((), (), ())
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            columns.append(pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                                                       pa.array(sha, pa.string())], fields=list(kind)))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], counts])
    return run


def _without(raw: bytes, keep: np.ndarray) -> str:
    """The text without the words not kept, and what follows each up to the next word."""
    start, _, _ = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    bounds = np.concatenate((start, [len(raw)]))
    change = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False])).astype(np.int8)))
    out = raw[:bounds[0]] + b"".join(raw[bounds[a]:bounds[b]] for a, b in zip(change[::2].tolist(), change[1::2].tolist()))
    return out.decode()


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and digest of the kept ones of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    c = F.col("__repeats")
    return remove_repeats(docs).select("doc_id", c["n_words"].alias("n_words"), c["n_removed"].alias("n_removed"),
                                       c["kept_sha256"].alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY md5(g)) AS m FROM g) WHERE doc_id > m),
k AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM r),
t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d),
s AS (SELECT t.doc_id, string_agg(w[t.j], ' ' ORDER BY t.j) AS kept, count(*) AS n
      FROM t LEFT JOIN k ON t.doc_id = k.doc_id AND t.j = k.j WHERE k.j IS NULL GROUP BY t.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)"""

QUERIES = {"op1_substring_dedup": op1_substring_dedup}
SQL = {"op1_substring_dedup": ORACLE}

"""Best-fit packing by bin completion.

A plan needs only how many pieces of each length there are, at most 1,024
counts whatever the corpus.  The search runs on these counts: the fillings
around the largest piece left are enumerated without the dominated ones, taken
as often as the counts allow, and pruned by the waste that would still beat
the incumbent; best-fit decreasing gives the first incumbent.  The plan, a few
thousand fillings with their numbers, then deals places to the pieces by their
rank among those of equal length, which Spark counts.

A null text is an empty document (its end id only).  Rows that repeat a doc_id
are packed each.  An empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenura.llm.scratch import stored
from tenura.llm.tokens import lots, piece_encoder, vocabulary

CAPACITY = 1024
END = 2
#: Nodes of the search after which the incumbent stands.
NODES = 4000
#: Fillings tried at a node, and leaves visited to find them.
BRANCHES, LEAVES = 3, 48
#: At every so many nodes best fit completes what has been taken, for a new incumbent.
TRY = 20


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocab: str | None = None, doc_id: str = "doc_id",
           text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every document; only longer documents are cut, and then the
    first piece takes what the whole ones leave.  ``part`` and ``nth`` number
    the pieces of one length within the task that made them."""
    vocab = vocab or vocabulary()
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids

    def run(batches):
        part, own, seen = TaskContext.get().partitionId(), piece_encoder(vocab), Counter()
        kinds = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
        for batch in batches:
            for i, j in lots(batch.column(1)):
                lot = batch.slice(i, j - i)
                flat, ends = own.ids([t or "" for t in lot.column(1).to_pylist()])
                rows = []
                for k, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    ids = np.append(flat[x:y], END).astype("<u4")
                    bounds = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                        own_ids = ids[a:b]
                        row = (k, piece, a, b - a, zlib.crc32(own_ids.tobytes()), part, seen[b - a])
                        rows.append((*row, own_ids.view(np.int32)) if with_ids else row)
                        seen[b - a] += 1
                columns = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [lot.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], kinds[1:]))], names)

    kind = dict(d.dtypes)["doc_id"]
    return d.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
                             + ", ids array<int>" * with_ids)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's bound: large pieces apart, the others by volume."""
    size = np.arange(capacity + 1)
    number = np.concatenate(([0], np.cumsum(counts)))  # of pieces below a length
    volume = np.concatenate(([0], np.cumsum(counts * size)))
    half = capacity // 2
    best = 0
    for a in range(half + 1):
        n1 = number[-1] - number[capacity - a + 1]
        n2 = number[capacity - a + 1] - number[half + 1]
        v2 = volume[capacity - a + 1] - volume[half + 1]
        v3 = volume[half + 1] - volume[a]
        best = max(best, int(n1 + n2 + max(0, -(-(v3 - (n2 * capacity - v2)) // capacity))))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over the counts: (filling, how often) in bulk."""
    room: dict[int, list] = {}
    done = []

    def put(filling, n):
        left = capacity - sum(filling)
        (room.setdefault(left, []) if left else done).append((filling, n))

    for s in np.flatnonzero(counts)[::-1].tolist():
        c = int(counts[s])
        while c:
            left = min((r for r in room if r >= s and room[r]), default=None)
            filling, n = room[left].pop() if left is not None else ((), -(-c // (capacity // s)))
            each = (left if left is not None else capacity) // s
            full = min(n, c // each)
            if full:
                put(filling + (s,) * each, full)
            c -= full * each
            if full < n:
                if c:  # the last bin takes the rest
                    put(filling + (s,) * c, 1)
                    full, c = full + 1, 0
                if full < n:
                    room.setdefault(left, []).append((filling, n - full))
    return done + [x for found in room.values() for x in found]


def fillings(counts: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Undominated fillings around the largest piece left, least waste first."""
    sizes = np.flatnonzero(counts)[::-1].tolist()
    largest, found, visits = sizes[0], [], 0
    left = {s: int(counts[s]) for s in sizes}
    left[largest] -= 1

    def extend(chosen, space, at):
        nonlocal visits
        if visits >= LEAVES:
            return
        grown = False
        for k in range(at, len(sizes)):
            s = sizes[k]
            if s <= space and left[s]:
                grown = True
                left[s] -= 1
                extend((*chosen, s), space - s, k)
                left[s] += 1
                if visits >= LEAVES or found and not found[-1][0] and len(found) >= BRANCHES:
                    return
        if not grown:
            visits += 1
            # dominated: a piece could give way to a larger one that still fits
            if not any(left.get(s + w) for s in set(chosen[1:]) for w in range(1, space + 1)):
                found.append((space, chosen))

    extend((largest,), capacity - largest, 0)
    found.sort(key=lambda x: x[0])
    return [f for _, f in found[:BRANCHES]] or [(largest,)]


def plan(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often each is used, in as few bins as the search finds."""
    whole = [((capacity,), int(counts[capacity]))] if counts[capacity] else []
    counts = counts.copy()
    counts[capacity] = 0
    best = best_fit(counts, capacity)
    most, least = sum(n for _, n in best), lower_bound(counts, capacity)
    size = np.arange(capacity + 1)
    stack = [(counts, (), 0)]
    while stack and nodes and most > least:
        nodes -= 1
        now, taken, bins = stack.pop()
        volume = int((now * size).sum())
        if bins + -(-volume // capacity) >= most:  # what is wasted by now can't beat the incumbent
            continue
        if not volume or nodes % TRY == 0:
            rest = best_fit(now, capacity)
            if bins + sum(n for _, n in rest) < most:
                most, best = bins + sum(n for _, n in rest), rest
                path = taken
                while path:
                    path, filling, n = path
                    best.append((filling, n))
        for f in reversed(fillings(now, capacity) if volume else []):
            use = Counter(f)
            n = min(int(now[s]) // k for s, k in use.items())
            after = now.copy()
            for s, k in use.items():
                after[s] -= n * k
            stack.append((after, (taken, f, n), bins + n))
    return whole + best


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Stored ``pieces`` with sequence_id and offset."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    places: dict[int, list] = {}
    base = 0
    for filling, n in plan(counts, capacity):
        at = 0
        for s, k in Counter(filling).items():
            places.setdefault(s, []).append((n * k, k, base, at))
            at += s * k
        base += n
    tables = {s: (np.cumsum([0, *(x[0] for x in rows)]), *(np.array(c) for c in list(zip(*rows))[1:])) for s, rows in places.items()}

    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (cut.groupBy("part", "length").count()
             .select("part", "length", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("ahead")))
    keep = [c for c in cut.columns if c not in ("part", "nth")]
    ranked = cut.join(ahead, ["part", "length"]).select(*keep, (F.col("ahead") + F.col("nth")).alias("rank"))

    def run(batches):
        for batch in batches:
            length = batch.column(keep.index("length")).to_numpy()
            rank = batch.column(batch.num_columns - 1).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length).tolist():
                rows = length == s
                first, each, begin, at = tables[s]
                i = np.searchsorted(first, rank[rows], "right") - 1
                bin_, slot = np.divmod(rank[rows] - first[i], each[i])
                sequence[rows], offset[rows] = begin[i] + bin_, at[i] + slot * s
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                                             [*keep, "sequence_id", "offset"])

    kinds = dict(cut.dtypes)
    return ranked.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocab: str | None = None, doc_id: str = "doc_id",
                   text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` with their places in sequences of ``capacity`` ids."""
    return pack(stored(pieces(docs, capacity, vocab, doc_id, text, with_ids), "pieces"), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
SQL: dict[str, str] = {}

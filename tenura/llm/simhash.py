"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within 4 bits share a value within 2 bits of both, so
every distinct fingerprint emits the 2,081 values of its ball of half the
radius and equal values meet.  Everything that meets in one value lies within
4 bits of everything else there, so a value links its fingerprints to the
smallest of them: as many links as fingerprints, never all pairs.

The values are shuffled by their leading bits.  A fingerprint travels once to
each of the few blocks that its ball touches, and expands there into just the
values of that block, which keeps the shuffle some tens of times smaller than
moving the values themselves.  A block's values are sorted, links verified by
their bit distance, deduplicated, and thinned to a forest before they leave.

Null texts are empty: no shingle, fingerprint zero, linked like any other.
Every row has its own fingerprint, also where a doc_id repeats; a null doc_id
has a group only through documents that have an id.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm.graph import components
from tenura.llm.scratch import free_name, stored
from tenura.llm.texts import mix, utf8

SHINGLE = 4
RADIUS = 4
SEED = 42
#: A block expands about so many ball values; more fingerprints make more blocks.
VALUES_PER_BLOCK = 1 << 20
#: A block of more ball values than this is dealt in parts.
MOST_VALUES = 1 << 25
#: Values that a task holds at a time (some 60 bytes each while they are put in order).
VALUES_AT_ONCE = 1 << 20


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): a signed 64-bit fingerprint for every row."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("fp"))
    return _fingerprinted(d, f"doc_id {dict(d.dtypes)['doc_id']}, fp bigint", shingle)


def _fingerprinted(d: DataFrame, schema, shingle: int) -> DataFrame:
    """``d`` with the texts of its last column replaced by their fingerprints."""
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(batch.num_columns - 1))
            raw = data.tobytes()
            fps = np.fromiter((_fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())),
                              np.uint64, len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], batch.schema.names)

    return d.mapInArrow(run, schema)


def _fingerprint(raw: bytes, shingle: int) -> int:
    # bytes.lower changes A-Z only, bytes.split cuts at ASCII white space
    words = raw.lower().split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total, parts = np.zeros(64, np.int64), n - shingle + 1
    digest = xxhash.xxh64_intdigest
    for i in range(0, parts, 1 << 16):
        j = min(parts, i + (1 << 16))
        h = np.array([digest(line[a:b], SEED) for a, b in
                      zip(starts[i:j].tolist(), ends[i + shingle - 1:j + shingle - 1].tolist())], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * total > parts).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links between nodes (fp, node) whose fingerprints, distinct here,
    differ in at most ``radius`` bits: few links, with the exact components."""
    if radius % 2:
        raise ValueError("the ball method needs an even radius")
    half = radius // 2
    ball = [sum(comb(64, k) for k in range(i + 1)) for i in range(half + 1)]
    lead = min(24, max(4, ceil(log2(max(1, nodes.count() * ball[half] / VALUES_PER_BLOCK)))))
    low = 64 - lead
    # a fingerprint goes to every block within half the radius of its own leading bits
    near = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(j).alias("used"))
                     for j in range(half + 1) for m in _masks(range(lead), j).tolist()])
    routed = (nodes.select("fp", "node", F.explode(near).alias("x"))
              .select(F.shiftrightunsigned("fp", low).bitwiseXOR(F.col("x")["m"]).alias("block"),
                      "fp", "node", F.col("x")["used"].alias("used")))
    # a block that many close fingerprints share is dealt in parts; what the parts have in common meets below
    weight = F.element_at(F.array(*[F.lit(sum(comb(low, k) for k in range(half - j + 1))) for j in range(half + 1)]),
                          F.col("used") + 1)
    hot = (routed.groupBy("block").agg(F.ceil(F.sum(weight) / MOST_VALUES).alias("parts")).where("parts > 1"))
    dealt = routed.join(hot, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))

    def run(table):
        block = table.column("block")[0].as_py()
        fp = table.column("fp").to_numpy().view(np.uint64)
        node, used = table.column("node").to_numpy(), table.column("used").to_numpy()
        found = _block_links(fp, node, used, block, lead, half, radius, table.column("parts")[0].as_py() > 1)
        return pa.table(dict(zip(("a", "b", "value"), found)))

    met = dealt.groupBy("block", "part").applyInArrow(run, "a bigint, b bigint, value bigint")
    met = stored(met, "ball-links")
    # values that stand in several parts of a block: their roots are chained in value order
    shared = met.where("value is not null").select("value", "a").repartition("value").sortWithinPartitions("value", "a")
    return met.where("value is null").select("a", "b").union(shared.mapInArrow(_chain, "a bigint, b bigint"))


def _masks(bits: range, most: int) -> np.ndarray:
    """All masks with exactly ``most`` of ``bits`` set."""
    return np.array([sum(1 << b for b in c) for c in combinations(bits, most)], np.uint64)


def _block_links(fp, node, used, block, lead, half, radius, shared):
    """Links (a, b, null) of the ball values of one block and, where other parts
    have the same values too, each value with its smallest node (a, null, value)."""
    size = sum(int((used == j).sum()) * sum(comb(64 - lead, k) for k in range(half - j + 1)) for j in range(half + 1))
    more = max(0, ceil(log2(max(1, size / VALUES_PER_BLOCK))))  # further bits, so that values come in bounded lots
    low = 64 - lead - more
    tail = [_masks(range(low), k) for k in range(half + 1)]
    pairs, values = [], []
    for s in range(1 << more):
        at = np.uint64((block << more | s) << low)
        flips = used + np.bitwise_count(((fp >> np.uint64(low)) ^ np.uint64(s)) & np.uint64((1 << more) - 1))
        inside = (fp & np.uint64((1 << low) - 1)) | at
        for value, owner in _lots(inside, flips, tail, half):
            if not shared:
                # most values occur once: only those met again are put in order with their owners
                ordered = np.sort(value)
                again = ordered[1:][ordered[1:] == ordered[:-1]]
                if not len(again):
                    continue
                place = np.searchsorted(again, value)
                place[place == len(again)] = 0
                met = again[place] == value
                value, owner = value[met], owner[met]
            if not len(value):
                continue
            order = np.lexsort((node[owner], value))
            value, owner = value[order], owner[order]
            first = np.concatenate(([True], value[1:] != value[:-1]))
            root = owner[np.flatnonzero(first)[np.cumsum(first) - 1]]
            if shared:
                values.append((node[root[first]], value[first].view(np.int64)))
            key = np.unique(owner[~first].astype(np.int64) << 32 | root[~first])
            a, b = key >> 32, key & 0xFFFFFFFF
            close = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            pairs.append((a[close], b[close]))
    a, b = (np.concatenate(x) if pairs else np.zeros(0, np.int64) for x in (zip(*pairs) if pairs else ((), ())))
    a, b = _forest(node, a, b)
    roots, kept = (np.concatenate(x) if values else np.zeros(0, np.int64) for x in (zip(*values) if values else ((), ())))
    return (pa.array(np.concatenate((a, roots)), pa.int64()),
            pa.array(np.concatenate((b, roots)), pa.int64()),
            pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(kept, pa.int64())]))


def _lots(inside, flips, tail, half):
    """The ball values and their owners, in lots of bounded size; a value's owners
    are all in one lot.  Close fingerprints share all leading bits, so lots go by
    a hash of the value: each lot goes over all values and keeps its own."""
    sets = [(np.flatnonzero(flips == j), m) for j in range(half + 1) for m in tail[:half - j + 1]]
    lots = max(1, ceil(sum(len(rows) * len(m) for rows, m in sets) / VALUES_AT_ONCE))
    for lot in range(lots):
        value, owner = [], []
        for rows, m in sets:
            step = max(1, VALUES_AT_ONCE // 4 // len(m)) if len(m) else 1
            for i in range(0, len(rows) if len(m) else 0, step):
                some = rows[i:i + step]
                v = (inside[some][:, None] ^ m).ravel()
                o = np.repeat(some.astype(np.int32), len(m))
                if lots > 1:
                    own = mix(v) % np.uint64(lots) == np.uint64(lot)
                    v, o = v[own], o[own]
                value.append(v)
                owner.append(o)
        if value:
            yield np.concatenate(value), np.concatenate(owner)


def _forest(node, a, b):
    """Links of each node that has some to the smallest node of its tree."""
    rank = np.empty(len(node), np.int64)
    order = np.argsort(node, kind="stable")
    rank[order] = np.arange(len(node))
    parent = np.arange(len(node))
    a, b = rank[a], rank[b]
    while True:
        x, y = parent[a], parent[b]
        differ = x != y
        if not differ.any():
            break
        np.minimum.at(parent, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (parent[parent] != parent).any():
            parent = parent[parent]
    child = np.flatnonzero(parent != np.arange(len(node)))
    return node[order[child]], node[order[parent[child]]]


def _chain(batches):
    """Links between the roots of neighbouring rows with equal values."""
    last = None
    for batch in batches:
        value, a = (batch.column(i).to_numpy() for i in range(2))
        if not len(value):
            continue
        if last is not None:
            value, a = np.concatenate(([last[0]], value)), np.concatenate(([last[1]], a))
        last = value[-1], a[-1]
        same = np.flatnonzero((value[1:] == value[:-1]) & (a[1:] != a[:-1]))
        pairs = np.unique(np.stack([a[1:][same], a[:-1][same]], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    fps = stored(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").cast("long").alias("node")), "nodes")
    found = components(links(nodes.where("node is not null"), radius))
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
             radius: int = RADIUS) -> DataFrame:
    """One row of every group of near copies, with its own columns: that of the
    smallest id, of its fingerprints the smallest, and of rows alike in both the
    first by their text and then their JSON.  Groups are those of the texts, also
    where an id stands on several; rows without an id all stay."""
    d = docs.where(F.col(doc_id).isNotNull())
    narrow = d.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("own"), F.col(text).cast("string").alias("fp"))
    narrow = stored(_fingerprinted(narrow, f"id {dict(docs.dtypes)[doc_id]}, own bigint, fp bigint", shingle), "fingerprints")
    nodes = stored(narrow.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    found = components(links(nodes.select("fp", F.col("fp").alias("node")), radius))
    classes = nodes.join(found, nodes["fp"] == found["node"], "left").select("id", "fp", F.coalesce("component", "fp").alias("class"))
    kept = classes.groupBy("class").agg(F.min(F.struct("id", "fp")).alias("first")).select("first.id", "first.fp")
    picked = narrow.join(kept, ["id", "fp"], "left_semi").groupBy("id", "fp", "own").agg(F.count(F.lit(1)).alias("rows"))
    rows = picked.groupBy("id", "fp").agg(F.sum("rows").alias("all"))
    names = [free_name(docs, n) for n in ("__id", "__own", "__fp", "__all")]
    picked = stored(picked.join(rows, ["id", "fp"]).select("id", "own", "fp", "all"), "kept").toDF(*names)
    # whole rows are read once; only where an id has several rows of its fingerprint is there a choice
    chosen = d.join(picked, (d[doc_id] == picked[names[0]]) & (F.xxhash64(d[text].cast("string")) == picked[names[1]]))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = (chosen.where(F.col(names[3]) > 1).groupBy(names[0], names[2])
               .agg(F.min_by(own, F.struct(F.col(text).cast("string"), F.to_json(own))).alias(names[1])).select(f"{names[1]}.*"))
    return (chosen.where(F.col(names[3]) == 1).select(*[F.col(f"`{c}`") for c in docs.columns]).union(several)
            .union(docs.where(F.col(doc_id).isNull())))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_simhash_near_dedup": op5_simhash_near_dedup}
SQL: dict[str, str] = {}

"""MinHash near-duplicates by one-permutation hashing.

A document's set holds its distinct word shingles.  One hash of each shingle
names a bin and a value, and the least value of a bin is kept; an empty bin
takes the value of the first full one in its own order of all bins (optimal
densification, so equal choices meet whichever bins are empty).  The bins form
bands, and documents that agree in a band share a bucket.

Equal sets are one node.  A bucket links its nodes to a centre only: a star,
not all pairs.  A node also has the parities of its hashes in ``BITS`` cells: each
shingle of only one of two sets flips one, so pairs with more different
parities than similar sets can have are no candidates, and no link is lost by it.
Candidates are confirmed on the full sets.  A star through one
centre can miss links between its other nodes, so buckets whose nodes are not
in one component by then go on: nodes outside the bucket's largest component
are centres in turn, a bounded number a round, against the nodes of other
components, until every bucket is one component or all its nodes have been
centres.  So a link that shares a bucket is never lost; links at the threshold
share none of the 64 buckets with probability 1e-5.

A null text and one without words have an empty set, linked with nothing.
Equal rows and rows that repeat a doc_id are documents each, grouped by their
own texts.  Rows without an id are grouped only through an equal set that has
one; else their component and ``kept`` are null.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm.graph import components
from tenura.llm.scratch import stored
from tenura.llm.texts import chunks, mix, span_names, utf8, word_names, word_spans

SHINGLE = 4
#: Links: 100 * intersection >= SIMILAR * union.
SIMILAR = 80
#: Bands and bins in each; their product is a power of two.
BANDS, ROWS = 64, 8
BINS = BANDS * ROWS
#: Parities of a set, in words of 64.
BITS = 256
WORDS = [f"bits{k}" for k in range(BITS // 64)]
#: Bands whose stars are tried first; the others mostly find one component then.
FIRST_BANDS = 8
#: Centres of a bucket in each later round, at most.
CENTRES = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_RANDOM = np.random.default_rng(0x12B1)
#: For every bin, the order in which it asks the others for a value.
_ORDER = np.argsort(_RANDOM.random((BINS, BINS)), axis=1).T.astype(np.int64).copy()
_SALT = _RANDOM.integers(1, 2**63, BINS, dtype=np.uint64)
_BAND = _RANDOM.integers(1, 2**63, BANDS, dtype=np.uint64)
_NAME = _RANDOM.integers(1, 2**63, 2, dtype=np.uint64)
_CELL = _RANDOM.integers(1, 2**63, dtype=np.uint64)


def shingles(column: pa.Array, width: int = SHINGLE):
    """Distinct shingle hashes of lots of texts, each text's in ascending order,
    with their bounds: (first row, hashes, bounds)."""
    data, offsets = utf8(column)
    for i, j in chunks(offsets):
        raw = _LOWER[data[offsets[i]:offsets[j]]]
        start, end, first = word_spans(raw, offsets[i:j + 1] - offsets[i])
        words = word_names(raw, start, end) if len(start) else np.zeros(0, np.uint64)
        n = np.diff(first)
        many = np.maximum(n - width + 1, np.minimum(n, 1))  # shingles, repeats included
        bounds = np.concatenate(([0], np.cumsum(many)))
        at = np.repeat(first[:-1] - bounds[:-1], many) + np.arange(bounds[-1])
        h = span_names(words, at, at + np.repeat(np.minimum(n, width), many)) if len(at) else np.zeros(0, np.uint64)
        sets = [np.unique(h[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        yield i, np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bins (row, bin) of sets of ascending hashes; no set is empty."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    cell = row * BINS + (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    sig, full = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    sig[cell[head]], full[cell[head]] = h[head], True
    left = np.flatnonzero(~full)
    base, bin_ = left - left % BINS, left % BINS
    for ask in _ORDER:
        if not len(left):
            break
        source = base + ask[bin_]
        found = full[source]
        sig[left[found]] = sig[source[found]]
        left, base, bin_ = left[~found], base[~found], bin_[~found]
    return sig.reshape(n, BINS)


def buckets(sig: np.ndarray) -> np.ndarray:
    """Names (row, band) of the buckets."""
    cells = mix(sig ^ _SALT).reshape(len(sig), BANDS, ROWS)
    return mix(cells.sum(2, dtype=np.uint64) ^ _BAND)


def parities(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parities (row, word) of the hashes of sets in BITS cells."""
    n = len(bounds) - 1
    cell = np.repeat(np.arange(n), np.diff(bounds)) * BITS + (mix(h ^ _CELL) % np.uint64(BITS)).astype(np.int64)
    odd = np.bincount(cell, minlength=n * BITS) % 2 == 1
    return np.packbits(odd).view(np.int64).reshape(n, BITS // 64)


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, banded: bool = True) -> DataFrame:
    """(doc_id, n_shingles, h1, h2) of every row: the set's size and its name in 128 bits;
    with ``banded`` also bands, its buckets (null for an empty set), and its parities."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for i, h, bounds in shingles(batch.column(1), width):
                for x in range(0, len(bounds) - 1, 256):
                    part = bounds[x:x + 257]
                    own, n = h[part[0]:part[-1]], np.diff(part)
                    full = n > 0
                    some = np.concatenate(([0], np.cumsum(n[full])))
                    names = np.zeros((2, len(n)), np.int64)
                    bands = np.zeros((0, BANDS), np.uint64)
                    if len(own):
                        for k in range(2):
                            names[k, full] = np.add.reduceat(mix(own ^ _NAME[k]), some[:-1]).view(np.int64)
                    found = [batch.column(0).slice(i + x, len(n)), pa.array(n, pa.int64()), *(pa.array(names[k], mask=~full) for k in range(2))]
                    if banded:
                        if len(own):
                            bands = buckets(signatures(own, some))
                        ends = np.concatenate(([0], np.cumsum(full))).astype(np.int32) * BANDS
                        found.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel().view(np.int64)), mask=pa.array(~full)))
                        found += [pa.array(b.copy()) for b in parities(own, part - part[0]).T]
                    yield pa.RecordBatch.from_arrays(found, columns)

    columns = ["doc_id", "n_shingles", "h1", "h2", *(["bands", *WORDS] if banded else [])]
    kind = f"doc_id {dict(d.dtypes)['doc_id']}, n_shingles bigint, h1 bigint, h2 bigint"
    return d.mapInArrow(run, kind + (", bands array<bigint>" + "".join(f", {b} bigint" for b in WORDS) if banded else ""))


def full_sets(docs: DataFrame, nodes: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(node, hashes): the whole sets of nodes (node, h1, h2, first), read again
    from a document that has them."""
    kind = dict(docs.dtypes)[doc_id]
    d = docs.select(F.col(doc_id).alias("first"), F.col(text).cast("string").alias("text"))
    d = d.join(nodes.select("first").distinct(), "first", "left_semi").select("text")

    def run(batches):
        for batch in batches:
            for i, h, bounds in shingles(batch.column(0), width):
                full = np.flatnonzero(np.diff(bounds))
                if not len(full):
                    continue
                names = [pa.array(np.add.reduceat(mix(h ^ _NAME[k]), bounds[full]).view(np.int64)) for k in range(2)]
                own = [h[bounds[r]:bounds[r + 1]].tobytes() for r in full]
                yield pa.RecordBatch.from_arrays([*names, pa.array(own, pa.binary())], ["h1", "h2", "hashes"])

    sets = d.mapInArrow(run, "h1 bigint, h2 bigint, hashes binary")
    return (sets.join(nodes.select("node", "h1", "h2"), ["h1", "h2"])
            .groupBy("node").agg(F.any_value("hashes").alias("hashes")))


def confirmed(edges: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The candidate pairs (a, b) whose full sets are similar."""
    both = (edges.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
            .join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").select("a", "b", "x", "y"))

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * shared >= similar * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def _pairs(centres: DataFrame, members: DataFrame, similar: int) -> DataFrame:
    """Distinct pairs (a, b) of centres (bucket, centre, size, group) and the
    members of other components; sizes or parities too far apart are no candidates."""
    fit = (100 * F.least("n", "size") >= similar * F.greatest("n", "size")) & (F.col("group") != F.col("label"))
    flips = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"c_{b}"))) for b in WORDS), F.lit(0))
    fit = fit & ((100 + similar) * flips <= (100 - similar) * (F.col("n") + F.col("size")))
    return (members.join(centres, "bucket").where(fit)
            .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())


def _centres(members: DataFrame, *by) -> DataFrame:
    """One member of every bucket (and class), another one in each bucket."""
    # a bucket's name flips the nodes' bits, so each bucket has its own order of them
    least = (members.groupBy("bucket", *by).agg(F.min(F.col("node").bitwiseXOR(F.col("bucket"))).alias("least"))
             .select("bucket", F.col("least").bitwiseXOR(F.col("bucket")).alias("centre")))
    own = members.select("bucket", F.col("node").alias("centre"), F.col("n").alias("size"), F.col("label").alias("group"),
                         *[F.col(b).alias(f"c_{b}") for b in WORDS])
    return least.join(own, ["bucket", "centre"])


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members with the component of their node."""
    found = components(links).withColumnRenamed("component", "label")
    return (members.drop("label").join(found, "node", "left")
            .select("bucket", "first_band", "node", "n", *WORDS, F.coalesce("label", "node").alias("label")))


def similar_links(nodes: DataFrame, sets, similar: int = SIMILAR) -> DataFrame:
    """Links (a, b) that join all similar nodes (node, n, bands, parities) that share a
    bucket; ``sets(ids)`` gives the full sets of some nodes."""
    every = nodes.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    many = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket")
    members = stored(every.join(many, "bucket", "left_semi").join(nodes.select("node", *WORDS), "node")
                     .select("bucket", (F.col("band") < FIRST_BANDS).alias("first_band"), "node", "n", *WORDS, F.col("node").alias("label")), "members")
    sets = stored(sets(members.select("node").distinct()), "full-sets")
    # stars of the first bands, then of all buckets that are not one component yet
    first = members.where("first_band")
    tested = stored(_pairs(_centres(first), first, similar), "candidates")
    links = stored(confirmed(tested, sets, similar), "links")
    members = stored(_labelled(members, links), "members")
    new = stored(_pairs(_centres(members), members, similar).join(tested, ["a", "b"], "left_anti"), "candidates")
    links = stored(links.union(confirmed(new, sets, similar)), "links")
    tested = stored(tested.union(new), "tested")
    members = stored(_labelled(members, links), "members")
    while True:
        size = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
        open_ = (size.groupBy("bucket").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("k", "label"))["label"].alias("top"))
                 .where("labels > 1"))
        members = stored(members.join(open_.select("bucket", "top"), "bucket"), "open-members")
        if members.isEmpty():
            return links
        # nodes outside the largest component, one of each class a round
        outside = members.where("label <> top").withColumn("class", F.pmod(F.xxhash64("node"), F.lit(CENTRES)))
        centres = stored(_centres(outside, "class"), "centres")
        new = stored(_pairs(centres, members, similar).join(tested, ["a", "b"], "left_anti"), "candidates")
        links = stored(links.union(confirmed(new, sets, similar)), "links")
        tested = stored(tested.union(new), "tested")
        # a centre has met all members of its bucket: it takes no more part there
        rest = members.drop("top").join(centres.select("bucket", F.col("centre").alias("node")), ["bucket", "node"], "left_anti")
        members = stored(_labelled(rest, links), "members")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE,
                    similar: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    # bands take most of a sketch: they are written for distinct sets only
    rows = stored(sketches(docs, doc_id, text, width, banded=False), "sketches")
    nodes = stored(sketches(docs, doc_id, text, width).where("n_shingles > 0").groupBy("h1", "h2")
                   .agg(*[F.any_value(b).alias(b) for b in ("bands", *WORDS)], F.max("n_shingles").alias("n"), F.min("doc_id").alias("first"))
                   .where("first is not null").withColumn("node", F.monotonically_increasing_id()), "nodes")
    links = similar_links(nodes, lambda ids: full_sets(docs, nodes.join(ids, "node", "left_semi"), doc_id, text, width), similar)
    found = stored(components(links), "components")
    classes = nodes.select("h1", "h2", "node", "first").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "component").select("h1", "h2", "component_id")
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return (rows.where("n_shingles > 0").select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
            .select("doc_id", "n_shingles", "component_id").union(empty)
            .withColumn("kept", F.col("doc_id") == F.col("component_id")))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, group and fate of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_minhash_near_dedup": op12_minhash_near_dedup}
SQL = {
    "op12_minhash_near_dedup": rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) <= {SHINGLE} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {SHINGLE} + 2), lambda i: array_to_string(ws[i:i + {SHINGLE} - 1], ' '))) END AS s FROM w),
u AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= {SIMILAR} * (a.n + b.n - k)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM reach r JOIN e ON e.x = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)""",
}

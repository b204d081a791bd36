"""Product codes of vectors with Orchard's search.

Components become integers, vectors are cut into equal parts, and each part
position has a codebook.  An entry keeps the other entries in order of their
distance to it.  The search for a part's nearest entry walks the list of the
best entry so far: an entry that is nearer is jumped to, entries seen are
marked, and the walk ends where the list's entries are more than twice as far
from the best one as the part is, as none of those can be nearer or as near.
All arithmetic is on integers, so ties are exact and go to the lower index.

Spark assigns parts in tasks and adds up the parts of every entry, one row an
entry and task; the driver holds codebooks only (at most ``ENTRIES`` vectors).

Dropped: rows whose vector is null or holds null or non-finite components.  The
rows kept must have one length that ``parts`` divides and components under
2^20 in size, else a ValueError says so.  Rows that repeat a vec_id each have a
code; the first codebook takes rows in order of vec_id and then of components,
null ids last.  Fewer rows than entries make a smaller codebook, an empty table
gives no rows, and columns other than the three named are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm.scratch import stored

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Integers of this size and more could overflow in squared distances.
MOST = 1 << 30
#: Vectors searched at a time within a task.
LOT = 4096


def integers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
             scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): the rows kept, with components floor(scale * x)."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.where(v.isNotNull() & ~bad)
            .select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v")))


def first_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (part, entry, place) of the rows with the smallest ids."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    v = np.array([r["v"] for r in first], np.int64).reshape(len(first), -1)
    return np.ascontiguousarray(v.reshape(len(first), parts, v.shape[1] // parts).swapaxes(0, 1))


def neighbour_lists(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry of one codebook: the other entries by distance, and the squared distances."""
    apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    k = len(book)
    # the entry itself goes to the front and is cut off
    order = np.argsort(np.where(np.eye(k, dtype=bool), -1, apart), axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(apart, order, 1)


def nearest(x: np.ndarray, book: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every row and its squared distance; ties to the lower index."""
    n, k = len(x), len(book)
    best = np.zeros(n, np.int64)
    far = ((x - book[0]) ** 2).sum(1)
    seen = np.zeros((n, k), bool)
    seen[:, 0] = True
    at = np.zeros(n, np.int64)
    rows = np.arange(n) if k > 1 else np.zeros(0, np.int64)
    while len(rows):
        rows = rows[at[rows] < k - 1]
        own, place = best[rows], at[rows]
        walk = apart[own, place] <= 4 * far[rows]
        rows, own, place = rows[walk], own[walk], place[walk]
        entry = order[own, place]
        at[rows] += 1
        new = np.flatnonzero(~seen[rows, entry])
        tried, entry, own = rows[new], entry[new], own[new]
        seen[tried, entry] = True
        d = ((x[tried] - book[entry]) ** 2).sum(1)
        jump = (d < far[tried]) | ((d == far[tried]) & (entry < own))
        tried, entry = tried[jump], entry[jump]
        best[tried], far[tried], at[tried] = entry, d[jump], 0
    return best, far


def _assigner(books: np.ndarray):
    """Codes and squared distances (row, part) of vectors."""
    lists = [neighbour_lists(book) for book in books]

    def assign(v: np.ndarray):
        cut = v.reshape(len(v), len(books), -1)
        found = [nearest(np.ascontiguousarray(cut[:, p]), books[p], *lists[p]) for p in range(len(books))]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    return assign


def _vectors(batch, column: int, width: int):
    """Lots of a batch: (start, rows, components)."""
    lists = batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), width)
    for i in range(0, len(flat), LOT):
        yield i, min(LOT, len(flat) - i), flat[i:i + LOT]


def next_books(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry replaced by the floored mean of the parts nearest to it; unused ones stay."""
    parts, k, width = books.shape

    def run(batches):
        assign, total, number = _assigner(books), np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            for _, n, v in _vectors(batch, 0, parts * width):
                code, _ = assign(v)
                for p in range(parts):
                    np.add.at(total[p], code[:, p], v.reshape(n, parts, width)[:, p])
                    number[p] += np.bincount(code[:, p], minlength=k)
        used = np.flatnonzero(number.ravel())
        row = np.concatenate((np.repeat(used, width), used))
        place = np.concatenate((np.tile(np.arange(width), len(used)), np.full(len(used), width)))
        value = np.concatenate((total.reshape(-1, width)[used].ravel(), number.ravel()[used]))
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(place, pa.int32()), pa.array(value, pa.int64())],
                                         ["entry", "place", "value"])

    sums = (rows.select("v").mapInArrow(run, "entry int, place int, value bigint")
            .groupBy("entry", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
            .collect())  # a number for each component of the codebooks and one for each entry
    total = {(r["entry"], r["place"]): int(r["value"]) for r in sums}
    new = books.reshape(parts * k, width).copy()
    for e in range(parts * k):
        n = total.get((e, width))
        if n:
            new[e] = [total[e, i] // n for i in range(width)]
    return new.reshape(books.shape)


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after ``rounds`` rounds over all rows."""
    books = first_books(rows, parts, entries)
    for _ in range(rounds):
        books = next_books(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): two hex digits a part, squared distances summed."""
    parts, _, width = books.shape
    kinds = dict(rows.dtypes)

    def run(batches):
        assign = _assigner(books)
        for batch in batches:
            for i, n, v in _vectors(batch, 2, parts * width):
                code, far = assign(v)
                text = [bytes(c).hex() for c in code.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, n).columns[:2], pa.array(text, pa.string()), pa.array(far.sum(1))],
                                                 ["vec_id", "label", "code", "error"])

    return (rows.select("vec_id", "label", "v")
            .mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"))


def digest(books: np.ndarray) -> str:
    """Checksum of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row kept."""
    if not 0 < entries <= 256:
        raise ValueError("two hex digits hold up to 256 entries")
    rows = stored(integers(vectors, vec_id, vector, label), "integers")
    size = F.size("v")
    least, most, largest = rows.agg(F.min(size), F.max(size), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()
    if least is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"),
                           F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    if least != most or most % parts or most == 0:
        raise ValueError(f"vectors need one length that {parts} divides; there are lengths from {least} to {most}")
    if largest >= MOST:
        raise ValueError("components of 2^20 and more are not supported")
    books = train(rows, parts, entries, rounds)
    coded = stored(encode(rows, books), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return (coded.join(sums, coded["label"].eqNullSafe(sums["of"]))
            .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))


def op13_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """Four rounds and the codes, each round a search over all entries."""
    far = "CAST(list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v) AS BIGINT)"
    steps = [f"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id, v) - 1 AS r FROM kept),
cut AS MATERIALIZED (
  SELECT r, p, v[CAST(p * len(v) / {PARTS} + 1 AS BIGINT):CAST((p + 1) * len(v) / {PARTS} AS BIGINT)] AS v
  FROM numbered, range({PARTS}) t(p)),
book0 AS MATERIALIZED (SELECT p, r AS e, v FROM cut WHERE r < {ENTRIES})"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""found{i} AS MATERIALIZED (
  SELECT a.r, a.p, any_value(a.v) AS v, min({far} * {ENTRIES} + b.e) AS k FROM cut a JOIN book{i} b USING (p) GROUP BY a.r, a.p)""")
        if i < ROUNDS:
            steps.append(f"""mean{i} AS (
  SELECT p, e, list(m ORDER BY i) AS v FROM (
    SELECT p, k % {ENTRIES} AS e, i, floor(sum(v[i + 1]) / count(*)) AS m FROM found{i}, range(len(v)) t(i) GROUP BY p, k % {ENTRIES}, i)
  GROUP BY p, e),
book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN mean{i} m USING (p, e))""")
    return "WITH " + ",\n".join(steps) + f""",
sha AS (SELECT sha256(string_agg(CAST(CAST(v[i + 1] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
        FROM book{ROUNDS}, range(len(v)) t(i)),
codes AS (SELECT r, string_agg(printf('%02x', k % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(k // {ENTRIES}) AS BIGINT) AS error
          FROM found{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes JOIN numbered USING (r), sha"""


QUERIES = {"op13_vector_code_compression": op13_vector_code_compression}
SQL = {"op13_vector_code_compression": _sql()}

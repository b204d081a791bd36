"""Token ids in ORC files.

Documents are dealt to segments by ranges of doc_id, one file each, in
ascending order.  Ids are a list column, which ORC stores with integer
run-length encoding; row indexes and a Bloom filter on doc_id let a reader skip
stripes and row groups, and stripes are read in parallel.  A row also carries
its segment and the ids before it there, so that global starts need just the
segments' totals.

A null text is an empty document (its end id only).  Null doc_ids come first.
Rows that repeat a doc_id are written each, equal ids ordered by text.  An
empty table writes files without rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenura.llm.scratch import shared_path
from tenura.llm.tokens import lots, piece_encoder, vocabulary

END = 2
#: Writer options: stripes of 16 MB, an index entry each 1,000 rows, 1 % false positives.
LAYOUT = {"compression": "zstd", "orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000",
          "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}


def write_tokens(docs: DataFrame, path: str, vocab: str | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append the end id, and write ORC files to ``path``."""
    vocab = vocab or vocabulary()
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    dealt = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        segment, before, own = TaskContext.get().partitionId(), 0, piece_encoder(vocab)
        for batch in batches:
            for i, j in lots(batch.column(1)):
                lot = batch.slice(i, j - i)
                ids, bounds = own.ids([t or "" for t in lot.column(1).to_pylist()])
                n = np.diff(bounds) + 1
                ends = np.cumsum(n)
                whole = np.insert(ids, bounds[1:], END).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    lot.column(0), pa.array(np.full(len(n), segment, np.int32)), pa.array(before + ends - n), pa.array(n),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(whole))],
                    ["doc_id", "segment", "before", "n_tokens", "ids"])
                before += int(ends[-1])

    kind = dict(d.dtypes)["doc_id"]
    (dealt.mapInArrow(run, f"doc_id {kind}, segment int, before bigint, n_tokens bigint, ids array<int>")
     .write.options(**LAYOUT).orc(path))


def read_tokens(spark: SparkSession, path: str, doc_id_type: str = "bigint") -> DataFrame:
    """The rows of written files; filters on doc_id reach the ORC indexes."""
    return spark.read.schema(f"doc_id {doc_id_type}, segment int, before bigint, n_tokens bigint, ids array<int>").orc(path)


def starts(tokens: DataFrame) -> DataFrame:
    """(segment, base): ids in all segments before; one row per file."""
    totals = tokens.groupBy("segment").agg(F.sum("n_tokens").alias("total"))
    w = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("segment", F.coalesce(F.sum("total").over(w), F.lit(0)).alias("base"))


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, segment, before, n_tokens, ids_crc32) of the ids as read."""
    def run(batches):
        for batch in batches:
            lists = batch.column(4)
            raw = memoryview(lists.values.to_numpy().astype("<u4").view(np.uint8))
            at = (lists.offsets.to_numpy().astype(np.int64) * 4).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], [*batch.schema.names[:4], "ids_crc32"])

    kind = dict(tokens.dtypes)["doc_id"]
    return (tokens.select("doc_id", "segment", "before", "n_tokens", "ids")
            .mapInArrow(run, f"doc_id {kind}, segment int, before bigint, n_tokens bigint, ids_crc32 bigint"))


def op2_token_orc_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids, read the files back, and digest them."""
    path = shared_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    tokens = read_tokens(spark, path)
    return (checksums(tokens).join(starts(tokens), "segment")
            .select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))


QUERIES = {"op2_token_orc_output": op2_token_orc_output}
SQL: dict[str, str] = {}

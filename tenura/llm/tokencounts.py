"""Edit-aware token counts.

A document keeps a segment tree: its leaves are runs of pre-tokens with their
lengths in characters and their token counts, its inner nodes the sums.  An
edit finds the leaves that it touches by descending on characters, takes in a
neighbour where the cut between two leaves no longer ends a pre-token, encodes
just that region anew and adds the differences along the paths to the root.

Trees are columns of a table beside the text, so a round of edits is one scan
of that table; texts without an edit pass through.  A null text is empty and
stays null unless it is edited.  Edits may not overlap; their places are in
characters of the text before the round.  Repeated rows keep a tree each.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm.scratch import free_name, stored
from tenura.llm.tokens import SPACES, encoder, vocabulary

#: Pre-token pieces of a fresh leaf.
LEAF = 32
_PIECE = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
_SPACE = re.compile(f"[{SPACES}]")

#: Edits of the production round: personal data and secrets give way to marks.
REDACTIONS = (("[^ \\t-\\r@]+@[^ \\t-\\r@]+", "<email>"), ("(?<=password=)[^ \\t-\\r]+", "<secret>"))


class Tree:
    """Characters and tokens of the leaves, and their sums, as two heaps."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens

    @classmethod
    def of(cls, text: str, own) -> Tree:
        pieces = _PIECE.findall(text)
        lots = ["".join(pieces[i:i + LEAF]) for i in range(0, len(pieces), LEAF)] or [""]
        return cls(_heap([len(x) for x in lots]), _heap([len(own.ids(x)) for x in lots]))

    @property
    def width(self) -> int:
        return len(self.chars) // 2

    def leaf(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one for the end) and where it begins."""
        i, begin = 1, 0
        while i < self.width:
            i *= 2
            if place - begin >= self.chars[i] and self.chars[i + 1]:
                begin += int(self.chars[i])
                i += 1
        return i - self.width, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        """Set a leaf and update the sums above it."""
        for heap, value in ((self.chars, chars), (self.tokens, tokens)):
            i = leaf + self.width
            change = value - int(heap[i])
            while i and change:
                heap[i] += change
                i //= 2


def _heap(leaves: Sequence[int]) -> np.ndarray:
    width = 1
    while width < len(leaves):
        width *= 2
    heap = np.zeros(2 * width, np.int64)
    heap[width:width + len(leaves)] = leaves
    for i in range(width - 1, 0, -1):
        heap[i] = heap[2 * i] + heap[2 * i + 1]
    return heap


def edit(text: str, tree: Tree, edits: Sequence[tuple[int, int, str]], own) -> tuple[str, int]:
    """Apply (place, length, replacement) edits; the text after, and the tokens
    encoded anew.  The text is taken apart into its leaves once and put
    together once, so an edit costs what the leaves it touches hold."""
    ends = np.cumsum(tree.chars[tree.width:]).tolist()
    leaves = [text[a:b] for a, b in zip([0, *ends], ends)]
    encoded = 0

    def beside(leaf: int, step: int) -> int | None:
        """The next leaf that is not empty."""
        leaf += step
        while 0 <= leaf < len(leaves):
            if leaves[leaf]:
                return leaf
            leaf += step
        return None

    for place, length, new in sorted(edits, reverse=True):  # from the end, so that places stay true
        first, begin = tree.leaf(place)
        last, _ = tree.leaf(max(place, place + length - 1))
        if place == begin:  # what goes before is context of an insertion at a cut
            before = beside(first, -1)
            if before is not None:
                first, begin = before, begin - len(leaves[before])
        region = "".join(leaves[first:last + 1])
        region = region[:place - begin] + new + region[place - begin + length:]
        # a cut is good between a character that is no space and one that is
        while (after := beside(last, 1)) is not None and (
                not region or _SPACE.match(region[-1]) or not _SPACE.match(leaves[after][0])):
            region, last = region + leaves[after], after
        while (before := beside(first, -1)) is not None and (
                not region or not _SPACE.match(region[0]) or _SPACE.match(leaves[before][-1])):
            region, first = leaves[before] + region, before
        pieces = _PIECE.findall(region)
        per = -(-len(pieces) // (last - first + 1)) if pieces else 1
        for k, leaf in enumerate(range(first, last + 1)):
            part = "".join(pieces[k * per:(k + 1) * per])
            n = len(own.ids(part))
            encoded += n
            tree.put(leaf, len(part), n)
            leaves[leaf] = part
    return "".join(leaves), encoded


def tree_names(docs: DataFrame) -> tuple[str, str]:
    """The columns that ``count`` adds: __chars and __tokens, lengthened by
    ``_`` where ``docs`` has such columns."""
    return free_name(docs, "__chars"), free_name(docs, "__tokens")


def count(docs: DataFrame, text: str = "text", vocab: str | None = None) -> DataFrame:
    """``docs`` with the trees as columns (``tree_names``); the whole text's
    tokens are the root, the second entry of the tokens' column."""
    vocab = vocab or vocabulary()
    at = docs.columns.index(text)
    names = tree_names(docs)

    def run(batches):
        own = encoder(vocab)
        for batch in batches:
            trees = [Tree.of(t.as_py() or "", own) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(_lists([getattr(t, k) for t in trees]) for k in ("chars", "tokens"))],
                                             [*batch.schema.names, *names])

    empty = F.lit(None).cast("array<int>")
    return docs.mapInArrow(run, docs.withColumns(dict.fromkeys(names, empty)).schema)


def _lists(heaps) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(h) for h in heaps]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*heaps, np.zeros(0, np.int64)]).astype(np.int32)))


def apply_edits(counted: DataFrame, find, text: str = "text", vocab: str | None = None,
                tree: Sequence[str] = ("__chars", "__tokens")) -> DataFrame:
    """``counted`` documents after one round of edits, with their trees, and
    columns __edits and __encoded (edits made, tokens encoded anew; lengthened
    by ``_`` where there are such columns).

    ``find`` gives the edits (place, length, replacement) of a text, ``tree``
    names the columns that ``count`` added."""
    vocab = vocab or vocabulary()
    names = counted.columns
    at, chars, tokens = (names.index(c) for c in (text, *tree))
    added = [free_name(counted, c) for c in ("__edits", "__encoded")]

    def run(batches):
        own = encoder(vocab)
        for batch in batches:
            texts, trees, made, encoded = [], [], [], []
            for t, c, k in zip(batch.column(at), batch.column(chars), batch.column(tokens), strict=True):
                t, n = t.as_py(), 0
                heaps = Tree(*(x.values.to_numpy().astype(np.int64) for x in (c, k)))
                edits = list(find(t or ""))
                if edits:
                    t, n = edit(t or "", heaps, edits, own)
                texts.append(t)
                trees.append(heaps)
                made.append(len(edits))
                encoded.append(n)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            columns[chars], columns[tokens] = (_lists([getattr(x, k) for x in trees]) for k in ("chars", "tokens"))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.int64()), pa.array(encoded, pa.int64())],
                                             [*names, *added])

    n = F.lit(0).cast("long")
    return counted.mapInArrow(run, counted.withColumns(dict.fromkeys(added, n)).schema)


class Redact:
    """Edits that put marks in the place of what patterns match."""

    def __init__(self, rules=REDACTIONS):
        self.patterns = [(re.compile(p), mark) for p, mark in rules]

    def __call__(self, text: str):
        if "@" not in text and "=" not in text:
            return
        end = 0
        for a, b, mark in sorted((m.start(), m.end(), mark) for p, mark in self.patterns for m in p.finditer(text)):
            if a >= end:
                yield a, b - a, mark
                end = b


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after redaction."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = count(docs)
    before = stored(counted.withColumn("__before", F.get("__tokens", F.lit(1)).cast("long")), "counted")
    after = apply_edits(before, Redact())
    return after.select("doc_id", F.col("__before").alias("n_tokens"), F.col("__edits").alias("n_edits"),
                        F.get("__tokens", F.lit(1)).cast("long").alias("n_tokens_after"), F.col("__encoded").alias("n_encoded"))


QUERIES = {"op4_token_counts": op4_token_counts}
SQL: dict[str, str] = {}

"""Token alignment of two tokenizers by white-space anchors.

Both tokenizers encode a whole text.  Where an A and a B token end at the same
byte and both next tokens begin with a space, the text is cut into windows.
Windows recur, so in a lot of texts each distinct one, known by the ids of both
sides, is aligned once and looked up for the others: groups end where both
sides end, and every overlapping A-B pair is a link.  A link's weight is the number of documents that hold its id pair.

The pairs' counts come from partial counts of every task.  A bounded number of
the most frequent pairs (``HEAVY``) is broadcast, which leaves no frequent key;
the other pairs meet their counts in a join.  The highest count of an A id is
one number for each id of the vocabulary.

A null or empty text, and one whose joined token bytes differ from space+text
on either side, has no tokens: zeros and an empty digest.  Every row is a
document, also where a doc_id repeats or is null; an empty table gives no rows.
Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm.scratch import stored
from tenura.llm.texts import mix, span_names
from tenura.llm.tokens import SPACES, lots, piece_encoder, pieces, spread, vocabulary

PIECES = "piece_bpe_32k.model"
#: Pairs whose counts are broadcast (12 bytes each).
HEAVY = 1 << 17
#: Bytes of text aligned at a time (or one longer text).
LOT_BYTES = 5 << 19


class SpacedPieces:
    """The sentencepiece side: ids of texts, and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]
        self.size = np.array(list(map(len, self.bytes)), np.int64)
        self.blank = self.model.piece_to_id("▁")
        # no entry runs on over a space or a line break, so ids of pieces in turn are the text's ids
        self.by_piece = not any("▁" in p.lstrip("▁") or "\n" in p for p in map(self.model.id_to_piece, range(len(self.bytes))))

    def _bytes(self, i: int) -> bytes:
        if self.model.is_byte(i):
            return bytes([int(self.model.id_to_piece(i)[3:5], 16)])
        return self.model.id_to_piece(i).replace("▁", " ").encode()

    def piece_ids(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that begin with one space or one line break, and their bounds."""
        # the model adds a space ahead: a piece's own one, or one to drop before a line break
        found = self.model.encode([n[1:] if n[0] == " " else n for n in names], num_threads=1)
        found = [x[1:] if n[0] == "\n" else x for n, x in zip(names, found)]
        return _flat(found)


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))))
    return np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1])), ends


def _by_words(text: str) -> bool:
    """Words stand between single spaces and single line breaks."""
    return not (any(c in text for c in SPACES if c not in " \n") or "  " in text or "\n\n" in text or " \n" in text
                or "\n " in text or text[-1] in " \n" or "▁" in text or "\0" in text)


class Aligner:
    """Alignments of texts under two vocabularies, with a table of known windows."""

    def __init__(self, byte_level: str, spaced: str):
        self.a = piece_encoder(byte_level, True)
        self.b = SpacedPieces(spaced)
        self.space_a, self.space_b = (np.array([x[:1] == b" " for x in side.bytes]) for side in (self.a, self.b))
        for side in (self.a, self.b):
            side.flat = np.frombuffer(b"".join(side.bytes), np.uint8)
            side.bounds = np.concatenate(([0], np.cumsum(side.size)))
        # ids as written with what may follow them
        most = max(len(self.a.bytes), len(self.b.bytes))
        self.written = [str(i) + mark for mark in ",|;" for i in range(most)] + list(map(str, range(most)))
        self.written_size = np.array(list(map(len, self.written)), np.int64)
        self.most = most

    def encode(self, texts: list[str]):
        """Ids and bounds of both sides for space+text; texts whose bytes differ have none."""
        spaced = [" " + t if t else "" for t in texts]
        plain = [bool(t) and self.b.by_piece and _by_words(" " + t) for t in texts]
        names, at, bounds = pieces(spaced)
        ids_a, ends = spread(*self.a.piece_ids(names), at)
        bounds_a = ends[bounds]
        # B: pieces of the texts made of words, the others whole
        used = np.zeros(len(names), bool)
        rows = np.repeat(np.array(plain, bool), np.diff(bounds))
        used[at[rows]] = True
        new = np.cumsum(used) - 1
        flat, ends = self.b.piece_ids([n for n, u in zip(names, used.tolist()) if u])
        part, part_ends = spread(flat, ends, new[at[rows]])
        part_bounds = part_ends[np.concatenate(([0], np.cumsum(rows)))[bounds]]
        if all(p or not t for p, t in zip(plain, texts)):
            ids_b, bounds_b = part, part_bounds
        else:
            own = [part[x:y] if p or not t else np.array(self.b.model.encode(t), np.int32)
                   for t, p, x, y in zip(texts, plain, part_bounds[:-1].tolist(), part_bounds[1:].tolist())]
            ids_b, bounds_b = np.concatenate(own), np.concatenate(([0], np.cumsum(list(map(len, own)))))
        # joined bytes are compared with the text's
        raw = np.frombuffer("".join(spaced).encode(), np.uint8)
        size = np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in spaced), np.int64, len(spaced))
        good = (size > 0) & self._equal(raw, size, self.a, ids_a, bounds_a) & self._equal(raw, size, self.b, ids_b, bounds_b)
        if not good.all():
            (ids_a, bounds_a), (ids_b, bounds_b) = ((ids[np.repeat(good, np.diff(x))], np.concatenate(([0], np.cumsum(np.diff(x) * good))))
                                                    for ids, x in ((ids_a, bounds_a), (ids_b, bounds_b)))
        return ids_a, bounds_a, ids_b, bounds_b

    @staticmethod
    def _equal(raw, size, side, ids, bounds):
        """Which texts, ``size`` bytes each of ``raw``, are the joined bytes of their ids."""
        ends = np.concatenate(([0], np.cumsum(side.size[ids])))[bounds]
        same = np.diff(ends) == size
        start = np.cumsum(size) - size
        # texts of the wrong length have no bytes to compare
        text, _ = spread(raw, np.concatenate((start, [len(raw)])), np.flatnonzero(same)) if not same.all() else (raw, None)
        joined, token = spread(side.flat, side.bounds, ids if same.all() else ids[np.repeat(same, np.diff(bounds))])
        wrong = np.flatnonzero(joined != text)
        if len(wrong):
            rows = np.flatnonzero(same)
            same[np.unique(rows[np.searchsorted(np.cumsum(size[rows]), wrong, "right")])] = False
        return same

    def windows(self, ids_a, bounds_a, ids_b, bounds_b):
        """Ends of the windows on both sides: shared ends before two tokens that
        begin with a space, and the ends of the texts."""
        end_a, end_b = np.cumsum(self.a.size[ids_a]), np.cumsum(self.b.size[ids_b])
        at_b = np.searchsorted(end_b, end_a)
        shared = end_b[np.minimum(at_b, len(end_b) - 1)] == end_a
        last = np.zeros(len(ids_a), bool)
        last[bounds_a[1:][np.diff(bounds_a) > 0] - 1] = True
        i = np.flatnonzero(shared[:-1] & ~last[:-1])
        i = i[self.space_a[ids_a[i + 1]] & self.space_b[ids_b[at_b[i] + 1]]]
        cut = np.sort(np.concatenate((i, np.flatnonzero(last))))
        return cut + 1, at_b[cut] + 1

    @staticmethod
    def distinct(ids_a, cut_a, ids_b, cut_b):
        """One window of each pair of id tuples, and for every window which that is."""
        cut_a, cut_b = np.concatenate(([0], cut_a)), np.concatenate(([0], cut_b))
        name = mix(span_names(ids_a.astype(np.uint64) + np.uint64(1), cut_a[:-1], cut_a[1:])) ^ span_names(
            ids_b.astype(np.uint64) + np.uint64(1), cut_b[:-1], cut_b[1:])
        _, one, of = np.unique(name, return_index=True, return_inverse=True)
        # names only find candidates: a window whose ids differ from its namesake's stands for itself
        other = np.zeros(len(name), bool)
        for ids, cut in ((ids_a, cut_a), (ids_b, cut_b)):
            size = np.diff(cut)
            other |= size != size[one[of]]
            rows = np.flatnonzero(~other)
            mine, ends = spread(ids, cut, rows)
            differ = np.flatnonzero(mine != spread(ids, cut, one[of[rows]])[0])
            other[rows[np.searchsorted(ends, differ, "right") - 1]] = True
        if other.any():
            of[other] = len(one) + np.arange(other.sum())
            one = np.concatenate((one, np.flatnonzero(other)))
        return one, of, cut_a, cut_b

    def align(self, ids_a, bounds_a, ids_b, bounds_b):
        """Of windows laid end to end: their groups, links as integers with their
        bounds, and the groups' text with its bounds."""
        end_a, end_b = np.cumsum(self.a.size[ids_a]), np.cumsum(self.b.size[ids_b])
        ends = np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        links = ids_a[at_a].astype(np.int64) << 32 | ids_b[at_b]
        link_bounds = np.concatenate(([0], np.searchsorted(ends, end_a[bounds_a[1:] - 1]) + 1))
        shared = np.flatnonzero((end_a[at_a] == ends) & (end_b[at_b] == ends))
        groups = np.diff(np.searchsorted(shared, link_bounds))
        # tokens in order of group, side and place, with the mark that follows each
        last_a, last_b = at_a[shared], at_b[shared]
        mark_a, mark_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        mark_a[last_a], mark_b[last_b] = 1, 2
        mark_b[bounds_b[1:] - 1] = 3
        place_a = np.arange(len(ids_a)) + np.concatenate(([0], last_b + 1))[np.searchsorted(last_a, np.arange(len(ids_a)))]
        place_b = np.arange(len(ids_b)) + (last_a + 1)[np.searchsorted(last_b, np.arange(len(ids_b)))]
        line = np.empty(len(ids_a) + len(ids_b), np.int64)
        line[place_a], line[place_b] = mark_a * self.most + ids_a, mark_b * self.most + ids_b
        text = "".join(map(self.written.__getitem__, line.tolist())).encode()
        text_bounds = np.concatenate(([0], np.cumsum(self.written_size[line])))[bounds_a + bounds_b]
        return groups, links, link_bounds, text, text_bounds

    def texts(self, texts: list[str]):
        """Per text: n_a, n_b, n_groups, n_links, digest; and the distinct links
        of each with their occurrences: codes, occurrences, bounds, and the codes' pairs."""
        ids_a, bounds_a, ids_b, bounds_b = self.encode(texts)
        n_a, n_b = np.diff(bounds_a), np.diff(bounds_b)
        if not len(ids_a):
            none, zeros = np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
            return n_a, n_b, zeros, zeros, [""] * len(texts), none, none, np.zeros(len(texts) + 1, np.int64), none
        cut_a, cut_b = self.windows(ids_a, bounds_a, ids_b, bounds_b)
        one, of, cut_a, cut_b = self.distinct(ids_a, cut_a, ids_b, cut_b)
        groups, links, link_bounds, text, text_bounds = self.align(*spread(ids_a, cut_a, one), *spread(ids_b, cut_b, one))
        pairs, code = np.unique(links, return_inverse=True)
        n = np.diff(link_bounds)
        first = np.searchsorted(cut_a, bounds_a)  # the first window of each text
        before = np.concatenate(([0], np.cumsum(groups[of])))[first]
        n_groups = np.diff(before)
        n_links = np.diff(np.concatenate(([0], np.cumsum(n[of])))[first])
        written = [text[x:y] for x, y in zip(text_bounds[:-1].tolist(), text_bounds[1:].tolist())]
        of_list = of.tolist()
        digests = ["" if x == y else hashlib.sha256(b";".join([written[k] for k in of_list[x:y]])).hexdigest()
                   for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
        key, _ = spread(code, link_bounds, of)
        key |= np.repeat(np.arange(len(texts)) << 32, n_links)
        key.sort()
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        occurs = np.diff(np.append(head, len(key)))
        key = key[head]
        return n_a, n_b, n_groups, n_links, digests, key & 0xFFFFFFFF, occurs, np.searchsorted(key >> 32, np.arange(len(texts) + 1)), pairs


@lru_cache(2)
def aligner(byte_level: str, spaced: str) -> Aligner:
    """The aligner of two vocabulary files, kept while the Python worker lives."""
    return Aligner(byte_level, spaced)


_COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def aligned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_level: str | None = None,
            spaced: str | None = None) -> DataFrame:
    """A row for every document, numbered by ``row``, with its id pairs and how
    often each is linked; and rows without a number whose ``occurs`` counts the
    documents of a lot that hold each pair."""
    byte_level, spaced = byte_level or vocabulary(), spaced or vocabulary(PIECES)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = dict(d.dtypes)["doc_id"]

    def run(batches):
        row, own = TaskContext.get().partitionId() << 40, aligner(byte_level, spaced)
        for batch in batches:
            for i, j in lots(batch.column(1), LOT_BYTES):
                lot = batch.slice(i, j - i)
                *counts, digests, code, occurs, bounds, pairs = own.texts([t or "" for t in lot.column(1).to_pylist()])
                n = lot.num_rows
                held = np.bincount(code, minlength=len(pairs))
                yield pa.RecordBatch.from_arrays([
                    pa.array([*range(row, row + n), None], pa.int64()),
                    pa.concat_arrays([lot.column(0), pa.nulls(1, lot.column(0).type)]),
                    *(pa.array([*c.tolist(), None], pa.int64()) for c in counts), pa.array([*digests, None], pa.string()),
                    pa.ListArray.from_arrays(np.append(bounds, len(code) + len(pairs)).astype(np.int32), np.concatenate((pairs[code], pairs))),
                    pa.ListArray.from_arrays(np.append(bounds, len(code) + len(pairs)).astype(np.int32),
                                             np.concatenate((occurs, held)).astype(np.int32))],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "occurs"])
                row += n

    return d.mapInArrow(run, f"row bigint, doc_id {kind}, {_COUNTS}, pairs array<bigint>, occurs array<int>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): how many documents hold an id pair linked; a pair is A id * 2^32 + B id."""
    return (rows.where("row is null").select(F.explode(F.arrays_zip("pairs", "occurs")).alias("x"))
            .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.occurs").alias("n")))


def link_scores(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) of every document with links."""
    spark = rows.sparkSession
    top = counts.orderBy(F.desc("n"), "pair").limit(HEAVY).toArrow()  # HEAVY rows at most
    pair, n = top["pair"].to_numpy(), top["n"].to_numpy()
    order = np.argsort(pair)
    best = counts.groupBy(F.shiftright("pair", 32).cast("int").alias("a")).agg(F.max("n").alias("n")).toArrow()  # one row an A id
    highest = np.zeros(int(max(best["a"].to_numpy(), default=0)) + 1, np.int64)
    highest[best["a"].to_numpy()] = best["n"].to_numpy()
    shared = spark.sparkContext.broadcast((pair[order], n[order], highest))

    def run(batches):
        pair, n, highest = shared.value
        for batch in batches:
            lists, occurs = batch.column(1), batch.column(2).values.to_numpy().astype(np.int64)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            own, occurs = lists.values.to_numpy()[bounds[0]:bounds[-1]], occurs[bounds[0]:bounds[-1]]
            doc = np.repeat(np.arange(len(lists)), np.diff(bounds))
            at = np.minimum(np.searchsorted(pair, own), max(0, len(pair) - 1))
            heavy = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            count = np.where(heavy, n[at], 0) if len(pair) else np.zeros(len(own), np.int64)
            top = heavy & (count == highest[own >> 32])
            sums = np.zeros((2, len(lists)), np.int64)
            np.add.at(sums[0], doc[top], occurs[top])
            np.add.at(sums[1], doc, occurs * count)
            rest = ~heavy
            rows = batch.column(0).to_numpy()
            none = pa.nulls(len(lists), pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate((rows, rows[doc[rest]]))),
                pa.concat_arrays([none, pa.array(own[rest], pa.int64())]), pa.concat_arrays([none, pa.array(occurs[rest], pa.int64())]),
                pa.array(np.concatenate((sums[0], highest[own[rest] >> 32]))), pa.array(np.concatenate((sums[1], np.zeros(rest.sum(), np.int64))))],
                ["row", "pair", "occurs", "n_best", "count_sum"])

    scored = stored(rows.where("n_links > 0").select("row", "pairs", "occurs")
                    .mapInArrow(run, "row bigint, pair bigint, occurs bigint, n_best bigint, count_sum bigint"), "link-scores")
    # in a row with a pair, n_best is the highest count of the pair's A id
    rare = (scored.where("pair is not null").join(counts, "pair")
            .select("row", F.when(F.col("n") == F.col("n_best"), F.col("occurs")).otherwise(0).alias("n_best"),
                    (F.col("n") * F.col("occurs")).alias("count_sum")))
    return (scored.where("pair is null").select("row", "n_best", "count_sum").union(rare)
            .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))


def align_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_level: str | None = None,
                    spaced: str | None = None) -> DataFrame:
    """Counts, link scores and the groups' digest of every document."""
    rows = stored(aligned(docs, doc_id, text, byte_level, spaced), "aligned")
    counts = stored(pair_counts(rows), "pair-counts")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (rows.where("row is not null").drop("pairs", "occurs").join(link_scores(rows, counts), "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document under the byte-level and the piece vocabulary."""
    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment}
SQL: dict[str, str] = {}

"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its
leading bytes, so inflected forms share what their stem has learnt.  Filters of
widths 1 to 3 slide over the words, each keeps its largest response in the
text (max pooling), and a logistic layer weighs them.  Weights start from the
log odds of the hashed features and are fitted by AdaGrad.

Thresholds are calibrated by language on rows left out of the fit; the language
is guessed from the text's own function words, and the threshold is shifted to
a score of 0.5.  Score inputs are the text's words alone.

The fit sees every labelled row that may be learnt from.  Rows are dealt into
lots of about ``LOT`` by a hash; in each epoch every lot goes on from the common
weights, and the lots' moves are averaged (an embedding's over the lots that moved
it), so one lot is a plain fit.  Log odds and calibration are sums over all lots.
Scoring is one scan over all whole texts with the weights, a fixed-size array,
broadcast.  A null or empty text has no words and gets the score of the bias.
Labels that are null, or that belong to no document, are ignored; without both
labels every score is the share of toxic rows (0 where there is none).
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm.scratch import batches_of, stored
from tenura.llm.texts import chunks, mix, span_names, utf8, word_spans

#: Labelled rows of a lot, about.
LOT = 4096
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 12, (1, 2, 3)
#: Leading bytes of a word that have embeddings of their own; 0 is the whole word.
STEMS = (0, 4, 5, 6)
EPOCHS, RATE = 4, 0.1
#: Rows that a bucket needs to count, and rows at which its log odds count half.
SEEN, SHRINK = 5, 5.0
#: A calibrated threshold weighs the rate of false alarms so many times the rate of misses.
ALARM = 3.0
#: One labelled row in FOLDS of the fit's own rows calibrates thresholds.
FOLDS = 4
#: Margins are counted in cells of 1 / CELLS from -EDGE to EDGE, where scores end.
CELLS, EDGE = 1000, 30

#: Function words that tell the languages apart.
LANGUAGES = {
    "en": "the of and to in is that it for was with this by are from".split(),
    "de": "der die und den von zu das mit sich des auf für ist nicht dem".split(),
    "fr": "le et les des un du une est pour qui sur dans au par pas".split(),
    "es": "que el y los se del las por con una su al para es lo".split(),
}

_LETTERS = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_GAPS = np.array([not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 or b == 0x27)
                  for b in range(256)])
_RANDOM = np.random.default_rng(0xB17E)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)


def _names(data, start, end):
    return span_names(_BYTE[data], start, end)


def _language_names() -> dict[str, np.ndarray]:
    found = {}
    for lang, words in LANGUAGES.items():
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(w) for w in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        found[lang] = np.sort(_names(data, ends - [len(w) for w in raw], ends))
    return found


_LANGUAGE_NAMES = _language_names()


def features(column: pa.Array):
    """Lots of rows: (first row, words before each row, feature buckets of each
    word, guessed language of each row)."""
    data, offsets = utf8(column)
    for i, j in chunks(offsets):
        o = offsets[i:j + 1]
        start, end, first = word_spans(data, o, _GAPS)
        lower = _LETTERS[data[o[0]:o[-1]]]
        buckets = np.empty((len(start), len(STEMS)), np.int32)
        values = _BYTE[lower]
        for k, stem in enumerate(STEMS):
            cut = np.minimum(end, start + stem) if stem else end
            name = span_names(values, start, cut)
            if not stem:
                whole = name
            h = (mix(name + np.uint64(k)) % np.uint64(BUCKETS)).astype(np.int32)
            buckets[:, k] = np.where(cut < end, h, BUCKETS) if stem else h  # BUCKETS: nothing
        votes = []
        for names in _LANGUAGE_NAMES.values():
            place = np.minimum(np.searchsorted(names, whole), len(names) - 1)
            votes.append(np.concatenate(([0], np.cumsum(names[place] == whole))))
        count = np.stack([v[first[1:]] - v[first[:-1]] for v in votes], 1)
        yield i, first, buckets, np.argmax(count, 1)


@dataclass
class Model:
    embed: np.ndarray  # (BUCKETS + 1, DIM), the last row zero
    filters: list      # for each width (width, DIM, FILTERS)
    bias: np.ndarray   # (widths, FILTERS)
    weights: np.ndarray
    offset: float
    thresholds: np.ndarray
    constant: float | None = None

    def margins(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Logits of the rows that ``first`` bounds."""
        x = self.embed[buckets].sum(1)
        n, rows = len(x), len(first) - 1
        filled = np.flatnonzero(np.diff(first))
        pooled = np.zeros((rows, len(WIDTHS), FILTERS), np.float32)
        last = np.repeat(first[1:], np.diff(first))  # end of each word's row
        for k, w in enumerate(WIDTHS):
            got = np.broadcast_to(self.bias[k], (n, FILTERS)).copy()
            for j in range(w):
                got[:n - j] += x[j:] @ self.filters[k][j]
            got[np.arange(n) + w > last] = 0
            if len(filled):
                pooled[filled, k] = np.maximum.reduceat(np.maximum(got, 0), first[filled])
        return pooled.reshape(rows, -1) @ self.weights + self.offset

    def scores(self, margins: np.ndarray, language: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(margins), self.constant)
        return 1 / (1 + np.exp(-np.clip(margins - self.thresholds[language], -30, 30).astype(float)))


def _seen(rows, label, calibrates):
    """Sums over rows: (rows of each label, fitted rows of each label, fitted rows of each label with each bucket)."""
    every, n, seen = np.zeros(2, np.int64), np.zeros(2, np.int64), np.zeros((2, BUCKETS + 1))
    for r, y, held in zip(rows, np.asarray(label).tolist(), calibrates):
        every[y] += 1
        if not held:
            n[y] += 1
            seen[y][np.unique(r)] += 1
    return every, n, seen


def _start(every, n, seen) -> tuple[Model, np.ndarray]:
    """The model before its fit, and the buckets that are too rare to learn."""
    rng = np.random.default_rng(17)
    embed = (rng.standard_normal((BUCKETS + 1, DIM)) * 0.05).astype(np.float32)
    filters = [(rng.standard_normal((w, DIM, FILTERS)) * 0.2).astype(np.float32) for w in WIDTHS]
    m = Model(embed, filters, np.zeros((len(WIDTHS), FILTERS), np.float32),
              np.full(len(WIDTHS) * FILTERS, 0.05, np.float32), -1.0, np.zeros(len(LANGUAGES), np.float32))
    if not n.all():
        m.constant = float(every[1] / every.sum()) if every.sum() else 0.0
        return m, np.ones(BUCKETS + 1, bool)
    # log odds of each bucket's presence start the first dimension
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    odds *= seen.sum(0) / (seen.sum(0) + SHRINK)
    embed[:, 0] = np.clip(odds, -4, 4) / 4
    # what few rows have can't be told from chance: it says nothing and learns nothing
    rare = seen.sum(0) < SEEN
    rare[BUCKETS] = True
    embed[rare] = 0
    for f in filters:
        f[:, 0] = np.abs(f[:, 0]) + 0.3
    return m, rare


def _sizes(m: Model) -> list[np.ndarray]:
    """AdaGrad's sums: one for each embedding, then those of filters, bias and weights."""
    return [np.full(BUCKETS + 1, 0.1, np.float32), *(np.full_like(x, 0.1) for x in (*m.filters, m.bias, m.weights))]


def _moves(m: Model, sizes, rare, weight, rows, label, calibrates, seed) -> list[np.ndarray]:
    """One epoch over a lot's fitted rows from the given weights: what it moves,
    times its rows where lots share all of a value, in the order of ``_moved``."""
    own = np.flatnonzero(~np.asarray(calibrates, bool))
    new = Model(m.embed.copy(), [f.copy() for f in m.filters], m.bias.copy(), m.weights.copy(), m.offset, m.thresholds)
    size, *sums = (x.copy() for x in sizes)
    for r in np.random.default_rng(seed).permutation(own).tolist():
        _step(new, rows[r], int(label[r]), weight[int(label[r])], size, (sums[:-2], sums[-2], sums[-1]), rare)
    pairs = [*zip(new.filters, m.filters), (new.bias, m.bias), (new.weights, m.weights), (new.offset, m.offset), *zip(sums, sizes[1:])]
    return [np.array(len(own)), (size != sizes[0]).astype(np.int32), new.embed - m.embed, size - sizes[0],
            *(np.asarray(x - y, float) * len(own) for x, y in pairs)]


def _moved(m: Model, sizes, moves) -> None:
    """Add the lots' average moves to the weights."""
    n, lots, embed, size, *rest = moves
    n, lots = max(int(n), 1), np.maximum(lots, 1).astype(np.float32)
    m.embed += embed / lots[:, None]
    sizes[0] += size / lots
    k = len(m.filters)
    for value, move in zip((*m.filters, m.bias, m.weights), rest):
        value += (move / n).astype(np.float32)
    m.offset += float(rest[k + 2] / n)
    for value, move in zip(sizes[1:], rest[k + 3:]):
        value += (move / n).astype(np.float32)


def _cells(m: Model, rows, label, language, calibrates) -> np.ndarray:
    """Calibrating rows by language, label and cell of their margin."""
    counts = np.zeros((len(LANGUAGES), 2, 2 * EDGE * CELLS + 1), np.int64)
    for r in np.flatnonzero(calibrates):
        z = float(m.margins(rows[r], np.array([0, len(rows[r])]))[0])
        counts[language[r], int(label[r]), int(round((min(max(z, -EDGE), EDGE) + EDGE) * CELLS))] += 1
    return counts


def _fit(lots) -> Model:
    """Fit to lots; ``lots(f)`` has the added arrays of f(lot number, rows, label, language, calibrates) of all lots."""
    every, n, seen = lots(lambda lot, rows, label, language, held: _seen(rows, label, held))
    m, rare = _start(every, n, seen)
    if m.constant is not None:
        return m
    sizes, weight = _sizes(m), (0.5 * n.sum() / n).tolist()
    for epoch in range(EPOCHS):
        _moved(m, sizes, lots(lambda lot, rows, label, language, held: _moves(m, sizes, rare, weight, rows, label, held, [17, epoch, lot])))
    (counts,) = lots(lambda lot, rows, label, language, held: [_cells(m, rows, label, language, held)])
    _calibrate(m, counts)
    return m


def fit(rows: list[np.ndarray], label: np.ndarray, language: np.ndarray, calibrates: np.ndarray) -> Model:
    """Fit to rows of feature buckets as one lot; the marked rows calibrate thresholds."""
    return _fit(lambda f: f(0, rows, label, language, calibrates))


def _step(m: Model, buckets, y, weight, size, sums, rare):
    """One AdaGrad step on one row."""
    if not len(buckets):
        m.offset -= RATE * weight * 0.1 * (1 / (1 + np.exp(-m.offset)) - y)
        return
    x = m.embed[buckets].sum(1)
    n, at, top = len(x), [], np.zeros((len(WIDTHS), FILTERS), np.float32)
    for k, w in enumerate(WIDTHS):
        if n < w:
            at.append(None)
            continue
        got = m.bias[k] + sum(x[j:n - w + 1 + j] @ m.filters[k][j] for j in range(w))
        at.append(got.argmax(0))
        top[k] = np.maximum(got[at[k], np.arange(FILTERS)], 0)
    slope = weight * (1 / (1 + np.exp(-np.clip(top.ravel() @ m.weights + m.offset, -30, 30))) - y)
    back = (slope * m.weights).reshape(top.shape) * (top > 0)

    def move(value, grad, total):
        total += grad * grad
        value -= RATE * grad / np.sqrt(total)

    words, grads = [], []
    for k, w in enumerate(WIDTHS):
        if at[k] is None:
            continue
        place = at[k][:, None] + np.arange(w)  # (FILTERS, w)
        words.append(place.ravel())
        grads.append((back[k][:, None, None] * m.filters[k].transpose(2, 0, 1)).reshape(-1, DIM))
        move(m.filters[k], (back[k][:, None, None] * x[place]).transpose(1, 2, 0), sums[0][k])
    move(m.bias, back, sums[1])
    move(m.weights, slope * top.ravel(), sums[2])
    m.offset -= RATE * 0.1 * slope
    word, grad = np.concatenate(words), np.concatenate(grads)
    moved, back_to = np.unique(buckets[word].ravel(), return_inverse=True)
    total = np.zeros((len(moved), DIM), np.float32)
    np.add.at(total, back_to.ravel(), np.repeat(grad, len(STEMS), axis=0))
    live = ~rare[moved]
    moved, total = moved[live], total[live]
    size[moved] += (total * total).sum(1)
    m.embed[moved] -= RATE * total / np.sqrt(size[moved])[:, None]


def _calibrate(m: Model, counts: np.ndarray):
    """Thresholds that err least on the rows left out (counts by language, label and cell):
    one over all, and one for each language that has enough of them, halfway between the labels' margins."""
    def best(n):
        at = np.flatnonzero(n.sum(0))
        z = at / CELLS - EDGE
        cuts = np.concatenate(([z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]))
        below = np.concatenate(([[0], [0]], np.cumsum(n[:, at], 1)), 1)  # clean and toxic rows below each cut
        wrong = below[1] / max(1, below[1, -1]) + ALARM * (below[0, -1] - below[0]) / max(1, below[0, -1])
        lowest = np.flatnonzero(wrong <= wrong.min() + 1e-9)
        return float(cuts[lowest[len(lowest) // 2]])

    if counts.sum((0, 2)).all():
        m.thresholds[:] = best(counts.sum(0))
        for k in range(len(LANGUAGES)):
            if (counts[k].sum(1) >= 10).all():
                m.thresholds[k] = best(counts[k])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int | None = None, lots: int | None = None) -> DataFrame:
    """(doc_id, text, toxic) of the rows that may be learnt from: crc32(doc_id) mod 5
    is not 0.  With ``sample``, of at most so many ids of each label; with ``lots``,
    in so many partitions by the id, which the join needs anyway."""
    known = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
             .where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0))
    if sample is not None:
        parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id")).limit(sample) for y in (0, 1)]
        known = parts[0].union(parts[1])
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if lots is not None:
        d = d.where(F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0))
        d, known = d.repartition(lots, "doc_id"), known.repartition(lots, "doc_id")
    return d.join(known, "doc_id").select("doc_id", "text", "toxic")


def _lots(rows: DataFrame) -> DataFrame:
    """Training rows as pickled lots, written once: (number, buckets of each row,
    label, language, calibrates).  A lot is a partition's rows by their id, or
    2 LOT of them.  Buckets are kept in 16 bits, with a bit for those that are nothing."""
    def run(batches):
        def done():
            ids = np.array(doc, np.int64).astype(np.uint64)
            block = int(ids[0]), kept, np.array(label), np.array(language), mix(ids) % np.uint64(FOLDS) == 0
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

        kept, label, language, doc = [], [], [], []
        for batch in batches:
            for i, first, buckets, lang in features(batch.column(1)):
                n = len(lang)
                doc += batch.column(0).slice(i, n).to_pylist()
                label += batch.column(2).slice(i, n).to_pylist()
                language += lang.tolist()
                for r in range(n):
                    own = buckets[first[r]:first[r + 1]]
                    kept.append((own.astype(np.uint16), np.packbits(own == BUCKETS)))
                if len(kept) >= 2 * LOT:
                    yield done()
                    kept, label, language, doc = [], [], [], []
        if kept:
            yield done()

    return stored(rows.sortWithinPartitions("doc_id", "text").mapInArrow(run, "block binary"), "training-lots")


def _unpacked(block: bytes):
    lot, kept, label, language, calibrates = pickle.loads(block)
    rows = [np.where(np.unpackbits(none, count=b.size).astype(bool).reshape(b.shape), BUCKETS, b.astype(np.int32)) for b, none in kept]
    return lot, rows, label, language, calibrates


def _partials(frame: DataFrame, get) -> DataFrame:
    """(part, sums): for each partition the added arrays of get(block) of its blocks, pickled."""
    def run(batches):
        total = None
        for batch in batches:
            for block in batch.column(batch.num_columns - 1):
                got = get(block.as_py())
                total = got if total is None else [x + y for x, y in zip(total, got)]
        if total is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(list(total))], pa.binary())], ["part", "sums"])

    return frame.mapInArrow(run, "part int, sums binary")


def _added(lots: DataFrame, f):
    """The added arrays of f over all lots; null without lots.  All passes are
    Arrow maps like the one that makes the lots, so they share its Python workers;
    an executor needs no second set of them.  A lot is a batch of its own."""
    parts = _partials(lots, lambda block: f(*_unpacked(block)))
    few = math.isqrt(lots.rdd.getNumPartitions())
    for n in ([few, 1] if few > 1 else [1]):
        parts = _partials(parts.repartition(n, "part").sortWithinPartitions("part"), pickle.loads)
    with batches_of(lots.sparkSession, 1):
        found = parts.collect()
    return pickle.loads(found[0]["sums"]) if found else None


def train(docs: DataFrame, labels: DataFrame, sample: int | None = None) -> Model:
    """Fit to all rows that may be learnt from, lots side by side."""
    n = training_rows(docs, labels, sample).count()
    lots = _lots(training_rows(docs, labels, sample, max(1, -(-n // LOT))))

    def added(f):
        found = _added(lots, f)
        return f(0, [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) if found is None else found

    return _fit(added)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, first, buckets, lang in features(batch.column(1)):
                out[i:i + len(lang)] = m.scores(m.margins(buckets, first), lang)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a classifier fitted to the labels of four in five."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
SQL: dict[str, str] = {}

"""Risk-set sums of a Cox partial likelihood over sorted blocks.

The rows are sorted once by (stratum, time descending): a range partitioning
in which a row's own number breaks ties, so a stratum or a time that holds a
third of all rows is cut like any other.  Sorted blocks are cached.  One
evaluation at a coefficient vector is two narrow passes without a shuffle:

1. every partition sums the weighted moments (1, x, xx') of its last stratum
   and the events of its last time; the driver carries these few vectors a
   partition forward in partition order;
2. every partition walks its blocks from the sums carried to it: running sums
   over its distinct times are the risk sets, and each time with events gives
   its part of log-likelihood, gradient and Hessian.

A time's part is added by whoever sees the next time, so times that reach over
blocks or partitions need no case of their own, and nothing is kept that
grows with the number of distinct times.  A (start, stop] row adds at its stop
and leaves at its start; one without an event time in between counts at its
stop alone, so episodes of a month are one row and nothing is subtracted.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.session import cut_lineage

#: Rows of a block: 8,192 rows of 40 covariates make 60 MB of moments.
BLOCK = 1 << 13
#: Tied events that are summed one by one; the rest of a larger tie by quadrature.
ONE_BY_ONE = 256
#: Rows a run from which a matrix product each is cheaper than sums over rows of moments.
LONG = 24
#: Weights are exp(xb - scale); scales are multiples of this, so that they grow seldom.
STEP = 64.0
#: Cells of event times by which rows are told that count at one time only.
CELLS = 1 << 10
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(12)


@dataclass
class Open:
    """The time at which a walk stands: its stratum, risk-set sums, sums of the time alone,
    and the scales whose exponentials the weights in both are divided by."""
    stratum: str
    time: float
    risk: np.ndarray
    own: np.ndarray
    scale: float
    own_scale: float

    def after(self, before: Open | None) -> Open:
        """This state, reached from rows that begin where ``before`` stands."""
        if before is None or before.stratum != self.stratum:
            return self
        scale = max(self.scale, before.scale)
        risk = self.risk * _factor(self.scale, scale) + before.risk * _factor(before.scale, scale)
        if before.time != self.time:
            return Open(self.stratum, self.time, risk, self.own, scale, self.own_scale)
        own = max(self.own_scale, before.own_scale)
        return Open(self.stratum, self.time, risk, _rescaled(self.own, len(risk), self.own_scale, own) + _rescaled(before.own, len(risk), before.own_scale, own),
                    scale, own)


def _factor(old: float, new: float) -> float:
    """Of weights, from one scale to a larger one; no rows have the scale -inf."""
    return 0.0 if old == -np.inf else math.exp(old - new)


def _rescaled(own: np.ndarray, m: int, old: float, new: float) -> np.ndarray:
    """Sums of a time alone (moments of its rows, of its events, 1, xb - scale, x) at a larger scale."""
    if old == new:
        return own
    own = own.copy()
    own[:2 * m] *= _factor(old, new)
    own[2 * m + 1] += (old - new) * own[2 * m]
    return own


def _scale(xb: np.ndarray) -> np.ndarray:
    """The multiple of ``STEP`` above each value: weights exp(xb - scale) are 1 at most, the largest exp(-STEP) at least."""
    return STEP * np.ceil(xb / STEP)


def _event_before(rows: DataFrame):
    """Column: a bound that no event time of any stratum between it and ``t`` exceeds, from the first
    and last event time of ``CELLS`` cells; infinite where a cell does not tell."""
    died = rows.where(F.col("e") == 1)
    lo, hi = died.agg(F.min("t"), F.max("t")).first()
    if lo is None:
        return F.lit(-np.inf)
    width = (hi - lo) / CELLS or 1.0
    cell = F.floor((F.col("t") - lo) / width)
    found = {r[0]: r[1:] for r in died.groupBy(cell).agg(F.min("t"), F.max("t")).collect()}  # some CELLS rows
    first, last, before = [], [], [-np.inf]
    for k in range(CELLS + 1):
        of = found.get(k, (np.inf, -np.inf))
        first.append(of[0])
        last.append(of[1])
        before.append(max(before[-1], of[1]))
    at = F.least(F.greatest(cell, F.lit(0)), F.lit(CELLS)).cast("int")
    pick = [F.get(F.lit(np.array(v)), at) for v in (first, last, before)]
    return F.when(F.col("t") > pick[1], F.greatest(pick[1], pick[2])).when(F.col("t") <= pick[0], pick[2]).otherwise(F.lit(np.inf))


def sorted_blocks(df: DataFrame, time: str, event: str, covariates: Sequence[str], strata: Sequence[str], start: str | None = None):
    """Cached RDD of blocks (labels, stratum codes, times, events, signs, X) in
    the order of (stratum, time descending) over partitions and blocks."""
    key = F.to_json(F.struct(*[F.col(f"`{s}`") for s in strata])) if strata else F.lit("")
    xs = [F.col(f"`{c}`").alias(f"x{k}") for k, c in enumerate(covariates)]
    # written first: row numbers, and with them the ranges, are those of fixed files
    rows = cut_lineage(df.select(key.alias("g"), F.col(time).alias("t"), F.col(event).alias("e"), *([F.col(start).alias("s")] if start else []), *xs))
    names = [f"x{k}" for k in range(len(covariates))]
    end = [F.struct(F.col("t"), F.col("e"), F.lit(1).alias("sign"))]
    if start:
        end.append(F.struct(F.col("s").alias("t"), F.lit(0).alias("e"), F.lit(-1).alias("sign")))
        alone = F.array(F.struct(F.col("t"), F.col("e"), F.lit(0).alias("sign")))
        ends = F.when(F.col("s") < F.col("t"), F.when(F.col("s") >= _event_before(rows), alone)).otherwise(F.lit(None))
        rows = rows.select("g", *names, F.monotonically_increasing_id().alias("i"), F.inline(F.coalesce(ends, F.array(*end))))
    else:
        rows = rows.select("g", *names, F.monotonically_increasing_id().alias("i"), F.inline(F.array(*end)))
    rows = (rows.select("g", "t", "e", "sign", *names, "i").repartitionByRange("g", F.desc("t"), "i")
            .sortWithinPartitions("g", F.desc("t")).drop("i"))
    p = len(covariates)

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                lot = batch.slice(at, BLOCK)
                g = lot.column(0).dictionary_encode()
                t, e, sign = (c.to_numpy(zero_copy_only=False) for c in lot.columns[1:4])
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in lot.columns[4:]], 1) if p else np.zeros((len(t), 0))
                block = g.dictionary.to_pylist(), g.indices.to_numpy(), t, e, sign, x
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    return rows.mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)


def _sums(w: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Weighted moments (1, x, xx') of the rows from each start to the next."""
    p = x.shape[1]
    i, j = np.triu_indices(p)
    if len(x) >= LONG * len(starts):  # long runs of rows: one matrix product each
        out = np.empty((len(starts), 1 + p + len(i)))
        wx = w[:, None] * x
        for k, (lo, hi) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(x)])):
            out[k, 0], out[k, 1:p + 1], out[k, p + 1:] = w[lo:hi].sum(), wx[lo:hi].sum(0), (wx[lo:hi].T @ x[lo:hi])[i, j]
        return out
    return np.add.reduceat(w[:, None] * np.concatenate((np.ones((len(x), 1)), x, x[:, i] * x[:, j]), 1), starts, axis=0)


def _of_runs(rows: np.ndarray, run: np.ndarray, n: int, *sums) -> np.ndarray:
    """``sums`` (functions of some rows and the places where a run begins) side by side, zero for runs without such rows."""
    run = run[rows]
    first = np.concatenate(([0], np.flatnonzero(run[1:] != run[:-1]) + 1))
    found = np.concatenate([f(rows, first) for f in sums], 1)
    out = np.zeros((n, found.shape[1]))
    out[run[first]] = found
    return out


def _moments(block, rows: slice, beta: np.ndarray, starts: np.ndarray, label: np.ndarray, carried: float = -np.inf):
    """Of the runs of some rows that begin at ``starts``: signed weighted moments at a scale that
    grows along a stratum (``label``, from ``carried`` on) and this scale; sums of the runs alone
    (moments of rows that count there only, of events, 1, xb - scale, x) and their scale."""
    e, sign, x = (c[rows] for c in block[3:])
    n, p = len(starts), x.shape[1]
    m = 1 + p + p * (p + 1) // 2
    run = np.repeat(np.arange(n), np.diff(starts, append=len(x)))
    xb = x @ beta
    own_scale = _scale(np.maximum.reduceat(xb, starts))
    scale = _scale(np.maximum.reduceat(np.where(sign != 0, xb, -np.inf), starts))
    new = np.concatenate(([0], np.flatnonzero(label[1:] != label[:-1]) + 1, [n]))
    scale[0] = max(scale[0], carried)
    for lo, hi in zip(new.tolist(), new[1:].tolist()):
        np.maximum.accumulate(scale[lo:hi], out=scale[lo:hi])
    risk, own = np.zeros((n, m)), np.zeros((n, 2 * m + 2 + p))
    xo = xb - own_scale[run]
    stays, alone, died = (np.flatnonzero(c) for c in (sign != 0, sign == 0, e == 1))
    for out, of, sums in ((risk, stays, [lambda r, f: _sums(sign[r] * np.exp(xb[r] - scale[run[r]]), x[r], f)]),
                          (own[:, :m], alone, [lambda r, f: _sums(np.exp(xo[r]), x[r], f)]),
                          (own[:, m:], died, [lambda r, f: _sums(np.exp(xo[r]), x[r], f), lambda r, f: np.add.reduceat(
                              np.concatenate((np.ones((len(r), 1)), xo[r, None], x[r]), 1), f, axis=0)])):
        if len(of):
            out[:] = _of_runs(of, run, n, *sums)
    return risk, own, scale, own_scale


def _tail(blocks: Iterable, beta: np.ndarray) -> Open | None:
    """Where a partition ends, without what is carried to it."""
    state = None
    for block in blocks:
        labels, g, t = block[:3]
        of_stratum = int(np.argmax(g == g[-1]))  # sorted: the rest of the block is of the last stratum
        of_time = int(np.argmax(t[of_stratum:] == t[-1]))
        starts = np.unique([0, of_time])  # the rows before the last time are a run: only their risk sums go on
        for time, risk, own, scale, own_scale in zip(t[of_stratum + starts], *_moments(block, slice(of_stratum, None), beta, starts, np.zeros(len(starts)))):
            state = Open(labels[g[-1]], time, risk, own, scale, own_scale).after(state)
    return state


def efron_sums(r: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Rows of the six Efron sums over l = 0..d-1, with c = l/d and den = r - c b:
    1/den, c/den, 1/den^2, c/den^2, (c/den)^2, ln(den).

    The terms next to the end, where den is least, are summed one by one.  The
    others of a large tie are their integral with the Euler-Maclaurin correction
    at both ends, by Gauss-Legendre on pieces no longer than their distance from
    the end, so every number of ties costs about the same."""
    def terms(u, r, b, d):  # u = d - l
        c, den = 1 - u / d, np.maximum(r - b, 0) + b * u / d
        return np.stack((1 / den, c / den, 1 / den ** 2, c / den ** 2, (c / den) ** 2, np.log(den)), -1)

    d = d.astype(np.int64)
    few = np.minimum(d, ONE_BY_ONE)
    first = np.cumsum(few) - few
    u = np.arange(few.sum()) - np.repeat(first, few) + 1
    out = np.add.reduceat(terms(u, *(np.repeat(v, few) for v in (r, b, d))), first, axis=0)
    for k in np.flatnonzero(d > ONE_BY_ONE).tolist():
        at = r[k], b[k], float(d[k])
        edges = [ONE_BY_ONE + 0.5]
        while edges[-1] < d[k] + 0.5:
            edges.append(min(2 * edges[-1], d[k] + 0.5))
        for lo, hi in zip(edges, edges[1:]):
            half = (hi - lo) / 2
            out[k] += half * _WEIGHTS @ terms(lo + half * (1 + _NODES), *at)
        ends = terms(np.array([ONE_BY_ONE, ONE_BY_ONE + 1, d[k], d[k] + 1], float), *at)
        out[k] -= (ends[3] - ends[2] - ends[1] + ends[0]) / 24
    return out


def _parts(risk: np.ndarray, own: np.ndarray, scale: np.ndarray, own_scale: np.ndarray, p: int, ties: str) -> np.ndarray:
    """Log-likelihood, gradient and upper Hessian, summed over some times."""
    i, j = np.triu_indices(p)
    m = 1 + p + len(i)
    at = own[:, 2 * m] > 0
    risk, own, scale, own_scale = risk[at], own[at], scale[at], own_scale[at]
    if not len(risk):
        return np.zeros(m)
    both = np.maximum(scale, own_scale)  # one scale for the sums of a time
    by = own_scale - both
    weight = np.exp(by)[:, None]
    risk = risk * np.exp(scale - both)[:, None] + own[:, :m] * weight
    events = own[:, m:].copy()
    events[:, :m] *= weight
    events[:, m + 1] += by * events[:, m]
    r0, r1, r2 = risk[:, 0], risk[:, 1:p + 1], risk[:, p + 1:]
    b0, b1, b2 = events[:, 0], events[:, 1:p + 1], events[:, p + 1:m]
    d, xbd, xd = events[:, m], events[:, m + 1], events[:, m + 2:]
    if ties == "breslow":
        zero = np.zeros(len(d))
        sums = np.stack((d / r0, zero, d / r0 ** 2, zero, zero, d * np.log(r0)), 1)
    else:
        sums = efron_sums(r0, b0, d)
    sa, sb, sc, sd, se, sl = (s[:, None] for s in sums.T)
    gradient = xd - (r1 * sa - b1 * sb)
    outer = r1[:, i] * r1[:, j] * sc - (r1[:, i] * b1[:, j] + b1[:, i] * r1[:, j]) * sd + b1[:, i] * b1[:, j] * se
    return np.concatenate(([(xbd - sl[:, 0]).sum()], gradient.sum(0), (outer - (r2 * sa - b2 * sb)).sum(0)))


def _walk(blocks: Iterable, beta: np.ndarray, state: Open | None, ties: str) -> np.ndarray:
    """The parts of all times that end in a partition; not its last one."""
    p = len(beta)
    total = np.zeros(1 + p + p * (p + 1) // 2)
    for block in blocks:
        labels, g, t = block[:3]
        starts = np.concatenate(([0], np.flatnonzero((g[1:] != g[:-1]) | (t[1:] != t[:-1])) + 1))
        g, t = g[starts], t[starts]
        same = state is not None and state.stratum == labels[g[0]]
        risk, own, scale, own_scale = _moments(block, slice(None), beta, starts, g, state.scale if same else -np.inf)
        if same:
            risk[0] += state.risk * _factor(state.scale, scale[0])
        if same and state.time == t[0]:
            larger = max(own_scale[0], state.own_scale)
            m = risk.shape[1]
            own[0] = _rescaled(own[0], m, own_scale[0], larger) + _rescaled(state.own, m, state.own_scale, larger)
            own_scale[0] = larger
        elif state is not None:
            total += _last(state, p, ties)
        # running sums of one stratum and scale; where the scale grows, those before are brought to it
        cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (scale[1:] != scale[:-1])) + 1).tolist(), len(g)]
        for a, b in zip(cuts, cuts[1:]):
            if a and g[a] == g[a - 1]:
                risk[a] += risk[a - 1] * _factor(scale[a - 1], scale[a])
            np.cumsum(risk[a:b], 0, out=risk[a:b])
        total += _parts(risk[:-1], own[:-1], scale[:-1], own_scale[:-1], p, ties)
        state = Open(labels[g[-1]], t[-1], risk[-1].copy(), own[-1].copy(), float(scale[-1]), float(own_scale[-1]))
    return total


def _last(state: Open, p: int, ties: str) -> np.ndarray:
    """The part of the time at which a walk stands."""
    return _parts(state.risk[None], state.own[None], np.array([state.scale]), np.array([state.own_scale]), p, ties)


def evaluate(blocks, beta: np.ndarray, ties: str) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-likelihood, gradient, Hessian) at ``beta``."""
    p, sc = len(beta), blocks.context

    def tails(index: int, part: Iterator):
        state = _tail(part, beta)
        return () if state is None else ((index, state),)

    carried, state = {}, None
    # a few vectors a partition, in the order of the partitions
    for index, tail in sorted(blocks.mapPartitionsWithIndex(tails).collect(), key=lambda r: r[0]):
        carried[index], state = state, tail.after(state)
    shared = sc.broadcast(carried)  # the same vectors, one state a partition

    def walk(index: int, part: Iterator):
        yield _walk(part, beta, shared.value.get(index), ties)

    total = blocks.mapPartitionsWithIndex(walk).treeAggregate(np.zeros(1 + p + p * (p + 1) // 2), np.add, np.add)
    shared.destroy()
    if state is not None:
        total = total + _last(state, p, ties)
    hessian = np.zeros((p, p))
    i, j = np.triu_indices(p)
    hessian[i, j] = hessian[j, i] = total[1 + p:]
    return float(total[0]), total[1:p + 1], hessian

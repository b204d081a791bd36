"""Long pages and texts, clashing columns, and the classifier against plain code."""
import random
import time

import numpy as np
import pytest

from tenura.llm import html as H
from tenura.llm import tokencounts as C
from tenura.llm import toxicity as X
from tenura.llm.tokens import encoder, vocabulary


def _augmenting(evidence, edges):
    """Source side by one search for each augmenting path."""
    n, rest = len(evidence), list(evidence)
    room = [{} for _ in range(n)]
    for (a, b), c in edges.items():
        room[a][b] = room[a].get(b, 0.0) + c
        room[b][a] = room[b].get(a, 0.0) + c
    while True:
        before = {i: None for i in range(n) if rest[i] > 1e-9}
        queue = list(before)
        for i in queue:
            if rest[i] < -1e-9:
                break
            for j, c in room[i].items():
                if c > 1e-9 and j not in before:
                    before[j] = i
                    queue.append(j)
        else:
            return [i in before for i in range(n)]
        path = [i]
        while before[path[-1]] is not None:
            path.append(before[path[-1]])
        flow = min(rest[path[-1]], -rest[i], *(room[b][a] for a, b in zip(path, path[1:])))
        rest[path[-1]] -= flow
        rest[i] += flow
        for a, b in zip(path, path[1:]):
            room[b][a] -= flow
            room[a][b] += flow


def test_cut_has_the_least_source_side():
    rng = random.Random(11)
    for _ in range(60):
        n = rng.randint(2, 120)
        e = [rng.choice((-1, 1)) * rng.random() * rng.choice((0.1, 1, 12)) for _ in range(n)]
        edges = {(i - 1, i): rng.random() for i in range(1, n)}
        edges |= {(i - g, i): 0.5 for i in range(n) for g in (2, 5) if i >= g and rng.random() < 0.4}
        assert H.minimum_cut(e, edges) == _augmenting(e, edges)


@pytest.mark.parametrize("kind", ["mixed", "pulled"])
def test_long_page_takes_few_passes(kind):
    rng, n = random.Random(2), 24_000
    e = [rng.uniform(-2, 2) if kind == "mixed" else (6.0 if i % 40 == 0 else -0.2) for i in range(n)]
    edges = {(i - 1, i): 0.5 for i in range(1, n)} | {(i - 3, i): 0.5 for i in range(3, n)}
    start = time.monotonic()
    kept = H.minimum_cut(e, edges)
    assert time.monotonic() - start < 20 and 0 < sum(kept) < n


def test_unclosed_inline_tags_are_read_once():
    start = time.monotonic()
    found = H.blocks("<div><b>t</div>" * 20 + "".join(f"<b><p>Text {i}.</p>" for i in range(12_000)))
    assert len(found) == 12_020 and time.monotonic() - start < 20


def test_many_edits_of_one_text():
    own = encoder(vocabulary())
    text = "a@b.c word " * 30_000
    tree, edits = C.Tree.of(text, own), list(C.Redact()(text))
    assert len(edits) == 30_000
    start = time.monotonic()
    after, _ = C.edit(text, tree, edits, own)
    assert time.monotonic() - start < 30
    assert after == "<email> word " * 30_000 and tree.chars[1] == len(after) and tree.tokens[1] == len(own.ids(after))


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x me@mail.org y", 5, 6, 7, 8)], "doc_id int, text string, __chars int, __tokens int, __edits int, __encoded int")
    names = C.tree_names(df)
    row = C.apply_edits(C.count(df), C.Redact(), tree=names).first().asDict()
    assert (row["text"], row["__chars"], row["__tokens"], row["__edits"], row["__encoded"]) == ("x <email> y", 5, 6, 7, 8)
    assert row["__edits_"] == 1 and row["__encoded_"] > 0 and row[names[1]][1] == len(encoder(vocabulary()).ids("x <email> y"))
    pages = spark.createDataFrame([("<p>Some text of a page.</p>", "kept")], "html string, main_text string")
    out = H.extract(pages)
    assert out.columns == ["main_text", "main_text_"] and out.first()["main_text"] == "kept"


def test_one_label_is_its_share():
    rows = [np.zeros((3, len(X.STEMS)), np.int64)] * 4
    for y in (0, 1):
        m = X.fit(rows, np.full(4, y), np.zeros(4, np.int64), np.array([False, False, False, True]))
        assert m.scores(np.zeros(2), np.zeros(2, np.int64)).tolist() == [float(y)] * 2
    assert X.fit([], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)).constant == 0.0


def _model(rng):
    embed = rng.standard_normal((X.BUCKETS + 1, X.DIM)).astype(np.float32) * 0.3
    embed[-1] = 0
    return X.Model(embed, [rng.standard_normal((w, X.DIM, X.FILTERS)).astype(np.float32) * 0.4 for w in X.WIDTHS],
                   rng.standard_normal((len(X.WIDTHS), X.FILTERS)).astype(np.float32) * 0.1,
                   rng.standard_normal(len(X.WIDTHS) * X.FILTERS).astype(np.float32), 0.2, np.zeros(len(X.LANGUAGES), np.float32))


def _plain_margin(m, buckets, filters=None, bias=None, weights=None):
    """Embeddings summed, every window of every width, the greatest value above zero."""
    filters, bias, weights = (d if g is None else g for g, d in ((filters, m.filters), (bias, m.bias), (weights, m.weights)))
    x, out = m.embed[buckets].astype(float).sum(1), m.offset
    for k, w in enumerate(X.WIDTHS):
        for f in range(X.FILTERS):
            got = [bias[k][f] + sum(x[i + j] @ filters[k][j, :, f] for j in range(w)) for i in range(len(x) - w + 1)]
            out += weights[k * X.FILTERS + f] * max([0.0, *got])
    return float(out)


def test_forward_pass_against_plain_loops():
    rng = np.random.default_rng(3)
    m = _model(rng)
    rows = [rng.integers(0, X.BUCKETS, (n, len(X.STEMS))) for n in (0, 1, 2, 3, 9)]
    first = np.cumsum([0, *map(len, rows)])
    got = m.margins(np.concatenate(rows), first)
    assert got == pytest.approx([_plain_margin(m, r) for r in rows], rel=1e-4, abs=1e-4)


def test_step_follows_the_numeric_gradient():
    rng = np.random.default_rng(4)
    m, r, weight, h = _model(rng), rng.integers(0, X.BUCKETS, (6, len(X.STEMS))), 1.5, 1e-4

    def loss(**changed):
        z = _plain_margin(m, r, **changed)
        return weight * np.log1p(np.exp(-z))  # the label is 1

    def slope(name, at, part=None):
        base = getattr(m, name) if part is None else m.filters[part]
        ends = []
        for s in (h, -h):
            v = base.astype(float).copy()
            v[at] += s
            ends.append(loss(**{name: v if part is None else [v if k == part else f for k, f in enumerate(m.filters)]}))
        return (ends[0] - ends[1]) / (2 * h)

    spots = [("weights", (i,), None) for i in (0, 5, len(m.weights) - 1)] + [("bias", (k, 1), None) for k in range(len(X.WIDTHS))]
    spots += [("filters", (0, d, f), k) for k in range(len(X.WIDTHS)) for d, f in ((0, 0), (2, 3))]
    want = [slope(*s) for s in spots]

    def value(name, at, part):
        return float((getattr(m, name) if part is None else m.filters[part])[at])

    before = [value(*s) for s in spots]
    sums = [np.full_like(f, 0.1) for f in m.filters], np.full_like(m.bias, 0.1), np.full_like(m.weights, 0.1)
    X._step(m, r, 1, weight, np.full(X.BUCKETS + 1, 0.1, np.float32), sums, np.zeros(X.BUCKETS + 1, bool))
    moved = [value(*s) - b for s, b in zip(spots, before)]
    assert moved == pytest.approx([-X.RATE * g / np.sqrt(0.1 + g * g) for g in want], rel=2e-2, abs=1e-4)
    assert any(abs(g) > 1e-3 for g in want)

"""Minimum-cut extraction, preference formatting, toxicity."""
import random
import re
import zlib
from html import unescape

import numpy as np
import pytest

from tenura.llm import chat as C
from tenura.llm import html as H
from tenura.llm import toxicity as X

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header class="site-header"><h1>Site name</h1><a href="/">Home</a></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div id="cookie-notice">We use cookies to make this site better for everyone who reads it.</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First with a <a href="x">link</a>  and\n&nbsp;space.
<div class="ad-slot">Buy this now, it is a great thing to own, really.</div>
<aside>A sidebar text which is long enough to look like a paragraph of text.</aside>
<p>Second<br>line &lt;b&gt;.</p><ul><li>item one<li>item two</ul>
<form><label>Mail</label><input name="m"><button>Send</button></form><noscript>Turn scripts on.</noscript></article>
<section id="comments"><h3>Comments</h3><article class="comment"><p>I think this is a fine article, thank you.</p></article></section>
</main><footer>&copy; someone</footer></body></html>"""


def test_page():
    assert H.main_text(PAGE).split("\n") == ["Title & more", "First with a link and space.", "Second line <b>.", "item one", "item two"]


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p>", ""), ("<article><h1>A cut title &amp", "A cut title &"),
    ("<article><p>Only &quo", "Only &quo"), ("<article><p>a <!-- c --> b</i></div><p>d", "a b\nd"),
    ("<article><p title='x>y'>quoted</p><p title=\"open>broken</p></article>", "quoted\nbroken"),
])
def test_broken_pages(page, text):
    assert H.main_text(page) == text


def test_page_without_article():
    prose = "This is a long paragraph of text, which goes on for a while and says something of note. " * 3
    page = f"<body><div class=menu><a href=1>x</a></div><div><p>{prose}</p><p>{prose}</p></div><div class=footer>foot</div>"
    assert H.main_text(page) == "\n".join([prose.strip()] * 2)


def test_long_page_is_whole():
    page = "<nav><a href=x>m</a></nav><article>" + "".join(f"<p>Paragraph {k} of the text.</p>" for k in range(4000))
    assert H.main_text(page).count("\n") == 3999


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randint(1, 7)
        e = [rng.choice((-3.0, -1.5, -0.25, 0.0, 0.75, 2.0)) + rng.random() / 9 for _ in range(n)]
        edges = {(a, b): rng.random() * 2 for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}

        def cost(kept):
            return (sum(x for x, k in zip(e, kept) if x > 0 and not k) - sum(x for x, k in zip(e, kept) if x < 0 and k)
                    + sum(c for (a, b), c in edges.items() if kept[a] != kept[b]))
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(H.minimum_cut(e, edges)) == pytest.approx(best)


def test_pages_table(spark):
    rows = H.op7_html_extraction(spark, "/root/testdata/sf0.01").collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)
        parts = [" ".join(unescape(re.sub(r"</?(?:b|br)>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside[1] if inside else "")]
        assert r["text"] == "\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


def test_extract_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, PAGE, "t", None), (1, None, None, 3)], "page_id int, html string, text string, main int")
    out = H.extract(df)
    assert out.columns == ["page_id", "text", "main", "main_text"]
    assert sorted(len(r["main_text"]) for r in out.collect())[0] == 0
    assert H.extract(df.limit(0)).count() == 0


def shown(turns):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)


def brute_pair(a, b):
    n = 0
    while n < min(len(a), len(b)) and [x or "" for x in a[n]] == [x or "" for x in b[n]]:
        n += 1

    def mask(turns):
        at, spans = 0, []
        for r, t in turns:
            begin = at + len(f"<|im_start|>{r or ''}\n")
            end = begin + len(f"{t or ''}<|im_end|>")
            at = end + 1
            spans += [f"{begin}-{end}"] * (r == "assistant")
        return ",".join(spans)
    return n, shown(a[:n]), shown(a[n:]), mask(a[n:]), shown(b[n:]), mask(b[n:])


def test_preferences(spark):
    rng = random.Random(6)
    pairs = {1: ([], [("user", "only rejected")]), 2: ([("user", "x"), ("assistant", "y")], []),
             3: ([("user", None), (None, "é")], [("user", ""), (None, "é"), ("assistant", "more")])}
    for k in range(4, 40):
        common = [(rng.choice(("user", "assistant")), f"t{rng.randint(0, 3)}") for _ in range(rng.randint(0, 4))]
        pairs[k] = tuple(common + [(rng.choice(("user", "assistant")), f"é{rng.randint(0, 2)}") for _ in range(rng.randint(0, 3))]
                         for _ in range(2))
    pairs = {k: v for k, v in pairs.items() if v[0] or v[1]}
    rows = [(k, s, i, r, t, "extra") for k, v in pairs.items() for s, turns in zip(("chosen", "rejected"), v)
            for i, (r, t) in enumerate(turns)] + [(None, "chosen", 0, "user", "no pair", "")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "pair_id int, side string, turn int, role string, text string, chosen string")
    out = C.format_preferences(df)
    assert out.columns == ["pair_id", "n_prefix", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask"]
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == {k: brute_pair(*v) for k, v in pairs.items()}
    assert C.format_preferences(df.limit(0)).count() == 0


def test_repeated_turns_have_an_order(spark):
    rows = [(1, "chosen", 0, "user", t) for t in ("b", "a", "a")] + [(1, "rejected", 0, "user", "a")]
    r = C.format_preferences(spark.createDataFrame(rows, "pair_id int, side string, turn int, role string, text string")).first()
    assert r["n_prefix"] == 1 and r["chosen"] == shown([("user", "a"), ("user", "b")])


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in X.op6_toxicity(spark, sf).collect()}
    docs = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert set(got) == docs and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    recall = np.mean([p for p, y in held if y == 1])
    clean = np.mean([1 - p for p, y in held if y == 0])
    assert recall > 0.9 and clean > 0.95


def test_training_rows_leave_the_held_out_alone(spark):
    sf = "/root/testdata/sf0.01"
    rows = X.training_rows(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), 30).collect()
    assert rows and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)
    assert max(sum(r["toxic"] == y for r in rows) for y in (0, 1)) <= 30


def test_scores_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "some words"), (4, "x " * 30000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["score"] == 0 for r in X.score(docs, X.train(docs, none)).collect())
    some = spark.createDataFrame([(1, None), (9, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    assert X.score(docs, X.train(docs, some)).count() == 5
    assert X.score(docs.limit(0), X.train(docs, some)).count() == 0


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    """No row is left out for its length or its number; lots together count and learn as one does."""
    rows = [(i, ("bad " if i % 3 == 0 else "good ") + f"w{i % 7} " * (25_000 if i == 1 else 5)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    learnt = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(r["doc_id"] for r in X.training_rows(docs, labels).collect()) == learnt
    seen, start = [], X._start
    monkeypatch.setattr(X, "_start", lambda every, *rest: seen.append(every.tolist()) or start(every, *rest))
    for lot in (4096, 40):
        monkeypatch.setattr(X, "LOT", lot)
        got = {r["doc_id"]: r["score"] for r in X.score(docs, X.train(docs, labels)).collect()}
        assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(300))
    toxic = sum(i % 3 == 0 for i in learnt)
    assert seen == [[len(learnt) - toxic, toxic]] * 2

import random
import time

import numpy as np
import pytest

from lattica.llm import block_labeller
from lattica.llm.block_labeller import fresh, generated, gradients, label, padded, page, vectors
from lattica.llm.html_blocks import leaves
from lattica.llm.html_text import extract_text, standard_model

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad --><div class="ad">Buy now.</div>
<article><h1>A &amp; B</h1><p><b>First   line
goes on.<br><p>Second &eacute;&nbsp;line, with more words in it.</p></article>
<div class="comments"><p>I disagree.</p></div><footer>&copy; us</footer>"""


def texts(html):
    return [x.text for x in leaves(html)]


def test_blocks_and_references():
    assert texts(PAGE) == ["Home", "News", "Buy now.", "A & B", "First line goes on.", "Second é line, with more words in it.", "I disagree.", "© us"]
    assert texts(None) == [] and texts("") == [] and texts("plain") == ["plain"]
    assert texts("<p>a<p>b<ul><li>c<li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert texts("<p>x</p><script>if (a<b) '</p>'</script><style>i{}</style><!-- <p>no</p> --><p>y < z") == ["x", "y < z"]


def test_paths_close_paragraphs():
    found = leaves("<article><p><b>a<br><p>b</p></article><footer>c</footer>")
    assert [x.path for x in found] == [("article", "p"), ("article", "p"), ("footer",)]


def test_gradients_match_differences():
    m = fresh(1)
    data = [generated(random.Random(k)) for k in range(3)]
    x, mask = padded([vectors(p[0]) for p in data])
    y = np.zeros(mask.shape, np.float32)
    for i, (_, labels) in enumerate(data):
        y[i, : len(labels)] = labels
    for p in m.parameters():
        p[...] = p.astype(np.float32)
    _, grads = gradients(m, x, y, mask)
    r = np.random.default_rng(0)
    for p, g in zip(m.parameters(), grads, strict=True):
        at = tuple(int(r.integers(n)) for n in p.shape) if p.ndim > 1 else (int(r.integers(len(p))),)
        k = np.unravel_index(np.abs(g).argmax(), g.shape) if np.abs(g).max() > 1e-3 else at
        e = 1e-2
        old = p[k]
        p[k] = old + e
        up, _ = gradients(m, x, y, mask)
        p[k] = old - e
        down, _ = gradients(m, x, y, mask)
        p[k] = old
        assert g[k] == pytest.approx((up - down) / (2 * e), rel=0.1, abs=2e-3)


def test_held_out_accuracy():
    test = [generated(random.Random(f"held-{k}")) for k in range(200)]
    got = label(standard_model(), [x for x, _ in test])
    hits = [g == np.array(y) for g, (_, y) in zip(got, test, strict=True)]
    assert np.concatenate(hits).mean() > 0.985


def read_by_hand(m, blocks):
    """The network block by block, in plain loops."""
    x = vectors(blocks).astype(float)
    logistic = lambda z: 1 / (1 + np.exp(-z))
    odds = np.full(len(blocks), float(m.c[0]))
    h = len(m.u[0])
    for d, order in ((0, range(len(x))), (1, reversed(range(len(x))))):
        state = cell = np.zeros(h)
        for t in order:
            z = x[t] @ m.w[d] + state @ m.u[d] + m.b[d]
            cell = logistic(z[h : 2 * h]) * cell + logistic(z[:h]) * np.tanh(z[3 * h :])
            state = logistic(z[2 * h : 3 * h]) * np.tanh(cell)
            odds[t] += state @ m.v[d * h : (d + 1) * h, 0]
    return odds


def test_extraction_matches_the_network_by_hand(spark):
    pages = [page(random.Random(f"hand-{k}")).replace("\x01", "") for k in range(60)] + [PAGE, "", None, "plain"]
    df = spark.createDataFrame([(k, "u", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r for r in extract_text(df).collect()}
    for k, p in enumerate(pages):
        blocks = leaves(p)
        odds = read_by_hand(standard_model(), blocks)
        assert not len(odds) or np.abs(odds).min() > 1e-3  # no toss-ups that rounding could decide
        assert got[k].text == "\n".join(b.text for b, o in zip(blocks, odds, strict=True) if o >= 0)
        assert got[k].n_blocks == len(blocks) and got[k].n_chars == len(got[k].text)


def test_long_pages_in_stretches(monkeypatch):
    blocks = [b for k in range(40) for b in generated(random.Random(f"long-{k}"))[0]]
    whole = label(standard_model(), [blocks])[0]
    monkeypatch.setattr(block_labeller, "MAX_BLOCKS", 37)
    assert (label(standard_model(), [blocks, blocks[:5]])[0] == whole).all()


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<a " * 330_000, []), ("<div>" * 200_000 + "x", ["x"]), ("<div>x" * 150_000, ["x"] * 150_000), ("<b>" * 100_000 + "<h1>x</h1>" * 30_000, ["x"] * 30_000), ("<!" * 500_000, []), ("<p x='" * 150_000, []),
        ("<script " * 120_000, []), ("&amp" * 200_000, ["&" * 200_000]), ("<" * 1_000_000, ["<" * 1_000_000]), ("<p>" + "w " * 500_000, [("w " * 500_000).strip()]), ("</div>" * 150_000 + "x", ["x"]),
    ],
    ids=range(11),
)
def test_any_page_of_a_million_characters_is_read_in_seconds(html, want):
    began = time.monotonic()
    got = texts(html)
    assert time.monotonic() - began < 20 and got == want


def test_every_word_of_a_block_counts():
    short, long = (leaves("<p>" + "word " * 64 + more)[0] for more in ("", "other " * 200))
    assert (vectors([short])[0] != vectors([long])[0])[256:288].any()


def test_extraction(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (3, "v", "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(extract_text(df).select("page_id", "text", "n_chars").collect())
    want = "A & B\nFirst line goes on.\nSecond é line, with more words in it."
    assert [tuple(r) for r in got] == [(1, want, len(want))] * 2 + [(2, "", 0), (3, "", 0)]
    assert extract_text(df.limit(0)).count() == 0
    clash = df.withColumnsRenamed({"text": "n_blocks"}).selectExpr("*", "'own' AS value", "'own' AS blocks")
    row = extract_text(clash).where("page_id = 1").first()
    assert row.value == row.blocks == "own" and row.n_blocks == 8

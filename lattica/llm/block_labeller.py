"""A recurrent block labeller: which leaf blocks of a page are its article.

Each block is a vector of hashed tag-path and class words, hashed words and a few sizes. A bidirectional LSTM in numpy reads
a page's blocks in both directions, so that every decision sees the whole page, and a logistic unit on both states says
whether a block belongs to the article. It is trained here, by backpropagation through time, on pages that are generated
with known labels; seeds are fixed, so the weights are the same every time.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from lattica.llm.html_blocks import Leaf, leaves

PATH_SIZE, WORD_SIZE, SCALARS, HIDDEN = 256, 32, 10, 24
SIZE = PATH_SIZE + WORD_SIZE + SCALARS
PAGES, EPOCHS, BATCH, RATE = 900, 14, 30, 0.01
#: Blocks of one forward pass; a page of more is read alone, in stretches of so many that pass their states on.
MAX_BLOCKS = 20_000


def bucket(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size


_path_buckets: dict[str, int] = {}


def vectors(page: Sequence[Leaf], first: int = 0, total: int | None = None) -> np.ndarray:
    """Of the blocks from place ``first`` on of a page of ``total`` blocks."""
    total = total or len(page)
    x = np.zeros((len(page), SIZE), np.float32)
    for i, (row, leaf) in enumerate(zip(x, page, strict=True), first):
        for token in leaf.path:
            k = _path_buckets.get(token)
            if k is None:
                k = bucket(token, PATH_SIZE)
                if len(_path_buckets) < 100_000:
                    _path_buckets[token] = k
            row[k] = 1
        words = leaf.text.lower().split()
        s = PATH_SIZE + WORD_SIZE
        row[PATH_SIZE:s] = np.bincount([bucket(w, WORD_SIZE) for w in words], minlength=WORD_SIZE) / len(words) if words else 0
        n = len(leaf.text)
        ends = leaf.text[-1:] in ".!?…\"”"
        row[s:] = (np.log1p(n) / 8, leaf.linked / n, n < 40, n > 200, ends, i / total, i == 0, i == total - 1, leaf.text.count(",") / n, len(leaf.path) / 12)
    return x


@dataclass
class Model:
    """Input, recurrent and bias weights of both directions (gates: input, forget, output, cell), and the output unit."""

    w: list[np.ndarray]
    u: list[np.ndarray]
    b: list[np.ndarray]
    v: np.ndarray
    c: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.w, *self.u, *self.b, self.v, self.c]


def fresh(seed: int) -> Model:
    r = np.random.default_rng(seed)
    draw = lambda n, m: (r.standard_normal((n, m)) * (1 / n) ** 0.5).astype(np.float32)
    bias = np.zeros(4 * HIDDEN, np.float32)
    bias[HIDDEN : 2 * HIDDEN] = 1
    return Model([draw(SIZE, 4 * HIDDEN) for _ in range(2)], [draw(HIDDEN, 4 * HIDDEN) for _ in range(2)], [bias.copy() for _ in range(2)], draw(2 * HIDDEN, 1), np.zeros(1, np.float32))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(m: Model, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Probabilities for x (pages, blocks, size); the second direction reads the blocks backwards, padding first."""
    h, n = HIDDEN, x.shape[1]
    states, tape = [], []
    for d in range(2):
        order = range(n) if d == 0 else range(n - 1, -1, -1)
        inputs = x @ m.w[d] + m.b[d]
        s, c = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
        out = np.zeros((len(x), n, h), np.float32)
        steps = []
        for t in order:
            a = inputs[:, t] + s @ m.u[d]
            g = np.concatenate([sigmoid(a[:, : 3 * h]), np.tanh(a[:, 3 * h :])], 1)
            new = g[:, h : 2 * h] * c + g[:, :h] * g[:, 3 * h :]
            k = mask[:, t, None]
            squashed = np.tanh(new)
            if keep:
                steps.append((t, g, c, squashed, s))
            s = np.where(k, g[:, 2 * h : 3 * h] * squashed, s)
            c = np.where(k, new, c)
            out[:, t] = s
        states.append(out)
        tape.append(steps)
    both = np.concatenate(states, 2)
    return sigmoid((both @ m.v + m.c)[..., 0]), both, tape


def gradients(m: Model, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
    h = HIDDEN
    p, both, tape = forward(m, x, mask, True)
    total = mask.sum()
    error = ((p - y) * mask / total).astype(np.float32)
    loss = -float((np.where(y > 0.5, np.log(p + 1e-9), np.log(1 - p + 1e-9)) * mask).sum() / total)
    gv, gc = (both * error[..., None]).sum((0, 1))[:, None], error.sum(keepdims=True)[0]
    back = error[..., None] * m.v[:, 0]
    gw, gu, gb = [], [], []
    for d in range(2):
        da = np.zeros((len(x), x.shape[1], 4 * h), np.float32)
        du = np.zeros_like(m.u[d])
        ds, dc = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
        for t, g, c, squashed, s in reversed(tape[d]):
            k = mask[:, t, None]
            ds = ds + back[:, t, d * h : (d + 1) * h]
            own = np.where(k, ds, 0)
            cell = np.where(k, dc, 0) + own * g[:, 2 * h : 3 * h] * (1 - squashed**2)
            i, f, o, z = (g[:, j * h : (j + 1) * h] for j in range(4))
            step = np.concatenate([cell * z * i * (1 - i), cell * c * f * (1 - f), own * squashed * o * (1 - o), cell * i * (1 - z**2)], 1)
            da[:, t] = step
            du += s.T @ step
            ds = np.where(k, step @ m.u[d].T, ds)
            dc = np.where(k, cell * f, dc)
        flat = da.reshape(-1, 4 * h)
        gw.append(x.reshape(-1, x.shape[2]).T @ flat)
        gb.append(flat.sum(0))
        gu.append(du)
    return loss, [*gw, *gu, *gb, gv, gc]


def padded(pages: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), n, SIZE), np.float32), np.zeros((len(pages), n), bool)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, True
    return x, mask


def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Adam on generated pages."""
    made = [generated(random.Random(f"train-{seed}-{k}")) for k in range(pages)]
    data = sorted(((vectors(x), np.array(y, np.float32)) for x, y in made), key=lambda p: len(p[1]))
    m = fresh(seed)
    first, second = ([np.zeros_like(p) for p in m.parameters()] for _ in range(2))
    order, step = list(range(0, len(data), BATCH)), 0
    shuffle = random.Random(seed)
    for epoch in range(epochs):
        shuffle.shuffle(order)
        rate = RATE * (1 - epoch / epochs) + 1e-4
        for a in order:
            part = data[a : a + BATCH]
            x, mask = padded([p[0] for p in part])
            y = np.zeros(mask.shape, np.float32)
            for i, (_, labels) in enumerate(part):
                y[i, : len(labels)] = labels
            _, grads = gradients(m, x, y, mask)
            step += 1
            norm = max(1.0, float(np.sqrt(sum((g**2).sum() for g in grads))) / 5)
            for p, g, f, s in zip(m.parameters(), grads, first, second, strict=True):
                g = g / norm
                f += 0.1 * (g - f)
                s += 0.01 * (g**2 - s)
                p -= (rate * (f / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return m


def label_long(m: Model, page: Sequence[Leaf]) -> np.ndarray:
    """As ``label`` for one page, holding the vectors of one stretch and one number for each block."""
    n, h = len(page), HIDDEN
    odds = np.full(n, m.c[0], np.float32)
    for d in range(2):
        s, c = np.zeros(h, np.float32), np.zeros(h, np.float32)
        weight = m.v[d * h : (d + 1) * h, 0]
        for a in range(0, n, MAX_BLOCKS)[:: 1 - 2 * d]:
            inputs = vectors(page[a : a + MAX_BLOCKS], a, n) @ m.w[d] + m.b[d]
            for t in range(len(inputs))[:: 1 - 2 * d]:
                gates = inputs[t] + s @ m.u[d]
                keep = sigmoid(gates[: 3 * h])
                c = keep[h : 2 * h] * c + keep[:h] * np.tanh(gates[3 * h :])
                s = keep[2 * h :] * np.tanh(c)
                odds[a + t] += s @ weight
    return odds >= 0


def label(m: Model, pages: Sequence[Sequence[Leaf]]) -> list[np.ndarray]:
    """For each page, which of its blocks are article."""
    out: list[np.ndarray] = [label_long(m, page) if len(page) > MAX_BLOCKS else np.zeros(0, bool) for page in pages]
    order = sorted((k for k in range(len(pages)) if 0 < len(pages[k]) <= MAX_BLOCKS), key=lambda k: len(pages[k]))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b + 1 - a) * len(pages[order[b]]) <= MAX_BLOCKS:
            b += 1
        x, mask = padded([vectors(pages[k]) for k in order[a:b]])
        p, _, _ = forward(m, x, mask)
        for i, k in enumerate(order[a:b]):
            out[k] = p[i, : len(pages[k])] >= 0.5
        a = b
    return out


# Generated pages. What site builders call the parts of a page.
ARTICLE = ["content", "post", "entry content", "story", "article body", "main content", "text", "post body", "page content", "article", "post content", "story body"]
PARTS = {
    "nav": ["nav", "navbar", "menu", "main menu", "navigation", "breadcrumb", "breadcrumbs", "tabs", "topnav", "pagination", "toc links"],
    "header": ["header", "site header", "masthead", "top bar", "branding", "page header", "topbar", "logo"],
    "footer": ["footer", "site footer", "colophon", "bottom", "page footer", "copyright", "footer links"],
    "aside": ["sidebar", "side", "related", "widget", "widget area", "recommended", "popular", "trending", "right column", "aside", "more stories", "tags", "share", "social"],
    "notice": ["cookie", "cookie notice", "notice", "banner", "consent", "alert", "gdpr", "privacy notice", "popup", "modal", "disclaimer", "paywall", "newsletter"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "ad slot", "adsbox", "banner ad", "sponsor"],
    "form": ["form", "search", "search form", "login", "signup", "subscribe", "subscribe form", "contact form", "newsletter form"],
    "comments": ["comments", "comment", "comment list", "reader comments", "discussion", "replies", "respond", "comment body", "responses", "disqus thread"],
}
SYLLABLES = ["an", "er", "in", "th", "on", "re", "ed", "ou", "le", "qu", "ai", "en", "sch", "ung", "ver", "ció", "os", "é", "ment", "ge", "li", "ta", "ro", "mi", "do", "ka", "su", "ne"]


def sentence(r: random.Random, words: int) -> str:
    made = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(words)]
    return " ".join(made).capitalize() + (r.choice([".", ".", ".", "?", "!", ""]) if words > 3 else r.choice(["", "", "."]))


def paragraph(r: random.Random) -> str:
    junk = r.random() < 0.15
    made = " ".join(sentence(r, r.choice([1, 2, 4, 8, 12, 20])) for _ in range(r.choice([1, 1, 2, 3, 6])))
    return made.replace(" ", r.choice([" | ", "&amp;&amp; ", "### ", "%%% "])) if junk and r.random() < 0.5 else made.upper() if junk else made


def named(r: random.Random, names: list[str]) -> str:
    words = r.choice(names).split()
    value = r.choice(["-", "_", " ", ""]).join(words) if len(words) > 1 else words[0]
    value += r.choice(["", "", "", f"-{r.randint(1, 9)}", " wide", " clearfix"])
    return f' {r.choice(["class", "class", "id"])}="{value}"'


def boilerplate(r: random.Random, kind: str) -> str:
    """Markup of one part that is not article; its text carries the mark \\x01."""
    say = lambda n: "\x01" + sentence(r, n)
    native = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
    tag = native if native and r.random() < 0.6 else r.choice(["div", "div", "section", "ul" if kind == "nav" else "div"])
    attributes = "" if tag == native and r.random() < 0.5 else named(r, PARTS[kind])
    if kind in ("nav", "aside") and r.random() < 0.8 or kind in ("footer", "header") and r.random() < 0.3:
        items = "".join(f"<li><a href='/{k}'>{say(r.randint(1, 5))}</a></li>" for k in range(r.randint(2, 8)))
        inner = items if tag == "ul" else f"<ul>{items}</ul>" + (f"<h3>{say(2)}</h3>" if r.random() < 0.3 else "")
    elif kind == "form":
        inner = f"<label>{say(2)}</label><input name='q'>" + f"<select><option>{say(1)}</option><option>{say(2)}</option></select>" * (r.random() < 0.3) + f"<button>{say(1)}</button>"
    elif kind == "comments":
        inner = f"<h2>{say(2)}</h2>" * (r.random() < 0.5) + "".join(f"<{t}{named(r, PARTS[kind]) if r.random() < 0.5 else ''}><b>{say(1)}</b><p>{say(r.randint(2, 30))}</p></{t}>" for t in [r.choice(["div", "li", "article"])] for _ in range(r.randint(1, 5)))
    elif kind == "footer":
        inner = r.choice(["", "<p>"]) + f"{say(1)} &copy; {r.randint(1999, 2030)} &middot; {say(r.randint(1, 8))}"
    else:
        inner = r.choice(["<p>{}</p>", "{}", "<span>{}</span>", "<h2>{}</h2>", "<p>{}</p>"]).format(say(r.randint(1, 25))) * r.choice([1, 1, 2])
    return f"<{tag}{attributes}>{inner}</{tag}>"


def body(r: random.Random) -> str:
    """Markup of an article, sometimes with other parts in between."""
    out = [f"<h1>{paragraph(r)}</h1>" if r.random() < 0.6 else f"<header><h1>{paragraph(r)}</h1></header>" if r.random() < 0.3 else f"<h1>{sentence(r, 4)}</h1>"]
    again = sentence(r, r.randint(1, 8)) if r.random() < 0.12 else ""
    for _ in range(r.choice([1, 2, 3, 5, 8, 14, 30])):
        kind = r.random()
        if again and r.random() < 0.8:
            out.append(f"<p>{again}</p>")
            continue
        if kind < 0.62:
            out.append(f"<p>{paragraph(r)}</p>")
        elif kind < 0.7:
            out.append(f"<p><b>{paragraph(r)}<br>")
        elif kind < 0.76:
            out.append(f"<h2>{sentence(r, r.randint(1, 6))}</h2>")
        elif kind < 0.82:
            out.append("<ul>" + "".join(f"<li>{sentence(r, r.randint(1, 9))}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
        elif kind < 0.86:
            out.append(f"<blockquote><p>{paragraph(r)}</p></blockquote>")
        elif kind < 0.9:
            out.append(f"<p>{sentence(r, 5)} <a href='/x'>{sentence(r, 2)}</a> {sentence(r, 4)}</p>")
        elif kind < 0.92:
            out.append(f"<div>{paragraph(r)}</div>")
        elif kind < 0.94:
            out.append(f"<table><tr><td>{sentence(r, 2)}</td><td>{sentence(r, 3)}</td></tr></table>")
        elif kind < 0.95:
            out.append(f"<figure><img src='a'><figcaption>{sentence(r, 6)}</figcaption></figure>")
        else:
            out.append(boilerplate(r, r.choice(["ad", "ad", "aside", "notice", "form", "nav"])))
    if r.random() < 0.1:
        out.append(boilerplate(r, "comments"))
    return "".join(out)


def page(r: random.Random) -> str:
    """A whole page; text that is not article is marked by \\x01."""
    some = lambda kinds, p: "".join(boilerplate(r, k) for k in kinds if r.random() < p)
    style = r.random()
    if style < 0.55:
        inner = f"<article{named(r, ARTICLE) if r.random() < 0.4 else ''}>{body(r)}</article>"
    elif style < 0.7:
        inner = f"<main{named(r, ARTICLE) if r.random() < 0.4 else ''}>{body(r)}</main>"
    elif style < 0.92:
        inner = f"<div{named(r, ARTICLE)}>{body(r)}</div>"
    else:
        inner = body(r)
    if r.random() < 0.3:
        inner = f"<{r.choice(['main', 'div', 'section'])}>{inner}{some(['comments', 'aside', 'ad'], 0.3)}" + r.choice(["</main>", "</div>", "</section>", ""])
    before, after = ["nav", "header", "ad", "notice", "form", "aside", "nav"], ["comments", "aside", "ad", "form", "notice", "footer", "nav"]
    r.shuffle(before)
    r.shuffle(after)
    out = some(before, 0.4) + inner + some(after, 0.4) + (boilerplate(r, "footer") if r.random() < 0.7 else "")
    if r.random() < 0.25:
        out = f"<div{named(r, ['wrapper', 'container', 'page', 'site', 'layout'])}>{out}</div>"
    return f"<html><head><title>{sentence(r, 3)}</title></head><body>{out}" + r.choice(["</body></html>", ""])


def generated(r: random.Random) -> tuple[list[Leaf], list[int]]:
    """A page's blocks and their labels."""
    found = leaves(page(r))
    labels = [int("\x01" not in leaf.text) for leaf in found]
    for leaf in found:
        leaf.text = leaf.text.replace("\x01", "") or "."
    return found, labels

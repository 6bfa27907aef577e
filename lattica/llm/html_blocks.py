"""HTML as a sequence of leaf blocks with their tag paths."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

#: A tag goes on to the first ``>`` outside quoted values; what is open at the end of the page is dropped, as in browsers. No
#: alternative gives anything back, so a page is read once whatever it holds.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-zA-Z]+")
#: Elements whose content is no text of the page, that break blocks, that have no content, and that end what is open.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
HIDDEN = RAW | {"head", "noscript", "template", "svg", "math", "canvas", "object"}
BLOCK = set(
    "html head body title article section main header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre form fieldset legend "
    "figure figcaption address hr details summary dialog option select optgroup button label menu center noscript template".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where looking for an element to close stops.
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "main", "aside", "nav", "header", "footer", "form"}
#: Block elements that end an open paragraph.
ENDS_P = BLOCK - {"option", "select", "optgroup", "button", "label", "legend", "html", "head", "body", "title", "td", "th", "tr", "caption", "summary"}


#: As in browsers' parsers.
MAX_DEPTH = 512


@dataclass(slots=True)
class Leaf:
    text: str
    path: tuple[str, ...]
    linked: int


def element(tag: str, attributes: str) -> tuple[str, tuple[str, ...]]:
    """The tag and the words of its class, id and role."""
    words = [w.lower() for m in ATTRIBUTE.finditer(attributes) for w in WORD.findall(m[2] or m[3] or m[4] or "")] if attributes else []
    return tag, (tag, *(f".{w}" for w in dict.fromkeys(words)))


class Open:
    """The open elements, with counts so that every question about them takes one look-up."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.of: Counter[str] = Counter()
        self.hidden = self.beyond = 0

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        if len(self.stack) >= MAX_DEPTH:
            self.beyond += 1
            return
        self.stack.append((tag, names))
        self.of[tag] += 1
        self.hidden += tag in HIDDEN

    def pop(self) -> str:
        tag = self.stack.pop()[0]
        self.of[tag] -= 1
        self.hidden -= tag in HIDDEN
        return tag

    def end(self, tag: str) -> None:
        if self.beyond:
            self.beyond -= 1
        elif self.of[tag]:
            while self.pop() != tag:
                pass

    def close(self, tags: set[str]) -> None:
        """Pop up to the innermost of these, unless something that holds it together lies in between."""
        if not any(self.of[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                while len(self.stack) > k:
                    self.pop()
                self.beyond = 0
                return
            if self.stack[k][0] in SCOPE:
                return

    def show(self) -> None:
        """A body ends what is hidden."""
        whole, self.stack = self.stack, []
        self.of.clear()
        self.hidden = 0
        for tag, names in whole:
            if tag not in HIDDEN:
                self.push(tag, names)


def leaves(html: str | None) -> list[Leaf]:
    """All visible blocks in page order, references decoded and white space as single blanks.

    In time linear in the page: a tag path holds the outermost ``MAX_DEPTH`` elements, and text below these belongs to them.
    """
    out: list[Leaf] = []
    opened = Open()
    text: list[str] = []
    linked = at = 0
    html = html or ""
    size = len(html)

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                out.append(Leaf(joined, tuple(x for _, names in opened.stack if names[0] in BLOCK or len(names) > 1 for x in names), min(linked, len(joined))))
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not opened.hidden:
            said = unescape(raw) if "&" in raw else raw
            text.append(said)
            if opened.of["a"]:
                linked += len(said)

    for m in iter(lambda: TOKEN.search(html, at), None):
        say(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            flush()
        elif tag == "br":
            text.append(" ")
        if m[1]:
            opened.end(tag)
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag in ENDS_P:
            opened.close({"p"})
        if tag in CLOSES:
            opened.close(CLOSES[tag])
        if tag == "body":
            opened.show()
        opened.push(*element(tag, m[3]))
    say(html[at:])
    flush()
    return out

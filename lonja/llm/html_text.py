"""Main text of HTML pages: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi.

A page is cut into leaf blocks: the text between block-level tags, with the tags and class words above it. Features of
a block are its ancestors, its own tag, its link density, length, punctuation and place. The field is trained on
labelled pages (``training_pages``: pages of many layouts in which every block is labelled main text or not), once for
a session, and its weights, a table of fixed size, are shipped to the tasks.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = r"[a-zA-Z][^\s/>]*"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)({_NAME})((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
#: What can stand after the last > of a page.
_TAIL = re.compile(r"<!--.*\Z|<[!?][^>]*", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: HTML element kinds (fixed values): elements that break the text, elements without end tag, elements whose content is no
#: markup, elements whose content is not shown, and those of them that hold no HTML.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea".split())
HIDDEN = frozenset("noscript template iframe svg math object".split())
FOREIGN = frozenset("svg math".split())
#: Elements that an opening tag of the same kind ends.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = BLOCKS - {"button", "label", "option", "select", "legend"}
#: Elements beyond which they end nothing.
_LISTS = frozenset(("ul", "ol", "dl", "table", "select"))


class Block:
    """A text block: its text, the names of its open elements and of their class words that are features, its own block
    element, and its characters inside links."""

    __slots__ = ("text", "above", "own", "linked")

    def __init__(self, text: str, above: frozenset[str], own: str, linked: int):
        self.text, self.above, self.own, self.linked = text, above, own, linked


def _words_of(attributes: str) -> frozenset[str]:
    found = set()
    for _, value in _ATTRIBUTE.findall(attributes):
        found.update(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
    return frozenset(found)


class _Open:
    """The open elements of a page. Each tag has the places of its open elements, and each feature its number of them, so
    that finding, opening and closing an element costs the same under any number of unclosed ones."""

    def __init__(self):
        self.stack: list[tuple[str, list[str]] | None] = []  # None: closed while elements above it are open
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.hidden: list[int] = []
        self.solid: list[int] = []  # blocks but p: beyond them an opening tag ends nothing
        self.counts: Counter[str] = Counter()
        self.above: frozenset[str] | None = frozenset()

    def last(self, tags: Iterable[str]) -> int:
        """The place of the uppermost open element of these tags, -1 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, tag: str, names: frozenset[str]) -> None:
        own = [f for f in (f"in:{tag}", *(f"name:{n}" for n in names)) if f in FEATURES]
        at = len(self.stack)
        self.stack.append((tag, own))
        self.places[tag].append(at)
        if tag in BLOCKS:
            self.blocks.append(at)
            if tag != "p":
                self.solid.append(at)
        if tag in HIDDEN:
            self.hidden.append(at)
        for f in own:
            self.counts[f] += 1
            if self.counts[f] == 1:
                self.above = None

    def _drop(self, element: tuple[str, list[str]]) -> None:
        self.places[element[0]].pop()
        for f in element[1]:
            self.counts[f] -= 1
            if not self.counts[f]:
                del self.counts[f]
                self.above = None

    def close(self, k: int) -> None:
        """Closes the element at k and all above it."""
        while len(self.stack) > k:
            if (element := self.stack.pop()) is not None:
                self._drop(element)
        for places in (self.blocks, self.solid, self.hidden):
            while places and places[-1] >= k:
                places.pop()

    def close_alone(self, k: int) -> None:
        """Closes the uppermost inline element of its tag and leaves those above it open."""
        self._drop(self.stack[k])
        self.stack[k] = None

    def features(self) -> frozenset[str]:
        if self.above is None:
            self.above = frozenset(self.counts)
        return self.above


def leaf_blocks(source: str | None) -> list[Block]:
    """The text blocks of a page in order: references decoded, white space single, trimmed, none empty. The time is in
    proportion to the page, whatever is left open in it; a page without tags is one block.

    The text of hidden elements is left out until they end: at their end tag, at that of an element around them, and
    for drawings and formulas at the next tag that breaks the text, as browsers do. Script, style, title and textarea
    without an end tag run to the end of the page."""
    source = source or ""
    blocks: list[Block] = []
    opened = _Open()
    parts: list[str] = []
    linked, at, last = 0, 0, source.rfind(">")

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            own = opened.stack[opened.blocks[-1]][0] if opened.blocks else "body"
            blocks.append(Block(text, opened.features(), own, min(linked, len(text))))
        parts, linked = [], 0

    while at < len(source):
        m = (_TAG if at <= last else _TAIL).search(source, at)
        text = source[at : m.start() if m else len(source)]
        if text and not opened.hidden:
            parts.append(text)
            if opened.places["a"]:
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = at <= last + 1 and m.group(2) and m.group(2).lower()
        if not tag:
            continue
        if m.group(1):
            k = opened.last((tag,))
            if tag in BLOCKS and not (opened.hidden and (k < 0 or opened.hidden[0] < k)):
                flush()
            if k >= 0:
                # An inline end tag does not close blocks around it.
                if tag in BLOCKS or tag in HIDDEN or not (opened.blocks and opened.blocks[-1] > k):
                    opened.close(k)
                else:
                    opened.close_alone(k)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at) if not m.group(3).endswith("/") else None
            at = end.end() if end else at if m.group(3).endswith("/") else len(source)
            parts.append(" ")
            continue
        if tag in BLOCKS:
            if opened.hidden:
                k = opened.hidden[-1]
                if opened.stack[k][0] in FOREIGN and opened.last(("foreignobject", "desc")) < k:
                    opened.close(k)
            if not opened.hidden:
                flush()
            k = opened.last(_CLOSES.get(tag, frozenset()) | ({"p"} if tag in _ENDS_P else frozenset()))
            barrier = opened.last(_LISTS) if tag in _CLOSES else max(opened.solid[-1:], default=-1)
            if k >= 0 and k >= max([barrier, *opened.hidden[-1:]]):
                opened.close(k)
        elif tag == "br":
            parts.append(" ")
        if tag not in VOID and not m.group(3).endswith("/"):
            opened.push(tag, _words_of(m.group(3)) if "=" in m.group(3) else frozenset())
        if tag in HIDDEN:
            parts.append(" ")
    flush()
    return blocks


#: Words of class, id and role attributes that tell what a part of a page is (fixed values, the features' vocabulary).
NAMES = tuple(
    "ad ads advert advertisement article author banner body bottom breadcrumb breadcrumbs byline caption comment comments complementary content contentinfo cookie consent copyright cta date disclaimer disqus entry feed flash footer form gdpr header hero legal links login main masthead menu meta modal nav navbar navigation newsletter notice pagination pager popup post privacy promo reading related reply respond search share sharing shop sidebar signup site skip social sponsor sponsored story subscribe summary tag tags tags text title toolbar top toc topic tracking warning widget".split()
)
_TAG_FEATURES = tuple("a article aside blockquote button dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header label li main menu nav ol option p pre section select table td th ul".split())
FEATURES = {
    name: k
    for k, name in enumerate(
        ["bias", *(f"in:{t}" for t in _TAG_FEATURES), *(f"own:{t}" for t in _TAG_FEATURES), *(f"name:{n}" for n in dict.fromkeys(NAMES)), *(f"words:{k}" for k in range(7)), *(f"links:{k}" for k in range(4)), "stop", "sentence", "symbol", "first", "last", "bar", "wide"]
    )
}


def block_features(blocks: list[Block]) -> list[list[int]]:
    out = []
    for i, b in enumerate(blocks):
        on = {"bias", f"own:{b.own}", *b.above}
        n = len(b.text.split())
        on.add(f"words:{min(6, n.bit_length() - 1)}")
        on.add(f"links:{min(3, 4 * b.linked // max(1, len(b.text)))}")
        if b.text[-1] in ".!?:;…\"'”’)":
            on.add("stop")
        if re.search(r"[.!?]\s+\S", b.text):
            on.add("sentence")
        if "©" in b.text or "|" in b.text[:80]:
            on.add("symbol" if "©" in b.text else "bar")
        if i == 0:
            on.add("first")
        if i == len(blocks) - 1:
            on.add("last")
        if len(b.text) > 400:
            on.add("wide")
        out.append(sorted(FEATURES[f] for f in on if f in FEATURES))
    return out


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """Best labels for emission scores (blocks x 2) and transition scores (2 x 2)."""
    if not len(scores):
        return []
    best, back = scores[0].tolist(), []
    m = moves.tolist()
    for s0, s1 in scores[1:].tolist():
        from0 = 0 if best[0] + m[0][0] >= best[1] + m[1][0] else 1
        from1 = 0 if best[0] + m[0][1] >= best[1] + m[1][1] else 1
        best = [best[from0] + m[from0][0] + s0, best[from1] + m[from1][1] + s1]
        back.append((from0, from1))
    y = [0 if best[0] >= best[1] else 1]
    for step in reversed(back):
        y.append(step[y[-1]])
    return y[::-1]


def train_field(pages: list[tuple[list[Block], list[int]]], epochs: int = 30, rate: float = 0.15, l2: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x 2) and transitions (2 x 2) by stochastic gradients of the chains' log-likelihood
    (forward and backward sums), with adaptive steps."""
    w, t = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    data = [(block_features(b), y) for b, y in pages if b]
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for rows, y in data:
            s = np.array([w[r].sum(0) for r in rows])
            n = len(s)
            fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
            fwd[0] = s[0]
            for i in range(1, n):
                fwd[i] = s[i] + np.logaddexp(fwd[i - 1][0] + t[0], fwd[i - 1][1] + t[1])
            for i in range(n - 2, -1, -1):
                bwd[i] = np.logaddexp(t[:, 0] + s[i + 1][0] + bwd[i + 1][0], t[:, 1] + s[i + 1][1] + bwd[i + 1][1])
            z = np.logaddexp(*fwd[-1])
            error = np.exp(fwd + bwd - z)
            error[np.arange(n), y] -= 1
            dw, dt = l2 * w, l2 * t
            for r, e in zip(rows, error):
                dw[r] += e
            for i in range(1, n):
                dt += np.exp(fwd[i - 1][:, None] + t + s[i][None] + bwd[i][None] - z)
                dt[y[i - 1], y[i]] -= 1
            gw += dw * dw
            gt += dt * dt
            w -= rate * dw / np.sqrt(gw)
            t -= rate * dt / np.sqrt(gt)
    return w, t


# --- labelled pages ---------------------------------------------------------------------------------------------------

_SYLLABLES = "an ble con de du el en er es fi ga hi in ka la le lo ma mi na no on or pa qui ra re ri sa se si so ta te ti to tra un va ver vi".split()
#: Ways to mark the parts of a page (fixed values): element, attribute; the empty ones give no hint.
_MAIN = [("article", ""), ("main", ""), ("div", ' class="content"'), ("div", ' id="main-content"'), ("div", ' class="post entry"'), ("div", ' class="story-body"'), ("section", ' class="article-text"'), ("td", ""), ("div", ""), ("article", ' class="post"')]
_OTHER = {
    "menu": [("nav", ""), ("div", ' class="menu"'), ("ul", ' class="navbar"'), ("div", ' id="navigation"'), ("header", ""), ("div", ' class="breadcrumbs"'), ("div", "")],
    "top": [("header", ""), ("div", ' class="site-header"'), ("div", ' class="masthead banner"'), ("div", ' id="top"')],
    "notice": [("div", ' class="cookie-notice"'), ("div", ' id="gdpr-consent"'), ("section", ' class="notice"'), ("div", ' class="popup newsletter"'), ("div", ' class="disclaimer"')],
    "advert": [("div", ' class="ad"'), ("div", ' class="ads sponsored"'), ("aside", ' class="promo"'), ("div", ' id="banner-ad"'), ("section", ' class="advertisement"')],
    "side": [("aside", ""), ("div", ' class="sidebar"'), ("div", ' class="related widget"'), ("aside", ' class="toc links"'), ("section", ' class="related-links"')],
    "form": [("form", ""), ("form", ' class="search"'), ("form", ' id="login"'), ("form", ' class="subscribe"'), ("div", ' class="signup form"')],
    "comments": [("section", ' class="comments"'), ("div", ' id="comments"'), ("div", ' id="disqus"'), ("ol", ' class="comment-list"'), ("div", ' class="reply respond"')],
    "share": [("div", ' class="share social"'), ("ul", ' class="tags"'), ("div", ' class="byline meta"'), ("div", ' class="pagination pager"')],
    "foot": [("footer", ""), ("div", ' class="footer"'), ("div", ' id="site-footer"'), ("div", ' class="copyright legal"'), ("footer", ' class="contentinfo"')],
}


class _Writer:
    """One labelled page: every block carries a mark that tells its label, removed from the page's text afterwards."""

    def __init__(self, rng: random.Random):
        self.r, self.marks = rng, 0

    def words(self, n: int) -> str:
        out = ["".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4))) for _ in range(n)]
        return " ".join(out)

    def sentence(self, n: int) -> str:
        s = self.words(n).capitalize()
        return s + self.r.choice([".", ".", ".", "!", "?", "", " | " + self.words(2), "***"])

    def prose(self, most: int = 8) -> str:
        return " ".join(self.sentence(self.r.randint(1, 22)) for _ in range(self.r.randint(1, most)))

    def mark(self, label: int, text: str) -> str:
        self.marks += 1
        return f"\ue000{label}\ue001{text}"

    def main(self) -> str:
        r, out = self.r, []
        tag, attributes = r.choice(_MAIN)
        if r.random() < 0.8:
            out.append(f"<h1>{self.mark(1, self.sentence(r.randint(1, 12)))}</h1>")
        for _ in range(r.randint(1, 14)):
            k = r.random()
            if k < 0.68:
                bold = r.random() < 0.1
                out.append(f"<p>{'<b>' if bold else ''}{self.mark(1, self.prose(2 if r.random() < 0.4 else 8))}{'</b>' if bold and r.random() < 0.5 else ''}{'</p>' if r.random() < 0.85 else ''}")
            elif k < 0.76:
                out.append(f"<h{r.randint(2, 4)}>{self.mark(1, self.sentence(r.randint(1, 8)))}</h2>")
            elif k < 0.84:
                out.append("<ul>" + "".join(f"<li>{self.mark(1, self.sentence(r.randint(2, 15)))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.89:
                out.append(f"<blockquote><p>{self.mark(1, self.prose(3))}</p></blockquote>")
            elif k < 0.92:
                out.append("<table><tr>" + "".join(f"<td>{self.mark(1, self.words(r.randint(1, 4)))}</td>" for _ in range(3)) + "</tr></table>")
            elif k < 0.95:
                out.append(f"<pre>{self.mark(1, self.words(8))}</pre>")
            else:
                out.append(self.other(r.choice(["advert", "share", "side", "form"])))
        if tag == "td":
            return f"<table><tr><td>{''.join(out)}</td></tr></table>"
        return f"<{tag}{attributes}>{''.join(out)}</{tag}>"

    def other(self, kind: str) -> str:
        r = self.r
        tag, attributes = r.choice(_OTHER[kind])
        if kind in ("menu", "share"):
            items = [f'<a href="/x">{self.mark(0, self.words(r.randint(1, 3)))}</a>' for _ in range(r.randint(2, 8))]
            inside = "".join(f"<li>{x}</li>" for x in items)
            inside = inside if tag in ("ul", "ol") else f"<ul>{inside}</ul>" if r.random() < 0.7 else "".join(f"<div>{x}</div>" for x in items)
        elif kind == "form":
            inside = f"<label>{self.mark(0, self.words(2))}</label><input><p>{self.mark(0, self.sentence(6))}</p><button>{self.mark(0, self.words(1))}</button>"
        elif kind == "comments":
            inside = "".join(f"<div><p>{self.mark(0, self.prose(4))}</p></div>" if tag != "ol" else f"<li>{self.mark(0, self.prose(4))}</li>" for _ in range(r.randint(1, 6)))
            inside = (f"<h3>{self.mark(0, self.words(2))}</h3>" if r.random() < 0.6 else "") + inside
        elif kind == "side":
            inside = f"<h3>{self.mark(0, self.words(2))}</h3>" + "".join(f"<p>{self.mark(0, self.prose(2))}</p>" if r.random() < 0.5 else f'<li><a href="/y">{self.mark(0, self.sentence(6))}</a></li>' for _ in range(r.randint(1, 5)))
        elif kind == "foot":
            inside = self.mark(0, f"{r.choice(['&copy; ', ''])}{self.words(3)} {r.choice(['&middot; ', ''])}{self.prose(2)}")
            inside = inside if r.random() < 0.6 else f"<p>{inside}</p>"
        else:
            inside = self.mark(0, self.prose(3))
            inside = inside if r.random() < 0.5 else f"<p>{inside}</p>"
        return f"<{tag}{attributes}>{inside}</{tag}>"

    def page(self) -> str:
        r = self.r
        parts = [self.other(k) for k in ("top", "menu", "notice", "advert") if r.random() < 0.6]
        r.shuffle(parts)
        tail = [self.other(k) for k in ("share", "side", "form", "comments", "advert") if r.random() < 0.45]
        r.shuffle(tail)
        body = "".join(parts) + self.main() + "".join(tail) + (self.other("foot") if r.random() < 0.85 else "")
        wrap = r.choice(["{}", "<div>{}</div>", '<div id="wrapper"><div class="container">{}</div></div>', '<div class="page">{}'])
        return f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{wrap.format(body)}</body></html>"


def training_pages(n: int = 500, seed: int = 1) -> list[tuple[list[Block], list[int]]]:
    """Labelled pages: blocks and a label for each, 1 for main text."""
    writer, out = _Writer(random.Random(seed)), []
    for _ in range(n):
        blocks = leaf_blocks(writer.page())
        labels = [int(b.text.partition("\ue000")[2][:1] or 0) for b in blocks]
        for b in blocks:
            b.text = re.sub("\ue000.\ue001", "", b.text)
        out.append((blocks, labels))
    return out


@lru_cache(maxsize=1)
def field() -> tuple[np.ndarray, np.ndarray]:
    return train_field(training_pages())


def main_text(source: str | None, weights: np.ndarray, moves: np.ndarray) -> str:
    blocks = leaf_blocks(source)
    scores = np.array([weights[r].sum(0) for r in block_features(blocks)]).reshape(-1, 2)
    return "\n\n".join(b.text for b, y in zip(blocks, viterbi(scores, moves)) if y)


def extract(pages: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """pages with a column ``into``: the main text, blocks joined by an empty line; empty for null or empty pages and
    pages without main text. Pages are taken whole; repeated rows give equal texts; broken markup is read as far as it
    makes sense. A column named ``into`` in pages is replaced."""
    shared = pages.sparkSession.sparkContext.broadcast(field())

    @F.pandas_udf("string")
    def of(sources: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, moves = shared.value
        for part in sources:
            yield pd.Series([main_text(x, weights, moves) for x in part], dtype=object)

    return pages.withColumn(into, of(F.col(f"`{html_col}`").cast("string")))


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of tags and words. Words score positive and tags negative; the contiguous
region with the greatest sum, found in one linear scan, is the content, and all its words are the
text. Weights come from labelled pages: a word's is the log-odds that words under its open
elements (names, classes, ids and roles) are main text, fitted by logistic regression; a tag's is
a cost that grows with how much more often it occurs outside main text. An element whose words
have negative log-odds is no part of the sequence that is scanned: only its own two tags are, at
``CUT`` each, so that an advert inside an article neither shows nor splits it, and what is left
has one best region.

Edge cases: null or empty html, and pages without words, give an empty text; of equally good
regions the first is taken; unclosed tags and comments end with the page; end tags that nothing
opened count as tags only; repeated rows give repeated results; null ids stay null; an empty table
gives no rows. Time and memory are linear in the page, however its tags are nested. Only page_id,
url and html are read, so other columns may have any names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from deltaloom.llm import labelled_pages
from deltaloom.llm._common import narrow, table, text_slices

TRAINING_PAGES = 600
#: The cost of each of the two tags of an element that is left out, and the most that a word scores.
CUT = -1.5
WORD = 2.0

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp "
    "small span strike strong sub sup time tt u var".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main nav ol p pre section table ul".split()
)
CLOSES_SELF = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
SCOPE = frozenset("ul ol dl table select".split())
NEVER = frozenset("script style noscript template iframe svg math head title".split())

ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
PART = re.compile(r"[a-z]+")
#: Attributes of at most so many characters are kept with their features.
CACHED = 2_000


def end_of_tag(page: str, at: int) -> int:
    """Where the tag that begins at ``at`` ends; quoted '>' do not end it."""
    stop = page.find(">", at)
    if stop < 0:
        return len(page)
    inner, quote = at, min((q for q in (page.find('"', at, stop), page.find("'", at, stop)) if q >= 0), default=-1)
    while quote >= 0:
        other = page.find(page[quote], quote + 1)
        if other < 0:
            return stop + 1
        inner = other + 1
        stop = page.find(">", inner)
        if stop < 0:
            return len(page)
        quote = min((q for q in (page.find('"', inner, stop), page.find("'", inner, stop)) if q >= 0), default=-1)
    return stop + 1


def scan(page: str):
    """('<', name, attributes), ('>', name, '') and ('', '', text) in page order."""
    at, n = 0, len(page)
    while at < n:
        open_ = page.find("<", at)
        if open_ < 0:
            yield "", "", page[at:]
            return
        nxt = page[open_ + 1 : open_ + 2]
        if not (nxt.isalpha() and nxt.isascii()) and nxt not in ("/", "!", "?"):
            stop = page.find("<", open_ + 1)
            stop = n if stop < 0 else stop
            yield "", "", page[at:stop]
            at = stop
            continue
        if open_ > at:
            yield "", "", page[at:open_]
        if page.startswith("<!--", open_):
            stop = page.find("-->", open_ + 4)
            at = n if stop < 0 else stop + 3
            continue
        at = end_of_tag(page, open_)
        tag = page[open_ + 1 : at]
        if nxt == "/":
            if m := NAME.match(tag, 1):
                yield ">", m.group().lower(), ""
        elif m := NAME.match(tag):
            name = m.group().lower().rstrip(">")
            yield "<", name, tag[m.end() :]
            if name in RAW and not tag.endswith("/>"):
                stop = re.compile(f"</{re.escape(name)}(?![a-zA-Z0-9-])", re.I).search(page, at)
                stop = stop.start() if stop else n
                yield "", "", page[at:stop]
                at = stop


def features(name: str, attributes: str) -> tuple[str, ...]:
    """The element's name and the words of its class, id, role and itemprop, wherever they stand."""
    return (_short_features if len(attributes) <= CACHED else _features)(name, attributes)


def _features(name: str, attributes: str) -> tuple[str, ...]:
    out = [name]
    for m in ATTRIBUTE.finditer(attributes):
        out += ["." + p for p in PART.findall((m[1] or m[2] or m[3] or "").lower())]
    return tuple(out)


_short_features = lru_cache(maxsize=4096)(_features)


class Stack:
    """The open elements, with where each name, block and scope is open last: every step is O(1) amortised."""

    def __init__(self, bias: float):
        self.items: list[tuple[str, float, tuple]] = [("", bias, ())]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []

    def push(self, name: str, score: float, open_: tuple) -> None:
        k = len(self.items)
        self.items.append((name, score, open_))
        self.at.setdefault(name, []).append(k)
        if name not in INLINE:
            self.blocks.append(k)
        if name in SCOPE:
            self.scopes.append(k)

    def shut(self, k: int) -> None:
        """Closes the k-th element and those inside it."""
        while len(self.items) > k:
            last = len(self.items) - 1
            self.at[self.items.pop()[0]].pop()
            for marks in (self.blocks, self.scopes):
                if marks and marks[-1] == last:
                    marks.pop()

    def last(self, names) -> int:
        """Where one of the names is open last (0: nowhere)."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def begin(self, name: str) -> None:
        """Closes what the start tag ``name`` ends: an open paragraph, or an item of its own list."""
        if own := CLOSES_SELF.get(name):
            k = self.last(own)
            if k > (self.scopes[-1] if self.scopes else 0):
                self.shut(k)
        if name in CLOSES_P and (k := self.last(("p",))) and k == self.blocks[-1]:
            self.shut(k)

    def end(self, name: str) -> None:
        if k := self.last((name,)):
            self.shut(k)


class Weights:
    """Log-odds of features of open elements, and costs of tags."""

    def __init__(self, bias: float, feature: dict[str, float], tag: dict[str, float], other: float):
        self.bias, self.feature, self.tag, self.other = bias, feature, tag, other

    def nodes(self, page: str):
        """(score of a tag or of each word, text or None, breaks, open elements, score of words under
        the innermost open element after it) in page order.

        Open elements are pairs of the outer ones and the features of the last.
        """
        stack = Stack(self.bias)
        for kind, name, rest in scan(page):
            if kind == "":
                top = stack.items[-1]
                yield top[1], rest, False, top[2], top[1]
                continue
            if kind == "<":
                stack.begin(name)
                if name not in VOID and not rest.endswith("/>"):
                    own = features(name, rest)
                    outer = stack.items[-1]
                    score = -1e9 if name in NEVER else outer[1] + sum(self.feature.get(f, 0.0) for f in own)
                    stack.push(name, score, (outer[2], own))
            else:
                stack.end(name)
            yield self.tag.get(name, self.other), None, name not in INLINE, (), stack.items[-1][1]

    def sequence(self, page: str):
        """(score, text or None, breaks) of what is scanned: the words that score, and the tags
        around them; of a left-out element only where it begins and ends."""
        under = self.bias
        for score, text, breaks, _, after in self.nodes(page):
            if text is not None:
                if not text.strip():
                    if score > 0:
                        yield 0.0, text, False
                elif score > 0:
                    yield min(WORD, score) * len(text.split()), text, False
            elif under > 0 and after > 0:
                yield score, None, breaks
            elif (under > 0) != (after > 0):
                yield CUT, None, True
            under = after if text is None else under

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = list(self.sequence(page))
        best, total, first, span = 0.0, 0.0, 0, (0, 0)
        for k, (score, _, _) in enumerate(nodes):
            if total <= 0:
                total, first = 0.0, k
            total += score
            if total > best:
                best, span = total, (first, k + 1)
        out = [" " if breaks else text or "" for _, text, breaks in nodes[span[0] : span[1]]]
        return " ".join(html.unescape("".join(out)).split())


def all_features(open_: tuple) -> frozenset[str]:
    """The features of open elements as ``nodes`` gives them."""
    found: set[str] = set()
    while open_:
        open_, own = open_
        found.update(own)
    return frozenset(found)


def train(pages: list[str]) -> Weights:
    """Weights from labelled pages, whose main words begin with k and others with z."""
    blank = Weights(0.0, {}, {}, -0.1)
    rows: Counter[tuple[frozenset, bool]] = Counter()
    inside, outside = Counter(), Counter()
    for page in pages:
        events, last = [], -1
        for _, text, _, open_, _ in blank.nodes(page):
            main = None
            if text and text.strip():
                main = text.split()[0].startswith("k")
                rows[all_features(open_), main] += min(len(text.split()), 10)
            events.append(main)
        marks = [k for k, m in enumerate(events) if m]
        if marks:
            first, last = marks[0], marks[-1]
        for k, (kind, name, _) in enumerate(scan_tags(page, len(events))):
            if kind:
                (inside if marks and first < k < last else outside)[name] += 1
    names = sorted({f for open_, _ in rows for f in open_})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    y, n = np.zeros(len(rows)), np.zeros(len(rows))
    for r, ((open_, main), count) in enumerate(rows.items()):
        x[r, [at[f] for f in open_]] = 1
        y[r], n[r] = main, count
    n = np.sqrt(n)
    w, b = np.zeros(len(names)), 0.0
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, 601):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        err = n * (p - y) / n.sum()
        gw, gb = x.T @ err + 2e-5 * w, err.sum()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.05 * (mw / c1) / (np.sqrt(vw / c2) + 1e-12)
        b -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-12)
    a, o = sum(inside.values()) + 1, sum(outside.values()) + 1
    tag = {
        t: -0.05 - 0.4 * max(0.0, float(np.log(((outside[t] + 1) / o) / ((inside[t] + 1) / a))))
        for t in inside | outside
    }
    return Weights(float(b), dict(zip(names, w.tolist(), strict=True)), tag, -0.4)


def scan_tags(page: str, n: int):
    """The events of ``nodes`` with their tag names."""
    for kind, name, rest in scan(page):
        yield kind, name, rest


@lru_cache(maxsize=1)
def weights() -> Weights:
    return train(labelled_pages.pages(TRAINING_PAGES))


def _extract(own: Weights):
    def run(batches):
        for batch, raw in text_slices(batches, "html"):
            texts = [own.text(p.decode("utf-8", "replace")) for p in raw]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return narrow(pages, "page_id", "url", "html").mapInArrow(
        _extract(weights()), "page_id long, url string, text string, n_chars long"
    )


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

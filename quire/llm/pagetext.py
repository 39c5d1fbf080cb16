"""Operator 6: main text of HTML pages by maximum-scoring subsequence.

A page becomes a row of words and tags. Words score 1, but -1 below an element whose class, id, role or
name marks it as no article text; tags cost something, a row of tags without a word between them as much as its dearest.
A block whose words are all links costs more for each end of a link. A linear scan finds the contiguous region with the
highest sum. Both kinds of weights are learned from labelled pages, those whose markup holds just one
article: a tag, class, id, role or block of links costs the logarithm of how much more often it lies outside the article than
inside (an article's own borders lie outside), and marks its words as no text where nearly all words
below it lie outside. A fixed prior adds to the odds of a mark, and is the cost of tokens that no labelled page has. What labelled pages happen to
have in menus only, such as lists, may be text elsewhere, so a cost has a limit by its kind: a block tag costs less than a word.

Below an article or main element no tag costs anything, as the element says what is text: it keeps all its words but those of
marked elements, which are holes. Costs decide on pages without such elements.
In the region, character references are decoded, white space inside a block becomes one space, and
blocks are joined by two line ends in page order. Pages are read in linear time, whatever they hold.

Null and empty pages, and pages without a word, give an empty text; an element that never ends reaches
to the end of the element around it, of the page, or to the next article; repeated rows are read once each,
long pages whole; an empty table gives no rows; columns but page_id, url and html are ignored.
"""

from __future__ import annotations

import html
import math
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slice, texts

#: Bound of the training sample: about so many pages, chosen by a hash of page_id.
PAGES = 2_000
#: Bounds of the cost of any tag, of inline and of plain ones (both may stand between an article's words), of classes, ids and roles, of the ends of links in a block of links, of other tags; logarithm of the odds from which a token marks its words as no text.
LEAST, INLINE_MOST, PLAIN_MOST, CLASS_MOST, LINK_MOST, MOST, MARKS = 0.02, 0.25, 0.5, 1.5, 2.0, 4.0, 3.0
#: Elements by what they do to text.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "br", "cite", "code", "em", "font", "i", "img", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u"}
TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
PLAIN = {"html", "body", "div", "section", "figure", "figcaption", "ul", "ol", "li", "dl", "dt", "dd", "table", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "center", "details", "summary", "hgroup", *INLINE, *TEXT}
BORDERS = {"article", "main"}
#: Fixed prior: names, roles and words of classes that mark elements as no text where no labelled page tells.
NAMES = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "svg", "canvas", "object", "dialog", "menu", "audio", "video", "map", "datalist", "fieldset", "label", "head"}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
CLASSES = {"ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "comment", "comments", "cookie", "cookies", "footer", "login", "menu", "nav", "navbar", "newsletter", "notice", "popup", "promo", "related", "share", "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget"}

NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z-]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?+")
PART = re.compile(r"[^\s_-]+")


def tag_end(page: str, at: int) -> int:
    """Where the tag ends that starts before ``at``: its ``>`` outside quotes, or the next one if a quote never closes."""
    here = at
    while (m := END.search(page, here)) is not None:
        if m[0] == ">":
            return m.start()
        close = page.find(m[0], m.end())
        if close < 0:
            return page.find(">", at)
        here = close + 1
    return page.find(">", at)


def tokens_of(name: str, attributes: str) -> tuple[str, ...]:
    """An element's name, with ``.word`` for its classes and ids, ``@role``, and ``@hidden`` where it is not shown."""
    found = [name]
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                found += [f".{w}" for w in dict.fromkeys([*value.split(), *PART.findall(value)])]
            elif key == "role":
                found.append(f"@{value.strip()}")
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                found.append("@hidden")
    return tuple(found)


def items(page: str):
    """("text", raw text), ("open", tokens) and ("close", name), in page order; comments and raw elements are left out."""
    at, last, size, raw_ends = 0, page.rfind(">"), len(page), {}
    while at < size:
        tag = page.find("<", at)
        if tag < 0 or tag > last:
            yield "text", page[at:]
            return
        if tag > at:
            yield "text", page[at:tag]
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), tag):
            at = page.find(">", tag) + 1
            continue
        m = NAME.match(page, tag + 1)
        if m is None:
            yield "text", "<"
            at = tag + 1
            continue
        end = tag_end(page, m.end())
        name, attributes, at = m[0].lower(), page[m.end() : end], end + 1
        if name[0] == "/":
            yield "close", name[1:]
            continue
        yield "open", tokens_of(name, attributes)
        if attributes.endswith("/") and name not in VOID:
            yield "close", name
        elif name in RAW:
            close = raw_ends.setdefault(name, re.compile(rf"</{name}(?=[\s/>])", re.I)).search(page, at)
            at = size if close is None else close.start()


class Weights:
    """Cost of each token, and the odds by which it marks words as no text."""

    def __init__(self, cost: dict[str, float], odds: dict[str, float]):
        self.cost, self.odds, self._costs, self._marks = cost, odds, {}, {}

    def prior_cost(self, token: str) -> float:
        if token.endswith(">a"):
            return LINK_MOST * (token[:-2] not in TEXT)
        return 0.0 if token[0] in ".@" else LEAST if token in TEXT or token in INLINE else 1.0 if token not in PLAIN else 0.25

    def most(self, token: str) -> float:
        return LINK_MOST if token.endswith(">a") else CLASS_MOST if token[0] in ".@" else INLINE_MOST if token in INLINE else PLAIN_MOST if token in PLAIN or token in BORDERS else MOST

    def of(self, token: str) -> float:
        return max(0.0, min(self.most(token), self.cost.get(token, self.prior_cost(token))))

    def prior_odds(self, token: str) -> float:
        return 2 * MARKS * (token == "@hidden" or token in NAMES or token[0] == "." and token[1:] in CLASSES or token[0] == "@" and token[1:] in ROLES)

    def tag(self, tokens: tuple[str, ...]) -> float:
        if tokens not in self._costs:
            self._costs[tokens] = max(LEAST, *map(self.of, tokens))
        return self._costs[tokens]

    def marked(self, tokens: tuple[str, ...], below_article: bool) -> bool:
        """Plain containers and text elements are judged by their classes, ids and role alone; headers of articles are text."""
        key = tokens, below_article
        if key not in self._marks:
            telling = [t for t in tokens if t[0] in ".@" or t not in PLAIN and t not in BORDERS and not (t == "header" and below_article)]
            self._marks[key] = tokens[0] not in ("html", "body") and any(self.odds.get(t, 0.0) + self.prior_odds(t) > MARKS for t in telling)
        return self._marks[key]


def walk(page: str, weights: Weights):
    """(text, open or close, value, depth of articles around, depth of marked elements around, tokens of a tag), raw elements left out."""
    stack: list[tuple[tuple[str, ...], bool, bool]] = []  # tokens, article, marked
    opened: dict[str, int] = {}
    inside = out = 0

    def pop() -> tuple[str, ...]:
        nonlocal inside, out
        tokens, article, marked = stack.pop()
        opened[tokens[0]] -= 1
        inside, out = inside - article, out - marked
        return tokens

    for kind, value in items(page):
        if kind == "text":
            if not (stack and stack[-1][0][0] in RAW):
                yield "text", value, inside, out, None
        elif kind == "open":
            name = value[0]
            article = name in BORDERS
            if article and out and not inside:  # a marked element that was never closed
                while out:
                    pop()
            yield "open", name, inside, out, value
            if name in VOID:
                continue
            marked = weights.marked(value, inside > 0) and not (article and not inside)
            stack.append((value, article, marked))
            opened[name] = opened.get(name, 0) + 1
            inside, out = inside + article, out + marked
        elif opened.get(value):
            tokens = pop()
            while tokens[0] != value:
                tokens = pop()
            yield "close", value, inside, out, tokens


class LinkBlocks:
    """Follows a page and finds its blocks (what lies between two tags that aren't inline) whose words are all links."""

    def __init__(self):
        self.block, self.depth, self.words, self.links = "", 0, False, []

    def text(self) -> None:
        self.words |= not self.depth

    def tag(self, kind: str, name: str, at) -> tuple[str, list]:
        """The tag that began the block that ends here, and the links' tags (their ``at``), if it is one of links."""
        if name == "a":
            self.depth = max(0, self.depth + (1 if kind == "open" else -1))
            self.links.append(at)
        if name in INLINE:
            return "", []
        ended = self.block, [] if self.words else self.links
        self.block, self.words, self.links = name if kind == "open" else "/", False, []
        return ended


def scores(found: list[tuple], weights: Weights) -> list[float]:
    """The score of each item of ``walk``."""
    out, run, blocks = [], 0.0, LinkBlocks()

    def charge(block: str, links: list[int]) -> None:
        for at in links:
            out[at] -= 0.0 if found[at][2] else weights.of(f"{block}>a")

    for k, (kind, value, inside, marked, tokens) in enumerate(found):
        if kind == "text":
            n = len(value.split())
            out.append(0.0 if inside and marked else float(-n if marked else n))
            if n:
                run = 0.0
                blocks.text()
            continue
        cost = 0.0 if inside else weights.tag(tokens)
        out.append(run - max(run, cost))
        run = max(run, cost)
        charge(*blocks.tag(kind, value, k))
    charge(*blocks.tag("close", "", len(found)))
    return out


def region(found: list[tuple], weights: Weights) -> tuple[int, int]:
    """First and end of the items whose scores have the highest sum (the first of equal ones)."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for k, score in enumerate(scores(found, weights)):
        total += score
        if total > best:
            best, best_at = total, (start, k + 1)
        elif total <= 0:
            total, start = 0.0, k + 1
    return best_at


def main_text(page: str, weights: Weights) -> str:
    found = list(walk(page, weights))
    first, end = region(found, weights)
    blocks: list[list[str]] = [[]]
    for kind, value, _, out, tokens in found[first:end]:
        if kind == "text":
            if not out:
                blocks[-1].append(value)
        elif value == "br":
            blocks[-1].append(" ")
        elif value not in INLINE:
            blocks.append([])
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks if b)
    return "\n\n".join(x for x in lines if x)


def token_counts(page: str) -> list[tuple[str, int, int, int, int]] | None:
    """Of a labelled page (one with exactly one article) for each token: tags inside and outside the article, words below it inside and outside. A block of links is a tag."""
    sums: dict[str, list[int]] = {}
    stack: list[tuple[tuple[str, ...], int, int]] = []
    opened: dict[str, int] = {}
    articles = state = words_in = words_out = 0
    blocks = LinkBlocks()

    def close() -> str:
        tokens, a, b = stack.pop()
        for t in tokens:
            own = sums[t]
            own[2], own[3] = own[2] + words_in - a, own[3] + words_out - b
        return tokens[0]

    for kind, value in items(page):
        if kind == "text":
            if not (stack and stack[-1][0][0] in RAW):
                n = len(value.split())
                words_in, words_out = words_in + n * (state == 1), words_out + n * (state != 1)
                if n:
                    blocks.text()
            continue
        block, links = blocks.tag(kind, value if kind == "close" else value[0], None)
        if links:
            sums.setdefault(f"{block}>a", [0, 0, 0, 0])[0 if state == 1 else 1] += len(links)
        if kind == "close":
            if not opened.get(value):
                continue
            name = None
            while name != value:
                name = close()
                opened[name] -= 1
                if name == "article":
                    state = 2
            continue
        articles += value[0] == "article"
        if articles > 1:
            return None
        for t in value:
            sums.setdefault(t, [0, 0, 0, 0])[0 if state == 1 else 1] += 1
        if value[0] == "article":
            state = 1
        if value[0] not in VOID:
            stack.append((value, words_in, words_out))
            opened[value[0]] = opened.get(value[0], 0) + 1
    while stack:
        close()
    return [(t, *own) for t, own in sums.items()] if articles == 1 else None


def train(pages: DataFrame, sample: int = PAGES) -> Weights:
    """The driver gets four sums for each token of the bounded sample. Without labelled pages only the fixed prior holds."""
    n = pages.count()
    chance = F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) / float(1 << 20)
    names = ("tags_in", "tags_out", "words_in", "words_out")

    def count(batches):
        sums: dict[str, list[int]] = {}
        for batch in batches:
            for page in texts(batch, "html"):
                for token, *own in token_counts(page) or ():
                    sums[token] = [a + b for a, b in zip(sums.get(token, [0] * 4), own)]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), *(pa.array([x[k] for x in sums.values()], pa.int64()) for k in range(4))], ["token", *names])

    some = pages.where((chance < sample / max(n, 1)) & F.col("html").isNotNull()).select("html")
    counts = some.mapInArrow(count, "token string, " + ", ".join(f"{x} bigint" for x in names)).groupBy("token").agg(*(F.sum(x).alias(x) for x in names)).toPandas()
    return weights_of(counts)


def weights_of(counts: pd.DataFrame) -> Weights:
    """Weights from sums by token. A token that is never outside tells nothing: an article's label covers all it holds."""
    odds = lambda out, inside: math.log((out + 0.5) / (inside + 0.5))
    rows = list(counts.itertuples(index=False))
    cost = {r.token: odds(r.tags_out, r.tags_in) for r in rows}
    return Weights(cost, {r.token: odds(r.words_out, r.words_in) for r in rows if r.words_out})


def page_texts(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars of every page; other columns are ignored."""
    cost, odds = weights.cost, weights.odds

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = Weights(cost, odds)
        found = [main_text(p, own) for p in texts(batch, "html")]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(by_slice(run, "html"), f"page_id {kind}, url string, text string, n_chars bigint")

"""Main text of web pages: boosted trees over DOM nodes, decoded so that no ancestor contradicts a descendant."""

from __future__ import annotations

import html
import random
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.boosting import Trees, fit
from tidebars.llm.columns import text_or_empty
from tidebars.llm.dom import Page, read

FIT_PAGES = 180  # pages whose text trains the trees, each also dressed anew
DRESSES = 3
AROUND, MAIN, OTHER = 0, 1, 2  # holds main text and more; main text; not main text
ALLOWED = {AROUND: (AROUND, MAIN, OTHER), MAIN: (MAIN, OTHER), OTHER: (OTHER,)}

# fixed values: names of elements and the words of class, id and role that sites give them
TAGS = [("html", "body", "#root"), ("div", "section"), ("article", "main"), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"),
        ("li", "dt", "dd"), ("a",), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "dialog"),
        ("input", "button", "select", "option", "label", "legend"), ("table", "tbody", "thead", "tr", "td", "th"), ("head",), ("blockquote", "pre"),
        ("figure", "figcaption", "img")]
WORDS = [
    "content article post entry story main body text articlebody blog page news maincontent hentry prose".split(),
    "nav navbar navigation menu breadcrumb breadcrumbs toc topnav menubar pagination pager tabs".split(),
    "sidebar side widget widgets rail aside complementary secondary".split(),
    "footer foot copyright colophon bottom contentinfo legal".split(),
    "header head masthead banner topbar branding logo title".split(),
    "ad ads adv advert advertisement adsbygoogle promo promotion sponsor sponsored sponsors banner commercial outbrain taboola".split(),
    "cookie cookies consent notice notices notification alert gdpr popup modal overlay privacy warning message announcement".split(),
    "comment comments commentlist disqus reply replies respond discussion reviews responses thread".split(),
    "share sharing social related recommended more trending popular tags tagcloud newsletter subscribe signup login search form".split(),
]
_TAG_GROUP = {tag: i for i, group in enumerate(TAGS) for tag in group}
_WORD_GROUP = {word: [g for g, group in enumerate(WORDS) if word in group] for group in WORDS for word in group}
LANDMARKS = ("article", "main")
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog button select".split())
HASHED = 16
WIDTH = 2 * (len(TAGS) + len(WORDS)) + HASHED + 20


def features(page: Page) -> np.ndarray:
    """A row per element: tag, attribute tokens and those of its ancestors, density, depth and siblings."""
    elements, n = page.elements, len(page.elements)
    x = np.zeros((n, WIDTH), np.float32)
    own, inherited = len(TAGS) + len(WORDS), 2 * (len(TAGS) + len(WORDS))
    chars, words, stops, linked, runs = (np.zeros(n) for _ in range(5))
    first = np.full(n, -1.0)
    position = 0
    in_link = np.zeros(n, bool)
    for i, e in enumerate(elements):
        group = _TAG_GROUP.get(e.tag)
        if group is not None:
            x[i, group] = 1
        for word in e.words:
            for g in _WORD_GROUP.get(word, ()):
                x[i, len(TAGS) + g] = 1
            x[i, inherited + sum(map(ord, word)) % HASHED] = 1
        if i:
            x[i, own:inherited] = np.maximum(x[e.parent, own:inherited], x[e.parent, :own])
            in_link[i] = in_link[e.parent] or e.tag == "a"
    for e, _, text in page.runs:
        size = len(text.strip())
        if size:
            chars[e] += size
            words[e] += text.count(" ") + 1
            stops[e] += text.count(".") + text.count(",") + text.count("?") + text.count("!")
            linked[e] += size * in_link[e]
            runs[e] += 1
            if first[e] < 0:
                first[e] = position
            position += size
    inside = np.ones(n)
    paragraphs = np.array([e.tag == "p" for e in elements], float)
    for i in range(n - 1, 0, -1):
        p = elements[i].parent
        for value in (chars, words, stops, linked, runs, inside, paragraphs):
            value[p] += value[i]
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    total = max(1.0, chars[0])
    at = inherited + HASHED
    x[:, at] = np.log1p(chars)
    x[:, at + 1] = chars / inside  # subtree density
    x[:, at + 2] = linked / np.maximum(chars, 1)
    x[:, at + 3] = chars / total
    x[:, at + 4] = stops / np.maximum(words, 1)
    x[:, at + 5] = words / np.maximum(runs, 1)
    x[:, at + 6] = paragraphs
    x[:, at + 7] = np.log1p(inside)
    x[:, at + 8] = [e.depth for e in elements]
    x[:, at + 9] = np.maximum(first, 0) / total
    x[:, at + 10] = np.log1p(runs)
    for i, e in enumerate(elements):
        if e.parent < 0:
            continue
        siblings = elements[e.parent].children
        x[i, at + 11] = len(siblings)
        x[i, at + 15] = chars[i] / max(1.0, chars[e.parent])
        x[i, at + 16] = x[e.parent, at + 2]
        x[i, at + 17] = x[e.parent, at + 1]
        x[i, at + 18] = x[e.parent, at + 5]
        x[i, at + 19] = x[e.parent, at + 3]
    for e in elements:
        tags = [elements[c].tag for c in e.children]
        same = Counter(tags)
        for k, c in enumerate(e.children):
            x[c, at + 12] = k / len(tags)
            x[c, at + 13] = same[tags[k]] / len(tags)
            x[c, at + 14] = chars[e.children[k - 1]] if k else 0
    return x


def decode(page: Page, chance: np.ndarray) -> np.ndarray:
    """The most probable labels of the tree in which main text holds no surroundings and nothing else holds any.

    ``chance``: log probabilities per element and label.
    """
    elements = page.elements
    best = chance.copy()
    choice = np.zeros((len(elements), 3), np.int8)
    for i in range(len(elements) - 1, 0, -1):
        p = elements[i].parent
        for state, allowed in ALLOWED.items():
            pick = max(allowed, key=lambda s: best[i, s])
            choice[i, state] = pick
            best[p, state] += best[i, pick]
    labels = np.zeros(len(elements), np.int8)
    for i in range(1, len(elements)):
        labels[i] = choice[i, labels[elements[i].parent]]
    return labels


def text_of(page: Page, labels: np.ndarray) -> str:
    """Runs of main elements, a line per block, white space as single blanks."""
    lines: dict[int, list[str]] = {}
    for element, block, text in page.runs:
        if labels[element] == MAIN:
            lines.setdefault(block, []).append(text)
    return "\n".join(line for line in (" ".join("".join(parts).split()) for parts in lines.values()) if line)


def _landmark_labels(page: Page) -> np.ndarray | None:
    """Labels of a page that marks its article itself, as far as tags go; None for other pages."""
    elements = page.elements
    marks = [i for i, e in enumerate(elements) if e.tag in LANDMARKS]
    if not marks:
        return None
    labels = np.full(len(elements), OTHER, np.int8)
    for i in marks:
        up = elements[i].parent
        while up >= 0:
            labels[up] = AROUND
            up = elements[up].parent
    for i, e in enumerate(elements):
        if e.tag in LANDMARKS:
            labels[i] = MAIN
        elif i and labels[e.parent] == MAIN and e.tag not in BOILERPLATE_TAGS:
            labels[i] = MAIN
    return labels


class Dresser:
    """Pages in many layouts around given texts, each element marked with its label."""

    def __init__(self, content: list[str], other: list[str], seed: int):
        self.draw = random.Random(seed)
        self.content = content or ["A page without any text of its own."]
        self.other = [t for t in other if t] or ["Home", "About us", "All rights reserved."]

    def page(self) -> str:
        draw = self.draw
        parts = [self._bar("nav"), self._bar("header"), self._ad(), self._aside(), self._notice(), self._form()]
        before = [p for p in parts if draw.random() < 0.5]
        after = [p for p in (self._aside(), self._bar("footer"), self._comments(), self._ad(), self._related(), self._notice(), self._form())
                 if draw.random() < 0.5]
        draw.shuffle(before)
        main = self._main()
        for _ in range(draw.choice([0, 0, 1, 2])):
            main = self._tag("div", draw.choice(["container", "wrapper", "row", "page", "site", "layout", "content", "main", ""]),
                             self._some([main], [self._aside(), self._ad(), self._comments()]), "A")
        return self._tag("html", "", "<head><title>" + self._words(6) + "</title></head>" + self._tag("body", "", "".join(before) + main + "".join(after), "A"), "A")

    def _some(self, always: list[str], maybe: list[str]) -> str:
        picked = always + [m for m in maybe if self.draw.random() < 0.3]
        self.draw.shuffle(picked)
        return "".join(picked)

    def _tag(self, tag: str, name: str, inner: str, mark: str) -> str:
        key = self.draw.choice(["class", "class", "id"])
        if name and self.draw.random() < 0.3:
            name = self.draw.choice(["site-{}", "{}-wrap", "{} clearfix", "js-{}", "{}_box", "the-{}", "{}-1"]).format(name)
        named = f' {key}="{name}"' if name else ""
        return f'<{tag}{named} data-mark="{mark}">{inner}</{tag}>'

    def _words(self, most: int) -> str:
        words = self.draw.choice(self.other).split()
        at = self.draw.randrange(max(1, len(words)))
        return html.escape(" ".join(words[at:at + self.draw.randint(1, most)]) or "Home")

    def _sentence(self) -> str:
        return html.escape(self.draw.choice(self.other + self.content)[:self.draw.randint(20, 300)])

    def _links(self, mark: str = "O") -> str:
        items = "".join(f'<li data-mark="{mark}"><a href="#" data-mark="{mark}">{self._words(4)}</a></li>' for _ in range(self.draw.randint(2, 9)))
        return f'<ul data-mark="{mark}">{items}</ul>' if self.draw.random() < 0.7 else items.replace("<li", "<span").replace("</li", "</span")

    def _bar(self, kind: str) -> str:
        names = {"nav": WORDS[1], "header": WORDS[4], "footer": WORDS[3]}[kind]
        tag, name = (kind, "") if self.draw.random() < 0.5 else ("div", self.draw.choice(names))
        title = self._tag(self.draw.choice(["div", "h1", "p", "span"]), self.draw.choice(["logo", "title", "tagline", ""]), self._words(5), "O")
        return self._tag(tag, name, {"nav": self._links(), "header": title + self._links() * self.draw.randint(0, 1),
                                     "footer": self._tag("p", "", "&copy; " + self._sentence(), "O") * self.draw.randint(0, 1) + self._sentence()}[kind], "O")

    def _ad(self) -> str:
        inner = self._sentence() if self.draw.random() < 0.6 else self._tag("p", "", self._sentence(), "O")
        return self._tag(self.draw.choice(["div", "div", "aside", "section", "ins"]), self.draw.choice(WORDS[5]), inner, "O")

    def _notice(self) -> str:
        inner = self._tag("p", "", self._sentence(), "O") + self._tag("button", "", self._words(2), "O") * self.draw.randint(0, 1)
        return self._tag(self.draw.choice(["div", "section", "dialog", "aside"]), self.draw.choice(WORDS[6]), inner, "O")

    def _aside(self) -> str:
        inner = self._tag("h3", "", self._words(3), "O") + self.draw.choice([self._links(), self._tag("p", "", self._sentence(), "O")])
        tag, name = ("aside", self.draw.choice(["", "sidebar"])) if self.draw.random() < 0.5 else ("div", self.draw.choice(WORDS[2]))
        return self._tag(tag, name, inner, "O")

    def _form(self) -> str:
        inner = self._tag("label", "", self._words(3), "O") + '<input name="q">' + self._tag("button", "", self._words(2), "O")
        form = self._tag("form", self.draw.choice(["", "search", "newsletter", "signup"]), inner, "O")
        return form if self.draw.random() < 0.6 else self._tag("div", self.draw.choice(["newsletter", "subscribe", "login"]),
                                                              self._tag("p", "", self._sentence(), "O") + form, "O")

    def _related(self) -> str:
        return self._tag(self.draw.choice(["div", "section", "aside"]), self.draw.choice(WORDS[8]), self._tag("h3", "", self._words(3), "O") + self._links(), "O")

    def _comments(self) -> str:
        one = lambda: self._tag(self.draw.choice(["div", "li", "article"]), self.draw.choice(["comment", "reply", "comment-body"]),
                                self._tag("span", "author", self._words(2), "O") + self._tag("p", "", self._sentence(), "O"), "O")
        inner = self._tag("h3", "", self._words(2), "O") * self.draw.randint(0, 1) + "".join(one() for _ in range(self.draw.randint(1, 6)))
        return self._tag(self.draw.choice(["div", "section", "ol", "ul"]), self.draw.choice(WORDS[7]), inner, "O")

    def _main(self) -> str:
        draw = self.draw
        tag, name = draw.choice([("article", ""), ("article", "post"), ("main", ""), ("div", draw.choice(WORDS[0])), ("div", draw.choice(WORDS[0])),
                                 ("section", draw.choice(WORDS[0])), ("div", ""), ("td", "")])
        texts = self.content if draw.random() < 0.5 else draw.sample(self.content, draw.randint(1, len(self.content)))
        if draw.random() < 0.25:  # short texts
            texts = [" ".join(t.split()[:draw.randint(1, 6)]) for t in texts[:draw.randint(1, 4)]]
        blocks = []
        head = draw.random() < 0.7
        for i, text in enumerate(texts):
            inner = html.escape(text)
            if i == 0 and head:
                title = self._tag(draw.choice(["h1", "h1", "h2"]), draw.choice(["", "title", "entry-title"]), inner[:120], "M")
                blocks.append(self._tag("header", draw.choice(["", "entry-header"]), title, "M") if draw.random() < 0.2 else title)
                continue
            if draw.random() < 0.2:
                words = inner.split(" ")
                k = draw.randrange(len(words))
                words[k] = self._tag(draw.choice(["a", "b", "i", "em", "strong", "span"]), "", words[k], "M")
                inner = " ".join(words)
            kind = draw.random()
            if kind < 0.8:
                blocks.append(f'<p data-mark="M">{inner}' + "</p>" * (draw.random() < 0.9))
            elif kind < 0.9:
                blocks.append(f'<ul data-mark="M"><li data-mark="M">{inner}</li></ul>')
            else:
                blocks.append(self._tag(draw.choice(["div", "blockquote", "h2", "pre"]), "", inner, "M"))
            if draw.random() < 0.06:
                blocks.append(draw.choice([self._ad, self._aside, self._related, self._form])())
        if draw.random() < 0.25:
            blocks.append(draw.choice([self._comments, self._related, lambda: self._bar("footer"), self._notice])())
        body = self._tag(tag, name, "".join(blocks), "M")
        return f'<table data-mark="A"><tr data-mark="A">{body}</tr></table>' if tag == "td" else body


def _marked(page: Page) -> np.ndarray:
    labels = np.zeros(len(page.elements), np.int8)
    for i, e in enumerate(page.elements):
        if i:
            labels[i] = {"A": AROUND, "M": MAIN, "O": OTHER}.get(e.mark, labels[e.parent] if labels[e.parent] != AROUND else OTHER)
    return labels


def fit_trees(sources: list[str], dresses: int = DRESSES, seed: int = 11) -> Trees:
    """Trees fitted on pages that mark their article themselves, and on the same texts in other layouts."""
    rows, labels = [], []
    for number, source in enumerate(sources or [""]):
        page = read(source)
        told = _landmark_labels(page)
        if told is not None:
            rows.append(features(page))
            labels.append(told)
            content = text_of(page, told).split("\n")
            other = [" ".join(t.split()) for e, _, t in page.runs if told[e] == OTHER]
        else:
            content = [" ".join(t.split()) for e, _, t in page.runs if len(t) > 80 and page.elements[e].tag != "a"]
            other = [" ".join(t.split()) for _, _, t in page.runs if len(t) <= 80]
        dresser = Dresser([t for t in content if t], other, seed * 1_000_003 + number)
        for _ in range(dresses):
            page = read(dresser.page())
            rows.append(features(page))
            labels.append(_marked(page))
    return fit(np.concatenate(rows), np.concatenate(labels), 3)


def train(pages: DataFrame, html_column: str = "html", key: str = "page_id", fit_pages: int = FIT_PAGES) -> Trees:
    """Trees from at most ``fit_pages`` pages, chosen by a hash of key and source."""
    chosen = (pages.select(text_or_empty(html_column).alias("html"), F.xxhash64(key, html_column).alias("h"))
              .filter((F.length("html") > 0) & (F.length("html") <= 200_000)))
    count = chosen.count()
    share = int(min(1.0, 3 * fit_pages / max(1, count)) * 1_000_000) + 1
    few = chosen.filter(F.pmod("h", F.lit(1_000_000)) < share).orderBy("h", "html").limit(fit_pages)
    return fit_trees([row["html"] for row in few.select("html").collect()])


def extract_text(sources: list[str], trees: Trees) -> list[str]:
    """Main texts of some pages, scored together."""
    pages = [read(source) for source in sources]
    if not pages:
        return []
    score = trees.scores(np.concatenate([features(page) for page in pages]))
    score -= np.log(np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + score.max(axis=1, keepdims=True)
    out, at = [], 0
    for page in pages:
        out.append(text_of(page, decode(page, score[at:at + len(page.elements)])))
        at += len(page.elements)
    return out


def extract(pages: DataFrame, trees: Trees, html_column: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """key, url, text, n_chars, one row per input row.

    Null and empty sources have an empty text, as have pages without main text. Whole pages are read, however
    long or broken; repeated rows give equal texts; a null key or url passes through. An empty table gives an
    empty result. Other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("string")
    def main_text(sources: pd.Series) -> pd.Series:
        out, held, size = [], [], 0
        for source in sources:  # about a megabyte of source at a time
            held.append(source)
            size += len(source)
            if size > 1_000_000:
                out += extract_text(held, shared.value)
                held, size = [], 0
        return pd.Series(out + extract_text(held, shared.value), dtype=object)

    return (pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), main_text(text_or_empty(html_column)).alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))

"""A small HTML reader: elements with their place in the tree, and runs of text."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg object textarea title".split())
TEXT = frozenset("script style textarea title".split())  # without an end tag these reach to the end of the page
NESTED = frozenset("svg template object".split())
BLOCK = frozenset(("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th "
                   "thead tr ul").split())
CLOSES_P = BLOCK - frozenset("body head html li dd dt option tbody td tfoot th thead tr caption button legend".split())
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "option": "option", "tr": "tr td th", "td": "td th", "th": "td th",
            "tbody": "thead tbody tr td th", "tfoot": "tbody thead tr td th"}
SCOPES = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "option": "select", "tr": "table", "td": "table", "th": "table", "tbody": "table", "tfoot": "table"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>",
                  re.S)
_TOKENS = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_MARK = re.compile(r'data-mark="(\w)"')
_WORD = re.compile(r"[a-z]+")


@dataclass
class Element:
    tag: str
    parent: int
    depth: int
    words: list[str] = field(default_factory=list)  # of class, id and role
    mark: str = ""  # label of a training page
    children: list[int] = field(default_factory=list)


def _ends(source: str, tag: str) -> dict[int, int]:
    """Where the elements of a raw tag end, by their start; those without an end tag are missing."""
    ends, waiting = {}, []
    for found in re.finditer(rf"""<(/?){tag}(?=[\s/>])((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)""", source, re.I):
        if not found[1]:
            if tag != "svg" or not found[2].endswith("/>"):
                waiting.append(found.start())
        elif tag in NESTED:
            if waiting:
                ends[waiting.pop()] = found.end()
        else:
            ends |= dict.fromkeys(waiting, found.end())
            waiting = []
    return ends


@dataclass
class Page:
    elements: list[Element]
    runs: list[tuple[int, int, str]]  # element, block number, decoded text


def read(source: str) -> Page:
    """Elements in page order (0 is the root) and text runs; raw elements and comments have no text."""
    elements, runs, stack, block, at = [Element("#root", -1, 0)], [], [0], 0, 0
    opened, ends = Counter(), {}  # open elements by tag; ends of raw elements by tag

    def close(down_to: int) -> None:
        nonlocal block
        while len(stack) > down_to:
            tag = elements[stack.pop()].tag
            opened[tag] -= 1
            block += tag in BLOCK

    def close_tags(tags: frozenset | set, stop: frozenset | set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            tag = elements[stack[i]].tag
            if tag in tags:
                return close(i)
            if tag in stop:
                return None
        return None

    for found in _TAG.finditer(source):
        if found.start() < at:
            continue
        if found.start() > at:
            runs.append((stack[-1], block, source[at:found.start()]))
        at = found.end()
        tag = found[2] or found[5]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1] or found[4]:
            if opened[tag]:
                close_tags({tag}, {"table"} if tag not in ("table", "body", "html", "article", "main", "div", "section") else set())
            continue
        attributes = found[3] if found[2] else found[6]
        if tag in CLOSES_P:
            close_tags({"p"}, {"table", "button", "td", "th", "object"})
        if tag in SIBLINGS:
            inner = set(SIBLINGS[tag].split())
            while any(elements[i].tag in inner for i in stack[1:]):
                before = len(stack)
                close_tags(inner, set(SCOPES[tag].split()))
                if len(stack) == before:
                    break
        block += tag in BLOCK
        if tag in RAW - TEXT:
            if tag != "svg" or not attributes.endswith("/"):
                if tag not in ends:
                    ends[tag] = _ends(source, tag)
                at = ends[tag].get(found.start(), at)
            continue
        if tag in TEXT:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        words = []
        if attributes and "=" in attributes:
            for value in _TOKENS.findall(attributes):
                words += _WORD.findall(value.lower())
        mark = _MARK.search(attributes) if attributes and "data-mark" in attributes else None
        number = len(elements)
        parent = stack[-1]
        elements.append(Element(tag, parent, elements[parent].depth + 1, words, mark[1] if mark else ""))
        elements[parent].children.append(number)
        if tag in VOID or attributes.endswith("/"):
            block += tag in BLOCK
            if tag == "br":
                runs.append((parent, block, " "))
        else:
            stack.append(number)
            opened[tag] += 1
    if at < len(source):
        runs.append((stack[-1], block, source[at:]))
    return Page(elements, [(e, b, html.unescape(t) if "&" in t else t) for e, b, t in runs])

"""WARC archives and main-text extraction."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pytest

from tidebars.llm import boosting, dom, html_text, warc
from tidebars.llm.columns import new_folder

SMALL = "/root/testdata/sf0.001"
LOREM = ["A title of the page", "The first paragraph, which tells more than a few words about the matter, and ends.",
         "A second one follows it, quite as long as the first, with commas, clauses and a full stop."]


# archives

def archive(compress: bool, damage=None) -> tuple[bytes, list[bytes]]:
    records = [warc.record(str(i), f"http://x/{i}", f"<p>{i} WARC/1.1 inside</p>".encode() * (i + 1)) for i in range(6)]
    parts = [warc.member(r) for r in records] if compress else records
    return b"".join(parts), parts


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_recovers_what_lies_behind_damage(compress):
    data, parts = archive(compress)
    starts = np.cumsum([0, *map(len, parts)])
    assert [f.head["warc-record-id"] for _, _, f in warc.salvage(data)] == [f"<urn:page:{i}>" for i in range(6)]
    hurt = bytearray(data)
    middle = int(starts[3]) - 14
    hurt[middle:middle + 4] = b"\xff\x00\xff\x00"
    found = list(warc.salvage(bytes(hurt)))
    gaps = [(a, b) for a, b, f in found if f.reason]
    assert gaps == [(starts[2], starts[3])] and all(f.reason for a, b, f in found if (a, b) in gaps)
    assert [f.head["warc-record-id"] for _, _, f in found if not f.reason] == [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 5)]
    covered = sorted((a, b) for a, b, _ in found)
    assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(covered, covered[1:], strict=False))


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_of_cut_and_foreign_bytes(compress):
    data, parts = archive(compress)
    found = list(warc.salvage(b"junk" + data[:-7]))
    assert [bool(f.reason) for _, _, f in found] == [True, *[False] * 5, True]
    assert found[0][:2] == (0, 4) and found[-1][1] == len(data) - 3
    assert list(warc.salvage(b"")) == []
    assert [f.reason != "" for _, _, f in warc.salvage(b"\x00" * 100)] == [True]


def base32(text: str) -> str:
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b\r\nX: y", "<p>x</p>"), (3, None, None), (4, "d", ""), (None, "e", "<p>x</p>"), (None, "f", "alone"),
            (5, "g", "é" * 300_000), (6, "h", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"), (1, "http://a", "<p>x</p>"),
            (7, "i", "\r\n\r\n\x1f\x8b\x08")]
    return spark.createDataFrame([(*r, "k", "s", "z") for r in rows], "page_id long, url string, html string, k string, sha string, first string")


@pytest.mark.parametrize("compress", [True, False])
def test_archives_round_trip(spark, odd_pages, compress):
    path = new_folder(spark, "warc")
    warc.write_archives(odd_pages, path, compress=compress, pages_per_file=3)
    back = warc.read_archives(spark, path).toPandas()
    assert "gap" not in set(back.kind) and len(back) == odd_pages.count()
    source = odd_pages.toPandas()
    html = source.html.where(source.html.notna(), "")
    assert sorted(back.payload_digest) == sorted(map(base32, html))
    assert sorted(back.payload_bytes) == sorted(len(h.encode()) for h in html)
    full = {r.record_id: bytes(r.payload) for r in back.itertuples() if r.kind == "response"}
    assert full["<urn:page:5>"] == ("é" * 300_000).encode() and full["<urn:page:3>"] == b""
    refers = {(r.record_id, r.refers_to) for r in back.itertuples() if r.kind == "revisit"}
    assert refers == {("<urn:page:2>", "<urn:page:1>"), ("<urn:page:null>", "<urn:page:1>"), ("<urn:page:4>", "<urn:page:3>")}


def test_archive_query(spark, odd_pages):
    got = warc.round_trip(odd_pages).toPandas()
    assert len(got) == odd_pages.count() and got.page_id.isna().sum() == 2
    assert warc.round_trip(odd_pages.limit(0)).count() == 0
    assert got[got.page_id == 4].refers_to.tolist() == [3.0]


def test_damaged_archive_in_spark(spark, tmp_path):
    data, _ = archive(True)
    (tmp_path / "a.warc.gz").write_bytes(data[:50] + b"\x00" * 9 + data[59:])
    (tmp_path / "empty.warc").write_bytes(b"")
    back = warc.read_archives(spark, str(tmp_path)).toPandas().sort_values("offset")
    assert back.kind.tolist() == ["gap", *["response"] * 5] and back.reason.iloc[0] and back.length.sum() == len(data)


@pytest.mark.parametrize("compress", [True, False])
def test_long_headers_are_read(spark, compress):
    """A url of 100,000 characters, also as the page that another refers to; a header without end loses its record only."""
    url = "data:text/html," + "x" * 100_000
    pages = spark.createDataFrame([(1, url, "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, url, "alone")], "page_id long, url string, html string")
    path = new_folder(spark, "warc")
    warc.write_archives(pages, path, compress=compress)
    rows = warc.read_archives(spark, path, payloads=False).collect()
    assert [r.reason for r in rows if r.kind == "gap"] == [] and sorted(r.uri for r in rows) == sorted([url, "http://b", url])
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None)}
    cut = warc.record("7", url, b"y").split(b"\r\n\r\n")[0] + b"\r\n" + warc.record("8", url, b"z")
    assert [f.head["warc-record-id"] for _, _, f in warc.salvage(cut) if not f.reason] == ["<urn:page:8>"]


# main text

def test_share_of_siblings_on_wide_pages():
    for n in (30, 300):
        page = dom.read("<body>" + "<p>words</p>" * n + "<div>advert</div></body>")
        share = {e.tag: x for e, x in zip(page.elements, html_text.features(page)[:, html_text.WIDTH - html_text.HASHED - 20 + html_text.HASHED + 13], strict=True)}
        assert abs(share["div"] - 1 / (n + 1)) < 1e-6 and abs(share["p"] - n / (n + 1)) < 1e-6


@pytest.mark.parametrize("source, texts", [
    ('<p>a<svg class="icon"/>b</p>c', "abc"),
    ('<p>a<svg><svg d="x>y"/><svg>n</svg>m</svg>b</p>', "ab"),
    ("<p>a<object data=x>b</p><p>c</p>", "abc"),
    ("<object>a<object>b</object>c", "ac"),
    ("a<template>b<template>c</template>d</template>e", "ae"),
    ("a<noscript>b</noscript>c<iframe>d", "acd"),
    ("a<svg-icon>b</svg-icon>c<svg>d</svg-icon>e</svg>f", "abcf"),
    ("a<script>b", "a"),
])
def test_raw_elements_end_where_they_end(source, texts):
    assert "".join(t for _, _, t in dom.read(source).runs) == texts


def test_end_tags_of_deep_inline_elements():
    page = dom.read("<p><my-card>" + "<b>" * 12 + "in</my-card>out</p>")
    assert [(page.elements[e].tag, t) for e, _, t in page.runs] == [("b", "in"), ("p", "out")]


def test_reader_closes_what_pages_leave_open():
    page = dom.read("<p>one<p>two <b>bold<br>more</p><ul><li>a<li>b</ul><script>x='</p>'</script><!-- c -->tail &amp; <td>cell<tr>")
    tags = [(e.tag, page.elements[e.parent].tag) for e in page.elements[1:]]
    assert tags[:5] == [("p", "#root"), ("p", "#root"), ("b", "p"), ("br", "b"), ("ul", "#root")]
    assert [t for _, _, t in page.runs if t.strip()] == ["one", "two ", "bold", "more", "a", "b", "tail & ", "cell"]
    assert dom.read("").runs == [] and dom.read("<").runs and dom.read("<p class='a").elements


def test_decoding_never_contradicts(spark):
    draw = np.random.default_rng(0)
    page = dom.read("<div><div><p>a</p><div><p>b</p></div></div><p>c</p></div>" * 5)
    for _ in range(200):
        labels = html_text.decode(page, np.log(draw.dirichlet([1, 1, 1], len(page.elements))))
        for i, e in enumerate(page.elements[1:], 1):
            assert labels[i] in html_text.ALLOWED[int(labels[e.parent])]


def test_decoding_is_the_best_tree():
    from itertools import product
    page = dom.read("<div><p>a</p><ul><li>b</li></ul></div>")
    n = len(page.elements)
    draw = np.random.default_rng(1)
    for _ in range(20):
        chance = np.log(draw.dirichlet([1, 1, 1], n))
        valid = [s for s in product(range(3), repeat=n - 1) if all((0, *s)[i] in html_text.ALLOWED[(0, *s)[page.elements[i].parent]] for i in range(1, n))]
        best = max(sum(chance[i + 1, s] for i, s in enumerate(v)) for v in valid)
        got = html_text.decode(page, chance)
        assert abs(sum(chance[i, got[i]] for i in range(1, n)) - best) < 1e-9


def test_boosting_learns_an_interaction():
    draw = np.random.default_rng(0)
    x = draw.random((3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int) + (x[:, 2] > 0.9)
    trees = boosting.fit(x[:2000], y[:2000], 3)
    assert (trees.scores(x[2000:]).argmax(axis=1) == y[2000:]).mean() > 0.9


@pytest.fixture(scope="module")
def trees(spark):
    return html_text.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), fit_pages=80)


def test_article_pages(spark, trees):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = html_text.extract(pages, trees).toPandas().set_index("page_id")
    right = 0
    for row in pages.toPandas().itertuples():
        page = dom.read(row.html)
        right += got.text[row.page_id] == html_text.text_of(page, html_text._landmark_labels(page))
        assert got.n_chars[row.page_id] == len(got.text[row.page_id])
    assert right >= len(got) - 2


def test_other_layouts(spark, trees):
    """Held-out texts in layouts that no page of the table has."""
    right = total = 0
    for seed in range(60):
        dresser = html_text.Dresser(LOREM, ["Home page", "About", "Read more now", "Terms of use apply to everything here."], 777 + seed)
        marked = dresser.page()
        want = html_text.text_of(page := dom.read(marked), html_text._marked(page)).split("\n")
        got = html_text.extract_text([re.sub(r' data-mark="\w"', "", marked)], trees)[0].split("\n")
        right += len(set(want) & set(got))
        total += len(set(want) | set(got))
    assert right / total > 0.8


def test_extraction_edges(spark, odd_pages, trees):
    got = html_text.extract(odd_pages, trees)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == odd_pages.count()
    assert {r.text for r in got.filter("page_id in (3, 4)").collect()} == {""}
    assert html_text.extract(odd_pages.limit(0), trees).count() == 0
    assert isinstance(html_text.train(odd_pages.limit(0)), boosting.Trees)
    long = "<article>" + "<p>Some words, again and again.</p>" * 20_000 + "</article>"
    deep = "<div>" * 3000 + "<p>deep text</p>"
    out = html_text.extract_text([long, deep, ""], trees)
    assert out[0].count("\n") == 19_999 and out[2] == ""



"""Conversation trie, token files and collocations against plain loops, and their edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_tables import no_docs, odd_docs  # noqa: F401

from tidebars.llm import collocations, prefix_trie, simple8b, token_files
from tidebars.llm.columns import new_folder

SMALL = "/root/testdata/sf0.001"


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# conversation trie

def trie_loop(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, role, len(text), tie, text))
    own = {c: [(t[2], t[5]) for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        turns = own.get(c - c % 100, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        saved[path] = sum(saved[c] for c in children[path]) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def turns_of(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


@pytest.fixture(scope="module")
def odd_turns(spark):
    """Nulls everywhere, ties in turn, repeated rows, a group of equal conversations, one of many turns, clashing names."""
    rows = [(100, 0, "user", "hi"), (100, 1, "bot", "yo"), (100, 2, "user", None), (100, None, None, "first"), (101, 0, "user", "hi"),
            (101, 0, "user", "hi"), (101, 0, "bot", "hi"), (102, None, None, None), (199, 5, "user", ""), (None, 0, "user", "lost"),
            (7, 0, "a", "bc"), (8, 0, "ab", "c"), (250, 1, "user", "no base")]
    rows += [(1000 + i, t, "user", f"same {t}") for i in range(60) for t in range(3)]
    rows += [(2000, t, "user", f"step {t % 7}") for t in range(900)] + [(2001, t, "user", f"step {t % 7}") for t in range(700)]
    odd = [(*r, 1, "x", 2, "y", None, b"z") for r in rows]
    return spark.createDataFrame(odd, "conv_id long, turn long, role string, text string, depth int, path string, node int, keys string, shard string, ends binary")


@pytest.mark.parametrize("shards", [1, 5, 70])
def test_trie(spark, odd_turns, shards):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shards))
    try:
        for df in (odd_turns, spark.read.parquet(f"{SMALL}/conversations.parquet")):
            got = prefix_trie.conversation_trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
            assert Counter(map(tuple, got.collect())) == trie_loop(turns_of(df))
        assert prefix_trie.conversation_trie(odd_turns.limit(0)).count() == 0
        assert prefix_trie.conversation_trie(odd_turns.filter("conv_id is null")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_with_few_splitters(odd_turns, monkeypatch):
    """Bounds on splitters and rows of ends change who does the work, not the result."""
    monkeypatch.setattr(prefix_trie, "ENDS", 7)
    convs = prefix_trie.rebuilt(prefix_trie.paths(odd_turns))
    for limit in (1, 300, 8_000_000):
        got = prefix_trie.trie(convs, shard_turns=20, splitter_bytes=limit)
        assert Counter(map(tuple, got.collect())) == trie_loop(turns_of(odd_turns))


def test_skeleton_holds_every_shared_node():
    """Each prefix with members on both sides of a splitter is a prefix of that splitter."""
    key = lambda *turns: b"".join(bytes([t]) * prefix_trie.KEY for t in turns)
    rows = sorted((key(a, b, c), i) for i, (a, b, c) in enumerate((a, b, c) for a in range(3) for b in range(3) for c in range(3)))
    skeleton = prefix_trie.Skeleton([rows[5], rows[13]])
    assert skeleton.parents[0] == -1 and len(skeleton.near(1)) == 2 and len(skeleton.near(0)) == 1
    for path, line in skeleton.near(1):
        assert [skeleton.depths[i] for i in line] == list(range(len(path) // prefix_trie.KEY + 1))


# Simple-8b and token files

@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2 ** 64 - 1), st.just(0)), max_size=700), st.data())
def test_simple8b(values, data):
    want = np.array(values, np.uint64)
    coded = simple8b.encode(want)
    assert (simple8b.decode(*coded, 0, len(want)) == want).all()
    begin = data.draw(st.integers(0, len(want)))
    end = data.draw(st.integers(begin, len(want)))
    assert (simple8b.decode(*coded, begin, end) == want[begin:end]).all()


def test_simple8b_is_dense_and_escapes():
    assert len(simple8b.pack(np.zeros(480, np.uint64))) == 2
    assert len(simple8b.pack(np.full(60, 1, np.uint64))) == 1
    rare = np.full(6400, 5, np.uint64)
    rare[::100] = 50_000
    words, offsets, places, escapes = simple8b.encode(rare)
    assert len(places) == 64 and (escapes == 50_000).all() and len(words) == 320 and len(offsets) == 2


def ids_loop(pairs, end=2):
    coder, at, out = token_files.tokenizer(token_files.default_vocabulary()), 0, Counter()
    for key, text in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1])):
        ids = [*coder.encode(text, add_special_tokens=False).ids, end]
        out[key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        at += len(ids)
    return out


def test_token_files(spark, odd_docs, no_docs):
    for df in (spark.read.parquet(f"{SMALL}/documents.parquet"), odd_docs):
        assert Counter(map(tuple, token_files.round_trip(df).collect())) == ids_loop(texts(df))
    assert token_files.round_trip(no_docs).count() == 0


def test_token_files_cut_documents(spark, odd_docs):
    """Documents over many blocks and files: same sums, and ids in order give the whole sequence."""
    path = new_folder(spark, "ids")
    token_files.write_ids(odd_docs, path, block=1000, blocks_per_file=3)
    assert Counter(map(tuple, token_files.summaries(spark, path).collect())) == ids_loop(texts(odd_docs))
    rows = token_files.read_ids(spark, path).orderBy("shard", "start").collect()
    whole = [i for r in rows for i in r["ids"]]
    coder = token_files.tokenizer(token_files.default_vocabulary())
    want = [i for _, t in sorted(texts(odd_docs), key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
            for i in [*coder.encode(t, add_special_tokens=False).ids, token_files.END_ID]]
    assert whole == want and any(not r["whole"] for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t.,!ab1é漢's\0 😀\r"), max_size=60), min_size=1, max_size=6))
def test_part_coder_equals_library(some):
    coder = token_files.part_coder(token_files.default_vocabulary())
    library = token_files.tokenizer(token_files.default_vocabulary())
    assert [x.tolist() for x in coder.encode(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_part_coder_forgets(monkeypatch):
    monkeypatch.setattr(token_files, "_KEPT_PARTS", 50)
    coder = token_files.PartCoder(token_files.default_vocabulary())
    library = token_files.tokenizer(token_files.default_vocabulary())
    for i in range(30):
        some = [f"word{i} and word{i + 1}. Then, x{j} " for j in range(5)]
        assert [x.tolist() for x in coder.encode(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]
    assert len(coder.parts) == coder.table.shape[1] <= 50


def test_part_coder_cuts_before_stops():
    """Words with different stops after them are one part, beyond ASCII too; what is no letter for certain is not parted."""
    coder = token_files.PartCoder(token_files.default_vocabulary())
    coder.encode(["été! été? été; (été) été"])
    assert set(coder.parts) == {"été", " été", "!", "?", ";", " (été", ")"}
    library = token_files.tokenizer(token_files.default_vocabulary())
    signs = [chr(i) for i in (*range(1, 0x300), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0x4E00, 0x6680, 0xFEFF, 0x1F680)]
    some = [f"a{x} b{x}.{x}\n{x}!a {x}'s {x},{x} {x}\nx{x}" for x in signs]
    assert [x.tolist() for x in coder.encode(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_part_coder_keeps_frequent_parts(monkeypatch):
    """Frequent words stay remembered, also those that come when the coder is full of rare ones."""
    monkeypatch.setattr(token_files, "_KEPT_PARTS", 50)
    coder = token_files.PartCoder(token_files.default_vocabulary())
    coder.encode([" ".join(f"early{i}" for i in range(45))])
    for i in range(20):
        coder.encode([f"the frequent words and rare{i} more{i} of{i} them{i}"])
    assert {"the", " frequent", " words", " and"} <= set(coder.parts) and len(coder.parts) <= 50


def test_joined_sums():
    assert token_files.joined_crc32(zlib.crc32(b"abc"), zlib.crc32(b"defgh"), 5) == zlib.crc32(b"abcdefgh")
    assert token_files.joined_crc32(zlib.crc32(b"abc"), 0, 0) == zlib.crc32(b"abc")


# collocations

def phrase_loop(rows, least, share, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f["und" if lang is None else lang][tuple(w[i:i + m])] += 1
    out = Counter()
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in good.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], a)
        found = []
        for p, a in good.items():
            if p not in inside or 100 * inside[p] < share * a:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out[lang, rank, p.decode(), -a, left, right, n[lang], -s] += 1
    return out


@pytest.fixture(scope="module")
def phrase_docs(spark):
    """Passages, overlaps, ties, nulls, pieces of every length, a very long text without stops, clashing names."""
    rng = np.random.default_rng(3)
    rows = [("en", "the same long passage of many words that is told again and again"), ("en", "a a a a a a a a"), (None, "x y, X Y; x y"),
            ("und", "x y"), ("fr", None), ("fr", ""), ("en", " .,;:!?\n\t "), ("de", "ÄÖ äö ÄÖ äö"), (None, None)] * 9
    rows += [("en", " ".join(rng.choice(["a", "b", "c", "the", "same"], 30))) for _ in range(60)]
    rows += [("es", " ".join(rng.choice(["uno", "dos", "tres"], 5000)))]
    odd = [(i, t, lang, 1, 2, "w", None) for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(odd, "doc_id long, text string, lang string, n long, h long, w1 string, p string")


@pytest.mark.parametrize(("least", "share", "top"), [(9, 100, 2000), (4, 60, 15), (1, 100, 300)])
def test_collocations(phrase_docs, least, share, top, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 1000)
    got = collocations.top_phrases(collocations.phrases(phrase_docs, least=least, share=share), top=top)
    want = phrase_loop([(r["lang"], r["text"]) for r in phrase_docs.collect()], least, share, top)
    assert Counter(map(tuple, got.collect())) == want


def test_collocations_hold_few_words_however_many_languages(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 1000)
    read = []

    def batches():
        for i in range(50):
            read.append(i)
            yield pd.DataFrame({"lang": [f"l{i}"], "text": [" ".join(f"w{j}" for j in range(300))]})

    out = collocations._counted(0)(batches())
    first = next(out)
    assert len(read) < 5
    assert len(first) + sum(map(len, out)) == 50 * 300


def test_collocations_of_odd_tables(odd_docs, no_docs):
    got = collocations.top_phrases(collocations.phrases(odd_docs, least=3))
    assert Counter(map(tuple, got.collect())) == phrase_loop([(r["lang"], r["text"]) for r in odd_docs.collect()], 3, 100, 2000)
    assert collocations.phrases(no_docs).count() == 0


def test_collocations_with_colliding_hashes(phrase_docs, monkeypatch):
    """A seed under which words share hashes is given up; a filter that lets everything through changes nothing."""
    want = Counter(map(tuple, collocations.top_phrases(collocations.phrases(phrase_docs, least=9)).collect()))
    counted = collocations._counted

    def colliding(seed):
        def run(batches):
            for out in counted(seed)(batches):
                yield out if seed else out.assign(h=out["word"].str.len() + 1)
        return run

    monkeypatch.setattr(collocations, "_counted", colliding)
    assert Counter(map(tuple, collocations.top_phrases(collocations.phrases(phrase_docs, least=9, most_bits=6)).collect())) == want
    assert collocations.vocabulary(phrase_docs.selectExpr("coalesce(lang, 'und') lang", "coalesce(text, '') text"))[1] == 1


def test_unary_paths(phrase_docs):
    """The passage is one path, and paths hold each heavy edge once."""
    rows = phrase_docs.selectExpr("coalesce(lang, 'und') lang", "coalesce(text, '') text")
    words, seed = collocations.vocabulary(rows)
    edges = collocations.graph(rows, seed, words, least=9)
    paths = collocations.unary_paths(edges, collocations.flows(edges, 4), least=9).collect()
    heavy = {tuple(r)[:5]: r["n"] for r in edges.filter("w5 <> 0 and n >= 9").collect()}
    told = Counter(tuple(p["words"][i:i + 5]) for p in paths for i in range(len(p["words"]) - 4))
    assert set(told) == set(heavy) and set(told.values()) == {1}
    assert all(heavy[tuple(p["words"][i:i + 5])] == p["n"] for p in paths for i in range(len(p["words"]) - 4))
    assert max(len(p["words"]) for p in paths) == 13

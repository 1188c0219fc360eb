"""The corpus pipeline against plain loops, and its stages on odd tables."""

from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
from odd_tables import no_docs, odd_docs  # noqa: F401
from test_text_operators import SMALL, exact_loop, leak_loop, near_loop, texts

from tidebars.llm import byte_bpe, quality


def test_pipeline_matches_loops(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    left = {k: t for k, t in texts(quality.keep_good(docs))}
    assert 0.7 * docs.count() < len(left) < docs.count()
    left = {k: left[k] for k, _, _, kept, _ in exact_loop(list(left.items())) if kept}
    left = {k: left[k] for k, _, _, kept in near_loop(sorted(left.items())) if kept}
    left = {k: left[k] for k, *_, hit in leak_loop(list(left.items()), bench) if not hit}
    coder = byte_bpe.encoding(byte_bpe.default_ranks())
    want = Counter((k, len(i := coder.encode_ordinary(t)), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(),
                    hashlib.sha256(t.encode()).hexdigest()) for k, t in left.items())
    assert Counter(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == want


def test_stages_keep_columns_and_stand_odd_tables(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_docs, SMALL)
        assert out.columns == odd_docs.columns and out.count() <= odd_docs.count(), name
        assert {3, 4, 5} & {r[0] for r in out.select("doc_id").collect()}, name
        assert stage(spark, no_docs, SMALL).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd_docs, SMALL).count() == odd_docs.count()

"""The registered queries of this subpackage and the SQL that they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebars.llm import (
    byte_bpe, collocations, decontaminate, exact_dedup, html_text, minhash_dedup, pitman_yor, prefix_trie, quality, secret_ledger, token_files,
    toxicity, warc,
)
from tidebars.llm.columns import table


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back: type, payload digest and length of every record."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in ten-word windows of benchmark items."""
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a document is junk, learnt from heuristic labellers, and the decision."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs))
    return scored.select("doc_id", "junk", (scored["junk"] >= quality.REJECT).alias("rejected"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page by boosted trees over its elements."""
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document and the bytes that they decode to, as digests."""
    return byte_bpe.digests(byte_bpe.encode(table(spark, sf_dir, "documents")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose texts are equal but for white space."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets of each document, scanned once per distinct text."""
    return secret_ledger.report(secret_ledger.scan(table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document by a factorization machine."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of each document under a hierarchical Pitman-Yor model and a smoothed unigram."""
    docs = table(spark, sf_dir, "documents")
    return pitman_yor.train_and_score(docs)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents: five-word shingles, similarity of 0.75 or more."""
    return minhash_dedup.near_groups(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of rebuilt conversations, with figures of its members and its subtree."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of each document's token ids, read back from files of Simple-8b blocks."""
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of two to five words of each language."""
    return collocations.top_phrases(collocations.phrases(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_warc_salvage": op1_warc_salvage,
    "op2_decontamination": op2_decontamination,
    "op3_quality": op3_quality,
    "op4_html_text": op4_html_text,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_toxicity": op8_toxicity,
    "op9_pitman_yor": op9_pitman_yor,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_files": op12_token_files,
    "op13_collocations": op13_collocations,
}

SQL = {
    "op1_warc_salvage": warc.SQL,
    "op2_decontamination": decontaminate.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op7_secret_scan": secret_ledger.SQL,
    "op10_minhash_dedup": minhash_dedup.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op13_collocations": collocations.SQL,
}

"""The queries opN_<name> and their SQL: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, hash_ring, minhash_forest, pfair, suffix_dedup, token_counts, toxicity, vamana, warc, window_dedup
from .cluster import shared_dir, table
from .sql import SQL

__all__ = ["QUERIES", "SHARES", "SQL"]

SHARES = {f"src{i}": 1 + i % 4 for i in range(20)}


def op1_token_counts(spark, sf_dir):
    """Totals by source, language and tokenizer version: all documents are inserted, the batch is replayed, then exact copies are deleted
    (all but the smallest id of each text) in a second batch. Null texts are copies of each other, not of the empty text."""
    docs = table(spark, sf_dir, "documents")
    tokenizers = {"bpe-50k": token_counts.bpe(f"{token_counts.VOCABULARIES}/byte_bpe_50k.tiktoken"), "words-1": token_counts.whitespace()}
    rollup = token_counts.Rollup(spark, shared_dir(spark), tokenizers)
    inserts = docs.withColumn("op", F.lit("insert"))
    rollup.commit("load", inserts)
    rollup.commit("load", inserts)
    named = docs.select("doc_id", F.coalesce(F.sha2("text", 256), F.lit("null")).alias("digest"))
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    copies = named.join(firsts, ["digest", "doc_id"], "left_anti")  # keys of two columns: a digest with many copies isn't one key
    none = F.lit(None).cast("string")
    rollup.commit("copies", copies.select(F.lit("delete").alias("op"), "doc_id", none.alias("text"), none.alias("source"), none.alias("lang")))
    return rollup.totals()


def op2_suffix_dedup(spark, sf_dir):
    """Bytes covered by a 50-byte string that also starts in a document with a smaller id."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 50, digest=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_decontaminate(spark, sf_dir):
    """Documents that hold a benchmark item: its ids and the best similarity."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_minhash_forest(spark, sf_dir):
    """Near-duplicate components at a Jaccard similarity of 0.85 of five-word shingles."""
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op5_vamana(spark, sf_dir):
    """The 5 nearest vectors of every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return vamana.search(vamana.index(rows), rows.where("vec_id % 50 = 0"), 5)


def op6_warc(spark, sf_dir):
    """Pages written as WARC archives and read back."""
    return warc.archived(table(spark, sf_dir, "pages"))


def op7_toxicity(spark, sf_dir):
    """Toxicity of every document, by a model that never saw the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_hash_ring(spark, sf_dir):
    """Documents in 24 shards whose counts are at most one apart."""
    return hash_ring.shard(table(spark, sf_dir, "documents"), 24)


def op9_pfair(spark, sf_dir):
    """Documents in blocks of 16, sources interleaved by their shares."""
    return pfair.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), SHARES, 16).select("row.doc_id", "source", "epoch", "block", "slot", "mix_pos")


def op10_window_dedup(spark, sf_dir):
    """Words covered by a 13-word window that also starts in a document with a smaller id."""
    return window_dedup.remove_repeats(table(spark, sf_dir, "documents"), 13, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_suffix_dedup, op3_decontaminate, op4_minhash_forest, op5_vamana, op6_warc, op7_toxicity, op8_hash_ring, op9_pfair, op10_window_dedup)}



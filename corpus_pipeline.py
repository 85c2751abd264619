"""A corpus pipeline over `documents`: toxicity, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Filters keep whole documents or drop them; the mix orders
the rows by their place in the schedule, and the written files follow it; the last stage adds law, shard and slot, where the slots of a shard
follow the order of the files it read, so each shard interleaves its sources as the mix does. Columns other than
those of documents are left out; null ids, texts, languages and sources stay, as do repeated rows of one id whose copy is kept; empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, hash_ring, minhash_forest, pfair, toxicity
from tidewatch.llm.cluster import table, written
from tidewatch.llm.queries import SHARES

CHUNK_ROWS = 100_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark, docs, sf_dir):
    """Drops what a classifier, fitted on the labelled documents outside the held-out fold, predicts to be toxic."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model).select(COLUMNS)


def drop_near_copies(spark, docs, sf_dir):
    """Keeps the document of smallest id of each group of near-duplicates (similarity 0.8 of five-word shingles). Rows of one id stay or go
    together, by the smallest of their components: of rows of one id with different texts one may be a near copy and still stay."""
    docs = docs.select(COLUMNS)  # other columns may have any name
    kept = minhash_forest.near_duplicates(docs, 80).where("kept").select(F.col("doc_id").alias("__kept"))
    return docs.join(kept.distinct(), docs["doc_id"].eqNullSafe(F.col("__kept")), "left_semi").select(COLUMNS)


def drop_leaks(spark, docs, sf_dir):
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mix_sources(spark, docs, sf_dir):
    """Orders documents by the Pfair schedule of their sources."""
    return pfair.mix(docs, SHARES, 16).orderBy("mix_pos").select("row.*").select(COLUMNS)


def shard(spark, docs, sf_dir):
    """Adds law, shard and slot: 24 shards, counts at most one apart; slots in the order of the files' rows, or of the rows' partitions where docs
    aren't files."""
    try:
        part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long")
        read = docs.select(*COLUMNS, part.alias("__part"), F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        read = docs.select(*COLUMNS, F.spark_partition_id().cast("long").alias("__part"), F.lit("").alias("__file"), F.monotonically_increasing_id().alias("__row"))
    read = read.withColumn("__chunk", F.floor(F.col("__row") / CHUNK_ROWS))
    at = ["__part", "__file", "__chunk", "__row"]
    placed = hash_ring.shard(read, 24, keep=[*COLUMNS[1:], *at])
    return hash_ring.in_order(placed, at[:3], at[3:]).select(*COLUMNS, "size", "text_crc32", "law", "shard", "slot")


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("pfair_mix", mix_sources), ("hash_ring_shards", shard)]


def run(spark, sf_dir):
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs


#: Learned scores and hash-ring positions have no SQL form; each stage is tested against a plain version of it.
ORACLE_SQL = None

"""Token counts as delta-maintained rollups.

A home folder holds committed batches. A batch is a table of changes: `op` insert, delete or revise, with id, text, source and language. It
is turned into signed rows (+1 for what a document now counts, -1 for what it counted before, taken from the ledger of earlier batches) and
their sums by source, language and tokenizer version. Totals are the sum of all batches' sums, so a batch never reads the corpus again.

Commits are idempotent: a batch is written aside and made visible by one rename to its name; a batch whose name is there already is
left as it is, so replays, retries and two writers of the same batch change nothing. A writer that fails leaves no trace in the totals.

`compact` folds the batches so far into a base: what each document counts now, the sums, and the names of the batches. Readers take the base
of the most batches and the batches that it doesn't name, so a batch with deletes or revisions reads one row for each living document and
tokenizer and not the whole history. A base becomes visible by one rename too; batches committed meanwhile stay beside it. `prune` then deletes the
rows of folded batches and older bases, for when no reader or writer that began before the fold is left; names stay, so replays still change nothing.

Within a batch all deletes and revisions of an id take back what it counted before the batch, once; each insert and revise row then counts.
Deleting or revising an unknown id takes back nothing. Null texts count as documents of 0 tokens; null source or language are groups of their
own; null ids can be inserted and not taken back. Groups whose documents and tokens sum to 0 are left out. Unknown ops raise an error.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the public pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SIGNED = "doc_id long, source string, lang string, tokenizer string, sign int, tokens long, bytes long"
KEYS = ["source", "lang", "tokenizer"]
SUMS = "source string, lang string, tokenizer string, documents long, tokens long, bytes long"


def bpe(path: str):
    """A maker of a token counter from a rank file; the file (below 2 MB) is read here and travels with the task."""
    with open(path, "rb") as f:
        raw = f.read()

    def make():
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(own.encode_ordinary(t)) for t in texts]

    return make


def pieces(path: str):
    with open(path, "rb") as f:
        raw = f.read()

    def make():
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=raw)
        return lambda texts: [len(own.encode(t)) for t in texts]

    return make


def whitespace():
    def make():
        return lambda texts: [len(t.split()) for t in texts]

    return make


class Rollup:
    """Totals below `home`, a shared folder. tokenizers: version name -> maker of a counter (see bpe, pieces, whitespace)."""

    def __init__(self, spark: SparkSession, home: str, tokenizers: dict):
        self.spark, self.home, self.tokenizers = ship(spark), home.rstrip("/"), tokenizers

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._path(f"{self.home}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def batches(self) -> list[str]:
        return sorted({*self._names("batches"), *self._folded()[1]})

    def _folded(self) -> tuple[str | None, set[str]]:
        """The base of the most batches, and their names."""
        bases = self._names("bases")
        if not bases:
            return None, set()
        return bases[-1], {r["name"] for r in self.spark.read.schema("name string").parquet(f"{self.home}/bases/{bases[-1]}/names").collect()}

    def _read(self, what: str, schema: str) -> DataFrame:
        base, folded = self._folded()
        paths = [f"{self.home}/bases/{base}/{what}"] if base else []
        paths += [f"{self.home}/batches/{n}/{what}" for n in self._names("batches") if n not in folded]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def compact(self) -> bool:
        """Folds all batches so far into a base; False if there is nothing to fold."""
        names = self.batches()
        if not set(names) - self._folded()[1]:
            return False
        aside = f"{self.home}/aside/{uuid.uuid4().hex}"
        self.current().where("doc_id is not null").write.parquet(f"{aside}/ledger")  # null ids are never taken back
        self.totals().repartition(1).write.parquet(f"{aside}/sums")
        self.spark.createDataFrame([(n,) for n in names], "name string").repartition(1).write.parquet(f"{aside}/names")
        to, fs = self._path(f"{self.home}/bases/{len(names):012d}-{os.path.basename(aside)}")
        fs.mkdirs(to.getParent())
        return bool(fs.rename(self._path(aside)[0], to))

    def prune(self) -> None:
        """Deletes the rows of folded batches, and all bases but the one in use."""
        base, folded = self._folded()
        gone = [f"batches/{n}/{what}" for n in sorted(folded) for what in ("ledger", "sums")] + [f"bases/{n}" for n in self._names("bases") if n != base]
        for name in gone:
            path, fs = self._path(f"{self.home}/{name}")
            fs.delete(path, True)

    def current(self, ids: DataFrame | None = None) -> DataFrame:
        """What each document (of these ids) counts now: signed rows, summed."""
        rows = self._read("ledger", SIGNED)
        rows = rows if ids is None else rows.join(ids, "doc_id", "left_semi")
        now = rows.groupBy("doc_id", *KEYS, "tokens", "bytes").agg(F.sum("sign").cast("int").alias("sign"))
        return now.where("sign <> 0").select("doc_id", *KEYS, "sign", "tokens", "bytes")

    def counted(self, rows: DataFrame) -> DataFrame:
        """Signed rows (+1) of documents for every tokenizer version."""
        makers = self.tokenizers

        def run(batches) -> Iterator[pa.RecordBatch]:
            counters = {name: make() for name, make in makers.items()}
            for batch in batches:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
                for name, count in counters.items():
                    n = batch.num_rows
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([name] * n, pa.string()), pa.array([1] * n, pa.int32()), pa.array(count(texts), pa.int64()), sizes], ["doc_id", "source", "lang", "tokenizer", "sign", "tokens", "bytes"])

        return rows.select("doc_id", "text", "source", "lang").mapInArrow(run, SIGNED)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies changes (op, doc_id, text, source, lang) as the batch of this name; False if it had been committed before."""
        if not batch or "/" in batch or batch.startswith((".", "_")):
            raise ValueError(f"no batch name: {batch!r}")
        to, fs = self._path(f"{self.home}/batches/{batch}")
        if fs.exists(to) or batch in self._folded()[1]:
            return False
        own = changes.select(F.lower(F.col("op")).alias("op"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
        known = F.col("op").isin("insert", "delete", "revise")
        own = own.where(F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null"))))).cast("boolean"))
        signed = self.counted(own.where("op in ('insert', 'revise')"))
        if self.batches():
            ids = own.where("op in ('delete', 'revise')").select("doc_id").distinct()
            before = self.current(ids)
            signed = signed.unionByName(before.select("doc_id", *KEYS, (-F.col("sign")).cast("int").alias("sign"), "tokens", "bytes"))
        aside = f"{self.home}/aside/{uuid.uuid4().hex}"
        signed.write.parquet(f"{aside}/ledger")
        self.summed(self.spark.read.schema(SIGNED).parquet(f"{aside}/ledger")).repartition(1).write.parquet(f"{aside}/sums")
        fs.mkdirs(to.getParent())
        done = fs.rename(self._path(aside)[0], to)
        if done and fs.exists(self._path(f"{self.home}/batches/{batch}/{os.path.basename(aside)}")[0]):
            fs.delete(self._path(f"{self.home}/batches/{batch}/{os.path.basename(aside)}")[0], True)  # another writer was first
            return False
        return bool(done)

    @staticmethod
    def summed(signed: DataFrame) -> DataFrame:
        return signed.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"), F.sum(F.col("sign") * F.col("bytes")).alias("bytes"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens, bytes."""
        sums = self._read("sums", SUMS)
        return sums.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("documents", "tokens", "bytes"))).where("documents <> 0 or tokens <> 0")

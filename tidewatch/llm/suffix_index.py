"""The suffix levels of suffix_dedup stored between runs: a logarithmic family of suffix arrays below a shared folder.

Each new batch of documents gets suffix arrays, is scanned against the levels of all earlier batches and against itself, and becomes a level;
levels no larger than the new one merge with it, so a suffix is merged O(log batches) times and O(log batches) levels are open.

A level is a Parquet table with one row for each bucket of anchor hashes: the sorted distinct hashes, the distinct contexts of its anchors, and
the suffix array of the contexts (positions of the distinct suffixes, cut at `width` bytes, in order). A batch first reads hashes alone; a scan
task holds one bucket of all levels, each suffix at `width` bytes, so `buckets` is to grow with the corpus that is expected.

A string counts as seen if it starts in an earlier batch or, in the same batch, in a document with a smaller id; so batches of ascending ids
give what one run over all of them gives. With other ids the order of batches decides, and rows of one id in two batches count as two
documents. Null texts, null ids and empty texts are as in suffix_dedup; an empty batch commits without a level.

Commits are numbered and made visible by one rename. A batch whose name is committed gives its stored result again and changes nothing; a writer
that fails leaves the index as it was; of two writers at once, one gets an error and may try again. Levels that have been merged stay on disk
for readers of older commits until `prune`, which is for when no such reader is left.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from . import kernels as K
from . import suffix_dedup as S
from .cluster import blocked, ship
from .window_dedup import untouched

LEVEL = "bucket int, n_hashes int, hashes binary, n int, body binary, suffixes long"
LEVEL_ARROW = pa.schema([("bucket", pa.int32()), ("n_hashes", pa.int32()), ("hashes", pa.binary()), ("n", pa.int32()), ("body", pa.binary()), ("suffixes", pa.int64())])


def level_row(bucket: int, hashes: np.ndarray, sizes: np.ndarray, text: bytes, order: np.ndarray) -> pa.Table:
    row = (bucket, len(hashes), K.planes(hashes), len(sizes), K.planes(sizes.astype(np.uint16)) + text + K.planes(order.astype(np.uint32)), len(order))
    return pa.table([pa.array([v], f.type) for v, f in zip(row, LEVEL_ARROW, strict=True)], schema=LEVEL_ARROW)


def ordered(text: bytes, at: np.ndarray, width: int) -> np.ndarray:
    """The suffix array: of the suffixes that begin at `at`, the distinct ones in order."""
    suffix = S.cut(np.frombuffer(text, np.uint8), at, width)
    order = np.argsort(suffix, kind="stable")
    suffix = suffix[order]
    new = np.ones(len(order), bool)
    new[1:] = suffix[1:] != suffix[:-1]
    return at[order[new]]


def build(width: int):
    """A bucket of a batch as a row of its level."""

    def of(hashes: pa.Table, contexts: pa.Table) -> pa.Table:
        h, _, _ = X.distinct(np.concatenate([K.unplanes(b, "u8") for b in hashes["body"].to_pylist()]), None)
        known: dict[bytes, None] = {}
        for n, body in zip(contexts["n"].to_pylist(), contexts["body"].to_pylist(), strict=True):
            x = 6 * n  # sizes of 2 bytes, first documents of 4
            for size in K.unplanes(body[: 2 * n], "u2").tolist():
                known[body[x : x + size]] = None
                x += size
        sizes, text = np.fromiter(map(len, known), np.int64, len(known)), b"".join(known)
        at, _ = K.within(np.concatenate(([0], np.cumsum(sizes))), width)
        return level_row(hashes["bucket"][0].as_py(), h, sizes, text, ordered(text, at, width))

    return of


def merge(width: int):
    """A bucket of several levels as one: the sorted arrays merge, equal suffixes are kept once."""

    def of(got: pa.Table) -> pa.Table:
        hashes, sizes, texts, at, skip = [], [], [], [], 0
        for r in got.to_pylist():
            size, text, order = S.stored(r["body"], r["n"])
            hashes.append(K.unplanes(r["hashes"], "u8"))
            sizes.append(size)
            texts.append(text)
            at.append(order + skip)
            skip += len(text)
        text = b"".join(texts)
        return level_row(got["bucket"][0].as_py(), X.distinct(np.concatenate(hashes), None)[0], np.concatenate(sizes), text, ordered(text, np.concatenate(at), width))

    return of


class SuffixIndex:
    """An index below `home`, a shared folder; width, anchor and buckets are fixed by its first batch."""

    def __init__(self, spark: SparkSession, home: str, width: int = 50, anchor: int | None = None, buckets: int = 256):
        self.spark, self.home, self.width, self.buckets = ship(spark), home.rstrip("/"), width, buckets
        self.anchor = anchor or max(1, 2 * width // 5)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[str]:
        path, fs = self._path(f"{self.home}/commits")
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def batches(self) -> list[str]:
        """Names of the committed batches, in order."""
        commits = self._commits()
        rows = self.spark.read.schema("at long, name string").parquet(f"{self.home}/commits/{commits[-1]}/names").collect() if commits else []
        return [r["name"] for r in sorted(rows)]

    def levels(self) -> list[tuple[str, int]]:
        """Folders and numbers of suffixes of the levels in use, the oldest first."""
        commits = self._commits()
        if not commits:
            return []
        rows = self.spark.read.schema("at long, path string, suffixes long, width int, anchor int, buckets int").parquet(f"{self.home}/commits/{commits[-1]}/levels").collect()
        for r in rows:
            if (r["width"], r["anchor"], r["buckets"]) != (self.width, self.anchor, self.buckets):
                raise ValueError(f"the index has width, anchor, buckets {r['width'], r['anchor'], r['buckets']}")
        return [(r["path"], r["suffixes"]) for r in sorted(rows) if r["path"]]

    def _level(self, path: str) -> DataFrame:
        return self.spark.read.schema(LEVEL).parquet(f"{self.home}/{path}")

    def remove_repeats(self, batch: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
        """Commits the documents as the batch of this name; per document doc_id, n_bytes, n_removed, n_spans, spans and the kept text."""
        if not batch:
            raise ValueError("a batch needs a name")
        names, levels = self.batches(), self.levels()
        if batch in names:
            return self._result(names.index(batch))
        aside = f"aside/{uuid.uuid4().hex}"
        to = f"commits/{len(names):012d}"
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        own, _ = blocked(rows, "doc_id", "text", block_bytes)
        own = own.select("block", "doc_id", "text")
        self._scanned(rows, own, levels).write.parquet(f"{self.home}/{aside}/out")
        self._fresh(own).write.parquet(f"{self.home}/{aside}/level")
        size = self._level(f"{aside}/level").agg(F.sum("suffixes")).first()[0] or 0
        last = []
        while levels and size and levels[-1][1] <= size:
            path, more = levels.pop()
            last.append(path)
            size += more
        where = "level"
        if last:
            where = "merged"
            parts = [self._level(p) for p in (f"{aside}/level", *last)]
            merged = parts[0]
            for part in parts[1:]:
                merged = merged.unionByName(part)
            merged.groupBy("bucket").applyInArrow(merge(self.width), LEVEL).write.parquet(f"{self.home}/{aside}/{where}")
            size = self._level(f"{aside}/{where}").agg(F.sum("suffixes")).first()[0]
        levels += [(f"{to}/{where}", size)] if size else []
        fixed = (self.width, self.anchor, self.buckets)
        self._table([(k, p, n, *fixed) for k, (p, n) in enumerate(levels)] or [(0, None, 0, *fixed)], "at long, path string, suffixes long, width int, anchor int, buckets int", f"{aside}/levels")
        self._table(list(enumerate([*names, batch])), "at long, name string", f"{aside}/names")
        self._commit(aside, to)
        return self._result(len(names))

    def _scanned(self, rows: DataFrame, own: DataFrame, levels: list[tuple[str, int]]) -> DataFrame:
        """The batch against itself and all levels. Levels take part in the exchange as blocks before all others."""
        args = (self.width, self.anchor, self.buckets)
        sent = own.groupBy("block").applyInArrow(S.emit_anchors(*args), X.SENT)
        held = []
        for k, (path, _) in enumerate(levels):
            level, at = self._level(path), F.lit(-1 - k).alias("block")
            sent = sent.unionByName(level.select(at, "bucket", F.lit(0).alias("kind"), F.col("n_hashes").alias("n"), F.col("hashes").alias("body")))
            held.append(level.select(at, "bucket", F.lit(2).alias("kind"), "n", "body"))
        shared = X.asked(sent, self.buckets, 1, None, False).where("block >= 0")
        suffixes = own.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(S.emit_contexts(*args, 1), X.SENT)
        for part in held:
            suffixes = suffixes.unionByName(part)
        firsts = X.relayed(suffixes, 1, None, S.scan_bucket(self.width, 1), None)
        done = own.groupBy("block").cogroup(shared.unionByName(firsts).groupBy("block")).applyInArrow(S.finish(*args, False), S.OUT)
        return done.unionByName(untouched(rows, S.finish(*args, False, alone=True), S.OUT))

    def _fresh(self, own: DataFrame) -> DataFrame:
        args = (self.width, self.anchor, self.buckets)
        sent = own.groupBy("block").applyInArrow(S.emit_anchors(*args), X.SENT)
        contexts = own.groupBy("block").applyInArrow(S.emit_all_contexts(*args), X.SENT)
        return sent.groupBy("bucket").cogroup(contexts.groupBy("bucket")).applyInArrow(build(self.width), LEVEL)

    def _table(self, rows: list[tuple], schema: str, name: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{self.home}/{name}")

    def _result(self, k: int) -> DataFrame:
        return self.spark.read.schema(S.OUT).parquet(f"{self.home}/commits/{k:012d}/out")

    def _commit(self, aside: str, name: str) -> None:
        to, fs = self._path(f"{self.home}/{name}")
        fs.mkdirs(to.getParent())
        done = not fs.exists(to) and fs.rename(self._path(f"{self.home}/{aside}")[0], to)
        inner = self._path(f"{self.home}/{name}/{os.path.basename(aside)}")[0]
        if done and fs.exists(inner):  # another writer was first, and the rename moved this one's files into its folder
            fs.delete(inner, True)
            done = False
        if not done:
            raise RuntimeError("another batch was committed meanwhile: commit this one again")

    def prune(self) -> None:
        """Deletes levels that no longer are in use."""
        used = {p for p, _ in self.levels()}
        for name in self._commits():
            for where in ("level", "merged"):
                if f"commits/{name}/{where}" not in used:
                    path, fs = self._path(f"{self.home}/commits/{name}/{where}")
                    fs.delete(path, True)

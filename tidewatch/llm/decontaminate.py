"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Words are lower-cased `[^\\x20\\x09-\\x0D]+`. The features of an item or window are its five-word shingles (all words as one if there are
fewer), weighted by how often they occur. Each item of n words is compared with every window of n words of every document: a window's
64-bit SimHash (signed sums of its shingles' hash bits) is looked up in an index of items of that length. The index cuts fingerprints into 8
blocks of 8 bits; two fingerprints within `radius` bits differ by at most radius // 8 bits in some block, so tables of the items within
that many bits of each block value find all items within the radius. Candidates within the radius are verified exactly: weighted Jaccard
similarity, sum of minima over sum of maxima, at least `percent`.

A window that shares no shingle with the benchmark has similarity 0, so only windows that hold a benchmark shingle are fingerprinted: exact,
whatever the data. A document of fewer words than an item is compared with it as one window. The benchmark is cut into parts of at most
`part_words` words, each sent to the tasks as one index, so one broadcast is bounded; all documents are read for each part, and together the
parts are as large as the benchmark.

Null or empty texts match nothing, nor do items without words. Null ids of documents stay null; items without an id are left out of `matches`
and `report`, which name items, and count in `clean`. Repeated rows are judged one by one; items of equal text all match. Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import kernels as K

WIDTH, BLOCKS = 5, 8
PAIRS = 1 << 24  # windows times items looked up at once
HITS = "doc_id long, item_id long, similarity double, start long, stop long"
POPCOUNT = np.bitwise_count(np.arange(256, dtype=np.uint8))


def texts(column):
    """(index, word codes) of each text."""
    buf, offs = K.flat(column)
    for i, j in K.chunks(offs):
        part = K.LOWER[buf[offs[i] : offs[j]]]
        s, e, first = K.words(part, offs[i : j + 1] - offs[i])
        codes = K.word_codes(part, s, e)
        yield i, codes, first


def shingles(codes: np.ndarray) -> np.ndarray:
    if len(codes) >= WIDTH:
        return K.runs_of(codes, WIDTH)
    return K.runs_of(codes, len(codes)) if len(codes) else np.zeros(0, np.uint64)


def signs(h: np.ndarray) -> np.ndarray:
    """+1 and -1 for the 64 bits of each hash."""
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """8 bytes for each row of 64 sums."""
    return np.packbits(sums > 0, axis=1)


class Members:
    """Exact membership in a set of hashes; a bit table answers most of the absent ones."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.mask = np.uint64((1 << max(16, (64 * len(self.sorted)).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[(self.sorted & self.mask).astype(np.int64)] = True

    def positions(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.bits[(h & self.mask).astype(np.int64)])
        return at[np.isin(h[at], self.sorted)]


class Index:
    """Items of one part, by their number of words."""

    def __init__(self, ids: list[int], items: list[np.ndarray], radius: int):
        self.radius = radius
        self.ids, self.by_length = np.array(ids, np.int64), {}
        self.grams = [dict(zip(*(x.tolist() for x in np.unique(shingles(c), return_counts=True)), strict=True)) for c in items]
        # by the number of words of a shingle: WIDTH, or that of a shorter item
        widths = {min(WIDTH, len(c)) for c in items}
        self.members = {w: Members(np.concatenate([np.fromiter(g, np.uint64, len(g)) for g, c in zip(self.grams, items, strict=True) if min(WIDTH, len(c)) == w])) for w in widths}
        prints = np.concatenate([fingerprints(signs(shingles(c)).sum(axis=0, keepdims=True)) for c in items])
        for n in {len(c) for c in items}:
            own = np.array([k for k, c in enumerate(items) if len(c) == n])
            # per block and value: the items within radius // BLOCKS bits
            near = POPCOUNT[np.arange(256, dtype=np.uint8)[None, :, None] ^ prints[own].T[:, None, :]] <= radius // BLOCKS
            self.by_length[n] = (own, prints[own], near)

    def near(self, n: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) within the radius."""
        own, prints, tables = self.by_length[n]
        step, found = max(1, PAIRS // len(own)), []
        for first in range(0, len(windows), step):
            some = windows[first : first + step]
            hit = tables[0][some[:, 0]]
            for b in range(1, BLOCKS):
                hit |= tables[b][some[:, b]]
            w, i = np.nonzero(hit)
            ok = POPCOUNT[some[w] ^ prints[i]].sum(axis=1, dtype=np.int32) <= self.radius
            found.append((w[ok] + first, own[i[ok]]))
        return np.concatenate([w for w, _ in found]), np.concatenate([i for _, i in found])


def suspects(codes: np.ndarray, first: np.ndarray, index: Index) -> np.ndarray:
    """The documents of a chunk that hold a benchmark shingle."""
    out = np.zeros(len(first) - 1, bool)
    for w, members in index.members.items():
        at = members.positions(K.runs_of(codes, w))
        k = np.searchsorted(first, at, "right") - 1
        out[k[at + w <= first[k + 1]]] = True
    return np.flatnonzero(out)


def search(codes: np.ndarray, index: Index, percent: int):
    """Matches of one document: (item, similarity, first word, end), the best window for each item."""
    best: dict[int, tuple[float, int, int]] = {}
    known: dict[int, tuple] = {}
    for n in index.by_length:
        size = min(n, len(codes))
        width = min(WIDTH, n)
        if size < width:
            continue
        if width not in known:
            h = K.runs_of(codes, width)
            known[width] = h, index.members[width].positions(h)
        h, hit = known[width]
        if not len(hit):
            continue
        k = size - width + 1  # shingles in a window
        last = len(codes) - size
        mark = np.zeros(last + 2, np.int32)
        np.add.at(mark, np.clip(hit - k + 1, 0, last + 1), 1)
        np.add.at(mark, np.minimum(hit, last) + 1, -1)
        at = np.flatnonzero(np.cumsum(mark)[: last + 1] > 0)
        if not len(at):
            continue
        low, high = int(at[0]), int(at[-1]) + k
        sums = np.zeros((high - low + 1, 64), np.int32)
        np.cumsum(signs(h[low:high]), axis=0, out=sums[1:])
        prints = fingerprints(sums[at - low + k] - sums[at - low])
        for w, item in zip(*index.near(n, prints), strict=True):
            a = int(at[w])
            want = index.grams[item]
            got: dict[int, int] = {}
            for g in h[a : a + k].tolist():
                got[g] = got.get(g, 0) + 1
            shared = sum(min(c, got.get(g, 0)) for g, c in want.items())
            whole = sum(want.values()) + k - shared
            if 100 * shared >= percent * whole and shared / whole > best.get(item, (0.0,))[0]:
                best[int(item)] = (shared / whole, a, a + size)
    return best


def indexed(bodies: list[str], names: list[int | None], radius: int) -> Index | None:
    codes = [c[a:b] for _, c, first in texts(pa.array(bodies, pa.string())) for a, b in zip(first[:-1], first[1:], strict=True)]
    some = [k for k, c in enumerate(codes) if len(c)]
    return Index([-1 if names[k] is None else names[k] for k in some], [codes[k] for k in some], radius) if some else None


def parts(items: DataFrame, part_words: int):
    """The benchmark's (ids, texts), a part at a time."""
    ids, bodies, words = [], [], 0
    for row in items.toLocalIterator():
        ids.append(row["id"])
        bodies.append(row["text"])
        words += len(row["text"]) // 6 + 1
        if words >= part_words:
            yield ids, bodies
            ids, bodies, words = [], [], 0
    if ids:
        yield ids, bodies


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = 80, radius: int = 23, part_words: int = 200_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start, stop): each item found in a document, with its best window as word positions. With radius 23 the
    expected distance of a pair at 0.8 is 9.7 of 64 bits, standard deviation 2.9."""
    spark = ship(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).where("id is not null and text is not null")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], HITS)
    for part in parts(items, part_words):
        at = spark.sparkContext.broadcast(part)

        def find(batches, at=at):
            names, bodies = at.value
            index = indexed(bodies, names, radius)
            for batch in batches:
                docs_, rows = batch.column(0).to_pylist(), []
                for i, codes_, first in texts(batch.column(1)) if index else ():
                    for k in suspects(codes_, first, index).tolist():
                        rows += [(docs_[i + k], int(index.ids[item]), s, x, y) for item, (s, x, y) in search(codes_[first[k] : first[k + 1]], index, percent).items()]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "similarity", "start", "stop"])

        out = out.unionByName(own.mapInArrow(K.tidy(find), HITS))
    return out


def report(docs: DataFrame, benchmark: DataFrame, percent: int = 80, **options) -> DataFrame:
    """Per contaminated document: doc_id, items (sorted list), n_items, best similarity."""
    found = matches(docs, benchmark, percent, **options)
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.countDistinct("item_id").alias("n_items"), F.max("similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = 80, radius: int = 23, part_words: int = 200_000, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """The rows without any match, whatever their ids; all columns. Each row is judged by its own text, where it is."""
    spark = ship(docs.sparkSession)
    items = benchmark.select(F.lit(None).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    at_text, out = docs.columns.index(text_col), docs
    for part in parts(items, part_words):
        at = spark.sparkContext.broadcast(part)

        def keep(batches, at=at):
            names, bodies = at.value
            index = indexed(bodies, names, radius)
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for i, codes_, first in texts(batch.column(at_text).cast(pa.string())) if index else ():
                    for k in suspects(codes_, first, index).tolist():
                        good[i + k] = not search(codes_[first[k] : first[k + 1]], index, percent)
                yield batch.filter(pa.array(good))

        out = out.mapInArrow(K.tidy(keep), docs.schema)
    return out

"""Substring deduplication over word windows: Rabin-Karp hashes of every fixed-length window, counted in Spark; repeated windows merge into
maximal removal intervals.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A window is `width` consecutive words of one document. A word goes if a window that covers it
also starts in a document with a smaller id; windows are judged on the input.

1. Every window's Rabin-Karp hash (modulo the prime 2**61 - 1) goes to the bucket of its hash, once from each block of documents; the bucket
   counts the blocks that have it and answers which hashes are repeated.
2. Equal hashes decide nothing yet: of repeated windows the words themselves, joined by one blank, are compared by their 128-bit BLAKE2b
   digests, for which no two texts of equal digest are known. The bucket of a digest answers which ones an earlier block has.
3. Repeated windows merge into maximal intervals, and the words in them go. No id, count or text is capped.

Null texts: no words. Empty texts: kept, nothing removed. Null ids: the row is returned whole, neither source nor target of a match; such rows
are read where they are, never in one group.
Repeated ids: rows of the same id never remove each other's words. Other columns are ignored, so clashing names don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import kernels as K
from .cluster import blocked

OUT = "doc_id long, n_words long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept string"
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.string())])


def windows(got: pa.Table, width: int):
    """Of one block, sorted by id: hash, first word and row of every window, and what is needed to find the words."""
    buf, offs = K.flat(got["text"])
    hs, at, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    shape, total = [], 0
    for i, j in K.chunks(offs):
        part, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        s, e, first = K.words(part, o)
        pos, doc = K.within(first, width)
        hs.append(K.runs_of(K.word_codes(part, s, e), width)[pos])
        at.append(pos + total)
        docs.append(doc + i)
        shape.append((i, j, s, e, first, total))
        total += len(s)
    return np.concatenate(hs), np.concatenate(at), np.concatenate(docs), shape, total, buf, offs


def digests(at: np.ndarray, width: int, shape, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2b of the words of the windows that begin at the words `at` (ascending), in two halves."""
    out = bytearray()
    for i, j, s, e, _, skip in shape:
        mine = at[np.searchsorted(at, skip) : np.searchsorted(at, skip + len(s))] - skip
        if not len(mine):
            continue
        size = e - s
        begin = np.cumsum(size + 1) - size - 1  # of each word in the words joined by one blank
        first = np.cumsum(size) - size
        joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
        place = np.arange(int(size.sum()))
        joined[place + np.repeat(begin - first, size)] = buf[offs[i] : offs[j]][place + np.repeat(s - first, size)]
        text = joined.tobytes()
        for a, b in zip(begin[mine].tolist(), (begin + size)[mine + width - 1].tolist(), strict=True):
            out += hashlib.blake2b(text[a:b], digest_size=16).digest()
    halves = np.frombuffer(bytes(out), np.uint64).reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


def repeated(got: pa.Table, answers: pa.Table, width: int, buckets: int):
    """Of one block, sorted by id: windows whose hash occurs in another block or in two documents of this one: the first word, row, whether it
    occurs in another block, and the digest."""
    h, at, doc, shape, total, buf, offs = windows(got, width)
    uh, _, index = X.distinct(h, None)
    shared = X.told(answers, uh, buckets)
    ids = got["doc_id"].to_numpy()
    low, high = np.full(len(uh), np.iinfo(np.int64).max), np.full(len(uh), np.iinfo(np.int64).min)
    np.minimum.at(low, index, ids[doc])
    np.maximum.at(high, index, ids[doc])
    some = np.flatnonzero((shared | (low != high))[index])
    return at[some], doc[some], shared[index[some]], digests(at[some], width, shape, buf, offs), ids, shape, total, buf, offs


def by_id(got: pa.Table) -> pa.Table:
    return got.sort_by([("doc_id", "ascending")])


def emit(width: int, buckets: int):
    def of(got: pa.Table) -> pa.Table:
        return X.rows(X.send(got["block"][0].as_py(), X.distinct(windows(got, width)[0], None)[0], None, buckets))

    return of


def emit_words(width: int, buckets: int):
    def of(got: pa.Table, answers: pa.Table) -> pa.Table:
        if not got.num_rows:
            return X.rows([])
        _, _, shared, (a, b), *_ = repeated(by_id(got), answers, width, buckets)
        a, b, _ = X.distinct(a[shared], b[shared])
        return X.rows([(*row[:2], 2, *row[3:]) for row in X.send(got["block"][0].as_py(), a, b, buckets)])

    return of


def finish(width: int, buckets: int, digest: bool, alone: bool = False):
    def of(got: pa.Table, answers: pa.Table | None) -> pa.Table:
        if not got.num_rows:
            return schema_of(digest).empty_table()
        if alone:
            *_, shape, total, buf, offs = windows(got, width)
            gone = np.zeros(total, bool)
        else:
            got = by_id(got)
            kinds = answers["kind"].to_numpy()
            at, doc, shared, (a, b), ids, shape, total, buf, offs = repeated(got, answers.filter(pa.array(kinds == 1)), width, buckets)
            ua, ub, index = X.distinct(a, b)
            sent = np.zeros(len(ua), bool)
            sent[index[shared]] = True
            seen = np.zeros(len(ua), bool)
            seen[sent] = X.told(answers.filter(pa.array(kinds == 3)), ua[sent], buckets, 3)
            least = np.full(len(ua), np.iinfo(np.int64).max)
            np.minimum.at(least, index, ids[doc])
            gone = K.cover(total, at[seen[index] | (least[index] < ids[doc])], width)
        n_words, n_removed, all_spans, kept = [], [], [], []
        for i, j, s, e, first, skip in shape:
            part, base = buf[offs[i] : offs[j]].tobytes(), offs[i]  # noqa: F841
            for k in range(j - i):
                a, b = int(first[k]), int(first[k + 1])
                g = gone[skip + a : skip + b]
                n_words.append(b - a)
                n_removed.append(int(g.sum()))
                edge = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
                all_spans.append([{"start": int(x), "stop": int(y)} for x, y in edge.reshape(-1, 2)])
                rest = b" ".join(part[x:y] for x, y in zip(s[a:b][~g].tolist(), e[a:b][~g].tolist(), strict=True))
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest.decode("utf-8", "replace"))
        return pa.table([got["doc_id"].cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([len(x) for x in all_spans], pa.int64()), pa.array(all_spans, OUT_ARROW.field("spans").type), pa.array(kept, pa.string())], schema=schema_of(digest))

    return of


def schema_of(digest: bool) -> pa.Schema:
    return OUT_ARROW.set(5, pa.field("kept_sha256", pa.string())) if digest else OUT_ARROW


def remove_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, block_bytes: int = 8 << 20, flat: int = X.FLAT) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, n_spans, spans (word intervals), and the kept text, or with `digest` its SHA-256.

    Text crosses the network once (by block), each block's distinct windows once as hashes of 8 bytes and, if repeated, as digests of 16;
    answers are bits. Beyond `flat` blocks the exchange has two levels."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own, n = blocked(rows, "doc_id", "text", block_bytes)
    out = OUT.replace("kept string", "kept_sha256 string") if digest else OUT
    buckets, fine = X.levels(n, n, flat)
    hashes = own.groupBy("block").applyInArrow(emit(width, buckets), X.SENT)
    shared = X.asked(hashes, buckets, fine, None, False)
    words = own.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(emit_words(width, buckets), X.SENT)
    earlier = X.asked(words, buckets, fine, "u8", True, 3)
    done = own.groupBy("block").cogroup(shared.unionByName(earlier).groupBy("block")).applyInArrow(finish(width, buckets, digest), out)
    return done.unionByName(untouched(rows, finish(width, buckets, digest, alone=True), out))


def untouched(rows: DataFrame, finish_, out: str) -> DataFrame:
    """The rows without an id, batch by batch where they are."""

    def of(batches):
        for batch in batches:
            yield from finish_(pa.Table.from_batches([batch]), None).to_batches()

    return rows.where("doc_id is null").mapInArrow(K.tidy(of), out)

"""Substring deduplication over bytes with a logarithmic family of suffix arrays.

Every text is UTF-8 bytes. A byte goes if a string of `width` bytes that covers it also starts in a document with a smaller id; strings are
judged on the input, overlaps count, matches never cross documents.

1. Anchors. Each window of `width` bytes names its anchor, the minimal of the `anchor`-byte strings in it (a minimizer). Equal windows have
   equal anchors, so a window whose anchor occurs in one document only can't repeat: that is exact, and leaves few windows. Anchors are
   exchanged as distinct hashes per block of documents (see exchange.py) and answered with bits.
2. Suffixes. For each remaining anchor the context that holds its windows goes to the bucket of the anchor's hash; equal contexts of a block
   go once. Blocks are ranges of ids, so they reach a bucket as batches in id order. Each batch gets a suffix array (suffixes cut at `width`
   bytes, which decide all matches), is merge-scanned against the levels of earlier batches, and becomes a level; equal-sized levels merge
   geometrically, so each suffix is merged O(log batches) times. Matches compare whole strings, not hashes.
3. Removal. Blocks mark covered bytes from the answers.

Null texts are empty; empty and shorter texts stay whole. Null ids: the row is returned whole and matches nothing, where it is. Rows of one id never
remove each other's bytes. Columns besides id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import kernels as K
from .cluster import blocked
from .window_dedup import by_id, untouched

BATCH = 1 << 18  # suffixes sorted at once
POS = np.uint64(28)
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept string"
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.string())])


def cut(text: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The suffixes that begin at `starts`, as strings of `width` bytes."""
    if not len(starts):
        return np.zeros(0, f"S{width}")
    return np.lib.stride_tricks.sliding_window_view(text, width)[starts].view(f"S{width}").ravel()


def stored(body: bytes, n: int) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Of a bucket of a stored level (see suffix_index.py): sizes of its n contexts, their text, its suffix array."""
    sizes = K.unplanes(body[: 2 * n], "u2").astype(np.int64)
    stop = 2 * n + int(sizes.sum())
    return sizes, body[2 * n : stop], K.unplanes(body[stop:], "u4").astype(np.int64)


class SuffixLevels:
    """Levels of sorted distinct suffixes (cut at `width` bytes). Batches must come in ascending order of their keys."""

    def __init__(self, width: int):
        self.width, self.levels = width, []

    def add(self, text: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """For each suffix the smallest key that has it in this batch, or -1 if an earlier batch has it; then the batch becomes a level."""
        if not len(starts):
            return np.zeros(0, np.int64)
        suffix = cut(text, starts, self.width)
        array = np.argsort(suffix, kind="stable")  # the suffix array
        ordered = suffix[array]
        new = np.ones(len(array), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        least, run = keys[array[new]].copy(), ordered[new]
        known = np.zeros(len(run), bool)
        for level in self.levels:  # merge-scan: both sides are sorted
            at = np.minimum(np.searchsorted(level, run), len(level) - 1)
            known |= level[at] == run
        least[known] = -1
        out = np.empty(len(array), np.int64)
        out[array] = least[np.cumsum(new) - 1]
        fresh = run[~known]
        if len(fresh):
            while self.levels and len(self.levels[-1]) <= len(fresh):  # equal-sized levels merge
                fresh = np.sort(np.concatenate((self.levels.pop(), fresh)), kind="stable")
            self.levels.append(fresh)
        return out


def anchors(buf: np.ndarray, offs: np.ndarray, width: int, anchor: int):
    """Runs of windows with one anchor: hash of the anchor, first and last window, row; for each chunk of documents."""
    n = width - anchor + 1
    hs, begins, ends, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in K.chunks(offs):
        o = offs[i : j + 1] - offs[i]
        pos, doc = K.within(o, width)
        if not len(pos):
            continue
        h = K.byte_runs(buf[offs[i] : offs[j]], anchor)
        key = (h >> POS << POS) | np.arange(len(h), dtype=np.uint64)
        m, span = key, 1
        while 2 * span <= n:
            m, span = np.minimum(m[:-span], m[span:]), 2 * span
        if span < n:
            m = np.minimum(m[: len(m) - (n - span)], m[n - span :])
        at = (m[pos] & ((np.uint64(1) << POS) - np.uint64(1))).astype(np.int64)
        first = np.ones(len(pos), bool)
        first[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        k = np.flatnonzero(first)
        hs.append(K.mix(~h[at[k]]))  # minimal hashes are small: spread them over the buckets
        begins.append(pos[k] + offs[i])
        ends.append(pos[np.append(k[1:], len(pos)) - 1] + offs[i])
        rows.append(doc[k] + i)
    return np.concatenate(hs), np.concatenate(begins), np.concatenate(ends), np.concatenate(rows)


def loaded(got: pa.Table, width: int, anchor: int):
    got = by_id(got)
    buf, offs = K.flat(got["text"])
    ids = got["doc_id"].to_numpy()
    rank = np.zeros(len(ids), np.int64)
    rank[1:] = np.cumsum(ids[1:] != ids[:-1])
    return got, buf, offs, rank, anchors(buf, offs, width, anchor)


def emit_anchors(width: int, anchor: int, buckets: int):
    def of(got: pa.Table) -> pa.Table:
        block = got["block"][0].as_py()
        buf, offs = K.flat(got["text"])
        return X.rows(X.send(block, X.distinct(anchors(buf, offs, width, anchor)[0], None)[0], None, buckets))

    return of


def contexts(buf, rank, runs, answers: pa.Table | None, buckets: int, width: int):
    """The runs whose anchor occurs in another document (all, without answers), bucket by bucket: (bucket, runs, number of each run's context, the distinct contexts
    in order of their first document, that document)."""
    h, begin, end, row = runs
    uh, _, index = X.distinct(h, None)
    shared = np.ones(len(uh), bool) if answers is None else X.told(answers, uh, buckets)
    doc = rank[row]
    low, high = np.full(len(uh), np.iinfo(np.int64).max), np.full(len(uh), -1)
    np.minimum.at(low, index, doc)
    np.maximum.at(high, index, doc)
    keep = np.flatnonzero((shared | (low != high))[index])
    del uh, index, low, high, shared
    bucket = X.bucket_of(h[keep], buckets)
    keep = keep[np.argsort(bucket, kind="stable")]
    cut = np.searchsorted(X.bucket_of(h[keep], buckets), np.arange(buckets + 1))
    text = memoryview(buf)
    for k in np.flatnonzero(np.diff(cut)):
        sel = keep[cut[k] : cut[k + 1]]
        known: dict[bytes, int] = {}
        docs, number = [], np.empty(len(sel), np.int64)
        for i, (x, y, d) in enumerate(zip(begin[sel].tolist(), (end[sel] + width).tolist(), doc[sel].tolist(), strict=True)):
            m = known.setdefault(bytes(text[x:y]), len(known))
            if m == len(docs):
                docs.append(d)
            number[i] = m
        yield int(k), sel, number, list(known), docs


def emit_contexts(width: int, anchor: int, buckets: int, fine: int):
    """Rows with lengths, first rows and, where there are fine buckets, the fine bucket of each context, then the contexts."""

    def of(got: pa.Table, answers: pa.Table | None) -> pa.Table:
        if not got.num_rows:
            return X.rows([])
        block = got["block"][0].as_py()
        _, buf, _, rank, runs = loaded(got, width, anchor)
        out = []
        for k, sel, number, c, d in contexts(buf, rank, runs, answers, buckets, width):
            to = b""
            if fine > 1:
                to = K.planes(X.bucket_of(runs[0][sel][np.unique(number, return_index=True)[1]], buckets * fine).astype(np.int32))
            out.append((block, k, 2, len(c), K.planes(np.fromiter(map(len, c), np.uint16, len(c))) + K.planes(np.array(d, np.int32)) + to + b"".join(c)))
        return X.rows(out)

    return of


def emit_all_contexts(width: int, anchor: int, buckets: int):
    of = emit_contexts(width, anchor, buckets, 1)
    return lambda got: of(got, None)


def gathered(got: pa.Table):
    """A group's rows in one coarse bucket: its distinct contexts in order of their first document, that document as a key, the fine bucket of
    each; and for each block the numbers of its contexts."""
    block, n, body = got["block"].to_pylist(), got["n"].to_pylist(), got["body"].to_pylist()
    known: dict[bytes, int] = {}
    keys, to, blocks = [], [], []
    for i in np.argsort(block, kind="stable").tolist():
        m, b = n[i], body[i]
        stops = np.cumsum(K.unplanes(b[: 2 * m], "u2").astype(np.int64)) + 10 * m
        number, x = [], 10 * m
        for y, d, f in zip(stops.tolist(), K.unplanes(b[2 * m : 6 * m], "i4").tolist(), K.unplanes(b[6 * m : 10 * m], "i4").tolist(), strict=True):
            k = known.setdefault(b[x:y], len(known))
            if k == len(keys):
                keys.append((block[i] << 32) + d)
                to.append(f)
            number.append(k)
            x = y
        blocks.append((block[i], np.array(number, np.int64)))
    return list(known), np.array(keys, np.int64), np.array(to, np.int64), blocks


def relay_up(got: pa.Table) -> pa.Table:
    texts, keys, to, _ = gathered(got)
    size = np.fromiter(map(len, texts), np.uint16, len(texts))
    group, order, out = got["group"][0].as_py(), np.argsort(to, kind="stable"), []
    for sel in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
        out.append((group, int(to[sel[0]]), 2, len(sel), K.planes(size[sel]) + K.planes(keys[sel]) + b"".join(texts[k] for k in sel.tolist())))
    return X.rows(out)


def relay_down(width: int):
    def of(got: pa.Table, answers: pa.Table) -> pa.Table:
        if not got.num_rows:
            return X.rows([])
        texts, _, to, blocks = gathered(got)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) - width + 1
        told = dict(zip(answers["bucket"].to_pylist(), answers["body"].to_pylist(), strict=True))
        first = np.concatenate([np.frombuffer(zlib.decompress(told[k]), np.int64) for k in np.unique(to).tolist()])
        order, skip = np.argsort(to, kind="stable"), np.empty(len(to), np.int64)
        skip[order] = np.cumsum(size[order]) - size[order]
        bucket, out = got["bucket"][0].as_py(), []
        for b, number in blocks:
            count = size[number]
            r = first[np.repeat(skip[number], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            out.append((b, bucket, 2, len(r), zlib.compress(own_firsts(r, b).tobytes(), 1)))
        return X.rows(out)

    return of


def own_firsts(keys: np.ndarray, block: int) -> np.ndarray:
    """The document within the block that has a suffix first, or -1 if an earlier block has it."""
    return np.where((keys < 0) | (keys >> 32 < block), -1, keys & 0xFFFFFFFF).astype(np.int32)


def scan_bucket(width: int, fine: int):
    """A bucket's contexts as batches in the order of the rows' blocks or groups; answers with first documents, or with their keys to groups.
    Rows of negative blocks are stored levels, which come before all batches and get no answer."""
    kind, each = ("i4", 4) if fine == 1 else ("i8", 8)

    def of(got: pa.Table) -> pa.Table:
        block, n, body = got["block"].to_numpy(), got["n"].to_numpy(), got["body"].to_pylist()
        bucket, levels, out = got["bucket"][0].as_py(), SuffixLevels(width), []
        batch, waiting = [], 0
        if block.max() < 0:  # nothing to scan against the levels
            return X.rows([])

        def flush() -> None:
            nonlocal waiting
            text = np.concatenate([t for *_, t in batch])
            shift = np.cumsum([0, *(len(t) for *_, t in batch)])
            starts, keys = [], []
            for (_, size, key, _), skip in zip(batch, shift, strict=False):
                at, which = K.within(np.concatenate(([0], np.cumsum(size))), width)
                starts.append(at + skip)
                keys.append(key[which])
            got = levels.add(text, np.concatenate(starts), np.concatenate(keys))
            i = 0
            for (b, *_), s in zip(batch, starts, strict=True):
                r = got[i : i + len(s)]
                i += len(s)
                out.append((b, bucket, 2, len(s), zlib.compress((own_firsts(r, b) if fine == 1 else r).tobytes(), 1)))
            batch.clear()
            waiting = 0

        for i in np.argsort(block, kind="stable"):
            m, b = int(n[i]), int(block[i])
            if b < 0:
                _, text, order = stored(body[i], m)
                if len(order):
                    levels.levels.append(cut(np.frombuffer(text, np.uint8), order, width))
                continue
            size = K.unplanes(body[i][: 2 * m], "u2").astype(np.int64)
            key = K.unplanes(body[i][2 * m : (2 + each) * m], kind).astype(np.int64) + ((b << 32) if fine == 1 else 0)
            batch.append((b, size, key, np.frombuffer(body[i], np.uint8, offset=(2 + each) * m)))
            waiting += int((size - width + 1).sum())
            if waiting >= BATCH:
                flush()
        if batch:
            flush()
        return X.rows(out)

    return of


def schema_of(digest: bool) -> pa.Schema:
    return OUT_ARROW.set(5, pa.field("kept_sha256", pa.string())) if digest else OUT_ARROW


def finish(width: int, anchor: int, buckets: int, digest: bool, alone: bool = False):
    def of(got: pa.Table, answers: pa.Table | None) -> pa.Table:
        if not got.num_rows:
            return schema_of(digest).empty_table()
        if alone:
            buf, offs = K.flat(got["text"])
        else:
            got, buf, offs, rank, runs = loaded(got, width, anchor)
        mark = np.zeros(len(buf) + 1, np.int32)
        if not alone:
            told = {b: body for b, k, body in zip(answers["bucket"].to_pylist(), answers["kind"].to_pylist(), answers["body"].to_pylist(), strict=True) if k == 2}
            for b, sel, number, texts, _ in contexts(buf, rank, runs, answers, buckets, width):
                size = np.fromiter(map(len, texts), np.int64) - width + 1
                skip, first = np.cumsum(size) - size, np.frombuffer(zlib.decompress(told[b]), np.int32)
                count = size[number]
                k = np.repeat(np.arange(len(sel)), count)
                step = np.arange(len(k)) - (np.cumsum(count) - count)[k]
                f = first[skip[number][k] + step]
                at = (runs[1][sel][k] + step)[(f < 0) | (f < rank[runs[3][sel]][k])]
                np.add.at(mark, at, 1)
                np.add.at(mark, at + width, -1)
        gone = np.cumsum(mark[:-1]) > 0
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        inner = offs[:-1][offs[:-1] < len(buf)]
        edge[inner] = gone[inner]
        last = gone.copy()
        last[:-1] &= ~gone[1:]
        tail = offs[1:][offs[1:] > 0] - 1
        last[tail] = gone[tail]
        starts, stops = np.flatnonzero(edge), np.flatnonzero(last) + 1
        cut = np.searchsorted(starts, offs)
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[offs])
        spans, kept = [], []
        for i in range(len(offs) - 1):
            a, b = offs[i], offs[i + 1]
            spans.append([{"start": int(x - a), "stop": int(y - a)} for x, y in zip(starts[cut[i] : cut[i + 1]], stops[cut[i] : cut[i + 1]], strict=True)])
            rest = (buf[a:b][~gone[a:b]] if removed[i] else buf[a:b]).tobytes()
            kept.append(hashlib.sha256(rest).hexdigest() if digest else rest.decode("utf-8", "replace"))
        return pa.table([got["doc_id"].cast(pa.int64()), pa.array(np.diff(offs), pa.int64()), pa.array(removed, pa.int64()), pa.array(np.diff(cut), pa.int64()), pa.array(spans, OUT_ARROW.field("spans").type), pa.array(kept, pa.string())], schema=schema_of(digest))

    return of


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, anchor: int | None = None, block_bytes: int = 4 << 20, flat: int = X.FLAT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, spans (byte intervals removed), and the kept text (bytes that are no longer UTF-8
    replaced), or with `digest` the SHA-256 of the kept bytes. Beyond `flat` blocks the exchange has two levels."""
    anchor = anchor or max(1, 2 * width // 5)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own, n = blocked(rows, "doc_id", "text", block_bytes)
    buckets, fine = X.levels(n, 2 * n, flat)
    sent = own.groupBy("block").applyInArrow(emit_anchors(width, anchor, buckets), X.SENT)
    shared = X.asked(sent, buckets, fine, None, False)
    suffixes = own.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(emit_contexts(width, anchor, buckets, fine), X.SENT)
    firsts = X.relayed(suffixes, fine, relay_up, scan_bucket(width, fine), relay_down(width))
    out = OUT.replace("kept string", "kept_sha256 string") if digest else OUT
    done = own.groupBy("block").cogroup(shared.unionByName(firsts).groupBy("block")).applyInArrow(finish(width, anchor, buckets, digest), out)
    return done.unionByName(untouched(rows, finish(width, anchor, buckets, digest, alone=True), out))

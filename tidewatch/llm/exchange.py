"""Compact exchange of hashes between blocks of documents.

Each block sends every bucket (a range of hashes) one row with its sorted distinct hashes as byte planes, so a frequent hash is combined on
the map side and crosses the network once per block. The bucket answers each block with one bit per hash. No group is ever larger than the
distinct hashes of one hash range, and a row of a block is answered by position, so answers need no keys.

Beyond FLAT blocks there are two levels, since rows would grow with the square of the n blocks. Blocks send only about sqrt(n) coarse buckets a
row; about sqrt(n) neighbouring blocks are a group, whose hashes of a coarse bucket meet at a relay; the relay sends every fine bucket of
its coarse one a row, and gives each block the answers that it gets, together with those it knows from the group itself. Each step has about
n**1.5 rows, each relay about as many hashes as a block has.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

SENT = "block int, bucket int, kind int, n int, body binary"
FLAT = 4096
SENT_ARROW = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Monotone in h: sorted hashes fall into contiguous buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def rows(items: list[tuple]) -> pa.Table:
    cols = list(zip(*items, strict=True)) if items else [[], [], [], [], []]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, SENT_ARROW, strict=True)], schema=SENT_ARROW)


def distinct(h: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Sorted distinct (hash, check) and, for each input position, its index among them."""
    order = np.argsort(h)
    s, c = h[order], None if check is None else check[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if c is not None:
        odd = ~new[1:] & (c[1:] != c[:-1])
        if odd.any():  # equal first lane, other second lane
            order = np.lexsort((check, h))
            s, c = h[order], check[order]
            new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
    index = np.empty(len(h), np.int64)
    index[order] = np.cumsum(new) - 1
    return s[new], None if c is None else c[new], index


def levels(blocks: int, buckets: int, flat: int = FLAT) -> tuple[int, int]:
    """(buckets that blocks send to, fine buckets of each, which is also the number of blocks in a group); 1 fine bucket is a single level."""
    fine = math.isqrt(blocks - 1) + 1 if blocks > max(1, flat) else 1
    return -(-buckets // fine), fine


def send(block: int, h: np.ndarray, check: np.ndarray | None, buckets: int, within: tuple[int, int] | None = None) -> list[tuple]:
    """Rows of a block: h sorted and distinct, all in the range `within` of buckets."""
    low, high = within or (0, buckets)
    out, cut = [], np.searchsorted(bucket_of(h, buckets), np.arange(low, high + 1))
    for b in np.flatnonzero(np.diff(cut)):
        i, j = cut[b], cut[b + 1]
        out.append((block, int(b) + low, 0, int(j - i), K.planes(h[i:j]) + (b"" if check is None else K.planes(check[i:j]))))
    return out


def unpack(body: bytes, n: int, check: str | None) -> tuple[np.ndarray, np.ndarray | None]:
    return K.unplanes(body[: 8 * n], "u8"), K.unplanes(body[8 * n :], check) if check else None


def merged(got: pa.Table, check: str | None):
    """Of rows of one bucket: their blocks in order, the number of hashes of each, the distinct hashes of all, the index of each among them."""
    block, n, body = got["block"].to_numpy(), got["n"].to_numpy(), got["body"].to_pylist()
    order = np.argsort(block, kind="stable")
    parts = [unpack(body[i], int(n[i]), check) for i in order]
    h, c, index = distinct(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]) if check else None)
    return block[order], n[order], h, c, index


def met(n: np.ndarray, index: np.ndarray, earlier: bool) -> np.ndarray:
    """Which hashes of each block, n of each, occur in an earlier block (or, if not `earlier`, in any other block)."""
    if not earlier:
        return np.bincount(index)[index] > 1
    at = np.repeat(np.arange(len(n)), n)
    first = np.full(int(index.max()) + 1, len(n))
    np.minimum.at(first, index, at)
    return first[index] < at


def replies(block: np.ndarray, bucket: int, kind: int, n: np.ndarray, bits: np.ndarray) -> pa.Table:
    out, i = [], 0
    for b, m in zip(block.tolist(), n.tolist(), strict=True):
        if bits[i : i + m].any():
            out.append((b, bucket, kind, m, np.packbits(bits[i : i + m]).tobytes()))
        i += m
    return rows(out)


def answer(got: pa.Table, check: str | None, earlier: bool, kind: int = 1) -> pa.Table:
    """One bucket: which hashes of each block occur in an earlier block (or, if not `earlier`, in any other block)."""
    block, n, _, _, index = merged(got, check)
    return replies(block, got["bucket"][0].as_py(), kind, n, met(n, index, earlier))


def told(answers: pa.Table, h: np.ndarray, buckets: int, kind: int = 1, within: tuple[int, int] | None = None) -> np.ndarray:
    """The bits for the block's sorted distinct hashes, from the rows that came back."""
    low, high = within or (0, buckets)
    bits = np.zeros(len(h), bool)
    if answers.num_rows:
        cut = np.searchsorted(bucket_of(h, buckets), np.arange(low, high + 1))
        for b, k, n, body in zip(*(answers[x].to_pylist() for x in ("bucket", "kind", "n", "body")), strict=True):
            if k == kind:
                assert cut[b - low + 1] - cut[b - low] == n, "a block was rebuilt differently"
                bits[cut[b - low] : cut[b - low + 1]] = np.unpackbits(np.frombuffer(body, np.uint8), count=n).astype(bool)
    return bits


def relayed(sent: DataFrame, fine: int, up, between, down) -> DataFrame:
    """What the blocks get back for the rows they sent: straight from `between`, a function of a bucket's rows, or by relays. up: rows of a
    group in a coarse bucket -> rows for fine buckets, with the group as their block; down: the same rows and the answers -> rows for blocks."""
    if fine == 1:
        return sent.groupBy("bucket").applyInArrow(between, SENT)
    sent = sent.withColumn("group", F.expr(f"cast(block div {fine} as int)"))
    back = sent.groupBy("group", "bucket").applyInArrow(up, SENT).groupBy("bucket").applyInArrow(between, SENT)
    back = back.withColumn("coarse", F.expr(f"cast(bucket div {fine} as int)"))
    return sent.groupBy("group", "bucket").cogroup(back.groupBy("block", "coarse")).applyInArrow(down, SENT)


def asked(sent: DataFrame, buckets: int, fine: int, check: str | None, earlier: bool, kind: int = 1) -> DataFrame:
    """The answers to the hashes that blocks sent to `buckets` buckets (see levels and answer)."""

    def span(got: pa.Table) -> tuple[int, tuple[int, int]]:
        b = got["bucket"][0].as_py()
        return b, (b * fine, (b + 1) * fine)

    def up(got: pa.Table) -> pa.Table:
        _, _, h, c, _ = merged(got, check)
        return rows(send(got["group"][0].as_py(), h, c, buckets * fine, span(got)[1]))

    def down(got: pa.Table, answers: pa.Table) -> pa.Table:
        if not got.num_rows:
            return rows([])
        b, within = span(got)
        block, n, h, _, index = merged(got, check)
        return replies(block, b, kind, n, met(n, index, earlier) | told(answers, h, buckets * fine, kind, within)[index])

    return relayed(sent, fine, up, lambda got: answer(got, check, earlier, kind), down)

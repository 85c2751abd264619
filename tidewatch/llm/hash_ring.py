"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has `vnodes` places on a ring of 2**63 positions; a row belongs to the next place clockwise of the hash of its id and its text's
checksum, so that rows of one id are spread. A shard holds
at most its bound, an even share of the rows (shares differ by one at most); rows that overflow a full shard continue clockwise to the next
place whose shard has room. So counts are at most one apart, and most rows stay at the shard of their own arc: only overflow moves.

The rows of an arc are one window partition; the number of places grows with the table so that an arc holds about 500,000 rows. Only counts
of arcs come to the driver (one number for each place). Groups of equal texts are spread by their ids. Slots follow the ring, or with
`in_order` the order of given columns, whose ranks are counted in chunks, so that no shard is one window partition.

Null texts have 8 bytes; null ids are hashed like a value. Rows equal in id and text share an arc and get slots of their own. Only id and text are
read, other columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

ARC_ROWS = 500_000


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the places in ascending order, and their shards."""
    at = [(int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") >> 1, s) for s in range(shards) for v in range(vnodes)]
    at.sort()
    return np.array([a for a, _ in at], np.int64), np.array([s for _, s in at], np.int32)


def plan(counts: list[int], owner: list[int], shards: int) -> list[tuple[int, int, int, int]]:
    """Segments (arc, first rank, shard, first slot) of the arcs' ranked rows under bounded loads."""
    n = sum(counts)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    filled, out, over = [0] * shards, [], []

    def put(arc: int, rank: int, rows: int, s: int) -> None:
        out.append((arc, rank, s, filled[s]))
        filled[s] += rows

    for arc, (c, s) in enumerate(zip(counts, owner, strict=True)):
        own = min(c, room[s] - filled[s])
        if own:
            put(arc, 0, own, s)
        if c > own:
            over.append((arc, own, c - own))
    m = len(owner)
    after = list(range(m))  # the next place from here on whose shard has room

    def free(p: int) -> int:
        path = []
        while filled[owner[p]] >= room[owner[p]]:
            path.append(p)
            after[p] = (p + 1) % m if after[p] == p else after[p]
            p = after[p]
        for x in path:
            after[x] = p
        return p

    for arc, rank, rows in over:
        p = arc
        while rows:
            p = free(p)
            s = owner[p]
            k = min(rows, room[s] - filled[s])
            put(arc, rank, k, s)
            rank, rows = rank + k, rows - k
    return out


def shard(docs: DataFrame, shards: int = 24, vnodes: int = 128, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard; and the columns in `keep`."""
    spark = ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *(F.struct(*keep).alias("kept_columns") for _ in [0] if keep))
    n = docs.count()
    vnodes = max(vnodes, -(-n // (shards * ARC_ROWS)))
    at, owner = ring(shards, vnodes)

    @F.pandas_udf("int")
    def arc(h: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(at, h.to_numpy(), "left") % len(at)).astype(np.int32))

    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32"), 1)
    own = own.withColumn("place", place).withColumn("arc", arc("place"))
    counted = {r["arc"]: r["count"] for r in own.groupBy("arc").count().collect()}
    segments: dict[int, list] = {}
    for a, rank, s, slot in plan([counted.get(i, 0) for i in range(len(at))], owner.tolist(), shards):
        segments.setdefault(a, []).append((rank, s, slot))
    table = spark.createDataFrame([(a, sorted(x)) for a, x in segments.items()], "arc int, parts array<struct<rank:long,shard:int,slot:long>>")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("arc").orderBy("place", "doc_id", "text_crc32", "size")).cast("long") - 1)
    part = F.element_at(F.filter("parts", lambda p: p["rank"] <= F.col("rank")), -1)
    out = ranked.join(table, "arc").withColumn("part", part)
    more = [F.col(f"kept_columns.{c}").alias(c) for c in keep or []]
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("part.shard").alias("shard"), (F.col("part.slot") + F.col("rank") - F.col("part.rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *more)


def in_order(placed: DataFrame, chunk: list[str], order: list[str]) -> DataFrame:
    """placed with `slot` numbered anew within each shard, by (chunk..., order...). A chunk's rows of one shard are one window partition; only
    counts of chunks are ordered as a whole."""
    counts = placed.groupBy("shard", *chunk).agg(F.count("*").alias("__rows"))
    before = Window.partitionBy("shard").orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("__shard"), *[F.col(c).alias(f"__{c}") for c in chunk], F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    on = F.col("shard") == F.col("__shard")
    for c in chunk:
        on &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    own = Window.partitionBy("shard", *chunk).orderBy(*order)
    ranked = placed.withColumn("__rank", F.row_number().over(own).cast("long") - 1).join(starts, on)
    return ranked.withColumn("slot", F.col("__start") + F.col("__rank")).select(*placed.columns)

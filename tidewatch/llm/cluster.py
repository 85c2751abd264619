"""How the operators use the cluster: shared folder, blocks of documents by id, written tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship, written

__all__ = ["blocked", "shared_dir", "ship", "table", "written"]

BLOCK_BYTES, MOST_BLOCKS = 8 << 20, 65536  # blocks of 8 MB of text; beyond that many of them blocks grow, up to LARGEST
LARGEST = 64 << 20
SAMPLES = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def blocked(docs: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """The docs that have a key, with a column `block`: ranges of `key` of about equal bytes in ascending order, so a smaller block holds smaller
    keys; rows of one key share a block. Bounds are quantiles of a sample of keys in proportion to the bytes of their rows, SAMPLES a block; they
    are at most MOST_BLOCKS .. bytes / LARGEST numbers."""
    ship(docs.sparkSession)
    own = docs.where(F.col(key).isNotNull())
    bytes_ = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 32
    size, rows = own.agg(F.sum(bytes_), F.count("*")).first()
    size = size or 0
    n = int(min(max(16, -(-size // block_bytes)), max(MOST_BLOCKS, -(-size // LARGEST)), max(1, rows)))
    bounds = []
    if n > 1:
        unit = max(1, size // (SAMPLES * n))
        times = F.floor((bytes_ + F.pmod(F.xxhash64(F.lit(3), key, bytes_), F.lit(unit))) / unit).cast("int")
        drawn = own.select(key, times.alias("__t")).where("__t > 0").select(key, F.explode(F.sequence(F.lit(1), "__t")))
        got = drawn.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 20 * n)).first()[0] or []
        bounds = sorted({int(b) for b in got})
    edges = np.asarray(bounds, np.int64)

    @F.pandas_udf("int")
    def block(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), "left").astype(np.int32))

    return own.withColumn("block", block(F.col(key).cast("long"))), len(bounds) + 1

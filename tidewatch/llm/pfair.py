"""Mixing sources to target weights by Pfair scheduling, with DataFrame and SQL functions only.

Each source has an integer share; its weight is share / (sum of shares). Its rows, in an order mixed by hash, form blocks of `block_rows`.
Block k of a source of weight w is released at slot floor(k / w) and due by slot ceil((k + 1) / w); among the released blocks the one with the
earliest deadline goes first. So after any number of slots each source has had its weight's worth of blocks to within less than one block.

The schedule repeats after H = sum of shares slots, so one period is computed, by a fold in SQL. When a source has no block left, a new epoch
starts with the remaining sources, whose weights are scaled up: no row is dropped, and the bound holds within each epoch. Only counts of
sources come to the driver; the plan has (sources * epochs) rows. Rows are numbered within hash buckets of a source and shifted by the counts
of the buckets before, so a source with a third of all rows is no window of its own.

A null source counts as the empty name. Rows of null or repeated ids are spread and ordered by the hash of their other columns; equal rows
get places of their own. All
columns of the input stay; clashing names are set aside in a struct. Sources without a share get share 1. Empty table: empty result.
"""

from __future__ import annotations

from math import gcd, isqrt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKET_ROWS, PLAN_ROWS = 50_000, 200_000  # a plan of more rows than that is joined without a broadcast


def period(spark: SparkSession, shares: list[int]) -> list[int]:
    """Earliest-deadline-first over one period: the source of each of the sum(shares) slots."""
    h, n = sum(shares), len(shares)
    a = "array(" + ",".join(map(str, shares)) + ")"
    step = isqrt(h - 1) + 1  # slots are gathered in parts of that many, since each slot copies the part that it is added to
    sql = f"""
    SELECT aggregate(sequence(0, {h - 1}, {step}), named_struct('next', array_repeat(0, {n}), 'parts', CAST(array() AS array<array<int>>)),
      (p, t0) -> aggregate(sequence(t0, least(t0 + {step}, {h}) - 1), named_struct('next', p.next, 'slots', CAST(array() AS array<int>)),
        (s, t) -> transform(array(array_min(transform(
            filter(sequence(0, {n - 1}), i -> s.next[i] < {a}[i] AND s.next[i] * {h}L div {a}[i] <= t),
            i -> named_struct('due', ((s.next[i] + 1) * {h}L + {a}[i] - 1) div {a}[i], 'i', i))).i),
          c -> named_struct('next', transform(s.next, (x, i) -> IF(i = c, x + 1, x)), 'slots', concat(s.slots, array(c))))[0],
        s -> named_struct('next', s.next, 'parts', concat(p.parts, array(s.slots)))),
      p -> flatten(p.parts)) AS slots"""
    return list(spark.sql(sql).first()["slots"])


def epochs(spark: SparkSession, blocks: dict[str, int], shares: dict[str, int]) -> list[tuple]:
    """(source, epoch, first block, end block, first slot, period, share, slots of the share's blocks within a period)."""
    left, done, slot, out, epoch = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, [], 0
    while left:
        names = sorted(left)
        g = gcd(*(shares.get(s, 1) for s in names))
        a = [shares.get(s, 1) // g for s in names]
        h, order = sum(a), period(spark, a)
        where = [[t for t, c in enumerate(order) if c == i] for i in range(len(names))]
        whole = min(left[s] // x for s, x in zip(names, a, strict=True))
        if whole:
            taken, length = [whole * x for x in a], whole * h
        else:  # part of a period: up to the slot of a block that isn't there
            length = min(w[left[s]] for s, w in zip(names, where, strict=True) if left[s] < len(w))
            taken = [sum(t < length for t in w) for w in where]
        for s, x, w, k in zip(names, a, where, taken, strict=True):
            if k:
                out.append((s, epoch, done[s], done[s] + k, slot, h, x, w))
            done[s] += k
            left[s] -= k
        left = {s: n for s, n in left.items() if n}
        slot, epoch = slot + length, epoch + 1
    return out


def mix(docs: DataFrame, shares: dict[str, int] | None = None, block_rows: int = 16, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The input's columns in a struct `row`, and source, epoch, block, slot, mix_pos (gapless from 0)."""
    spark = docs.sparkSession
    hashed = [F.col(c) for c, kind in docs.dtypes if c != id_col and "map<" not in kind and "variant" not in kind]
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.xxhash64(F.lit(9), F.col(id_col), *hashed).alias("h"))
    most = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    nb = max(64, -(-most // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(nb)).cast("int"))
    counts = rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    shifts = counts.withColumn("shift", F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("source", "bucket", F.coalesce("shift", F.lit(0)).alias("shift"))
    totals = {r["source"]: r["n"] for r in counts.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    blocks = {s: -(-n // block_rows) for s, n in totals.items()}
    planned = epochs(spark, blocks, shares or {})
    kinds = "array<struct<source:string,epoch:int,k0:bigint,k1:bigint,slot0:bigint,period:bigint,share:bigint,slots:array<bigint>>>"
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    items = [f"struct({quote(s)},{e},{k0},{k1},{x},{h},{a},array({','.join(map(str, w))}))" for s, e, k0, k1, x, h, a, w in planned]
    plan = spark.sql(f"SELECT p.* FROM (SELECT explode(CAST(array({','.join(items)}) AS {kinds})) AS p)").withColumnRenamed("source", "of")
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("h", F.col(f"row.{id_col}"))).cast("long") - 1).join(shifts, ["source", "bucket"])
    rank = F.col("n") + F.col("shift")
    placed = ranked.select("row", "source", (rank / block_rows).cast("long").alias("block"), (rank % block_rows).alias("inner"))
    on = (F.col("source") == F.col("of")) & (F.col("block") >= F.col("k0")) & (F.col("block") < F.col("k1"))
    step = F.col("block") - F.col("k0")
    slot = F.col("slot0") + F.floor(step / F.col("share")) * F.col("period") + F.element_at("slots", (step % F.col("share") + 1).cast("int"))
    out = placed.join(F.broadcast(plan) if len(planned) <= PLAN_ROWS else plan, on).withColumn("slot", slot)
    short = {s: block_rows * blocks[s] - n for s, n in totals.items() if n % block_rows}  # a source's last block may be short
    last = {}
    for s, _, k0, k1, x, h, a, w in planned:
        if k1 == blocks[s]:
            j = k1 - 1 - k0
            last[s] = x + j // a * h + w[j % a]
    gaps = "array(" + ",".join(f"struct({last[s]}L,{m}L)" for s, m in short.items()) + ")" if short else None
    missing = F.expr(f"aggregate({gaps}, 0L, (acc, g) -> acc + IF(g.col1 < slot, g.col2, 0L))") if gaps else F.lit(0)
    return out.select("row", "source", "epoch", "block", F.col("slot").cast("long").alias("slot"), (F.col("slot") * block_rows + F.col("inner") - missing).cast("long").alias("mix_pos"))

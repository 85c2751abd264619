"""Near-duplicate documents: MinHash LSH forest, links confirmed on full shingle sets, connected components.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A document's set is its distinct 5-word shingles (64-bit hashes); with fewer words the
whole sequence is its one shingle; without words it is empty and linked with nothing. Two documents are linked if
100 * intersection >= percent * union.

1. Sets. Each text gives its set's size, a 128-bit digest of the set, and `trees * depth` minhashes. Equal sets become one node, named by
   their smallest id, by a combining aggregate; copies are never paired.
2. Forest. Each tree orders all nodes by its `depth` minhashes (a range-partitioned sort, so a huge region of equal prefixes is spread over
   many tasks). Candidates are neighbours in that order: the depth adapts to the region, going down until at most `leaf` nodes share the
   prefix, and all of these are candidates; in regions which stay larger at full depth, and between leaves, each node is compared with its
   nearest neighbours by common prefix. Candidates per node are at most trees * leaf, whatever the group size.
   A bit sketch and the set sizes drop candidates that are far below the threshold (six standard deviations).
3. Links. Candidates are confirmed on the full sets.
4. Components. Alternating large-star and small-star contraction, each round a written table.
5. The rest. Whatever the limits of step 2 left out is compared: regions of SHALLOW equal values that still hold several components.
   In one of at most `leaf` nodes, these are pairs that a border between tasks parted. In a larger one each node outside the main component
   meets, in the first tree that they share, all nodes of other components, block by block, on full sets; of the links found a block
   returns those that join components, so its output is no larger than its input. After this no two nodes of different components that
   share a prefix stay uncompared. Regions of one component cost nothing.

A pair at the threshold shares no 4-value prefix in any of 20 trees with probability 4e-7 (85 percent) or 3e-5 (80 percent).
Null texts are empty. Null ids: component null, kept. Repeated rows and ids are linked like other copies. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import kernels as K
from .cluster import written

TREES, DEPTH, SHALLOW, LEAF, NEAR = 20, 8, 4, 8, 1
WINDOW_ROWS = 100_000
SIDE, NODE = 1 << 19, 100  # of step 5: shingles on each side of a block, where a node counts as NODE more
_rng = np.random.default_rng(77)
MULT = (_rng.integers(1, 2**31, TREES * DEPTH, dtype=np.uint64) * 2 + 1).astype(np.uint32)
ADD = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def shingle_sets(column, width: int = 5):
    """The sorted distinct shingle hashes of each text."""
    buf, offs = K.flat(column)
    for i, j in K.chunks(offs):
        part = K.LOWER[buf[offs[i] : offs[j]]]
        s, e, first = K.words(part, offs[i : j + 1] - offs[i])
        codes = K.word_codes(part, s, e)
        h = K.runs_of(codes, width)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(h[a : b - width + 1])
            elif b > a:
                yield K.runs_of(codes[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minhashes as uint32, a row for each non-empty set."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), len(MULT)), np.uint32)
    v = np.empty_like(flat)
    for k, (a, b) in enumerate(zip(MULT, ADD, strict=True)):
        np.multiply(flat, a, out=v)
        np.add(v, b, out=v)
        out[:, k] = np.minimum.reduceat(v, at)
    return out * np.uint32(0x9E3779B1)  # spreads the minima over all bits


NODES = "doc_id long, n_shingles long, digest binary, sig binary, sketch binary"


def describe(width: int):
    def of(batches):
        for batch in batches:
            ids, group, out = batch.column(0).to_pylist(), [], []

            def flush(group=group, out=out):
                some = [s for s in group if len(s)]
                sig = signatures(some) if some else np.zeros((0, len(MULT)), np.uint32)
                key = (sig >> np.uint32(16)).astype(">u2")
                bits = np.packbits(((sig >> np.uint32(15)) & np.uint32(1)).astype(np.uint8), axis=1)
                k = 0
                for s in group:
                    if len(s):
                        out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), key[k].tobytes(), bits[k].tobytes()))
                        k += 1
                    else:
                        out.append((0, None, None, None))
                group.clear()

            total = 0
            for s in shingle_sets(batch.column(1), width):
                group.append(s)
                total += len(s)
                if total > 200_000:
                    flush()
                    total = 0
            flush()
            n, d, g, b = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.binary()), pa.array(g, pa.binary()), pa.array(b, pa.binary())], ["doc_id", "n_shingles", "digest", "sig", "sketch"])

    return of


def far_bits(percent: int) -> int:
    """Most differing sketch bits of a pair at the threshold, with six standard deviations."""
    n, p = TREES * DEPTH, (1 - percent / 100) / 2
    return int(n * p + 6 * (n * p * (1 - p)) ** 0.5) + 1


def neighbours(percent: int):
    """Over rows sorted by (tree, key): pairs of nodes to compare."""
    most = far_bits(percent)

    def pairs(tree, key, node, size, sketch):
        n = len(node)
        same = np.zeros((n, DEPTH + 1), bool)  # row i and the row before share a prefix of d values
        same[1:, 0] = tree[1:] == tree[:-1]
        for d in range(DEPTH):
            same[1:, d + 1] = same[1:, d] & (key[1:, d] == key[:-1, d])
        left, right = [], []

        def keep(i, j):
            if not len(i):
                return
            ok = (node[i] != node[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
            i, j = i[ok], j[ok]
            ok = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1) <= most
            i, j = i[ok], j[ok]
            left.append(np.minimum(node[i], node[j]))
            right.append(np.maximum(node[i], node[j]))

        leaf = np.full(n, DEPTH + 1)  # the shallowest depth at which at most LEAF rows share the prefix
        for d in range(DEPTH, SHALLOW - 1, -1):
            region = np.cumsum(~same[:, d]) - 1
            leaf[np.bincount(region)[region] <= LEAF] = d
        common = np.full(n, DEPTH)  # depth that row i shares with the row `step` before
        lcp = same.sum(axis=1) - 1
        for step in range(1, LEAF):
            if step >= n:
                break
            common = np.minimum(common[1:], lcp[1 : n - step + 1])
            j = np.arange(step, n)
            i = j - step
            ok = (common >= leaf[j]) | ((common >= SHALLOW) & (step <= NEAR))
            keep(i[ok], j[ok])
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            both = np.unique(np.stack((a, b), axis=1), axis=0)
            return both[:, 0], both[:, 1]
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(batches):
        kept: list = []
        waiting = 0

        def run():
            nonlocal kept, waiting
            t = pa.Table.from_batches(kept).combine_chunks()
            n = t.num_rows
            raw = lambda c, w, kind: np.frombuffer(K.flat(t[c])[0], np.uint8).reshape(n, w).view(kind)
            a, b = pairs(t["tree"].to_numpy(), raw("key", 2 * DEPTH, ">u2"), t["node"].to_numpy(), t["n_shingles"].to_numpy(), raw("sketch", TREES * DEPTH // 8, np.uint8))
            tail = t.slice(max(0, n - LEAF))
            kept, waiting = tail.to_batches(), 0
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
                waiting += batch.num_rows
                if waiting >= WINDOW_ROWS:
                    yield run()
        if waiting:
            yield run()

    return of


def candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b), a < b. nodes: node, n_shingles, sig, sketch."""
    spark = nodes.sparkSession
    trees = nodes.select("node", "n_shingles", "sketch", F.posexplode(F.array(*[F.substring("sig", 2 * DEPTH * t + 1, 2 * DEPTH) for t in range(TREES)])).alias("tree", "key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = trees.repartitionByRange(parts, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    return ordered.mapInArrow(K.tidy(neighbours(percent)), "a long, b long").distinct()


def least_equal(percent: int) -> int:
    """Fewest equal minhashes of a pair at the threshold, with six standard deviations."""
    n, p = TREES * DEPTH, percent / 100
    return int(n * p - 6 * (n * p * (1 - p)) ** 0.5)


def crowded(nodes: DataFrame) -> DataFrame:
    """Nodes in regions of several components, for each tree: tree, prefix, main (component), n (nodes), left and right (blocks), node, comp."""
    prefixes = F.array(*[F.substring("sig", 2 * DEPTH * t + 1, 2 * SHALLOW) for t in range(TREES)])
    placed = nodes.select("node", "comp", "n_shingles", F.posexplode(prefixes).alias("tree", "prefix"))
    counts = placed.groupBy("tree", "prefix", "comp").agg(F.count("*").alias("n"), F.sum(F.col("n_shingles") + NODE).alias("weight"))
    regions = counts.groupBy("tree", "prefix").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.max("weight").alias("most"), F.max_by("comp", F.struct("weight", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda w: F.ceil(w / SIDE).cast("int")
    regions = written(regions.select("tree", "prefix", "main", "n", blocks(F.col("weight") - F.col("most")).alias("left"), blocks(F.col("weight")).alias("right")))
    return written(placed.drop("n_shingles").join(regions, ["tree", "prefix"]))


def parted(members: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of different components in regions of at most LEAF nodes."""
    small = members.where(F.col("n") <= LEAF)
    a = small.select("tree", "prefix", F.col("node").alias("a"), F.col("comp").alias("comp_a"))
    b = small.select("tree", "prefix", F.col("node").alias("b"), F.col("comp").alias("comp_b"))
    return a.join(b, ["tree", "prefix"]).where("a < b and comp_a <> comp_b").select("a", "b").distinct()


def meeting(percent: int):
    """Links of one block that join components."""
    most, fewest = far_bits(percent), least_equal(percent)

    def of(block):
        raw = lambda c, kind: np.frombuffer(K.flat(block[c].combine_chunks())[0], kind).reshape(block.num_rows, -1)
        node, comp, size, main, tree = block["node"].to_numpy(), block["comp"].to_numpy().copy(), block["n_shingles"].to_numpy(), block["main"][0].as_py(), block["tree"][0].as_py()
        sketch, sig = raw("sketch", np.uint8), raw("sig", np.uint16)
        told, minor = block["told"].to_numpy(), block["comp"].to_numpy() != main
        body, offs = K.flat(block["shingles"].combine_chunks())
        names, code = np.unique(body.view(np.uint64), return_inverse=True)
        offs, mine, links = offs // 8, np.zeros(len(names), bool), []
        for i in np.flatnonzero(block["asks"].to_numpy()):
            j = np.flatnonzero(told & (comp != comp[i]) & (~minor | (node < node[i])) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])))
            j = j[np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1) <= most]
            equal = sig[j] == sig[i]
            before = equal.reshape(len(j), TREES, DEPTH)[:, :tree, :SHALLOW].all(axis=2).any(axis=1)
            j = j[(equal.sum(axis=1) >= fewest) & ~before]
            if not len(j):
                continue
            n = offs[j + 1] - offs[j]
            start = np.cumsum(n) - n
            own = code[offs[i] : offs[i + 1]]
            mine[own] = True
            both = np.add.reduceat(mine[code[np.repeat(offs[j] - start, n) + np.arange(n.sum())]], start, dtype=np.int64)
            mine[own] = False
            for k in j[100 * both >= percent * (size[i] + size[j] - both)]:
                if comp[k] != comp[i]:
                    links.append((min(node[i], node[k]), max(node[i], node[k])))
                    comp[comp == comp[k]] = comp[i]
        K.trim()
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return of


def unmet(members: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b), a < b, that join components in regions of more than LEAF nodes."""
    large = members.where(F.col("n") > LEAF)
    full = full_sets(large.select("node").distinct().join(nodes.select("node", "digest"), "node"), docs, width)
    large = large.join(nodes.select("node", "n_shingles", "sig", "sketch").dropDuplicates(["node"]), "node").join(full, "node")
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one, minor, yes, no = F.greatest("left", "right") == 1, F.col("comp") != F.col("main"), F.lit(True), F.lit(False)
    sides = [
        large.where(one).withColumns({"l": F.lit(0), "r": F.lit(0), "asks": minor, "told": yes}),
        large.where(~one & minor).withColumns({"l": own(F.col("left")), "asks": yes, "told": no}).withColumn("r", every("right")),
        large.where(~one).withColumns({"r": own(F.col("right")), "asks": no, "told": yes}).withColumn("l", every("left")),
    ]
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2])
    return rows.groupBy("tree", "prefix", "l", "r").applyInArrow(meeting(percent), "a long, b long").distinct()


def compare(percent: int):
    def of(batches):
        for batch in batches:
            xs, ys = batch.column(2), batch.column(3)
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(xs[i].as_buffer(), np.uint64), np.frombuffer(ys[i].as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both) and both > 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    return of


def full_sets(wanted: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the wanted nodes (node, digest), built again from their texts."""

    def sets(batches):
        for batch in batches:
            ids, want = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows = [(i, s.tobytes()) for i, s, w in zip(ids, shingle_sets(batch.column(1), width), want, strict=True) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == w]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["node", "shingles"])

    return docs.join(wanted, docs["doc_id"] == wanted["node"]).select("node", "text", "digest").mapInArrow(K.tidy(sets), "node long, shingles binary").dropDuplicates(["node"])


def confirm(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs that are links by their full sets, which are built again from the texts of paired nodes only."""
    paired = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "digest"), "node")
    spark = docs.sparkSession
    found = written(full_sets(paired, docs, width))
    a = found.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    b = found.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")  # a row holds two sets
    try:
        return written(pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(K.tidy(compare(percent)), "a long, b long"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def components(links: DataFrame, id_a: str = "a", id_b: str = "b") -> DataFrame:
    """(node, comp): the smallest node reachable; nodes without links are left out. Each round is a written table; rounds grow with the
    logarithm of a component's size."""
    edges = links.select(F.greatest(id_a, id_b).alias("u"), F.least(id_a, id_b).alias("v")).where("u <> v").distinct()
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        edges = written(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        seen = now


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = written(own.mapInArrow(K.tidy(describe(width)), NODES))
    some = described.where("digest is not null and doc_id is not null")
    first = some.groupBy("digest").agg(F.min("doc_id").alias("node"))
    nodes = some.withColumn("node", F.col("doc_id")).join(first, ["digest", "node"]).dropDuplicates(["node", "digest"]).select("node", "digest", "n_shingles", "sig", "sketch")
    nodes = written(nodes)
    tested = written(candidates(nodes, percent))
    links = confirm(tested, own, nodes, percent, width)
    comps = components(links)
    placed = written(nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    members = crowded(placed)
    more = written(parted(members).join(tested, ["a", "b"], "left_anti"))
    found = written(unmet(members, placed, own, percent, width).union(confirm(more, own, nodes, percent, width)))
    if not found.isEmpty():
        comps = components(links.union(found))
    # written, so that the next join reads two plain exchanges, of which Spark splits the partition of a digest with very many copies
    named = written(first.join(comps, "node", "left").select("digest", F.coalesce("comp", "node").alias("component_id")))
    out = described.where("digest is not null").join(named, "digest", "left").select("doc_id", "n_shingles", "component_id")
    out = out.union(described.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))

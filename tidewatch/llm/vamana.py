"""Approximate nearest neighbours by cosine: a robust-pruned directed graph for each shard, searched by beams.

Vectors are dealt to shards of about `shard_rows` by hash of their id. Each shard builds a graph in the manner of Vamana: vectors enter in
batches; a greedy beam search on the graph so far proposes neighbours of each; robust pruning keeps the nearest candidate and drops those
that it is closer to, relaxed by `alpha`, so edges stay diverse; back edges are added and pruned alike. A second pass repeats this on the full
graph. A query walks every shard's graph with a beam; the found vectors are scored again in double precision on the original vectors, and the
`k` best of all shards are returned, nearest first, ties to the smaller id.

Vectors of one direction (equal or scaled ones, to within `SAME`) are one node of a shard's graph: pruning keeps no edges between copies. A node
found stands for all its rows; those that can be among the k best are scored. Of rows of one and the same vector these are at most 2k.

Queries are sent in blocks to the shards as rows of a join on (shard, block); a task holds one shard's graph and one block. Every row
is indexed. Vectors that are null, zero, or hold null or non-finite components take no part; nor do rows of null id. Rows of one id: each is a
candidate of its own, and none is a candidate for a query of that id. Vectors of a length other than the most common one take no part.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .cluster import written

SHARD_ROWS, DEGREE, BEAM, ALPHA, BLOCK_ROWS, QUERY_BEAM = 4096, 32, 64, 1.2, 4096, 128
SAME = 1e-6  # distance of unit vectors: above the rounding of scaled 32-bit components, far above that of squared distances in double precision
PAIR_BYTES = 16 << 20  # vectors scored at once
PRUNED = 64  # nodes pruned at once


def beam_search(unit: np.ndarray, graph: np.ndarray, queries: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Beams of all queries at once: (nodes, similarities), best first; -1 where a beam isn't full. graph: -1 where a node has no edge."""
    q, n = len(queries), len(unit)
    rows = np.arange(q)
    beam = np.full((q, width), -1, np.int64)
    sim = np.full((q, width), -np.inf)
    k = min(width, len(starts))
    beam[:, :k] = starts[:k]
    sim[:, :k] = queries @ unit[starts[:k]].T
    done = np.zeros((q, width), bool)
    seen = np.zeros((q, n), bool)
    seen[:, starts[:k]] = True
    while True:
        open_ = np.where(done | (beam < 0), -np.inf, sim)
        best = open_.argmax(axis=1)
        live = np.flatnonzero(open_[rows, best] > -np.inf)
        if not len(live):
            break
        b = best[live]
        done[live, b] = True
        near = graph[beam[live, b]]
        ok = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(ok)
        if not len(r):
            continue
        node = near[r, c]
        seen[live[r], node] = True
        s = np.full(near.shape, -np.inf)
        s[r, c] = np.einsum("ij,ij->i", queries[live[r]], unit[node])
        both = np.concatenate((sim[live], s), axis=1)
        names = np.concatenate((beam[live], np.where(ok, near, -1)), axis=1)
        marks = np.concatenate((done[live], np.zeros(near.shape, bool)), axis=1)
        top = np.argpartition(-both, width - 1, axis=1)[:, :width]
        at = np.arange(len(live))[:, None]
        sim[live], beam[live], done[live] = both[at, top], names[at, top], marks[at, top]
    order = np.argsort(-sim, axis=1, kind="stable")
    return np.take_along_axis(beam, order, axis=1), np.take_along_axis(sim, order, axis=1)


def robust_prune(unit: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Edges of each node from its candidates (rows, -1 for none): diverse ones by relaxed distance pruning, at most `degree`."""
    c = candidates.copy()
    c[c == nodes[:, None]] = -1
    c.sort(axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    c.sort(axis=1)
    c = c[:, (c >= 0).any(axis=0)]
    if not c.shape[1]:
        return np.full((len(nodes), degree), -1, np.int64)
    vectors = unit[np.maximum(c, 0)]
    own = 2 - 2 * np.einsum("ijk,ik->ij", vectors, unit[nodes])  # squared distances
    own[c < 0] = np.inf
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    near = alpha * alpha * (2 - 2 * (vectors @ vectors.transpose(0, 2, 1)))  # between candidates, relaxed
    for k in range(degree):
        best = own.argmin(axis=1)
        ok = own[rows, best] < np.inf
        if not ok.any():
            break
        out[ok, k] = c[rows, best][ok]
        own[near[rows, best] <= own] = np.inf
        own[rows, best] = np.inf
    return out


def build(unit: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 1, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(graph, start nodes) of one shard."""
    n = len(unit)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    graph = np.full((n, degree), -1, np.int64)
    centre = int((unit @ unit.mean(axis=0)).argmax())
    starts = np.unique(np.append(order[: min(n, 4)], centre))

    def link(nodes: np.ndarray, prune: float, pool: np.ndarray | None) -> None:
        found = beam_search(unit, graph, unit[nodes], starts, beam)[0] if pool is None else np.broadcast_to(pool, (len(nodes), len(pool)))
        for i in range(0, len(nodes), PRUNED):
            mine = nodes[i : i + PRUNED]
            graph[mine] = robust_prune(unit, mine, np.concatenate((found[i : i + PRUNED], graph[mine]), axis=1), degree, prune)
        a, b = np.repeat(nodes, degree), graph[nodes].ravel()
        a, b = a[b >= 0], b[b >= 0]
        o = np.argsort(b, kind="stable")
        a, b = a[o], b[o]
        targets, first, count = np.unique(b, return_index=True, return_counts=True)
        o = np.argsort(count, kind="stable")  # targets of about as many back edges are pruned together
        targets, first, count = targets[o], first[o], count[o]
        for i in range(0, len(targets), PRUNED):  # back edges
            t, f, m = targets[i : i + PRUNED], first[i : i + PRUNED], count[i : i + PRUNED]
            back = np.full((len(t), int(m.max())), -1, np.int64)
            which = np.repeat(np.arange(len(t)), m)
            place = np.arange(m.sum()) - (np.cumsum(m) - m)[which]
            back[which, place] = a[f[which] + place]
            graph[t] = robust_prune(unit, t, np.concatenate((graph[t], back), axis=1), degree, prune)

    first = order[: min(n, 64)]
    link(first, 1.0, first)
    for rest, prune in ((order[64:], 1.0), (order, alpha)):
        i, size = 0, 64
        while i < len(rest):
            link(rest[i : i + size], prune, None)
            i, size = i + size, min(batch, 2 * size)
    return graph, starts


def unit_of(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def leaders(unit: np.ndarray) -> np.ndarray:
    """For each row the row whose direction it shares: itself, or the first one within SAME that shares no other's."""
    lead = np.arange(len(unit))
    axis = np.random.default_rng(1).normal(size=unit.shape[1])
    line = unit @ (axis / np.linalg.norm(axis))  # no farther apart than the vectors are
    o = np.argsort(line, kind="stable")
    for run in np.split(o, np.flatnonzero(np.diff(line[o]) > SAME) + 1):
        rest = np.sort(run)
        while len(rest) > 1:
            same = np.square(unit[rest] - unit[rest[0]]).sum(axis=1) <= SAME * SAME
            same[0] = True
            lead[rest[same]] = rest[0]
            rest = rest[~same]
    return lead


def place_in(*keys: np.ndarray) -> np.ndarray:
    """Place of each row in its run of equal keys."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))


def exact_cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of rows in double precision on the original vectors."""
    return np.einsum("ij,ij->i", q, x) / (np.sqrt(np.einsum("ij,ij->i", q, q)) * np.sqrt(np.einsum("ij,ij->i", x, x)))


SHARD = "shard int, ids binary, vectors binary, nodes binary, graph binary, starts binary"
FOUND = "query_id long, vec_id long, score double"


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return own.where(finite).where(F.exists("v", lambda x: x != 0))


def index(rows: DataFrame, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The index as a written table: a row for each shard with its ids, vectors, their nodes in ascending order, and the graph of the nodes."""
    spark = ship(rows.sparkSession)
    own = valid(rows, id_col, vector_col)
    sizes = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], SHARD)
    dim, n = sizes["d"], sizes["count"]
    shards = max(1, -(-n // shard_rows))
    own = own.where(F.size("v") == dim).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    def of(got: pa.Table) -> pa.Table:
        ids = got["vec_id"].to_numpy()
        v = np.array(got["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
        o = np.lexsort((*v.T[::-1], ids))
        ids, v = ids[o], v[o]
        lead = leaders(unit_of(v))
        o = np.lexsort((ids, *v.T[::-1], lead))  # rows of a node, and of those the rows of one vector, stand together
        ids, v = ids[o], v[o]
        _, first, nodes = np.unique(lead[o], return_index=True, return_inverse=True)
        graph, starts = build(unit_of(v[first]), degree, beam, alpha)
        return pa.table([pa.array([got["shard"][0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, v, nodes.astype(np.int32), graph.astype(np.int32), starts))], ["shard", "ids", "vectors", "nodes", "graph", "starts"])

    return written(own.groupBy("shard").applyInArrow(of, SHARD))


def search(shards: DataFrame, queries: DataFrame, k: int = 5, beam: int = QUERY_BEAM, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found in all shards, its own id left out."""
    ship(queries.sparkSession)
    own = valid(queries, id_col, vector_col)
    n = own.count()
    blocks = max(1, -(-n // block_rows))
    own = own.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def pack(got: pa.Table) -> pa.Table:
        flat = np.array(got["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False))
        sizes = np.diff(np.array(got["v"].combine_chunks().offsets))
        return pa.table([pa.array([got["block"][0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (got["vec_id"].to_numpy(), flat, sizes.astype(np.int64)))], ["block", "q_ids", "q_vectors", "q_sizes"])

    packed = own.groupBy("block").applyInArrow(pack, "block int, q_ids binary, q_vectors binary, q_sizes binary")
    sent = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "block")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c, kind, row=row, batch=batch: np.frombuffer(batch.column(c)[row].as_buffer(), kind)
                ids, graph = get("ids", np.int64), get("graph", np.int32)
                v = get("vectors", np.float64).reshape(len(ids), -1)
                q_ids, sizes, flat = get("q_ids", np.int64), get("q_sizes", np.int64), get("q_vectors", np.float64)
                fits = np.flatnonzero(sizes == v.shape[1])
                if not len(fits):
                    continue
                at = np.cumsum(sizes) - sizes
                q, q_ids = flat[(at[fits][:, None] + np.arange(v.shape[1])).ravel()].reshape(len(fits), -1), q_ids[fits]
                owner, starts = get("nodes", np.int32), get("starts", np.int64)
                g = graph.reshape(owner[-1] + 1, -1).astype(np.int64)
                unit = unit_of(v[np.searchsorted(owner, np.arange(len(g)))])
                vector = np.cumsum(np.append(True, (v[1:] != v[:-1]).any(axis=1) | (owner[1:] != owner[:-1])))
                some = np.flatnonzero(place_in(vector, ids) < k)  # k of each vector and id, then 2k of each vector: k or all without the query's own
                some = some[place_in(vector[some]) < 2 * k]
                ids, v, owner = ids[some], v[some], owner[some]
                at = np.searchsorted(owner, np.arange(len(g) + 1))
                sizes, by_id = np.diff(at), np.sort(ids)
                most = max(1, PAIR_BYTES // (8 * v.shape[1]))
                for i in range(0, len(q), 256):
                    nodes, sim = beam_search(unit, g, unit_of(q[i : i + 256]), starts, max(beam, 2 * k))
                    mine = np.searchsorted(by_id, q_ids[i : i + 256], "right") - np.searchsorted(by_id, q_ids[i : i + 256])
                    held = np.cumsum(np.where(nodes >= 0, sizes[nodes], 0), axis=1) >= k + mine[:, None]
                    floor = np.where(held.any(axis=1), sim[np.arange(len(sim)), held.argmax(axis=1)], -np.inf)
                    # a row is within 2 * SAME of its node's vector, so a node below this has none of the k best
                    r, c = np.nonzero((nodes >= 0) & (sim >= floor[:, None] - 5 * SAME))
                    node = nodes[r, c]
                    part = np.cumsum(np.bincount(r, sizes[node], len(nodes)).astype(np.int64)) // most
                    for p in np.unique(part):
                        here = part[r] == p
                        m = sizes[node[here]]
                        asks = np.repeat(r[here], m)
                        row_of = np.repeat(at[node[here]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                        other = ids[row_of] != q_ids[i + asks]
                        asks, row_of = asks[other], row_of[other]
                        score = exact_cosine(q[i + asks], v[row_of])
                        o = np.lexsort((ids[row_of], -score, asks))
                        asks, row_of, score = asks[o], row_of[o], score[o]
                        best = np.arange(len(asks)) - np.searchsorted(asks, asks) < k
                        asks, row_of, score = asks[best], row_of[best], score[best]
                        yield pa.RecordBatch.from_arrays([pa.array(q_ids[i + asks], pa.int64()), pa.array(ids[row_of], pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])

    found = sent.repartition("shard", "block").select("ids", "graph", "vectors", "nodes", "starts", "q_ids", "q_vectors", "q_sizes").mapInArrow(run, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

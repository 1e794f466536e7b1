"""Approximate nearest neighbours with a robust-pruned directed graph.

Vectors are dealt over shards. In each shard a graph is built: a greedy search from the entry point
proposes neighbours for every vector, and relaxed distance pruning keeps an edge only where no kept
neighbour is much nearer to its end than the vector itself, which leaves diverse, also long edges.
Queries go to every shard in blocks and are answered there by a beam search; the shards' finds are
merged, scored exactly on the original vectors.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelsight.llm.common import stage

#: Vectors of a shard (about), edges of a node, beam while building and searching, relaxation of the pruning.
SHARD_ROWS, DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAXED = 4096, 32, 48, 96, 1.2
#: Queries that visit a shard together.
QUERY_BLOCK = 1024


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def beam_search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int,
                seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of the beam of each query, best first; -1 where it isn't full.

    All queries walk in step: each expands its best node that it hasn't yet. ``seen`` gets the expanded.
    """
    n = len(queries)
    nodes = np.full((n, beam), -1, np.int64)
    best = np.full((n, beam), -np.inf, np.float32)
    done = np.zeros((n, beam), bool)
    nodes[:, 0], best[:, 0] = entry, queries @ points[entry]
    active = np.arange(n)
    while len(active):
        open_ = np.where(done[active] | (nodes[active] < 0), -np.inf, best[active])
        at = open_.argmax(1)
        go = open_[np.arange(len(active)), at] > -np.inf
        active, at = active[go], at[go]
        if not len(active):
            break
        done[active, at] = True
        expanded = nodes[active, at]
        if seen is not None:
            seen.append((active, expanded))
        new = edges[expanded]
        known = (new[:, :, None] == nodes[active][:, None, :]).any(2) | (new < 0)
        near = np.einsum("qkd,qd->qk", points[new], queries[active])
        near[known] = -np.inf
        new = np.where(known, -1, new)
        all_nodes = np.concatenate([nodes[active], new], 1)
        all_best = np.concatenate([best[active], near], 1)
        all_done = np.concatenate([done[active], np.zeros(new.shape, bool)], 1)
        order = np.argsort(-all_best, axis=1, kind="stable")[:, :beam]
        take = lambda x: np.take_along_axis(x, order, 1)
        nodes[active], best[active], done[active] = take(all_nodes), take(all_best), take(all_done)
    return nodes, best


def robust_prune(points: np.ndarray, node: int, candidates: np.ndarray, degree: int, relaxed: float) -> np.ndarray:
    """At most ``degree`` diverse candidates: of two that lie close together only the nearer stays."""
    candidates = np.unique(candidates)
    candidates = candidates[(candidates != node) & (candidates >= 0)]
    away = 2 - 2 * (points[candidates] @ points[node])
    order = np.argsort(away, kind="stable")
    candidates, away = candidates[order], away[order]
    between = 2 - 2 * (points[candidates] @ points[candidates].T)
    alive, kept = np.ones(len(candidates), bool), []
    for i in range(len(candidates)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= relaxed * between[i] > away
    return candidates[kept]


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relaxed: float = RELAXED,
                seed: int = 3) -> tuple[np.ndarray, int]:
    """(edges, entry point) over unit vectors. Batches that double are inserted into what is there."""
    n, rng = len(points), np.random.default_rng(seed)
    edges = np.full((n, degree), -1, np.int64)
    entry = int((points @ points.mean(0)).argmax())
    order = rng.permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        batch = order[at:min(n, at + max(1, min(at, 512)))]
        seen: list = []
        nodes, _ = beam_search(points, edges, entry, points[batch], beam, seen)
        visited = [[] for _ in batch]
        for rows, found in seen:
            for r, f in zip(rows.tolist(), found.tolist(), strict=True):
                visited[r].append(f)
        back: dict[int, list[int]] = {}
        for k, node in enumerate(batch.tolist()):
            kept = robust_prune(points, node, np.append(visited[k], nodes[k]).astype(np.int64), degree, relaxed)
            edges[node, :len(kept)] = kept
            for target in kept.tolist():
                back.setdefault(target, []).append(node)
        for target, sources in back.items():
            old = edges[target][edges[target] >= 0]
            both = np.concatenate([old, sources])
            if len(both) > degree:
                both = robust_prune(points, target, both, degree, relaxed)
            edges[target] = -1
            edges[target, :len(both)] = both
        at += len(batch)
    return edges, entry


def _build(per_vector: int):
    def run(group: pa.Table) -> pa.Table:
        """A shard's index: distinct vectors with the smallest ids of each, their graph."""
        ids = group["vec_id"].to_numpy()
        vectors = np.array(group["embedding"].to_pylist(), np.float64)
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        distinct, of = np.unique(vectors, axis=0, return_inverse=True)
        by_class = np.argsort(of.ravel(), kind="stable")
        starts = np.searchsorted(of.ravel()[by_class], np.arange(len(distinct) + 1))
        owners = [ids[by_class[a:min(b, a + per_vector)]] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        points = _unit(distinct)
        edges, entry = build_graph(points)
        index = {"vectors": distinct, "owners": owners, "edges": edges.astype(np.int32), "entry": entry}
        return pa.table({"shard": [group["shard"][0].as_py()], "index": [pickle.dumps(index)]})
    return run


def _search(k: int, beam: int):
    def run(queries: pa.Table, graphs: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                          "score": pa.array([], pa.float64())})
        if not graphs.num_rows or not queries.num_rows:
            return empty
        index = pickle.loads(graphs["index"][0].as_py())
        vectors, edges, owners = index["vectors"], index["edges"].astype(np.int64), index["owners"]
        points = _unit(vectors)
        ids = queries["query_id"].to_numpy()
        asked = np.array(queries["embedding"].to_pylist(), np.float64)
        lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        out = []
        for a in range(0, len(ids), 256):
            q = asked[a:a + 256]
            nodes, _ = beam_search(points, edges, index["entry"], _unit(q), min(beam, max(len(points), 1)))
            exact = np.einsum("qd,qkd->qk", q, vectors[nodes]) / (
                np.sqrt(np.einsum("ij,ij->i", q, q))[:, None] * lengths[nodes])
            exact = np.where(nodes < 0, -np.inf, exact)
            for i in range(len(q)):
                own = ids[a + i]
                order = np.argsort(-exact[i], kind="stable")
                finds, least = [], -np.inf
                for j in order:
                    if nodes[i, j] < 0 or len(finds) >= k and exact[i, j] < least:
                        break
                    finds += [(own, v, exact[i, j]) for v in owners[nodes[i, j]].tolist() if v != own]
                    if len(finds) >= k and least == -np.inf:
                        least = sorted((-f[2] for f in finds))[k - 1] * -1
                out += sorted(finds, key=lambda f: (-f[2], f[1]))[:k]
        if not out:
            return empty
        q, v, s = zip(*out, strict=True)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()),
                         "score": pa.array(s, pa.float64())})
    return run


def usable(embedding: Column) -> Column:
    """True for a vector without null or non-finite components that isn't zero."""
    def odd(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (embedding.isNotNull() & (F.size(embedding) > 0) & ~F.exists(embedding, odd)
            & F.exists(embedding, lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, beam: int = SEARCH_BEAM) -> DataFrame:
    """The ``k`` vectors of largest cosine that a beam search finds for each query.

    ``vectors`` (vec_id, embedding) are all indexed; ``queries`` (query_id, embedding). A query's own id is no
    candidate. Returns query_id, rank (from 1; nearest first, ties to the smaller vec_id), vec_id, score (the
    cosine in double precision). With fewer candidates all are returned. Null and zero vectors, vectors
    with null or non-finite components, and null ids take no part. Equal vectors are one node of a shard's
    graph that holds the smallest of their ids. Rows that repeat an id stand for one candidate. Vectors of
    another length than the most frequent one are left out, as no cosine with them is defined.
    """
    def clean(df: DataFrame, name: str) -> DataFrame:
        return (df.filter(usable(F.col("embedding")) & F.col(name).isNotNull())
                .select(F.col(name).cast("long").alias(name), F.transform("embedding", lambda x: x.cast("double"))
                        .alias("embedding")).dropDuplicates([name]))

    points = clean(vectors, "vec_id")
    sizes = points.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "d").limit(1).collect()
    width, total = (sizes[0]["d"], sizes[0]["n"]) if sizes else (1, 0)
    points = points.filter(F.size("embedding") == width)
    shards = max(1, -(-total // SHARD_ROWS))
    graphs = stage(points.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("long"))
                   .groupBy("shard").applyInArrow(_build(k + 1), "shard long, index binary"), "ann-graphs")
    asked = clean(queries, "query_id").filter(F.size("embedding") == width)
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(n_blocks)).cast("long")
    every_shard = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    visits = asked.withColumn("block", block).withColumn("shard", every_shard)
    found = (visits.groupBy("shard", "block").cogroup(graphs.withColumn("block", every_block)
                                                      .groupBy("shard", "block"))
             .applyInArrow(_search(k, beam), "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

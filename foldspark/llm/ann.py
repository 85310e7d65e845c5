"""Approximate nearest neighbours: robust-pruned directed graphs, one per shard.

Every valid vector is in one shard.  A shard's graph is built in batches: greedy
searches from the entry point propose neighbours, pruning with a relaxed distance
keeps those edges that no kept edge makes superfluous, and reverse edges are added
and pruned alike.  A bounded sample of the queries is then answered by the graph and
by brute force, and the shard keeps the narrowest of ``BEAMS`` with a recall of
``TARGET`` or more; a shard in which none has it is searched exactly.  Queries run a
beam search over each shard, scores are computed again in double precision on the
original vectors, and the shards' best are merged.

Largest inner product is turned into smallest distance by one more component,
sqrt(M^2 - |x|^2) with M the shard's largest norm (0 for queries).

Shards are files in the shared folder, which tasks map into memory, so graphs do not
move with the queries.

Vectors that are null, empty, zero or hold null or non-finite components take no
part.  Vectors of different lengths are never compared.  Equal vectors are one
node that carries its ids; of these only the smallest ``k + 1`` can be among the
nearest ``k``, so no more are kept, and however many copies a vector has, no task
holds them all.  Ties go to the smaller id.  Of rows with the same id the one with
the smallest vector counts (compared component by component).  Where a query
has fewer than ``k`` candidates it gets all.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm import shared_files
from foldspark.llm.common import materialised, ready, shared_uri

#: Distinct vectors of a shard, queries of a block (both bound a task's memory).
SHARD_ROWS, BLOCK_QUERIES = 32_768, 8192
#: Edges of a node, width of the beam when building, relaxation of the pruning.
DEGREE, BUILD_BEAM, ALPHA = 32, 48, 1.2
#: Widths of the beam when searching, the recall that one must have, and the queries on which it is measured.
BEAMS, TARGET, SAMPLE = (48, 96, 192, 384), 0.97, 128
#: Stands for a shard that is searched exactly.
EXACT = 0
_FAR = np.float32(np.inf)


class Graph:
    """Vectors with directed edges; -1 fills unused places."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray | None = None):
        x = np.asarray(vectors, np.float64)
        norm = (x * x).sum(1)
        self.x = np.concatenate((x, np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))[:, None]), 1).astype(np.float32)
        self.square = (self.x * self.x).sum(1)
        middle = self.x.mean(0, keepdims=True) if len(x) else self.x
        self.entry = int(((self.x - middle) ** 2).sum(1).argmin()) if len(x) else 0
        self.edges = np.full((len(x), DEGREE), -1, np.int32) if edges is None else edges

    def _distances(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances less the query's own square, of ``nodes`` (queries x some)."""
        dot = np.matmul(self.x[nodes], q[:, :, None])[:, :, 0]
        return np.where(nodes >= 0, self.square[nodes] - 2 * dot, _FAR)

    def search(self, queries: np.ndarray, beam: int, trail: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes found for each query, nearest first; with ``trail`` also the nodes expanded."""
        n, total = len(queries), len(self.x)
        found = np.full((n, beam), -1, np.int32)
        dist = np.full((n, beam), _FAR, np.float32)
        done = np.zeros((n, beam), bool)
        seen = np.zeros((n, total), bool)
        found[:, 0] = self.entry
        dist[:, 0] = self._distances(queries, found[:, :1])[:, 0]
        seen[:, self.entry] = True
        live = np.arange(n)
        width = min(4, beam)
        while len(live):
            open_ = ~done[live] & (found[live] >= 0)
            going = open_.any(1)
            live, open_ = live[going], open_[going]
            if not len(live):
                break
            # The nearest few nodes not expanded yet.
            rank = np.cumsum(open_, 1)
            pick = open_ & (rank <= width)
            row, col = np.nonzero(pick)
            done[live[row], col] = True
            offer = np.full((len(live), width, DEGREE), -1, np.int32)
            offer[row, rank[row, col] - 1] = self.edges[found[live[row], col]]
            offer = offer.reshape(len(live), -1)
            offer = np.where((offer >= 0) & ~seen[live[:, None], offer], offer, -1)
            offer.sort(1)
            offer[:, 1:][offer[:, 1:] == offer[:, :-1]] = -1
            keep = (offer >= 0).sum(1).max(initial=0)
            if keep == 0:
                continue
            offer = -np.sort(-offer, 1)[:, :keep]
            r, c = np.nonzero(offer >= 0)
            seen[live[r], offer[r, c]] = True
            both = np.concatenate((dist[live], self._distances(queries[live], offer)), 1)
            order = np.argsort(both, 1, kind="stable")[:, :beam]
            dist[live] = np.take_along_axis(both, order, 1)
            found[live] = np.take_along_axis(np.concatenate((found[live], offer), 1), order, 1)
            done[live] = np.take_along_axis(np.concatenate((done[live], np.zeros(offer.shape, bool)), 1), order, 1)
        return np.where(np.isfinite(dist), found, -1), dist

    def _prune(self, nodes: np.ndarray, offered: np.ndarray) -> np.ndarray:
        """For each node at most DEGREE of the nodes offered, such that no kept one is
        closer by the factor ALPHA to another kept one than the node itself is."""
        offered = np.where(offered == nodes[:, None], -1, offered)
        offered = np.sort(offered, 1)
        offered[:, 1:][offered[:, 1:] == offered[:, :-1]] = -1
        dist = np.maximum(self._distances(self.x[nodes], offered) + self.square[nodes][:, None], 0)
        order = np.argsort(dist, 1, kind="stable")
        offered, dist = np.take_along_axis(offered, order, 1), np.take_along_axis(dist, order, 1)
        m = int((offered >= 0).sum(1).max(initial=0))
        offered, dist = offered[:, :m], dist[:, :m]
        out = np.full((len(nodes), DEGREE), -1, np.int32)
        alive = offered >= 0
        x = self.x[offered]
        square = self.square[offered]
        rows = np.arange(len(nodes))
        for k in range(DEGREE):
            some = alive.any(1)
            if not some.any():
                break
            first = alive.argmax(1)
            out[some, k] = offered[rows[some], first[some]]
            chosen = x[rows, first]
            between = square + square[rows, first][:, None] - 2 * np.matmul(x, chosen[:, :, None])[:, :, 0]
            alive &= some[:, None] & (ALPHA * ALPHA * between > dist)
            alive[rows, first] = False
        return out

    def build(self) -> "Graph":
        """Two rounds over all nodes in a fixed random order; batches grow with the graph."""
        n = len(self.x)
        if n <= 1:
            return self
        rng = np.random.default_rng(n)
        for i in range(0, n, 4096):  # random edges keep early searches from getting stuck
            self.edges[i : i + 4096, : min(8, DEGREE)] = rng.integers(0, n, (len(self.edges[i : i + 4096]), min(8, DEGREE)))
        order = rng.permutation(n)
        at = 0
        while at < n:
            batch = order[at : at + min(1024, max(64, at))]
            at += len(batch)
            found, _ = self.search(self.x[batch], BUILD_BEAM)
            self.edges[batch] = self._prune(batch, np.concatenate((found, self.edges[batch]), 1))
            self._link_back(batch)
        return self

    def _link_back(self, batch: np.ndarray) -> None:
        to = self.edges[batch].ravel()
        source = np.repeat(batch, DEGREE)[to >= 0].astype(np.int32)
        to = to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        nodes, start, count = np.unique(to, return_index=True, return_counts=True)
        # Nodes with room get the edge at once, the others are pruned, some at a time.
        for lo in range(0, len(nodes), 2048):
            some, first, many = nodes[lo : lo + 2048], start[lo : lo + 2048], count[lo : lo + 2048]
            offer = np.full((len(some), int(many.max())), -1, np.int32)
            r = np.repeat(np.arange(len(some)), many)
            c = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
            offer[r, c] = source[np.repeat(first, many) + c]
            self.edges[some] = self._prune(some, np.concatenate((self.edges[some], offer), 1))


def valid(vector: str | Column) -> Column:
    """Whether a vector takes part."""
    v = F.col(vector) if isinstance(vector, str) else vector
    limit = float(np.finfo(np.float64).max)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= limit))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda c: c != 0)


def nodes(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, ids, vector): a row for each distinct vector with its ``k + 1`` smallest ids."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).filter(F.col("_r") <= k + 1)
    one = ranked.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    one = materialised(one.withColumn("_h", F.xxhash64("vector")))
    sizes = one.groupBy(F.size("vector").alias("_d")).agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("_n"))
    return one.join(sizes, F.size("vector") == F.col("_d")).select(F.concat_ws("-", "_d", F.pmod("_h", "_n")).alias("shard"), "ids", "vector")


def exactly(vectors: np.ndarray, queries: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` rows with the largest inner products for each query, by brute force, largest first."""
    n = min(n, len(vectors))
    out = np.empty((len(queries), n), np.int64)
    step = max(1, (1 << 24) // max(len(vectors), 1))
    for i in range(0, len(queries), step):
        score = queries[i : i + step] @ vectors.T
        best = np.argpartition(-score, n - 1, axis=1)[:, :n]
        own = np.take_along_axis(score, best, 1)
        out[i : i + step] = np.take_along_axis(best, np.argsort(-own, 1, kind="stable"), 1)
    return out


def _matrix(vectors: pa.ChunkedArray, order: list[int] | None = None) -> np.ndarray:
    """Vectors of one length as rows, without a Python object for each number."""
    flat = vectors.combine_chunks()
    flat = flat.take(pa.array(order)) if order is not None else flat
    return np.ascontiguousarray(flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1), np.float64)


def _lifted(queries: np.ndarray) -> np.ndarray:
    return np.concatenate((queries, np.zeros((len(queries), 1))), 1).astype(np.float32)


def measured(graph: Graph, vectors: np.ndarray, queries: np.ndarray, k: int) -> tuple[int, float]:
    """(width of the beam, recall at ``k + 1``) of the narrowest beam that reaches ``TARGET``; EXACT if none
    does, or if there is no query to measure it with."""
    want = exactly(vectors, queries, k + 1)
    if not want.size:
        return EXACT, 1.0
    for beam in (b for b in BEAMS if b > k):
        found = graph.search(_lifted(queries), beam)[0]
        recall = float(np.mean([np.isin(w, f).mean() for w, f in zip(want, found)]))
        if recall >= TARGET:
            return beam, recall
    return EXACT, 1.0


def index(nodes_: DataFrame, sample: DataFrame, uri: str, k: int = 20) -> DataFrame:
    """Builds all shards and writes them below ``uri``: (shard, d, rows, beam, recall).

    ``sample`` (vector) has the queries on which the recall is measured; at most ``SAMPLE`` are collected.
    """
    asked: dict[int, list] = {}
    for r in sample.limit(SAMPLE).collect():
        asked.setdefault(len(r["vector"]), []).append(list(r["vector"]))

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("ids").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: ids[i][0])
        ids = [ids[i] for i in order]
        vectors = _matrix(table.column("vector"), order)
        graph = Graph(vectors).build()
        beam, recall = measured(graph, vectors, np.array(asked.get(vectors.shape[1], []), np.float64).reshape(-1, vectors.shape[1]), k)
        shard = table.column("shard")[0].as_py()
        many = np.array([len(x) for x in ids], np.int64)
        shared_files.write(uri, shard, np.array(vectors.shape, np.int64), vectors, graph.edges, many, np.concatenate([np.array(x, np.int64) for x in ids]))
        return pa.table({"shard": [shard], "d": pa.array([vectors.shape[1]], pa.int32()), "rows": pa.array([len(ids)], pa.int64()), "beam": pa.array([beam], pa.int32()), "recall": [recall]})

    return materialised(nodes_.groupBy("shard").applyInArrow(build, "shard string, d int, rows long, beam int, recall double"))


_last: dict[str, tuple] = {}


def _shard(uri: str, name: str) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """(graph, vectors, where each node's ids begin, ids) of a shard; the last one stays in the worker."""
    if f"{uri}/{name}" not in _last:
        _last.clear()
        data = shared_files.mapped(uri, name)
        n, d = np.frombuffer(data, np.int64, 2).tolist()
        vectors = np.frombuffer(data, np.float64, n * d, 16).reshape(n, d)
        at = 16 + vectors.nbytes
        edges = np.frombuffer(data, np.int32, n * DEGREE, at).reshape(n, DEGREE)
        at += edges.nbytes
        begin = np.concatenate(([0], np.cumsum(np.frombuffer(data, np.int64, n, at))))
        _last[f"{uri}/{name}"] = Graph(vectors, edges), vectors, begin, np.frombuffer(data, np.int64, offset=at + 8 * n)
    return _last[f"{uri}/{name}"]


def search(shards: DataFrame, queries: DataFrame, uri: str, k: int = 20, block: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, id, score) for ``queries`` (id, vector); a query's own id is no candidate of it.
    ``shards`` is what :func:`index` gave for ``uri``."""
    blocks = max(1, -(-queries.count() // block))
    asked = queries.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    asked = asked.join(shards.select("shard", "d", "beam"), F.size("vector") == F.col("d")).select("shard", "block", "beam", "id", "vector")

    def run(table: pa.Table) -> pa.Table:
        graph, vectors, begin, ids = _shard(uri, table.column("shard")[0].as_py())
        beam, own = table.column("beam")[0].as_py(), table.column("id").to_numpy()
        q = _matrix(table.column("vector"))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, (1 << 24) // len(vectors))
        for i in range(0, len(q), step):
            part = q[i : i + step]
            found = exactly(vectors, part, k + 1) if beam == EXACT else graph.search(_lifted(part), beam)[0]
            r, c = np.nonzero(found >= 0)
            node = found[r, c]
            score = np.einsum("ij,ij->i", vectors[node], part[r])
            # A node stands for its ids, which have its score.
            many = (begin[1:] - begin[:-1])[node]
            r, score = np.repeat(r, many), np.repeat(score, many)
            end = np.cumsum(many)
            name = ids[np.repeat(begin[node] - end + many, many) + np.arange(len(r))]
            other = name != own[i + r]
            r, score, name = r[other], score[other], name[other]
            order = np.lexsort((name, -score, r))
            r, score, name = r[order], score[order], name[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            best = place < k
            out.append((own[i + r[best]], name[best], score[best]))
        a, b, s = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query_id": pa.array(a, pa.int64()), "id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    best = asked.groupBy("shard", "block").applyInArrow(run, "query_id long, id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def nearest(table: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The contract's rows: queries are the rows whose id is divisible by ``every``."""
    ready(table.sparkSession)
    rows = table.filter(F.col("vec_id").isNotNull() & valid("embedding")).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.groupBy("id").agg(F.min("vector").alias("vector"))
    queries = materialised(rows.filter(F.col("id") % every == 0))
    uri = shared_uri(table.sparkSession)
    shards = index(nodes(rows, k), queries.orderBy(F.xxhash64("id"), "id").select("vector"), uri, k)
    found = search(shards, queries, uri, k)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")

"""N-gram Jaccard join: a MinHash LSH forest proposes, exact counts decide.

A document is the set of its runs of ``N`` words (all its words if it has fewer).
Documents with equal sets are one node, so copies are never compared.  Each node has
``TREES`` labels, sequences of MinHash values.  The labels of a tree, sorted, are a
prefix trie: nodes below the same trie node share a prefix.  Nodes meet where they
share a prefix of the depth at which a pair at the threshold is expected to meet with
the target recall; from there prefixes are shortened by another value wherever at
most ``CROWD`` branches hang together, which raises the recall where that is cheap
and leaves crowded parts, such as common boilerplate, apart.

Nodes that meet, directly or by others, form a cluster.  A cluster of more than
``LARGE`` nodes is split first: sets at or above the threshold share one of their
rarest shingles (as many as may be missing in the other, and one), so only nodes
that do stay together.  Every pair of a cluster is then decided by the exact Jaccard
similarity of its sets, in pairs of blocks of bounded size; only links per node and
spanning edges leave a task.

Null and empty texts, and texts of white space only, have no set and no links.
Words are compared as they are (case and punctuation count), by hashes of 64 bits;
equal sets by two hashes of 64 bits each.  A null key is a key of its own.  Repeated
rows are copies of each other.  An empty table gives no rows.  Columns ``k``, ``h``
and ``node`` of the input are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm.common import materialised, ready
from foldspark.llm.components import components
from foldspark.llm.textvec import HashMap, hashed_words, mix

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
HASHES, TREES, DEPTH = 128, 64, 10
#: Branches that a shortened prefix may hold together.
CROWD = 32
#: Nodes of a block, and the shared shingles whose incidence is held at a time.
BLOCK, COLUMNS = 512, 8192
#: Nodes of a cluster that is compared as it is.
LARGE = 2048
#: Labels that a task remembers.
MEETINGS = 1 << 20

_rng = np.random.default_rng(7)
_FLIP = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_TIMES = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_BRANCH = np.stack([_rng.permutation(HASHES)[:DEPTH] for _ in range(TREES)])
_STEP = np.uint64(0x9E3779B97F4A7C15)


def expected_recall(similarity: float, depth: int) -> float:
    """Share of the pairs of a similarity that meet in some tree at a depth (all trees draw on the same hashes)."""
    return sum(
        comb(HASHES, m) * similarity**m * (1 - similarity) ** (HASHES - m) * (1 - (1 - (m / HASHES) ** depth) ** TREES) for m in range(HASHES + 1)
    )


def prefix_depth(threshold: float, recall: float) -> int:
    """The longest prefix that reaches the recall."""
    return next((d for d in range(DEPTH, 0, -1) if expected_recall(threshold, d) >= recall), 1)


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingles of some rows one after the other, where each row's begin)."""
    for i, j, words, first in hashed_words(column):
        count = np.diff(first)
        out: list[np.ndarray] = []
        rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for k in range(n):
            rolled = rolled * _STEP + words[k : k + len(rolled)]
        rolled = mix(rolled)
        for a, c in zip(first[:-1].tolist(), count.tolist()):
            if c >= n:
                s = np.sort(rolled[a : a + c - n + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif c:
                h = np.uint64(c)
                for w in words[a : a + c]:
                    h = np.uint64((int(h) * int(_STEP) + int(w)) & 0xFFFFFFFFFFFFFFFF)
                out.append(mix(np.array([h], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        begins = np.concatenate(([0], np.cumsum([len(x) for x in out])))
        yield i, np.concatenate(out) if out else np.zeros(0, np.uint64), begins


def signatures(shingles: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """MinHash values (rows x HASHES) of rows that have shingles."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begins) - 1, HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((x ^ _FLIP[k]) * _TIMES[k], begins[:-1])
    return out


def labels(sig: np.ndarray, depth: int) -> np.ndarray:
    """Each tree's prefix of ``depth`` values (rows x TREES) as a number whose highest 48
    bits stand for the tree and all values but the last, so that sorting gives the trie."""
    h = np.broadcast_to(mix(np.arange(1, TREES + 1, dtype=np.uint64)), (len(sig), TREES)).copy()
    for d in range(depth - 1):
        h = mix(h * _STEP + sig[:, _BRANCH[:, d]])
    last = mix(h * _STEP + sig[:, _BRANCH[:, depth - 1]])
    return h >> np.uint64(16) << np.uint64(16) | last >> np.uint64(48)


class Meetings:
    """What a task has seen of the labels: its first node for each. A node with a label
    seen before is linked to that node at once, so that however many nodes share a
    label, a task sends one of them on."""

    def __init__(self) -> None:
        self._first = HashMap()

    def __call__(self, found: np.ndarray, node: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(labels to send on, nodes to link to) for each row of ``found`` (rows x TREES)."""
        flat = np.where(found == 0, np.uint64(1), found).ravel()
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        keys, sample = ordered[new], order[new]
        row = np.arange(len(flat)) // found.shape[1]
        if len(self._first) > MEETINGS:
            self._first = HashMap()  # only sends more labels on
        first, there = self._first.find(keys)
        first[~there] = node[row[sample[~there]]]
        self._first.add(keys[~there], first[~there])
        least = np.empty(len(flat), np.int64)
        least[order] = first[np.cumsum(new) - 1]
        own = np.zeros(len(flat), bool)
        own[sample[~there]] = True
        linked = least != node[row]
        cut = np.arange(1, len(node))
        send = np.split(flat[own].view(np.int64), np.searchsorted(row[own], cut))
        link = np.split(least[linked], np.searchsorted(row[linked], cut))
        return send, [np.unique(x) if len(x) else x for x in link]


def _signed(docs: DataFrame, n: int, depth: int, node_bits: int) -> DataFrame:
    """(k, h, node, proof, labels, links) for each row of ``docs`` (k, h, t); node is null where there is no set.
    ``proof`` is another hash of the set."""
    keep = np.uint64((1 << node_bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meet = Meetings()
        for batch in batches:
            for i, shingles, begins in shingle_sets(batch.column(2), n):
                rows = batch.slice(i, len(begins) - 1)
                some = np.flatnonzero(np.diff(begins))
                node, proof = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
                send: list = [None] * rows.num_rows
                link: list = [None] * rows.num_rows
                if len(some):
                    starts = np.append(begins[some], len(shingles))
                    size = np.diff(starts).astype(np.uint64)
                    for to, step in ((node, _STEP), (proof, _STEP << np.uint64(1))):
                        to[some] = mix(np.add.reduceat(mix(shingles + step), begins[some]) + mix(size)).view(np.int64)
                    node[some] = (node[some].view(np.uint64) & keep).view(np.int64)
                    for r, x, y in zip(some.tolist(), *meet(labels(signatures(shingles, starts), depth), node[some])):
                        send[r], link[r] = x, y
                mask = np.ones(rows.num_rows, bool)
                mask[some] = False
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (send, link)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(x, pa.int64(), mask=mask) for x in (node, proof)), *lists], ["k", "h", "node", "proof", "labels", "links"])

    return docs.mapInArrow(run, "k long, h long, node long, proof long, labels array<long>, links array<long>")


def _split_nodes(signed: DataFrame, shared: DataFrame) -> DataFrame:
    """Gives different sets that share a node (``shared``: s) nodes of their own. The old
    node stays as a meeting place, so everything that met it still meets all of them."""
    own = F.xxhash64("node", "proof")
    both = signed.join(shared, F.col("node") == F.col("s"), "left")
    links = F.when(F.col("s").isNotNull(), F.concat(F.coalesce("links", F.array().cast("array<long>")), F.array("node"))).otherwise(F.col("links"))
    spread = both.withColumn("links", links).withColumn("owner", F.when(F.col("s").isNotNull(), own).otherwise(F.col("node")))
    return spread.select("k", "h", F.col("owner").alias("node"), "proof", F.col("node").alias("place"), "labels", "links")


def met(signed: DataFrame) -> DataFrame:
    """Edges (u, v) to the smallest node of each trie node at the full depth, and between the
    smallest of its branches where a prefix shorter by one value is not crowded."""
    prefix = F.shiftrightunsigned("label", 16)
    rows = signed.select(F.col("place").alias("node"), F.explode("labels").alias("label"))
    rows = rows.repartition(prefix).select("node", "label", prefix.alias("prefix"))
    leaf = Window.partitionBy("prefix", "label").orderBy("node")
    stem = Window.partitionBy("prefix")
    rows = rows.withColumn("first", F.row_number().over(leaf) == 1).withColumn("least", F.first("node").over(leaf))
    rows = rows.withColumn("branches", F.sum(F.col("first").cast("int")).over(stem)).withColumn("top", F.min("node").over(stem))
    to = F.when(F.col("first") & (F.col("branches") <= CROWD), F.col("top")).otherwise(F.col("least"))
    return rows.select(F.col("node").alias("u"), to.alias("v")).filter("u <> v")


def _prefix_edges(sets: DataFrame, threshold: float) -> DataFrame:
    """Edges (u, v) within a cluster between nodes that share one of their rarest shingles.

    Of two sets at or above the threshold the smaller lacks at most a share of (1 - threshold)
    of its shingles in the other, so in one order of all shingles, rarest first, the first
    floor((1 - threshold) * size) + 1 of both have one in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            flat = np.concatenate(each) if each else np.zeros(0, np.int64)
            size = np.array([len(x) for x in each], np.int64)
            owner = np.repeat(np.arange(len(each)), size)
            for lo in range(0, len(flat), 1 << 18):
                own = owner[lo : lo + (1 << 18)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), pa.array(size[own]), pa.array(flat[lo : lo + (1 << 18)])], ["cluster", "node", "size", "s"])

    each = materialised(sets.select("cluster", "node", "shingles").mapInArrow(run, "cluster long, node long, size long, s long"))
    often = each.groupBy("cluster", "s").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    # Shingles that no other node of the cluster has come first and lead nowhere.
    shared = each.join(often, ["cluster", "s"])
    alone = F.col("size") - F.count(F.lit(1)).over(Window.partitionBy("node"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("often", "s"))
    kept = shared.withColumn("place", place + alone).filter(F.col("place") <= F.floor((1 - threshold) * F.col("size") + 1e-9) + 1)
    least = kept.groupBy("cluster", "s").agg(F.min("node").alias("v"))
    return kept.join(least, ["cluster", "s"]).select(F.col("node").alias("u"), "v")


def _with_sets(texts: DataFrame, n: int) -> DataFrame:
    """(node, cluster, copies, shingles) from (node, cluster, copies, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, shingles, begins in shingle_sets(batch.column(3), n):
                rows = batch.slice(i, len(begins) - 1)
                sets = [shingles[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:])]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in range(3)), pa.array(sets, pa.binary())], ["node", "cluster", "copies", "shingles"])

    return texts.mapInArrow(run, "node long, cluster long, copies long, shingles binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common elements of each pair of sorted sets (left x right)."""
    both = left + right
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    every = np.concatenate(both)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    column = np.cumsum(np.concatenate(([0], (every[1:] != every[:-1]).astype(np.int64))))
    many = np.bincount(column)[column] > 1
    owner, column = owner[many], column[many]
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(column):
        return out
    column = np.cumsum(np.concatenate(([0], (column[1:] != column[:-1]).astype(np.int64))))
    for lo in range(0, int(column[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        held = np.zeros((len(both), min(COLUMNS, int(column[-1]) + 1 - lo)), np.float32)
        held[owner[a:b], column[a:b] - lo] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out


def _verify(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, low, high = (x.as_py() for x in key)
        block = table.column("block").to_numpy()
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets], np.float64)
        a = np.flatnonzero(block == low)
        b = a if low == high else np.flatnonzero(block == high)
        common = overlaps([sets[i] for i in a], [sets[i] for i in b]).astype(np.float64)
        linked = common >= threshold * (size[a][:, None] + size[b][None, :] - common) - 1e-9
        if low == high:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(node), np.int64)
        links[a] += linked @ copies[b]
        if low != high:
            links[b] += linked.T @ copies[a]
        # Components by the smallest node that a link reaches.
        root = node.copy()
        while True:
            last = root.copy()
            for rows, cols, hit in ((a, b, linked), (b, a, linked.T)):
                if len(rows) and len(cols):
                    best = np.where(hit, root[cols][None, :], np.iinfo(np.int64).max).min(1)
                    root[rows] = np.minimum(root[rows], best)
            if (last == root).all():
                break
        return pa.table({"node": pa.array(node), "root": pa.array(root), "links": pa.array(links), "blocks": table.column("blocks")})

    return run


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, node_bits: int = 64) -> DataFrame:
    """(k, h, node, class_id, n_links, class_size, keep_k, keep_h) for each row of ``docs``.

    ``h`` is the text's hash; ``class_id`` the smallest key of the class, ``n_links``
    the number of other rows at or above the threshold, ``class_size`` the rows of the
    class, and (``keep_k``, ``keep_h``) the key and text hash of its first row.
    """
    ready(docs.sparkSession)
    depth = prefix_depth(threshold, recall)
    plain = docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    signed = materialised(_signed(plain, n, depth, node_bits)).withColumn("place", F.col("node"))
    nodes = _nodes(signed)
    shared = nodes.filter("low <> high").select(F.col("node").alias("s"))
    if not shared.isEmpty():
        signed = materialised(_split_nodes(signed, shared))
        nodes = _nodes(signed)
    edges = met(signed).unionAll(signed.select(F.col("node").alias("u"), F.explode("links").alias("v")))
    cluster = materialised(components(edges)).select(F.col("id").alias("node"), F.col("component").alias("cluster"))
    sets = _sets(plain, nodes, cluster, n)
    many = materialised(cluster.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE))
    if not many.isEmpty():
        # Clusters of many nodes fall apart into those that can hold a pair; a node without an edge there has no link.
        large = materialised(cluster.join(many, "cluster").select("node", "cluster"))
        parts = components(_prefix_edges(_sets(plain, nodes, large, n), threshold)).select(F.col("id").alias("node"), F.col("component").alias("cluster"))
        cluster = materialised(cluster.join(many, "cluster", "left_anti").select("node", "cluster").unionAll(parts))
        sets = _sets(plain, nodes, cluster, n)
    blocks = cluster.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    sets = sets.join(blocks, "cluster")
    # A node of block b meets the blocks 0 to blocks - 1, each pair of blocks in one task.
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pairs = sets.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
    checked = materialised(pairs.groupBy("cluster", "low", "high").applyInArrow(_verify(threshold), "node long, root long, links long, blocks long"))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    several = checked.filter("blocks > 1")
    roots = checked.filter("blocks = 1").select("node", "root")
    if not several.isEmpty():
        joined = components(several.select(F.col("node").alias("u"), F.col("root").alias("v")))
        alone = several.select("node").distinct().join(joined, F.col("node") == F.col("id"), "left")
        roots = roots.unionAll(alone.select("node", F.coalesce("component", "node").alias("root")))
    known = roots.join(links, "node").withColumnRenamed("node", "n")
    named = nodes.join(known, F.col("node") == F.col("n"), "left").select(
        "node", "first", "copies", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    totals = named.groupBy("root").agg(F.min("first").alias("keep"), F.sum("copies").alias("class_size"))
    named = named.join(totals, "root").select(F.col("node").alias("n"), "n_links", "class_size", "keep")
    return signed.join(named, F.col("node") == F.col("n"), "left").select(
        "k",
        "h",
        "node",
        F.when(F.col("node").isNull(), F.col("k")).otherwise(F.col("keep.k")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.when(F.col("node").isNull(), F.col("k")).otherwise(F.col("keep.k")).alias("keep_k"),
        F.when(F.col("node").isNull(), F.col("h")).otherwise(F.col("keep.h")).alias("keep_h"),
    )


def _nodes(signed: DataFrame) -> DataFrame:
    """A row for each node: its first row, how many rows it has, and the range of their other hash."""
    by = signed.filter("node is not null").groupBy("node")
    return materialised(by.agg(F.min(F.struct("k", "h")).alias("first"), F.count(F.lit(1)).alias("copies"), F.min("proof").alias("low"), F.max("proof").alias("high")))


def _sets(plain: DataFrame, nodes: DataFrame, cluster: DataFrame, n: int) -> DataFrame:
    """(node, cluster, copies, shingles) of the nodes in ``cluster`` (node, cluster), from the text of their first row."""
    # Joined by shuffles at every size: with growing input the rows wanted grow too, and are no case for a broadcast.
    wanted = materialised(cluster.join(nodes, "node").select("node", "cluster", "copies", F.col("first.k").alias("fk"), F.col("first.h").alias("fh")))
    texts = plain.join(wanted.hint("merge"), F.col("k").eqNullSafe(F.col("fk")) & (F.col("h") == F.col("fh"))).dropDuplicates(["k", "h"])
    return _with_sets(texts.select("node", "cluster", "copies", "t"), n)


def per_document(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    return classes(docs).select(F.col("k").alias("doc_id"), "class_id", "n_links", "class_size")


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class, its first; rows without a set all stay."""
    found = classes(docs, key, text)
    keep = found.filter("node is not null").select(F.col("keep_k").alias("_keep_k"), F.col("keep_h").alias("_keep_h")).distinct()
    taken = {c.lower() for c in docs.columns}
    mark = next(name for i in range(len(taken) + 1) if (name := f"_hash_{i}") not in taken)
    marked = docs.withColumn(mark, F.xxhash64(text))
    chosen = marked.join(keep, F.col(key).eqNullSafe(F.col("_keep_k")) & (F.col(mark) == F.col("_keep_h"))).dropDuplicates([key, mark])
    without = marked.filter(F.col(text).isNull() | ~F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    return chosen.select(*docs.columns).unionByName(without.select(*docs.columns))

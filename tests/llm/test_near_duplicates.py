import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import WORD

from foldspark.llm import near_duplicates as nd
from foldspark.llm.components import components


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent, links, at = list(range(len(rows))), Counter(), defaultdict(list)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for g in s:
            at[g].append(i)
    pairs = Counter((i, j) for own in at.values() for a, i in enumerate(own) for j in own[a + 1 :])
    for (i, j), c in pairs.items():
        if c >= 0.8 * (len(sets[i]) + len(sets[j]) - c) - 1e-9:
            links[i] += 1
            links[j] += 1
            parent[max(find(i), find(j))] = min(find(i), find(j))
    group = defaultdict(list)
    for i in range(len(rows)):
        group[find(i)].append(rows[i][0])
    low = lambda ks: None if None in ks else min(ks)
    return sorted((str(rows[i][0]), str(low(group[find(i)])), links[i], len(group[find(i)])) for i in range(len(rows)))


def got(df):
    return sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"], r["class_size"]) for r in nd.per_document(df).collect())


def test_same_as_brute_force(spark, edge, empty):
    for df in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), edge, empty):
        assert got(df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


@pytest.mark.parametrize("block", [7, 512])
def test_large_group_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(150)] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"v{rng.random()}" for _ in range(40))) for i in range(30)] + [(200 + i, rows[5][1]) for i in range(25)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_one_of_each_group_stays(spark, edge):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = nd.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({int(c) for _, c, _, _ in brute([(r["doc_id"], r["text"]) for r in docs.collect()])})
    assert sorted(str(r["doc_id"]) for r in nd.first_of_each(edge).collect()) == sorted(["1", "2", "3", "4", "5", "6", "None", "8", "9"])


def test_sets_that_share_a_hash_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = nd.classes(docs, node_bits=5).select(F.col("k").alias("doc_id"), "class_id", "n_links", "class_size")
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"], r["class_size"]) for r in out.collect()) == brute(rows)


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_on_which_polynomial_hashes_agree(spark, n):
    x, y = "a", "b"
    while len(x) < n:
        x, y = x + y, y + x
    rows = [(1, " ".join([x] * 8)), (2, " ".join([y] * 8)), (3, " ".join([x] * 8)), (4, x), (5, y)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)
    assert nd.first_of_each(df).count() == 4


@pytest.mark.parametrize("large", [8, 2048])
def test_boilerplate_does_not_chain(spark, monkeypatch, large):
    """Texts that share half of their words with all others, and pairs of near copies among them."""
    monkeypatch.setattr(nd, "LARGE", large)
    rng = random.Random(3)
    common = [f"c{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = [f"o{rng.random()}" for _ in range(rng.choice([60, 100, 140]))]
        rows.append((2 * i, " ".join(common + own)))
        own[rng.randrange(len(own))] = "changed"
        rows.append((2 * i + 1, " ".join(common + own[: -rng.choice([1, 30, 60])])))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_large_clusters_fall_apart(spark):
    sets = [(1, range(0, 10)), (2, range(1, 11)), (3, [*range(0, 5), *range(20, 25)]), (4, range(30, 40)), (5, [*range(30, 39), 50])]
    from foldspark.llm.common import ready

    rows = [(1, k, 1, np.array(s, np.int64).tobytes()) for k, s in sets]
    df = spark.createDataFrame(rows, "cluster long, node long, copies long, shingles binary")
    ready(spark)
    found = {r["id"]: r["component"] for r in components(nd._prefix_edges(df, 0.8)).collect()}
    assert found[1] == found[2] and found[4] == found[5] and found[1] != found[4] and found.get(3) != found[4]


def test_measured_recall():
    """Pairs of sets of similarity 0.8 that meet in some tree, at the full depth and with prefixes shortened."""
    rng, depth = np.random.default_rng(5), nd.prefix_depth(nd.THRESHOLD, nd.RECALL)
    n, missed, shorter = 20_000, 0, 0
    for _ in range(n // 2000):
        every = rng.integers(0, 1 << 63, (2000, 50), dtype=np.uint64)
        left, right = every[:, :45], every[:, 5:]  # 40 of 50 in common
        flat = np.concatenate((left, right)).ravel()
        found = nd.labels(nd.signatures(flat, np.arange(0, 4001 * 45, 45)), depth)
        same = found[:2000] == found[2000:]
        stem = found[:2000] >> np.uint64(16) == found[2000:] >> np.uint64(16)
        missed += int((~same.any(1)).sum())
        shorter += int((~stem.any(1)).sum())
    assert missed <= 0.0005 * n and shorter <= 0.0001 * n


def test_prefixes_reach_the_recall():
    depth = nd.prefix_depth(0.8, 0.9999)
    assert nd.expected_recall(0.8, depth) >= 0.9999 > nd.expected_recall(0.8, depth + 1)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, rng.randrange(101, 200)) for _ in range(50)] + [(300, 301), (301, 300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    out = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {x: find(x) for x in list(parent)}

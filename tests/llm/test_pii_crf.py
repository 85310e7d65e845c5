import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.llm import pii_crf as p

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    """The contract's patterns as they stand, and their checks."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            doubled = sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d)))
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and doubled % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_equals_the_plain_patterns():
    rng = random.Random(2)
    parts = ["a.b", "@", "x-y", ".", "+1", "+", " ", "  ", "(555)", "-", "12", "255", "256", "0007", "4111 1111 1111 1111", "4111111111111111", "3782-822463-10005", "1.2.3.4", "é", "\n", "\t", "ab@c.de", "_%", "9" * 20, "日本"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert [f"{p.KINDS[k]}:{a}:{b}" for k, a, b in p.base(text)] == plain_base(text), text
    for long in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "@" * 200_000, "+" + " " * 200_000, "1 " * 100_000, "x" * 100_000 + "@" + "y." * 50_000):
        spans = p.base(long)
        p.nodes(long, spans), p.run_on(long)
        assert len(spans) <= 100_000


def test_messages_are_exact_on_trees_and_stay_in_their_document():
    rng = np.random.default_rng(1)
    k, n = 5, 6
    edges = np.array([(0, 1), (1, 2), (1, 3), (3, 4), (3, 5)])
    unary, pot = rng.normal(size=(n, k)), rng.normal(size=(len(edges), k, k))
    want = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        w = np.exp(sum(unary[i, y] for i, y in enumerate(labels)) + sum(pot[e, labels[i], labels[j]] for e, (i, j) in enumerate(edges)))
        for i, y in enumerate(labels):
            want[i, y] += w
    got = p.marginals(unary, edges, pot)
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-4)
    twice = p.marginals(np.concatenate((unary, rng.normal(size=(3, k)))), np.concatenate((edges, [(6, 7), (7, 8), (8, 6)])), np.concatenate((pot, rng.normal(size=(3, k, k)))))
    assert np.array_equal(twice[:n], got)


def test_chain_potentials_are_learned():
    """Tokens alike, whose label only the one before tells: A then B is a phone number, B alone nothing."""
    chains = [([[1, 9], [2, 9]], [3, 3], 50), ([[2, 9]], [p.NONE], 50), ([[3, 9], [2, 9]], [p.NONE, p.NONE], 50)]
    model = p.fit(chains, [(2, 0, 0, 30), (2, 0, p.NONE, 1), (0, 1, p.NONE, 9)])
    assert model.skip[2] > 2 and model.skip[0] == 0 and model.chain[3, 3] > model.chain[3, p.NONE]
    u = lambda *x: model.unary[np.array(x)].sum(1)
    assert p.marginals(u([1, 9], [2, 9]), np.array([(0, 1)]), model.chain[None])[1, 3] > 0.9
    assert p.marginals(u([3, 9], [2, 9]), np.array([(0, 1)]), model.chain[None])[1, p.NONE] > 0.9


@pytest.fixture(scope="module")
def trained(spark):
    return p.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def added(text, model):
    spans, more = p.find([text], model)[0]
    assert [f"{p.KINDS[k]}:{a}:{b}" for k, a, b in spans] == plain_base(text)
    return [(p.KINDS[k], text[a:b]) for k, a, b in more]


def test_adds_what_patterns_read_past(trained):
    assert added("so +1 (826) 555-4081 190.137.223.20 is", trained) == [("phone", "+1 (826) 555-4081")]
    assert added("or 4845168114407329 12 and", trained) in ([("card", "4845168114407329")], [])
    for clean in ("room 42 at 10:30 on 2021-03-04, 1.5 kg, v2.0.1, 100% of a@b", "", "no number", "9233 and 7536784127813050 too", 'token = "44b15e09fd311c3cf3163b66d5a9875b883d8ce"'):
        assert added(clean, trained) == []


def test_a_distant_mention_is_added_because_of_the_skip_link(trained):
    known, far = "so +1 (826) 555-4081 is here.", " the words between" * 30
    without = p.Model(trained.unary * 0, trained.chain * 0, np.zeros(3))
    without.unary[p._place("*"), p.NONE] = 0.2
    linked = p.Model(without.unary, without.chain, np.array([0.0, 0.0, 6.0]))
    text = known + far + " call 555-4081 now"
    assert added(text, without) == [] and added(text, linked) == [("phone", "555-4081")]
    assert added(known + far + " call 555-4082 now", linked) == []
    # Equal tokens agree with each other too: one given occurrence reaches all, by the next of each.
    assert len(added(known + (far + " call 555-4081 now") * 4, linked)) == 4


def test_query_and_edge_cases(spark, edge, empty):
    more = spark.createDataFrame([(70, "mail a.b@c.de or +1 (826) 555-4081 190.137.223.20 é 4111111111111111", "en", "s")] * 2, "doc_id long, text string, lang string, source string")
    docs = edge.unionByName(more, allowMissingColumns=True).withColumns({c: F.lit("z") for c in ("spans", "n_email", "n_added", "x", "y", "what", "n")})
    for df in (docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        got = p.personal_data(df).collect()
        texts = {}
        for r in df.collect():
            texts.setdefault(r.doc_id, r.text or "")
        assert len(got) == df.count()
        for r in got:
            want = plain_base(texts[r.doc_id])
            assert [r[f"n_{k}"] for k in p.KINDS] == [sum(x.startswith(k + ":") for x in want) for k in p.KINDS]
            assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(filter(None, r.spans.split(",")))
    assert p.personal_data(empty).count() == 0
    alone = p.detect(docs, p.train(docs.filter("false")))
    assert alone.count() == docs.count() and alone.filter("n_added > 0").count() == 0 and "source" in alone.columns
    a, b = (sorted(map(str, p.personal_data(x).collect())) for x in (docs, docs.repartition(3)))
    assert a == b

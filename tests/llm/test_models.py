import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.llm import kneser_ney, language_codes, quality_gam, toxicity_crf

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def key_crc(k):
    return zlib.crc32(("" if k is None else str(k)).encode())


def brute_kneser_ney(rows):
    docs = [(k, [w.translate(LOW) for w in WORD.findall(t or "")] + ["</s>"]) for k, t in rows]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for k, toks in docs:
        if key_crc(k) % 7 != 2:
            uni.update(toks)
            for u, w in zip(["<s>", *toks], toks):
                bi[u, w] += 1
                ctx[u] += 1
    n, v = sum(uni.values()), len(uni)
    cont, follow = Counter(w for _, w in bi), defaultdict(lambda: [0, 0, 0])
    for (u, _), c in bi.items():
        follow[u][min(c, 3) - 1] += 1

    def disc(values):
        k = [sum(c == i for c in values) for i in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1]) if k[0] + k[1] else 0
        return [0] + [min(max(i - (i + 1) * y * k[i] / k[i - 1], 0), i) if k[i - 1] else 0 for i in (1, 2, 3)]

    d2, d1, t = disc(list(bi.values())), disc(list(cont.values())), len(bi)
    mass = sum(d1[min(c, 3)] for c in cont.values()) / t if t else 1

    def one(w):
        return (max(cont[w] - d1[min(cont[w], 3)], 0) / t if t else 0) + mass / (v + 1)

    out = []
    for k, toks in docs:
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in toks)
        full = 0.0
        for u, w in zip(["<s>", *toks], toks):
            p = one(w)
            if ctx[u]:
                f, c = follow[u], bi[u, w]
                p = max(c - d2[min(c, 3)], 0) / ctx[u] + (d2[1] * f[0] + d2[2] * f[1] + d2[3] * f[2]) / ctx[u] * p
            full += math.log10(p)
        out.append((-1 if k is None else k, key_crc(k) % 7 == 2, len(toks), sum(uni[w] > 0 for w in toks), n, base, full))
    return sorted(out)


@pytest.mark.parametrize("shard", [3000, 1_500_000])
def test_kneser_ney_is_brute_force(spark, edge, empty, monkeypatch, shard):
    monkeypatch.setattr(kneser_ney, "SHARD_TOKENS", shard)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (docs, edge, edge.filter("doc_id = 1"), empty):
        want = brute_kneser_ney([(r["doc_id"], r["text"]) for r in df.collect()])
        got = sorted(tuple(r) for r in kneser_ney.held_out_scores(df).fillna(-1, ["doc_id"]).collect())
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)


def brute_trigrams(rows):
    """Scores of order 3, from dictionaries."""
    docs = [(k, [w.translate(LOW) for w in WORD.findall(t or "")] + ["</s>"]) for k, t in rows]
    tri, raw = Counter(), Counter()
    for k, toks in docs:
        if key_crc(k) % 7 != 2:
            padded = ["<s>", *toks]
            raw.update(zip(padded, toks))
            tri.update(zip(padded, toks, toks[1:]))
    bi = Counter((u, w) for _, u, w in tri) + Counter({p: c for p, c in raw.items() if p[0] == "<s>"})
    assert set(bi) == set(raw)
    cont = Counter(w for _, w in bi)

    def disc(values):
        k = [sum(c == i for c in values) for i in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1]) if k[0] + k[1] else 0
        return [0] + [min(max(i - (i + 1) * y * k[i] / k[i - 1], 0), i) if k[i - 1] else 0 for i in (1, 2, 3)]

    levels = []
    for grams in (bi, tri):
        d, total, mass = disc(list(grams.values())), Counter(), Counter()
        for g, c in grams.items():
            total[g[:-1]] += c
            mass[g[:-1]] += d[min(c, 3)]
        levels.append((grams, d, total, mass))
    d1, n, v = disc(list(cont.values())), len(bi), len(cont)
    floor = (sum(d1[min(c, 3)] for c in cont.values()) / n if n else 1) / (v + 1)
    out = []
    for k, toks in docs:
        full, padded = 0.0, ["<s>", *toks]
        for i, w in enumerate(toks):
            p = floor + (max(cont[w] - d1[min(cont[w], 3)], 0) / n if n else 0)
            for m, (grams, d, total, mass) in enumerate(levels[: i + 1], 1):
                before = tuple(padded[i + 1 - m : i + 1])
                if total[before]:
                    c = grams[(*before, w)]
                    p = (max(c - d[min(c, 3)], 0) + mass[before] * p) / total[before]
            full += math.log10(p)
        out.append((-1 if k is None else k, full))
    return sorted(out)


@pytest.mark.parametrize("shard", [3000, 1_500_000])
def test_kneser_ney_of_order_three_is_brute_force(spark, edge, empty, monkeypatch, shard):
    monkeypatch.setattr(kneser_ney, "SHARD_TOKENS", shard)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (docs, edge, edge.filter("doc_id = 1"), empty):
        want = brute_trigrams([(r["doc_id"], r["text"]) for r in df.collect()])
        got = sorted((r["doc_id"], r["score"]) for r in kneser_ney.held_out_scores(df, order=3).fillna(-1, ["doc_id"]).collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-9, atol=1e-9)


def test_kneser_ney_beats_its_base_on_held_out_texts(spark):
    rows = kneser_ney.held_out_scores(spark.read.parquet(f"{SF}/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > 0.9 * rows[1]


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_codes.held_out_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]) > 0.98
    assert all(r["held_out"] == (key_crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)


def test_languages_of_edge_cases(spark, edge, empty):
    rows = language_codes.held_out_languages(edge).collect()
    assert len(rows) == edge.count()
    for r in rows:
        if r["doc_id"] in (1, 2, 3, 9):
            assert r["lang_pred"] == "und" and r["score"] == 0
        else:
            assert r["lang_pred"] in ("en", "de")
    assert language_codes.held_out_languages(empty).count() == 0
    none = edge.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_codes.held_out_languages(none).collect()} == {"und"}
    one = language_codes.held_out_languages(edge.withColumn("lang", F.lit("xx")))
    assert {r["lang_pred"] for r in one.collect()} == {"xx", "und"}


def test_codewords_are_far_apart():
    for k in (2, 3, 4, 7, 20):
        code = language_codes.codewords(k)
        apart = [(code[a] != code[b]).sum() for a in range(k) for b in range(a)]
        assert min(apart) >= (1 if k == 2 else 2) and set(np.unique(code)) == {-1.0, 1.0}


def test_codes_correct_a_wrong_bit():
    code = language_codes.codewords(4)
    model = language_codes.Codes(list("abcd"), code, np.eye(code.shape[1]), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    for k in range(4):
        x = 5.0 * code[[k]]
        x[0, 2] = -x[0, 2] / 5
        assert model.predict(x)[0][0] == k


def _labelled(spark, make, name):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = make(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (key_crc(r["doc_id"]) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    return np.array([r[name] for r in held]), np.array([r["predicted"] for r in held])


def test_quality_held_out(spark):
    y, p = _labelled(spark, quality_gam.held_out_quality, "quality")
    assert (p[y == 1]).mean() > 0.97 and (1 - p[y == 0]).mean() > 0.95


def test_toxicity_held_out(spark):
    y, p = _labelled(spark, toxicity_crf.held_out_toxicity, "toxic")
    assert (p[y == 1]).mean() > 0.85 and (1 - p[y == 0]).mean() > 0.99


def test_classifiers_of_edge_cases(spark, edge, empty, labels):
    for make in (quality_gam.held_out_quality, toxicity_crf.held_out_toxicity):
        rows = make(edge, labels).collect()
        assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
        same = {r["score"] for r in rows if r["doc_id"] in (6, 7)}
        assert len(same) == 1
        assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
        assert make(empty, labels).count() == 0
        assert make(edge, labels.limit(0)).count() == edge.count()


def test_tables_add_up():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality_gam.fit(x, y, 0.5)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9 and (0, 1) in model.pairs


def test_marginals_are_brute_force():
    rng = np.random.default_rng(4)
    chain = toxicity_crf.Chain(np.zeros(4), 0.0, rng.normal(size=(2, 2)))
    emit, n = rng.normal(size=(2, 5)), np.array([5, 3])
    p, steps = chain.marginals(emit, n)
    total = np.zeros((2, 2))
    for row in range(2):
        z, each, pairs = 0.0, np.zeros(5), np.zeros((2, 2))
        for states in np.ndindex(*(2,) * n[row]):
            s = sum(emit[row, i] for i, v in enumerate(states) if v) + sum(chain.step[a, b] for a, b in zip(states, states[1:]))
            w = math.exp(s)
            z += w
            for i, v in enumerate(states):
                each[i] += w * v
            for a, b in zip(states, states[1:]):
                pairs[a, b] += w
        assert np.allclose(p[row, : n[row]], each[: n[row]] / z)
        total += pairs / z
    assert np.allclose(steps, total)


def test_spans_are_characters(spark):
    docs = spark.createDataFrame([(i, f"çéß {'good' if i % 2 else 'vilest'} thing {i}") for i in range(200)], "doc_id long, text string")
    known = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("label"))
    rows = toxicity_crf.score(docs, toxicity_crf.train(docs, known)).collect()
    for r in rows:
        assert [r["text"][s["start"] : s["end"]] for s in r["spans"]] == ([] if r["doc_id"] % 2 else ["vilest"])
        assert (r["score"] > 0.5) == (r["doc_id"] % 2 == 0)


def letters(text):
    """(words in small letters, their places) of a text: runs of ASCII letters and everything beyond ASCII."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or "\u00c0" <= c <= "\u00de" else c for c in text)
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"[A-Za-z\u0080-\U0010ffff]+", low)]


def test_toxicity_scores_are_brute_force(spark):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("some plain words that mean little and harm nobody".split(), 8)) + (" you vile beast" if i % 4 == 0 else "")) for i in range(300)], "doc_id long, text string")
    known = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("label"))
    tagger = toxicity_crf.train(docs, known)
    texts = ["", "12 !", "A VILE thing", "you vile beast and some words", "Çevile beast nobody", "plain words " * 4 + "you vile beast"]
    got = {r["text"]: r["score"] for r in toxicity_crf.score(spark.createDataFrame([(t,) for t in texts], "text string"), tagger).collect()}

    def hashed(word):
        return int(next(toxicity_crf.word_hashes(pa.array([word])))[2][0, 0])

    def place(h, kind):
        return int(toxicity_crf.bucket(np.array([[h] * (toxicity_crf.N_OWN + 2)], np.uint64))[0, kind])

    for text in texts:
        words, p = [w for w, _, _ in letters(text)], []
        cut = [(w.encode()[:n]) for w in words for n in (4, 5, 6)]
        for a in range(0, len(words), toxicity_crf.WINDOW):
            emit = []
            for k in range(a, min(a + toxicity_crf.WINDOW, len(words))):
                h = next(toxicity_crf.word_hashes(pa.array([words[k]])))[2][0].tolist()
                h += [hashed(words[k - 1]) if k else 0, hashed(words[k + 1]) if k + 1 < len(words) else 0]
                assert len(set(cut[3 * k : 3 * k + 3])) >= len(set(h[1:4])) - 1
                emit.append(tagger.chain.bias + sum(float(tagger.chain.word[place(h[f], f)]) for f in tagger.kinds))
            emit = np.clip(emit, -30, 30)
            z, each = 0.0, np.zeros(len(emit))
            for states in np.ndindex(*(2,) * len(emit)):
                w = math.exp(sum(e for e, v in zip(emit, states) if v) + sum(tagger.chain.step[x, y] for x, y in zip(states, states[1:])))
                z += w
                each += w * np.array(states)
            p += list(each / z)
        over = sum(max(x - toxicity_crf.FLOOR, 0) / (1 - toxicity_crf.FLOOR) for x in p)
        margin = max(p, default=0) * tagger.curve[0] + math.log1p(over) * tagger.curve[1] + tagger.curve[2]
        assert got[text] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-5)
    assert got["you vile beast and some words"] > 0.5 > got["12 !"]


def test_ratio_and_features_are_cross_validated():
    y, weight = np.array([1, 1, 0, 0.0]), np.ones(4)
    assert toxicity_crf.best_ratio(np.array([20, 13, 9, 0.0]), y, weight) == 12 and toxicity_crf.best_ratio(np.array([40, 35, 25, 0.0]), y, weight) == 32
    rng = np.random.default_rng(1)
    buckets = np.stack([rng.integers(k * 1000, k * 1000 + 40, (400, 20)) for k in range(toxicity_crf.N_OWN + 2)], 2)
    half, length = np.arange(400) % 2, np.full(400, 20)
    assert toxicity_crf.best_kinds(buckets, buckets[:, :, 0] % 7 == 0, length, half) == toxicity_crf.KINDS[0]
    assert toxicity_crf.best_kinds(buckets, buckets[:, :, 5] % 7 == 0, length, half) == toxicity_crf.KINDS[2]


def test_language_predictions_are_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_codes.train(docs)
    rows = language_codes.predict(docs.limit(40), model).collect()
    assert len(rows) == 40
    for r in rows:
        data = re.sub(rb"\xc3[\x80-\x9e]", lambda m: bytes((0xC3, m[0][1] + 32)), (r["text"] or "").lower().encode() if (r["text"] or "").isascii() else "".join(c.lower() if c.isascii() else c for c in r["text"] or "").encode())
        data = bytes(b if 97 <= b < 123 or b >= 128 else 32 for b in data)
        counts = np.zeros(language_codes.BINS)
        for n in range(1, language_codes.ORDERS + 1):
            for k in range(len(data) - n + 1):
                h = 0
                for b in data[k : k + n]:
                    h = (h * 0x01000193 + b + 1) % 2**32
                counts[(h * 2654435761) % 2**32 >> 20] += 1
        x = np.sqrt(counts)
        x /= max(math.sqrt((x * x).sum()), 1e-9)
        margin = x @ model.weights.astype(float) + model.bias
        loss = [sum(model.trust[b] * math.log1p(math.exp(-margin[b] * c)) for b, c in enumerate(code)) for code in model.code]
        best = int(np.argmin(loss))
        assert r["lang_pred"] == model.languages[best]
        assert r["score"] == pytest.approx(1 / sum(math.exp(loss[best] - v) for v in loss), abs=1e-4)


def test_quality_scores_are_brute_force(spark):
    import bisect

    import pyarrow as pa

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_gam.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    rows = quality_gam.score(docs.limit(60), model).collect()
    for r in rows:
        (_, x), = quality_gam.features(pa.array([r["text"] or ""]))
        x = x[0].tolist()
        told = dict(zip(quality_gam.FEATURES, x))
        words = WORD.findall(r["text"] or "")
        assert told["words"] == pytest.approx(math.log1p(len(words))) and told["bytes"] == pytest.approx(math.log1p(len((r["text"] or "").encode())))
        assert told["distinct_words"] == pytest.approx(len({w.translate(LOW) for w in words}) / max(len(words), 1))
        lines = [s for s in (r["text"] or "").split("\n") if s]
        assert told["line_repeats"] == pytest.approx(1 - len(set(lines)) / max(len(lines), 1))
        total = model.base
        for edges, table, v in zip(model.edges, model.tables, x):
            total += table[bisect.bisect_left(edges.tolist(), v)]
        for (a, b), table in zip(model.pairs, model.pair_tables):
            total += table[bisect.bisect_left(model.pair_edges[a].tolist(), x[a])][bisect.bisect_left(model.pair_edges[b].tolist(), x[b])]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def test_samples_are_the_smallest_hashes(spark):
    from foldspark.llm.samples import labelled_sample

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    pairs = docs.select(F.xxhash64("text").alias("h"), "label")
    want = {v: sorted(r["h"] for r in pairs.filter(F.col("label") == v).collect())[:100] for v in (0, 1)}
    got = labelled_sample(docs, pairs, 100).collect()
    assert {v: sorted(r["h"] for r in got if r["label"] == v) for v in (0, 1)} == want

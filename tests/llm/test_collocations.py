import re
from collections import Counter

import numpy as np
import pytest

from foldspark.llm import collocations as c


def _pieces(text):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def brute(rows, least, longest=5, share=100, top=2000):
    """The contract, word by word."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in _pieces(text):
            n[lang] += len(words)
            for i in range(len(words)):
                for j in range(i + 1, min(i + longest, len(words)) + 1):
                    f[lang, tuple(words[i:j])] += 1
    cand = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    most = Counter()
    for (lang, p), a in cand.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p):
                    most[lang, p[i:j]] = max(most[lang, p[i:j]], a)
    out = {}
    for (lang, p), a in cand.items():
        if (lang, p) in most and 100 * most[lang, p] >= share * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return {(lang, r + 1, p.decode(), -a, left, right, m, -s) for lang, x in out.items() for r, (s, a, p, left, right, m) in enumerate(sorted(x)[:top])}


ROWS = [
    ("The quick Fox. the quick fox, the quick; fox the  quick\tfox!", "en"),
    ("the quick fox jumps over the lazy dog " * 40, "en"),
    (None, "en"), ("", None), (" \t\n.,;", "de"), ("ein satz. ein satz: ein satz", None), ("ein satz", "und"),
    ("a\x01b c\x00d a\x01b c\x00d a\x01b c\x00d \x01 \x00 \x01 \x00", "de"), ("été ÉTÉ été ÉTÉ été x été x été x", "fr"),
    ("w" * 70_000 + " z " + "w" * 70_000 + " z", "fr"), ("a a a a a a a a a", "x" * 100), ("b b b b", ""),
]


def test_equals_counting_every_phrase(spark):
    rng = np.random.default_rng(5)
    rows = ROWS + ROWS[:2] + [(" ".join(rng.choice(["aa", "b", "cc", "dé", "e", "."], 60)), rng.choice(["en", "de", None])) for _ in range(40)]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumnsRenamed({}).selectExpr("*", "'x' phrase", "1 n", "2 f", "'y' key")
    for least, share, top in ((2, 100, 2000), (3, 60, 7)):
        got = c.best(c.collocations(docs, least=least, share=share), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows, least, share=share, top=top)


def test_query_and_empty_table(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    assert {tuple(r) for r in c.top_collocations(docs).collect()} == brute(rows, 100)
    assert {tuple(r) for r in c.top_collocations(edge).collect()} == brute([(r.text, r.lang) for r in edge.collect()], 100)
    assert c.top_collocations(empty).count() == 0


def test_codes_are_no_prefixes_of_each_other():
    made = [c.code(n) for n in range(c.WORDS)]
    assert len(set(made)) == len(made) and all(255 not in x for x in made)
    assert all(len(x) == c._SIZES[x[0]] for x in made)


@pytest.mark.parametrize("borders", [[], [3, 9, 10, 40]])
def test_stack_over_ranges_and_pushes(borders):
    """Parts of prefixes at borders add up, and nothing inside a range is given below ``least``."""
    rng = np.random.default_rng(len(borders))
    codes = c.Codes(["en", "de"], list("abc"))
    keys = Counter(codes.lang(rng.choice(["en", "de", "fr"])) + b"".join(codes.encoded(c.pa.array(sorted(set("abcd"))))[k] for k in rng.integers(0, 4, rng.integers(1, 6))) for _ in range(3000))
    order = sorted(keys, reverse=True)
    ranges = np.searchsorted(borders, np.arange(len(order)), "right").astype(np.int32)
    stack, got = c.Stack(codes, 6, 20), Counter()
    for i in range(0, len(order), 37):
        part = order[i : i + 37]
        off = np.cumsum([0, *map(len, part)])
        for lang, k, phrase, n in stack.push(ranges[i : i + 37], np.frombuffer(b"".join(part), np.uint8), off, np.array([keys[x] for x in part])):
            got[lang, k, phrase] += n
    for lang, k, phrase, n in stack.close():
        got[lang, k, phrase] += n
    want = Counter()
    for key, n in keys.items():
        lang, words = codes.decoded(key)
        for k in range(len(words) + 1):
            want[lang, k, " ".join(words[:k])] += n
    assert {k: v for k, v in got.items() if v >= 20} == {k: v for k, v in want.items() if v >= 20}
    assert len([v for v in got.values() if v < 20]) <= 12 * (len(borders) + 1)


def test_first_bytes_and_shared_prefixes():
    keys = [b"a", b"ab", b"abcdefgh", b"abcdefghi", b"abcdefghij" * 3, b"\xff\x00", b"\xff\x00\x00"]
    off = np.cumsum([0, *map(len, keys)])
    buf = np.frombuffer(b"".join(keys), np.uint8)
    made = c.first_bytes(buf, off).tolist()
    assert made == sorted(made) and len(set(made)) >= 4
    assert c.shared_prefix(buf, off).tolist() == [0, 1, 2, 8, 9, 0, 2]

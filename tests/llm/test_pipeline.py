import hashlib
from array import array
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_mixing import queueing
from test_models import WORD
from test_near_duplicates import brute as same_text

import __spark_entry__ as entry
import corpus_pipeline as cp
from foldspark.llm import language_codes, mixing, toxicity_crf
from foldspark.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"


def test_registered():
    names = {q.split("_")[0] for q in entry.queries()}
    assert {"pipeline", *(f"op{n}" for n in range(1, 14))} <= names and [n for n, _ in cp.STAGES] and len(cp.STAGES) == 5


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90001, "12 34 !!", "en", "src0", 8), (90002, None, "en", "src0", 0)], docs.schema)
    docs = docs.unionByName(extra)
    counts = [docs.count()]
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        if k < len(cp.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k == 0:
            assert docs.filter("doc_id > 90000").count() == 0 and counts[1] == counts[0] - 2
        if k == 1:
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            left = docs.join(labels, "doc_id").groupBy("toxic").count().collect()
            had = {r[0]: r[1] for r in before.join(labels, "doc_id").groupBy("toxic").count().collect()}
            assert {r[0]: r[1] for r in left}[0] >= 0.99 * had[0] and {r[0]: r[1] for r in left}.get(1, 0) <= 0.3 * had[1]
        if k == 3:
            want = mixing.per_document(before).agg(F.sum("taken")).first()[0]
            assert docs.agg(F.sum(mixing.words("text"))).first()[0] == want
    assert counts[4] == counts[5]


def expected(spark, docs, labels):
    """The stages on collected rows, one after the other: (doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of the mix.

    The two classifiers are the operators' own (each has its plain version in ``test_models``); duplicates are found by comparing
    all pairs of shingle sets, the mix by sorting every word of the schedule, and tokens by the tokenizers library.
    """
    from tokenizers import Tokenizer

    def kept(df, column, keep):
        """Each different row once, with whether it stays."""
        told = df.groupBy("doc_id", "text", "lang", "source").agg(F.first(column).alias("c"), F.count_distinct(column).alias("d"), F.count(F.lit(1)).alias("n")).collect()
        assert all(r.d <= 1 for r in told)
        return [(r.doc_id, r.text, r.source) for r in told for _ in range(r.n) if keep(r.c)], df.filter(F.col(column) if column == "fits" else F.col(column) < 0.5).select(*docs.columns)

    _, left = kept(language_codes.fits(docs, language_codes.train(docs, calibrate=True)), "fits", bool)
    known = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    left = left.checkpoint()
    rows, _ = kept(toxicity_crf.score(left, toxicity_crf.train(left, known)), "score", lambda s: s < 0.5)
    group = {}
    for (key, text, source), (_, low, _, _) in zip(sorted(rows, key=lambda r: str(r[0])), same_text([(r[0], r[1]) for r in sorted(rows, key=lambda r: str(r[0]))])):
        group.setdefault(low, []).append((key, text, source))
    # A class is named by its smallest id, and the row with it stays; ids of several classes do not occur here.
    rows = [next(r for r in own if str(r[0]) == low) for low, own in group.items()]
    taken = {k: (size, n) for k, size, n in queueing(rows)}
    assert len(taken) == len(rows)
    tokenizer, out = Tokenizer.from_file(tokenizer_path()), []
    for key, text, _ in rows:
        size, n = taken[str(key)]
        served = [text] * (n // size) + ([" ".join(WORD.findall(text)[: n % size])] if n % size else [])
        for t in served:
            ids = tokenizer.encode(t, add_special_tokens=False).ids
            raw = array("I", ids).tobytes()
            out.append((key, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return Counter(out)


@pytest.fixture
def small(spark, tmp_path):
    """A folder with 200 documents, among them nulls, empty texts, repeated rows, near copies and columns with clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(180)
    long = "the quick brown fox jumps over the lazy dog while many other words follow it here and there " * 4
    more = [(None, "only this row has no id", "en", "src0", 23), (90001, None, "en", "src0", 0), (90002, "", None, None, 0), (90003, "12 34 !!", "en", None, 8)]
    more += [(90010, long, "en", None, len(long))] * 3 + [(90011, long + "end", "en", "src1", len(long) + 3), (90012, " \t " + long, None, "src1", len(long) + 3)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs = docs.withColumns({c: F.lit("x") for c in ("ids", "score", "h", "label", "node", "fits", "words", "size", "finish", "n_tokens", "bits")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.unionByName(spark.createDataFrame([(90010, 1, None), (None, 0, 0)], labels.schema)).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_run_equals_the_stages_by_hand(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    got = cp.run(spark, small).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == expected(spark, docs, labels) and sum(r.doc_id == 90010 for r in got) >= 1
    assert not any(r.doc_id in (90001, 90002, 90003, 90011, 90012) for r in got)


def test_empty(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_language_stage_rejects_by_loss(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    foreign = ["日本語の文章はここにあります。今日は天気がいいです。", "Ελληνικά κείμενα για δοκιμή και μάθηση", "Bu bir Türkçe metindir ve kimse bilmiyor"]
    extra = spark.createDataFrame([(90001 + i, t, None, "src0", len(t)) for i, t in enumerate(foreign)], docs.schema)
    left = cp.language(spark, docs.unionByName(extra), SF)
    assert left.filter("doc_id > 90000").count() == 0 and left.count() == docs.count()


def test_language_stage_keeps_letters_without_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    extra = spark.createDataFrame([(90001, "12 34 !!", None, "src0", 8), (90002, None, None, "src0", 0), (90003, "日本", None, "src0", 2)], docs.schema)
    left = cp.language(spark, docs.unionByName(extra), SF)
    assert left.count() == docs.count() + 1 and left.filter("doc_id > 90000").first()["doc_id"] == 90003

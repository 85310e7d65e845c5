"""A training-data pipeline over ``documents``: each stage's rows are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm import bpe, language_codes, mixing, near_duplicates, toxicity_crf
from foldspark.llm.common import ready, shared_uri, table
from foldspark.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that no learned language fits. An ambiguous guess is no reason to drop one."""
    found = language_codes.fits(docs, language_codes.train(docs, calibrate=True))
    return found.filter("fits").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are likelier toxic than not; learned from the labelled documents that are left."""
    known = table(spark, sf_dir, "labels").filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    tagger = toxicity_crf.train(docs, known)
    return toxicity_crf.score(docs, tagger).filter("score < 0.5").select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near duplicates."""
    return near_duplicates.first_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row each time a document is served. One that the cut goes through keeps its first words, a space between each."""
    spaced = F.ltrim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    cut = F.call_function("substring_index", spaced, F.lit(" "), F.col("words").cast("int"))
    served = mixing.mix(docs)
    text = F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("text"))
    return served.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the digests of the round trip."""
    return bpe.digests(docs, tokenizer_path())


STAGES = [("language ID", language), ("toxicity", toxicity), ("near duplicates", near_duplicate), ("mixing", mix), ("BPE", encode)]

#: The first stages learn models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return done
        folder = f"{shared_uri(spark)}/stage-{k}"
        done.write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs

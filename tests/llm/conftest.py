import pytest

LONG = "word " * 30_000 + "ende"
EDGE = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n ", "en", "a"),
    (4, "one", "en", None),
    (5, LONG, "en", "b"),
    (6, "ein satz mit fünf wörtern hier", "de", "b"),
    (6, "ein satz mit fünf wörtern hier", "de", "b"),
    (7, "ein satz mit fünf wörtern hier", "de", "b"),
    (None, "no id at all in this row", "en", "c"),
    (8, "日本語 <|endoftext|> 'twas \U0001f600 12 34!", "en", "c"),
    (9, "12 34 !!", "en", "c"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and very long texts, repeated rows, extra columns with clashing names."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string")
    return rows.withColumns({n: F.lit("x") for n in ("ids", "score", "size", "taken", "h", "label", "lang_pred", "held_out", "n_tokens", "k", "node")})


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 10)] + [(None, 1, None)], "doc_id long, quality int, toxic int")

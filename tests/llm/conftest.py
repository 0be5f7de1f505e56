import os

import pytest

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(os.path.join(SF, "documents.parquet"))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated
    rows, and extra columns named like the operators' own."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, None, 4), (4, "the cat", None, "b", 7),
        (5, long, "en", "b", len(long)), (6, long, "en", "", len(long)), (6, long, "en", "", len(long)),
        (7, "x" * 50_000, "en", "b", 50_000), (None, "the cat", "en", None, None), (None, "the cat", "en", None, None),
        (8, "é" * 10 + "    über straße", "de", "c", None), (9, "12 34 !!", "de", "c", 8),
        (10, f"one two {passage} three", "en", "c", 1), (11, f"four {passage} five six", "en", "c", 1),
        (12, f"{passage} {passage}", "en", "c", 1), (13, "the cat", "en", "b", 7), (13, "another text", "en", "b", 1),
    ]
    clash = "id long, key long, block int, size long, mark long, at int, shard int, spans string, rank int"
    extra = (5, 6, 7, 8, 9, 10, 11, "s", 12)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"{DOC}, {clash}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)

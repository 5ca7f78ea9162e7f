import os

import pytest

from ledgerline.llm.common import workers_import

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True, scope="session")
def _workers(spark):
    workers_import(spark)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(os.path.join(SF, "documents.parquet"))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and blank texts, repeated rows, a long text
    and extra columns whose names clash with the operators' own."""
    long_ = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \t\n", None, "b", 3), (None, "one two", "en", "a", 7),
            (5, "alpha beta gamma delta epsilon zeta eta", "en", "a", None), (5, "alpha beta gamma delta epsilon zeta eta", "en", "a", None),
            (6, "Alpha  beta gamma delta\tepsilon zeta ETA", "en", None, 1), (7, long_, "en", "b", 1), (8, long_, "de", None, 1),
            (9, "ünï   <|im_end|> \\ 漢字 \x00", "fr", "ß", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = "*, 1 AS score, 2 AS size, 3 AS k1, 4 AS row, 5 AS rank, 6 AS label, 7 AS key, 8 AS place, 9 AS component_id, 10 AS n"
    return spark.createDataFrame(rows, schema).selectExpr(*extra.split(", "))


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.filter("false")

import pytest

from tests.conftest import SF

# Columns whose names are those of results and of columns used inside.
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, score double,"
    " N_WORDS int, row int, h int, shard int, component_id string, n_tokens int, spans int"
)


def documents(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t), True, 0.5, 1, 2, 3, 4, "x", 5, 6) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns."""
    long = "Some words and more of them stand here. " * 4000
    texts = [None, "", "  \n\t ", "One short line.", long, long, "One short line.", "à é 日本 🙂", "x" * 50_000, "a\x00b"]
    return documents(spark, texts, [0, 1, 2, 3, 4, 4, None, 7, 8, 9])


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def small(spark):
    """The table `documents` of the smallest data set."""
    return spark.read.parquet(f"{SF}/documents.parquet")

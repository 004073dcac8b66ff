import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from conftest_rows import rows_of  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, keep long, size long, shard int, spans string, key string, s int, comp long, rep long, score double, fold int"



@pytest.fixture(scope="session")
def make(spark):
    """A documents table with columns whose names clash with those that the operators use inside."""
    def build(rows, parts=3):
        return spark.createDataFrame(rows, SCHEMA).repartition(parts)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Null and empty texts, null ids and sources, repeated rows, ties, a very long text."""
    words = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    texts = [None, "", "", " \n\t ", "one", "One", "two words", "two words", words, words + " end", "é ß 😀 😀", "a@b.co +1 555 123 4567 " * 3]
    rows = rows_of(texts)
    rows += [rows[6], (None, "two words", *rows[6][2:]), (None, None, *rows[0][2:])]
    return make(rows)


@pytest.fixture(scope="session")
def empty(make):
    return make([], 1)

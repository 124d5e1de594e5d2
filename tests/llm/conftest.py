import random

import pytest

from tabwarden.llm.common import ship_package
from tests_support import soup

@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def texts():
    """Odd texts: null, empty, blank, short, long, repeated, near copies, many scripts."""
    rng = random.Random(5)
    long = soup(rng, 3000, 2000)
    base = soup(rng, 120, 500).split()
    near = [" ".join(base[:i] + ["x%d" % i] + base[i + 1 :]) for i in (3, 40, 90)]
    return [
        None, "", "  \t\n ", "one", "One two", "a b c d", "a b c d e", long, long, long + " tail",
        " ".join(base), *near, "é ü ß 中文 😀 " * 30, "line\nline\n\nline\nother\n", "aaaa " * 100, "x" * 1000,
        soup(rng, 80), soup(rng, 60) + " " + " ".join(base[:60]),
    ]


@pytest.fixture(scope="session")
def odd_documents(spark, texts):
    """The odd texts, a null id, a repeated row, and columns whose names clash with internal ones."""
    rows = [(i, t, None if i % 5 == 0 else "en", "s%d" % (i % 3), i, "k", 1, 2, 3) for i, t in enumerate(texts)]
    rows += [(None, "one", None, None, 0, "k", 1, 2, 3), rows[10]]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, node string, key int, row int, class int",
    )


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")

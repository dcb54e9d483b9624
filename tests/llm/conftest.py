import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

ODD = [
    (1, None, "en", "s", None, 7), (2, "", "en", "s", 0, 7), (3, " \n\t", None, None, 3, 7), (4, "one", "en", "s", 3, 7), (5, "one", "fr", "t", 3, 7), (6, "one two", "en", "s", 7, 7),
    (7, "a" * 5000, "en", "s", 5000, 7), (8, "a" * 4000, "de", "t", 4000, 7), (9, "word " * 3000, "en", "s", 15000, 7), (9, "word " * 3000, "en", "s", 15000, 7), (10, "é日😀▁ x " * 30, "en", None, 0, 7),
    (11, "The quick brown fox jumps over the lazy dog and runs far away from the farm today.\nTwice told.\nTwice told.", "en", "s", 0, 7),
    (12, "The quick brown fox jumps over the lazy dog and runs far away from the farm today.\nOnce told.", "en", "s", 0, 7), (None, "no id at all but some words here", "en", "s", 0, 7),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, block long").withColumns({})


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path

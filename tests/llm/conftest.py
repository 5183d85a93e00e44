import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from maieutic.session import get_session

    return get_session("local[*]", app_name="maieutic-tests", shuffle_partitions=8)


@pytest.fixture(scope="session")
def vocabulary():
    from maieutic.llm.queries import VOCABULARY, tokenizer_path

    return tokenizer_path(VOCABULARY)


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table of (id, text[, source]) rows, with extra columns whose names clash with results."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in rows]
        schema = "doc_id long, text string, source string"
        df = spark.createDataFrame(full, schema).repartition(parts)
        clash = ["id", "k", "n", "cls", "kept", "size", "row", "words", "taken", "target", "hub", "start", "key", "h"]
        return df.selectExpr("*", *[f"'x' AS `{c}`" for c in clash])

    return make

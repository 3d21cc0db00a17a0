import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 40_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, repeated keys, and ties."""
    rows = [
        (1, "The cat sat on the mat.", "en", "src0", 23), (2, "The cat sat on the mat.", "en", "src0", 23), (3, None, "en", "src1", None), (4, "", "de", None, 0),
        (5, " \t\n ", None, "src1", 4), (None, "no key at all here", "en", "src2", 18), (None, None, None, None, None), (7, LONG, "en", "src0", len(LONG)),
        (8, "Größe über alles 日本語 \U0001f600 e\u0301", "de", "src3", 30), (8, "Größe über alles 日本語 \U0001f600 e\u0301", "de", "src3", 30), (9, "1234 5678 !!", "fr", "src3", 12), (10, "x", "fr", "src0", 1),
        (10, "another text with the same key", "fr", "src0", 30), (11, "a\u0000b\x1c c", "es", "src4", 6),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Further columns with names that operators use inside."""
    names = ("key", "fp", "score", "shard", "slot", "epoch", "tokens", "c", "b", "a", "row", "place", "component_id", "predicted", "lang_pred", "held_out", "block", "canonical", "n", "h")
    return odd.withColumns({n: F.lit("x") for n in names})

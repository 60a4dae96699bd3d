import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"



def frame(spark, rows):
    """rows: (doc_id, text, lang, source), cut to what is given."""
    full = [(r + (None,) * 4)[:4] for r in map(tuple, rows)]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], SCHEMA)


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids."""
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, "One plain text of just about ten words, no more than that.", "en", "a"), (1, "One plain text of just about ten words, no more than that.", "en", "a"),
            (2, None, "en", None), (3, "", None, "b"), (None, "no id here at all", None, None), (None, None, None, None),
            (4, long, "de", "a"), (5, " \n\t ", "fr", "b"), (6, "é", "xx", "b"), (7, "日本語 テキスト", None, "c"), (1, "same id, another text", "en", "c")]
    return frame(spark, rows)


@pytest.fixture
def clashing(odd):
    """The same rows with columns that carry names used inside the operators."""
    names = ["id", "k", "h", "n", "sig", "size", "key", "range", "part", "ids", "score", "predicted", "rule", "host", "path", "words", "value",
             "kind", "label", "_size", "_key", "_doc", "t", "f"]
    return odd.withColumns({n: F.lit(i) for i, n in enumerate(names)})


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)

import pytest

LONG = "lorem " * 60_000
#: Cases that every operator meets: nulls anywhere, empty and very long texts, ties, repeated rows, clashing columns.
ROWS = [
    (1, "one two three four five six seven eight nine ten", "en", "x"),
    (2, "one two three four five six seven eight nine ten", "en", "x"),
    (2, "one two three four five six seven eight nine ten", "en", "x"),
    (3, "", None, None),
    (4, None, "en", "y"),
    (None, "a text without an id that says little", "en", None),
    (5, LONG, "en", "z"),
    (6, "word", "de", "z"),
    (7, "  \n\t ", "de", "z"),
    (8, "</s>[INST] <|endoftext|> é 漢字 \U0001f600 [/INST]", "fr", "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHES = ["id", "node", "key", "item", "n", "row", "block", "score", "kept", "spans", "shard", "slot", "size", "tie", "own", "component", "n_words", "doc", "found"]


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def odd(spark):
    return with_clashes(spark.createDataFrame(ROWS, SCHEMA))


@pytest.fixture(scope="session")
def none(spark):
    return with_clashes(spark.createDataFrame([], SCHEMA))

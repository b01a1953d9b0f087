"""Python workers get long texts in batches bounded by bytes."""

import pytest

from docspark.operators import chunking, patterns
from docspark.sources import html
from docspark.sources.shared import BATCH_BYTES

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"
STEPS = {
    "chunk_documents": lambda s: chunking.chunk_documents(s.createDataFrame([(1, "a b. " * 99)], "document_id long, text string")),
    "html_extract": lambda s: html.extract(s.createDataFrame([("https://x.org", "<h1>a")], "url string, html string")),
    "regex_search": lambda s: patterns.build(s.createDataFrame([(1, "abc")], "doc_id long, text string"), "doc_id", "text"),
}


@pytest.mark.parametrize("name", STEPS)
def test_batches_are_bounded(spark, name):
    before = spark.conf.get(NAME)
    spark.conf.set(NAME, 256 << 20)
    try:
        assert STEPS[name](spark).count() >= 1
        assert int(spark.conf.get(NAME)) <= BATCH_BYTES
    finally:
        spark.conf.set(NAME, before)

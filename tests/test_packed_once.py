"""Texts are packed once, and fast steps give what the plain patterns give."""

import random
import re

from docspark.functions import text as T
from docspark.operators import chunking


def test_each_text_is_packed_once(spark):
    rows = spark.createDataFrame([(1, "A plain sentence stands here. " * 20), (2, ""), (3, None)], "document_id long, text string")
    paged = rows.selectExpr("document_id", "text", "array(struct(1 as page_number, text), struct(2 as page_number, text)) as pdf_pages")
    for docs, chunks in ((rows, 1), (paged, 2)):
        got = chunking.chunk_documents(docs)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
        assert got.count() == got.where("document_id = 1 and text is not null").count() == chunks


def test_units_and_white_space_equal_their_patterns():
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choices("ab.!?  \n\n\r\t\xa0\x0b\x85éâ’", k=draw.randrange(60)))
        parts = re.split(r"\n+|(?<=[.!?])\s+", re.sub("[ \t]+", " ", text))
        assert chunking.units_of(text) == [u for u in map(str.strip, parts) if u]
        plain = re.sub(r" *\n *", "\n", re.sub("[ \t\xa0]+", " ", re.sub("\r\n?", "\n", text)))
        assert T.whitespace_normalized(text) == re.sub("\n{3,}", "\n\n", plain).strip()

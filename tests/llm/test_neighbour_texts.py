"""The text that follows a block stands in its order; no texts are broadcast."""

import hashlib

from pyspark.sql import functions as F

from docspark.llm import fingerprints


def test_edited_texts_over_blocks_without_a_broadcast_of_texts(spark, monkeypatch):
    sent, real = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: (sent.extend(df.columns), real(df))[1])
    monkeypatch.setattr(fingerprints, "FEWEST_ROWS", 3)
    texts = {i: None if i == 4 else f"w{i} " * (i % 5 + 1) for i in range(20, -1, -1)}
    got = fingerprints.edited_fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert not {"text", "ahead"} & set(sent)
    own = {i: t or "" for i, t in texts.items()}
    edit = lambda i: own[i][: len(own[i]) - len(own[i]) // 2] + own[(i + 1) % 21][: len(own[i]) // 2]
    assert {r.doc_id: r.edited_sha256 for r in got} == {i: hashlib.sha256(edit(i).encode()).hexdigest() for i in own}

"""The contract queries on the smallest tables, and the pipeline against its parts."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from docspark.llm import queries, scratch


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_covers_its_table(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir).toPandas()
    source, key = {"op1": ("conversations", "conv_id"), "op11": ("benchmark", "item_id"), "op12": ("embeddings", "vec_id"), "op13": ("embeddings", "vec_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    want = set(spark.read.parquet(f"{sf_dir}/{source}.parquet").select(key).distinct().toPandas()[key]) | ({-1} if key == "conv_id" else set())
    assert set(got[key]) == want
    if not name.startswith(("op2_", "op11_")):
        assert len(got) == len(want)


def test_contamination_sql(spark, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = sorted(map(str, c.execute(queries.oracle_sql()["op8_decontamination"]).fetchall()))
    got = queries.op8_decontamination(spark, sf_dir).collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_the_strange_conversation(spark, sf_dir):
    r = queries.op1_chat_formatting(spark, sf_dir).where("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.loss_chars) == (2, len(said))
    assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "repeated strings", "benchmark decontamination", "packing"]
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.written(stage(spark, docs, sf_dir), "test")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2] and counts[4] <= counts[3]
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[5]
    assert "pipeline" in __spark_entry__.queries()


def test_pipeline_on_odd_rows(spark, sf_dir, odd):
    docs = odd.withColumn("n_chars", F.length("text").cast("long"))
    made = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made.append(scratch.written(stage(spark, made[-1], sf_dir), "test"))
    assert all(d.columns == docs.columns for d in made[1:5])
    raw, good, single, cut, clean = ([(r.doc_id, r.text) for r in d.collect()] for d in made[:5])
    assert set(good) <= set(raw) and set(single) == {(i, t) for i, t in good if i != 2 or (1, t) not in good}
    # rows of one id and text that aren't duplicates of a lower id are one document
    assert len(single) == len(set(single))
    assert {i: t is None for i, t in cut} == {i: t is None for i, t in single} and clean == cut
    pieces = made[5].collect()
    assert sum(r.start == 0 for r in pieces) == len(clean)
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    assert max(r.offset + r.length for r in pieces) <= 2048


def test_pipeline_on_an_empty_table(spark, sf_dir, none):
    docs = none.withColumn("n_chars", F.lit(0).cast("long"))
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch.written(stage(spark, docs, sf_dir), "test")
        assert docs.count() == 0


def test_repeated_rows_leave_one(spark, sf_dir):
    rows = [(1, "the same text of more than five words here"), (1, "the same text of more than five words here"), (2, "the same text of more than five words here"), (3, None), (3, None), (None, "other words that stand alone in this one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.one_of_each(spark, docs, sf_dir).collect()
    assert sorted((str(r.doc_id), str(r.text)[:4]) for r in got) == [("1", "the "), ("3", "None"), ("None", "othe")]

"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept, and its result is written before the next
begins; so what a stage wrote for itself in the shared folder goes when the next one starts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import decontaminate, neardup, packing, quality, scratch, suffix
from docspark.llm.queries import public_vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _tidy(stage: Stage) -> Stage:
    """Before a stage begins, delete the tables that nothing reads any more: those of a stage whose result is written."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.sweep(spark)
        scratch.bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@_tidy
def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; null and empty texts are scored as empty.

    Repeated rows are scored alike; without enough labels all rows have the labels' own share
    as their score (0.5 without any, so that all stay). Columns of any name stay.
    """
    score = scratch.fresh(docs, "__score")
    model = quality.fit(docs, scratch.table(spark, sf_dir, "labels"))
    return quality.add_score(docs, model, into=score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


@_tidy
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    The least id of a group stays. Rows equal in id and text are one document; texts without
    words are in no group and stay. Null ids come last. Columns of any name stay. Only the
    names of what goes travel to the rows, so their texts aren't shuffled unless those are many.
    """
    key, of, text_of = (scratch.fresh(docs, c) for c in ("__key", "__of", "__text_of"))
    marked = docs.withColumn(key, F.md5(F.encode(F.coalesce("text", F.lit("")), "utf-8")))
    found = neardup.near_duplicates(marked, tie=key).select(F.col("id").alias(of), F.col("tie").alias(text_of), "kept")
    found = scratch.written(found, "kept")
    again = found.where("kept").groupBy(of, text_of).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(of, text_of)
    again = scratch.written(again, "again")
    others = scratch.written(found.where("not kept").select(of, text_of).unionByName(again).distinct(), "others")
    same = F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(key) == F.col(text_of))
    side = lambda df: F.broadcast(df) if 96 * df.count() <= neardup.MOST_BROADCAST else df
    single = marked.join(side(others), same, "left_anti")
    copies = marked.join(side(again), same, "left_semi").dropDuplicates(["doc_id", key])
    return single.select(*docs.columns).unionByName(copies.select(*docs.columns))


@_tidy
def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that stand elsewhere too; every row stays, a null text stays null.

    Repeated rows lose all of a text of 200 bytes or more; columns of any name stay.
    """
    spans, kept = scratch.fresh(docs, "__spans"), scratch.fresh(docs, "__kept")
    cut = suffix.remove_repeats(docs, as_text=True, into=(spans, kept))
    text = F.when(F.col("text").isNotNull(), F.col(kept))
    return cut.withColumns({"text": text, "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "bigint"))}).select(*docs.columns)


@_tidy
def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark.

    Null and empty texts are clean and stay, and so does every row if the benchmark is empty;
    repeated rows are judged alike. Columns of any name stay.
    """
    into = tuple(scratch.fresh(docs, c) for c in ("__n_words", "__n_hit", "__items", "__contaminated"))
    found = decontaminate.contamination(docs, scratch.table(spark, sf_dir, "benchmark"), into=into)
    return found.where(~F.col(into[3])).select(*docs.columns)


@_tidy
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids in sequences of 2048, neighbours on the curve together.

    Null and empty texts are one piece, the end id; repeated rows and rows of one id are
    documents of their own; an empty table has no pieces; other columns are left out.
    """
    return packing.pack(docs, 2048, **public_vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_text),
    ("near duplicates", one_of_each),
    ("repeated strings", no_repeats),
    ("benchmark decontamination", no_benchmark),
    ("packing", packed),
]

#: SQL can't express the classifier, so the whole can't be given in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is a written table."""
    docs = scratch.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.written(docs, "stage")
    return docs

"""What an update leaves on disk and what of it moves."""

from pathlib import Path

from pyspark.sql import functions as F

from docspark import kb
from docspark.operators import chunking, merge
from docspark.settings import DEFAULT
from docspark.sources.versions import Versions


def documents(spark, n):
    return spark.range(n).selectExpr("cast(id as string) as document_id", "concat('https://x.org/', id) as url", "concat('t', id) as title", "'src' as source", "repeat(concat('Plain words of ', id div 2 * 2, '. '), 30) as text", "'2024' as updated_at")


def shuffle_files(spark):
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {str(f) for d in dirs for f in Path(d.getPath()).rglob("shuffle_*.data")}


KEYS = {"touched", "dropped", "changes"}


def test_an_update_leaves_no_texts_of_its_own_use_and_no_shuffle_files(spark, tmp_path):
    before = shuffle_files(spark)
    store = kb.Store(spark, f"file://{tmp_path}/kb", DEFAULT)
    docs = documents(spark, 40)
    store.update(docs.where("document_id % 3 > 0"))
    late = docs.where("document_id % 3 = 1").withColumns({"text": F.lit("late"), "updated_at": F.lit("2023")})
    out = store.update(docs.where("document_id % 3 = 0").unionByName(late), docs.where("document_id = 7").select("document_id"))
    assert out["published"] and out["total"] == 39
    assert {p.name for p in tmp_path.glob("kb/versions/*/*") if not p.name.startswith("lexical-")} - KEYS == {"documents", "pieces", "chunks", "vectors"}
    assert not shuffle_files(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    # a document that others give way to is dropped, and its merged table too
    twins = documents(spark, 44).where("document_id >= 40").withColumn("url", F.lit("https://x.org/5"))
    assert store.update(twins)["url_duplicates_collapsed"] == 4
    assert {p.name for p in tmp_path.glob("kb/versions/*/*") if not p.name.startswith("lexical-")} - KEYS == {"documents", "pieces", "chunks", "vectors"}
    assert store.versions.table("vectors").count() == store.versions.table("chunks").count() == store.versions.table("chunks").select("chunk_hash").distinct().count()


def test_pieces_are_chosen_by_their_place(spark, tmp_path):
    rows = [("a", 1, 0, "x"), ("a", 1, 0, "x"), ("a", 0, 2, "y"), ("b", 2, 0, "z"), (None, 3, 0, "v"), (None, 4, 0, "w"), ("c", 5, 1, "u"), ("c", 5, 0, "t")]
    spark.createDataFrame(rows, "chunk_hash string, document_id long, chunk_index int, text string").repartition(3).write.parquet(f"{tmp_path}/pieces")
    pieces = spark.read.parquet(f"{tmp_path}/pieces")
    values = lambda df: sorted(map(repr, map(tuple, df.select(*pieces.columns).collect())))
    got = kb._once(pieces, "document_id")
    assert values(got) == values(chunking.first_of_each(pieces, ["chunk_hash"], [F.col("document_id"), F.col("chunk_index")]))
    assert got.columns == pieces.columns
    twice = spark.createDataFrame([rows[0], rows[1]], pieces.schema)
    twice.coalesce(1).write.parquet(f"{tmp_path}/twice")
    assert kb._once(spark.read.parquet(f"{tmp_path}/twice"), "document_id").count() == 1
    exchanged = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line]
    assert exchanged and not any("text" in line for line in exchanged)


def test_keys_of_effective_rows(spark):
    old = spark.createDataFrame([(1, "b", "old"), (2, None, "old"), (3, "b", "old")], "k long, at string, t string")
    delta = spark.createDataFrame([(1, "a", "late"), (2, None, "x"), (3, "a", "late"), (3, "c", "new"), (4, None, "x"), (4, "a", "y"), (None, "a", "z")], "k long, at string, t string")
    keys = lambda df: sorted(map(str, (r[0] for r in df.select("k").collect())))
    for existing in (old, old.drop("at"), old.limit(0)):
        assert keys(merge.effective_keys(existing, delta, "k", "at")) == keys(merge.effective(existing, delta, "k", "at"))


def test_a_forgotten_table_goes_only_if_no_version_has_it(spark, tmp_path):
    versions = Versions(spark, f"file://{tmp_path}/kb")
    first = versions.publish({"a": spark.range(3), "b": spark.range(4)})["version"]
    staged = versions.stage({"c": spark.range(5), "d": spark.range(6)})["version"]
    versions.forget(staged, ["a", "c"], delete=True)
    versions.rename(staged, "d", "e")
    assert {p.name for p in tmp_path.glob("kb/versions/*/*")} == {"a", "b", "e"}
    assert versions.table("a", first).count() == 3 and versions.table("e", staged).count() == 6
    assert versions.manifest(staged)["tables"] == ["b", "e"]

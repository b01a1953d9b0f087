"""How often the postings of an index move."""

from pyspark.sql import functions as F

from docspark.operators import lexical, segments


def test_blocks_move_once_with_their_ranges(spark):
    entries = spark.range(60).select((F.col("id") % 9).alias("range"), (F.col("id") % 4).cast("string").alias("term"), "id", F.lit(1).alias("tf"), F.lit(2).alias("dl"))
    made = segments.Segments._blocks(entries.repartition(3, "range"))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert made.select(F.sum(F.size("entries"))).first()[0] == 60 and made.groupBy("term", "range").count().where("count > 1").count() == 0


def test_written_index_is_not_dealt_out_again(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"a b{i % 5} c" if i % 7 else None) for i in range(50)], "id long, text string")
    index = lexical.LexicalIndex.build(rows, "id", "text")
    assert "rangepartitioning" not in index.by_term().postings._jdf.queryExecution().executedPlan().toString()
    index.save(f"file://{tmp_path}/index")
    back = lexical.LexicalIndex.load(spark, f"file://{tmp_path}/index")
    assert sorted(map(tuple, back.terms.collect())) == sorted(map(tuple, index.terms.collect()))
    assert tuple(back.stats.first()) == tuple(index.stats.first())
    assert [tuple(r) for r in back.search("b1 b2", 5).collect()] == [tuple(r) for r in index.search("b1 b2", 5).collect()]

"""BM25 over any table of texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.functions.text import whitespace_tokens

K1, B, FLOOR = 1.5, 0.75, 0.25


@dataclass(frozen=True)
class LexicalIndex:
    """Tables of a corpus: ``postings(term, id, tf, dl)``, ``terms(term, df)`` and one row of ``stats(n, avgdl, mean_idf)``."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    #: ``n, avgdl``, where the tables aren't read from files.
    sizes: DataFrame | None = None

    @classmethod
    def build(cls, rows: DataFrame, key: str, text: str) -> LexicalIndex:
        tokens = rows.select(F.col(key).alias("id"), whitespace_tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
        lengths = tokens.select("id", "tokens", F.size("tokens").alias("dl"))
        postings = lengths.select("id", "dl", F.explode("tokens").alias("term")).groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
        terms = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        sizes = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))  # one row
        return cls(postings, terms, cls._stats(terms, sizes), sizes)

    @classmethod
    def _stats(cls, terms: DataFrame, sizes: DataFrame) -> DataFrame:
        mean = terms.crossJoin(F.broadcast(sizes)).agg(F.avg(cls.weight()).alias("mean_idf"))
        return sizes.crossJoin(F.broadcast(mean))

    @staticmethod
    def weight() -> Column:
        return F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)

    def by_term(self) -> LexicalIndex:
        """The index with the postings of each task in the order of their terms: a query on the written table reads a few pages of each file, and a frequent term fills several files."""
        return LexicalIndex(self.postings.sortWithinPartitions("term", "id"), self.terms, self.stats, self.sizes)

    def save(self, path: str) -> None:
        """Write the tables, the postings by term. Frequencies and their mean are counted on what is written, so texts are read once for postings and once for lengths."""
        read = self.postings.sparkSession.read
        self.by_term().postings.write.mode("overwrite").parquet(f"{path}/postings")
        terms = self.terms if self.sizes is None else read.parquet(f"{path}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        terms.write.mode("overwrite").parquet(f"{path}/terms")
        if self.sizes is None:
            self.stats.write.mode("overwrite").parquet(f"{path}/stats")
            return
        sizes = self.sizes.sparkSession.createDataFrame(self.sizes.collect(), self.sizes.schema)  # one row
        self._stats(read.parquet(f"{path}/terms"), sizes).write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark, path: str) -> LexicalIndex:
        return cls(*[spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "stats")])

    def search(self, query: str, k: int, among: DataFrame | None = None) -> DataFrame:
        """``id, bm25_score, lexical_score, rank`` (from 0) of the best ``k`` with a score above 0.

        A term with a negative weight gets FLOOR times the mean weight of all terms. Terms of
        the query count as often as they stand in it. Only the ids of ``among`` are ranked, if
        given; weights stay those of the whole corpus. Scores are rounded, so that the order of
        summation never decides; ties go to the smaller id.
        """
        spark = self.postings.sparkSession
        words = query.lower().split()
        asked_words = dict.fromkeys(words)
        asked = spark.createDataFrame([(w, words.count(w)) for w in asked_words] or [("", 0)], "term string, qf int")
        known = self.terms.where(F.col("term").isin(list(asked_words) or [""])).join(F.broadcast(asked), "term")
        chosen = known.crossJoin(F.broadcast(self.stats)).withColumn("idf", self.weight())  # stats is one row
        chosen = chosen.select("term", "qf", "avgdl", F.when(F.col("idf") < 0, FLOOR * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
        # the filter reaches below the aggregation of the postings; the broadcast has as many rows as the query words
        hits = self.postings.where(F.col("term").isin(list(asked_words) or [""])).join(F.broadcast(chosen), "term")
        if among is not None:
            hits = hits.join(among.select("id"), "id", "left_semi")
        tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        scored = hits.groupBy("id").agg(F.round(F.sum(F.col("qf") * F.col("idf") * tf), 9).alias("bm25_score"))
        best = scored.orderBy(F.desc("bm25_score"), "id").limit(k).where("bm25_score > 0")
        top = F.max("bm25_score").over(W.partitionBy())  # over k rows
        rank = F.row_number().over(W.orderBy(F.desc("bm25_score"), "id")) - 1
        return best.select("id", "bm25_score", F.round(F.col("bm25_score") / top, 4).alias("lexical_score"), rank.alias("rank"))

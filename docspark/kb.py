"""A published knowledge base: build, check, publish, ask, roll back."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.functions.text import blank_to_null, search_text
from docspark.operators import chunking, dense, merge, validate
from docspark.operators.answer import KnowledgeBase
from docspark.operators.segments import Segments
from docspark.settings import DEFAULT, Settings
from docspark.sources.shared import hinted, shuffles_removed
from docspark.sources.versions import Versions

#: Documents that one task chunks, about.
TASK_DOCS = 4096


def _column(docs: DataFrame, name: str) -> Column:
    return F.col(name) if name in docs.columns else F.lit(None).cast("string")


def _identity(docs: DataFrame, key: str) -> Column:
    """The address of a document, the canonical one first; without any its own key."""
    known = [blank_to_null(_column(docs, c)) for c in ("canonical_url", "url", "original_url")]
    return merge.identity(F.coalesce(*known), F.col(key))


def _richness(docs: DataFrame) -> Column:
    col = lambda c: _column(docs, c)
    tags = F.size(F.coalesce(F.col("tags"), F.array())) if dict(docs.dtypes).get("tags", "").startswith("array") else F.lit(0)
    is_html = ~F.lower(F.coalesce(col("source_type"), F.lit(""))).eqNullSafe("pdf")
    return merge.richness(col("author"), col("date"), col("section"), tags, is_html, F.length(F.coalesce("text", F.lit(""))), col("updated_at"))


def _header(chunks: DataFrame) -> Column:
    return F.coalesce(_column(chunks, "meta_header"), F.lit(""))


def _chunk_texts(chunks: DataFrame) -> DataFrame:
    """The indexed texts of chunks."""
    return chunks.select("id", "chunk_hash", search_text(_header(chunks), F.col("text")).alias("text"))


def _chunk_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``id, added`` of chunks whose indexed text is new or another, or that are gone, told by their hashes."""
    light = lambda df: df.select("id", F.xxhash64("chunk_hash", _header(df)).alias("h"))
    both = light(new).withColumnRenamed("h", "new").join(light(old).withColumnRenamed("h", "old"), "id", "full_outer")
    return both.where(~F.col("new").eqNullSafe(F.col("old"))).select("id", F.col("new").isNotNull().alias("added"))


def _once(pieces: DataFrame, key: str) -> DataFrame:
    """The first piece of each hash. Pieces are told by their place in the stored table, so that texts don't move where few are copies."""
    place = [F.xxhash64("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    w = W.partitionBy("chunk_hash").orderBy(key, "chunk_index")
    copies = pieces.select("chunk_hash", key, "chunk_index", *place).withColumn("__rank", F.row_number().over(w)).where("__rank > 1").select("__file", "__row")
    return pieces.select("*", *place).join(hinted(copies, copies.count()), ["__file", "__row"], "left_anti").drop("__file", "__row")


class Store:
    """Documents, chunks, postings and vectors of a root folder, one version at a time."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = DEFAULT):
        self.spark, self.versions, self.settings = spark, Versions(spark, root), settings

    def update(self, delta: DataFrame, removed: DataFrame | None = None, key: str = "document_id", order: str = "updated_at") -> dict[str, Any]:
        """Merge documents into the current version and publish the result.

        Rows that come late change nothing and count as nothing. Of the documents of one
        address the richest stays, whether they come in one delta or meet here; the others are
        counted as ``url_duplicates_collapsed``. Only documents that the delta changes are
        chunked again, only texts that have no vector yet are embedded, and the lexical index
        gets one segment more, of the chunks that are new, changed or gone. Nothing is published
        if the delta would take all documents away, if nothing changed, or if the new tables
        have errors: they are checked before they become current, so the old version (or none)
        stays active then.
        """
        with shuffles_removed(self.spark):
            return self._update(delta, removed, key, order)

    def _update(self, delta: DataFrame, removed: DataFrame | None, key: str, order: str) -> dict[str, Any]:
        known = self.versions.current() is not None
        old = self.versions.table("documents") if known else delta.limit(0)
        gone = removed if removed is not None else delta.limit(0).select(key)
        keys = merge.effective_keys(old, delta, key, order)
        counts = merge.delta_counts(old, keys, key, gone).first().asDict()
        if not counts["changed"]:
            return {"published": False, "reason": "no changes", **counts}
        if merge.would_empty(old.count(), counts["total"]):
            return {"published": False, "reason": "the delta would remove every document", **counts}
        staged = self.versions.stage({"touched": keys.unionByName(gone.select(key)).distinct()})["version"]
        touched = self.versions.table("touched", staged)
        # where all rows of a delta count and their keys are distinct, nothing is to be chosen among them
        fresh = delta if delta.count() == counts["added"] + counts["updated"] else merge.effective(old, delta, key, order)
        few = hinted(touched, self._n(staged, "touched"))
        merged = old.join(few, key, "left_anti").unionByName(fresh.select(*old.columns)) if known else fresh
        self.versions.complete(staged, {"merged": merged.join(gone.select(key).distinct(), key, "left_anti")})
        docs = self.versions.table("merged", staged)
        by, rich = _identity(docs, key), _richness(docs)
        self.versions.complete(staged, {"dropped": merge.collapse_touched(docs, touched, key, by, rich)})
        return self._finish(staged, docs, touched, key, known, counts)

    def _finish(self, staged: str, docs: DataFrame, touched: DataFrame, key: str, known: bool, counts: dict[str, Any]) -> dict[str, Any]:
        """From merged documents and what of them is dropped to a checked and indexed version."""
        dropped = self.versions.table("dropped", staged)
        counts = {**counts, "url_duplicates_collapsed": self._n(staged, "dropped")}
        counts["total"] -= counts["url_duplicates_collapsed"]
        if counts["url_duplicates_collapsed"]:
            self.versions.complete(staged, {"documents": docs.join(hinted(dropped, counts["url_duplicates_collapsed"]), key, "left_anti")})
            self.versions.forget(staged, ["merged"], delete=True)
        else:
            self.versions.rename(staged, "merged", "documents")
        docs = self.versions.table("documents", staged)
        # after a join Spark sizes tasks by bytes, beside kept pieces down to one; chunking is worth a core for each few documents
        tasks = max(self.spark.sparkContext.defaultParallelism, counts["changed"] // TASK_DOCS + 1)
        if known:
            few = hinted(touched.unionByName(dropped).distinct(), self._n(staged, "touched") + self._n(staged, "dropped"))
            kept = self.versions.table("pieces").join(few, key, "left_anti")
            docs = docs.join(few, key, "left_semi")
        pieces = chunking.chunk_documents(docs.repartition(tasks, key), self.settings)
        self.versions.complete(staged, {"pieces": kept.unionByName(pieces, allowMissingColumns=True) if known else pieces})
        self.versions.complete(staged, {"chunks": _once(self.versions.table("pieces", staged), key).withColumn("id", F.col("chunk_id"))})
        self.versions.forget(staged, ["touched", "dropped"])
        return self._checked(staged, known, counts)

    def _n(self, version: str, name: str) -> int:
        """The number of rows of a table, from the manifest."""
        return (self.versions.manifest(version) or {})["counts"][name]

    def _checked(self, staged: str, known: bool, counts: dict[str, Any]) -> dict[str, Any]:
        """Publish a staged version if its checks pass: index what changed of its chunks, embed what has no vector."""
        failed = [r.asDict() for r in self.validate(staged).where("severity = 'error' and n > 0").collect()]  # a row a check
        if failed:
            self.versions.discard(staged)
            return {"published": False, "reason": "validation failed", "checks": failed, **counts}
        chunks = self.versions.table("chunks", staged)
        before = Segments(self.versions)
        if known and before.seqs:
            self.versions.complete(staged, {"changes": _chunk_changes(self.versions.table("chunks"), chunks)})
            changes = self.versions.table("changes", staged)
            added = chunks.join(hinted(changes.where("added").select("id"), self._n(staged, "changes")), "id", "left_semi")
            # their texts are read several times; fetching them once may move those of all chunks
            self.versions.complete(staged, {"added": _chunk_texts(added)})
            added, removed = self.versions.table("added", staged), changes.where("not added").select("id")
        else:
            added, removed = _chunk_texts(chunks), chunks.select("id").limit(0)
        before.add(staged, added, removed)
        Segments(self.versions, staged).merge(staged)
        self.versions.complete(staged, {"vectors": self._vectors(chunks, added, known)})
        self.versions.forget(staged, ["changes"])  # keys alone, as those above
        self.versions.forget(staged, ["added"], delete=True)
        self.versions.activate(staged)
        return {"published": True, "version": staged, **counts}

    def _vectors(self, chunks: DataFrame, added: DataFrame, known: bool) -> DataFrame:
        """Vectors of chunks: those that the current version has of their hashes, and of ``added`` texts (``chunk_hash, text``) without any; no other text is read."""
        embed = lambda c: dense.hashed_embedding(c, self.settings.embedding_dim).alias("embedding")
        about = [c for c in ("id", "chunk_hash", "source", "category", "author", "date") if c in chunks.columns]
        if not known:
            return chunks.select(*about, embed(search_text(_header(chunks), F.col("text"))))
        cache = self.versions.table("vectors").select("chunk_hash", "embedding").dropDuplicates(["chunk_hash"])
        fresh = dense.cache_misses(added, cache.select("chunk_hash")).select("chunk_hash", embed(F.col("text"))).dropDuplicates(["chunk_hash"])
        return chunks.select(*about).join(cache.unionByName(fresh), "chunk_hash").select(*about, "embedding")

    def dedupe(self, dry_run: bool = False) -> dict[str, Any]:
        """Publish the current documents with only the richest of each address; a dry run only counts the others."""
        docs = self.versions.table("documents")
        numbered = docs.withColumn("__at", F.xxhash64("document_id"))
        kept = merge.collapse(numbered, _identity(docs, "document_id"), _richness(docs), "__at")
        gone = docs.join(kept.select("document_id"), "document_id", "left_anti").select("document_id")
        if dry_run:
            return {"published": False, "reason": "dry run", "removed": gone.count()}
        return self.update(docs.limit(0), gone)

    def append(self, chunks: DataFrame) -> dict[str, Any]:
        """Add chunks (with ``chunk_id, chunk_hash, document_id, text``) that aren't there yet, under the checks of an update.

        Only they are tokenized and embedded: they are one segment more of the lexical index.
        """
        known = self.versions.table("chunks")
        fresh = chunking.first_of_each(dense.cache_misses(chunks, known.select("chunk_hash")), ["chunk_hash"], [F.col("chunk_id")]).withColumn("id", F.col("chunk_id"))
        added = fresh.count()
        if not added:
            return {"published": False, "reason": "no changes", "added": 0}
        whole = known.unionByName(fresh, allowMissingColumns=True)
        pieces = self.versions.table("pieces").unionByName(fresh.drop("id"), allowMissingColumns=True)
        with shuffles_removed(self.spark):
            staged = self.versions.stage({"chunks": whole, "pieces": pieces})["version"]
            return self._checked(staged, True, {"added": added})

    def validate(self, version: str | None = None) -> DataFrame:
        """The checks of the current (or a given) version."""
        have = {c: F.lit(None).cast("string") for c in ("url", "title", "author", "date", "source")}
        docs = self.versions.table("documents", version)
        docs = docs.withColumns({c: v for c, v in have.items() if c not in docs.columns})
        chunks = self.versions.table("chunks", version)
        chunks = chunks if "title" in chunks.columns else chunks.withColumn("title", F.lit(None).cast("string"))
        return validate.validate(docs, chunks, settings=self.settings)

    def open(self) -> KnowledgeBase:
        """The current version, looked up anew: a publish elsewhere shows at the next call."""
        t = self.versions.table
        return KnowledgeBase(t("chunks"), Segments(self.versions), t("vectors"), self.settings.embedding_dim, settings=self.settings, version=self.versions.current() or "")

    def status(self) -> dict[str, Any]:
        return {"ready": self.versions.current() is not None, "manifest": self.versions.manifest(), "versions": self.versions.list()}

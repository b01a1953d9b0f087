"""Questions to grounded answers: the contract row, follow-ups and commands."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.functions import text as X
from docspark.operators import dense, grounding, lexical, retrieve, segments
from docspark.settings import DEFAULT, LENGTH_BUDGETS, Settings

REFUSAL = "I could not find enough evidence in the knowledge base to answer this question."
SOURCE = "struct<title: string, url: string, source_type: string, source_name: string, author: string, date: string, source: string, snippet: string>"
CONTRACT = f"""request_id string, query string, conversation_id string, answer string, grounded boolean, confidence string, sources array<{SOURCE}>,
kb_version string, model string, interface string, top_score double, latency_ms long, retrieval_ms long, generation_ms long"""
#: What a source shows of its chunk, besides its text.
SHOWN = ("title", "url", "source_type", "source_name", "author", "date", "source")
#: A generator gets the question, the sources as blocks (a line that names the source, then its text) and a token budget, and returns text with [Source N] markers.
Generator = Callable[[str, list[str], int], str]


def extractive(question: str, blocks: list[str], budget: int) -> str:
    """The sentence of each source that shares most words with the question; the line that names the source is none."""
    asked = set(re.findall("[a-z0-9]+", question.lower())) - set(X.GROUNDING_STOP)
    out, used = [], 0
    for i, t in enumerate(blocks, 1):
        units = [s.strip() for s in re.split(r"\n+|(?<=[.!?])\s+", t.partition("\n")[2]) if s.strip()]
        if not units:
            continue
        best = max(units, key=lambda s: (len(asked & set(re.findall("[a-z0-9]+", s.lower()))), -units.index(s)))
        used += len(best.split())
        if used > budget and out:
            break
        out.append(f"{best} [Source {i}]")
    return " ".join(out)


@dataclass
class KnowledgeBase:
    """Chunks (``id, document_id, text`` and metadata) with their lexical index and vectors."""

    chunks: DataFrame
    index: lexical.LexicalIndex | segments.Segments
    vectors: DataFrame | None = None
    dim: int = DEFAULT.embedding_dim
    generator: Generator = extractive
    settings: Settings = DEFAULT
    version: str = ""
    model: str = "extractive"

    @classmethod
    def build(cls, chunks: DataFrame, dim: int = 64, cache: DataFrame | None = None, **more) -> KnowledgeBase:
        """Index and vectors of chunks. Texts whose hash has a vector in ``cache`` (``chunk_hash, embedding``) aren't embedded again."""
        body = X.search_text(F.col("meta_header") if "meta_header" in chunks.columns else F.lit(""), F.col("text"))
        rows = chunks.withColumn("__body", body)
        about = [c for c in ("chunk_hash", "source", "category", "author", "date") if c in chunks.columns]
        if cache is not None:
            known = cache.select("chunk_hash", "embedding").dropDuplicates(["chunk_hash"])
            embedded, _ = dense.embed_with_cache(rows.select("id", *about, "__body"), known, lambda c: dense.hashed_embedding(c, dim), "__body")
            vectors = embedded.select("id", *about, "embedding")
        else:
            vectors = rows.select("id", *about, dense.hashed_embedding(F.col("__body"), dim).alias("embedding"))
        return cls(chunks, lexical.LexicalIndex.build(rows, "id", "__body"), vectors, dim, **more)

    def retrieve(self, query: str, k: int | None = None, where: Column | None = None) -> DataFrame:
        k = k or self.settings.top_k
        near = dense.search(self.vectors, "id", "embedding", dense.embed_query(query, self.dim), max(36 * k, 30), where)
        # filters hold for both lists, before either is cut
        found = self.index.search(query, 3 * k, self.chunks.where(where).select("id") if where is not None else None)
        return retrieve.retrieve(self.chunks, near, found, query, k, self.settings)

    def answer(self, query: str, length: str = "normal", where: Column | None = None, conversation_id: str = "", interface: str = "api") -> DataFrame:
        """One row of CONTRACT. Without a question or enough evidence the answer is a refusal without sources."""
        spark, start = self.chunks.sparkSession, time.monotonic()
        query = (query or "").strip()
        ms = lambda since: int(1000 * (time.monotonic() - since))

        def row(text: str, grounded: bool, tier: str, sources: list[dict], top: float, retrieval: int, generation: int) -> DataFrame:
            return spark.createDataFrame([(uuid.uuid4().hex[:12], query, conversation_id, text, grounded, tier, sources, self.version, self.model, interface, top, ms(start), retrieval, generation)], CONTRACT)

        if not query:
            return row(REFUSAL, False, "none", [], 0.0, 0, 0)
        shown = [c for c in SHOWN if c in self.chunks.columns]
        more = [c for c in ("updated_date", "category", "section", "tags") if c in self.chunks.columns]
        hits = self.retrieve(query, where=where).select("id", "document_id", "text", "position", "score", "lexical_score", "lexical_verified", "author_verified", "low_value", *shown, *more).cache()
        try:
            gate = retrieve.evidence(hits, self.settings).first()
            if not gate.sufficient:
                return row(REFUSAL, False, gate.confidence, [], gate.best_cosine, ms(start), 0)
            kept = retrieve.evidence_filter(hits, self.settings)
            named = {c: F.col(c) for c in (*shown, *more)}
            kept = kept.withColumn("document", grounding.document_key(F.col("document_id"), named.get("title", F.lit(None)), named.get("source", F.lit(None))))
            merged = grounding.merge_documents(kept, [], "document", "position", "text", self.settings.merge_cap)
            about = kept.select("position", *shown, *more)  # of each document's first hit
            if "tags" in more:
                named["tags"] = X.joined(F.col("tags")) if dict(kept.dtypes)["tags"].startswith("array") else F.col("tags")
            blocks = grounding.numbered_blocks(merged.join(about, "position"), "position", "text", named)
            # top_k rows at most come to the driver, where the generator runs
            packed = grounding.context_pack(blocks, [], "position", "block", self.settings.max_context_chars).orderBy("position").collect()
            retrieval = ms(start)
            began = time.monotonic()
            text = self.generator(query, [r.block for r in packed], LENGTH_BUDGETS.get(length, LENGTH_BUDGETS["normal"]))
            generation = ms(began)
            sources = [{**{c: (r[c] if c in shown else None) for c in SHOWN}, "text": r.text} for r in packed]
            kind = "array<struct<" + ", ".join(f"{c}: string" for c in (*SHOWN, "text")) + ">>"
            drafted = spark.createDataFrame([(text, sources)], f"answer string, sources {kind}")
            checked = grounding.verify(drafted, settings=self.settings).first()
            if not checked.grounded or gate.confidence == "none" or not checked.kept:
                return row(REFUSAL, False, gate.confidence, [], gate.best_cosine, retrieval, generation)
            cited = [{**{c: s[c] for c in SHOWN}, "snippet": s.text} for s in checked.kept]
            out = row(checked.answer, True, gate.confidence, cited, gate.best_cosine, retrieval, generation)
            return out.withColumn("sources", F.transform("sources", lambda s: s.withField("snippet", X.snippet(s["snippet"]))))
        finally:
            hits.unpersist()


def follow_up(turns: DataFrame, key: str = "conv_id", order: str = "turn", keep: int = 6) -> DataFrame:
    """``conv_id, question, resolved``: each conversation's last question in the light of the last different one before.

    Only the last ``keep`` turns count; without an earlier question it stands as it is.
    """
    last = turns.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__n") <= keep)
    asked = last.where(F.lower("role") == "user").groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col(order)).alias("o"), F.col("text").alias("t")))).alias("u"))
    question = F.element_at("u", 1)["t"]
    before = F.get(F.filter(F.col("u"), lambda x: x["t"] != F.element_at("u", 1)["t"]), 0)["t"]
    return asked.select(key, question.alias("question"), F.when(before.isNull(), question).otherwise(F.concat(question, F.lit(" (regarding: "), before, F.lit(")"))).alias("resolved"))


def suggestions(title: Column, category: Column) -> Column:
    """Up to three follow-up questions about a source."""
    made = F.array(F.concat(F.lit("What else does "), title, F.lit(" say?")), F.concat(F.lit("What are the main points of "), title, F.lit("?")), F.concat(F.lit("What else is there on "), category, F.lit("?")))
    return F.slice(F.array_compact(F.array_distinct(made)), 1, 3)


@dataclass(frozen=True)
class Command:
    destination: str = "here"
    targets: tuple[str, ...] = ()
    mode: str = "normal"
    public: bool = False
    voice: bool = False
    question: str = ""


def parse_command(text: str) -> Command:
    """Leading words of a command, in any order, up to the question: dm, user, channel or group with targets, a mode, visibility, voice."""
    words, found = text.strip().split(), {}
    targets: list[str] = []
    while words:
        w = words[0].lower().lstrip("-")
        if w in ("short", "normal", "detailed", "search", "sources"):
            found["mode"] = w
        elif w in ("public", "private"):
            found["public"] = w == "public"
        elif w == "voice":
            found["voice"] = True
        elif w == "dm":
            found["destination"] = "dm"
        elif w in ("user", "channel", "group") and len(words) > 1 and words[1][0] in "@~":
            found["destination"] = w
            words.pop(0)
            while words and words[0][0] in "@~" and (w == "group" or not targets):
                targets.extend(t.strip("@~").lower() for t in words.pop(0).split(",") if t.strip("@~"))
            continue
        else:
            break
        words.pop(0)
    question = " ".join(words)
    if len(question) > 1 and question[0] == question[-1] and question[0] in "\"'":
        question = question[1:-1]
    return Command(targets=tuple(dict.fromkeys(targets)), question=question, **found)

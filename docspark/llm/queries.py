"""The queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import chat, codes, decontaminate, fingerprints, gridjoin, language, neardup, oracles, packing, quality, ranking, sharding, suffix, wordpiece
from docspark.llm.scratch import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one given as a JSON record of another layout, read back.

    Null roles and texts count as empty. An empty table leaves only the record.
    """
    rows = table(spark, sf_dir, "conversations")
    turns = chat.conversations(rows)
    said = "</s>[INST] ok [/INST]"
    record = f'{{"messages": [{{"role": "user", "content": "{said}"}}, {{"role": "assistant", "content": "{said}"}}]}}'
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(record).alias("record"))
    out = turns.unionByName(chat.conversations(extra)).select("conv_id", chat.render(F.col("turns")).alias("out")).select("conv_id", "out.formatted", "out.mask")
    back = out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("mask")).alias("loss"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def public_vocabulary() -> dict[str, str]:
    """Where the public tokenizer's two files are, and the pattern of the second."""
    import public_tokenizers

    return {"json_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op2_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens along a Hilbert curve."""
    return packing.pack(table(spark, sf_dir, "documents"), 2048, **public_vocabulary(), digest=True)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word pieces of every document, in the public 32k vocabulary."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wordpiece.add_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_words", "n_tokens")


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 shards by the jump hash of doc_id."""
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by similarity 0.8 or more on 2-word shingles."""
    out = neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op6_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.held_out(F.col("doc_id"))
    model = language.fit(docs.where(~out))
    return language.add_language(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of every document that stands in the benchmark, in windows of 13 words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # only the flags come along: the text is dropped before the last join
    out = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 200-byte strings that stand elsewhere too."""
    out = suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learnt from labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.add_score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score")
    return scored.withColumn("predicted", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    out = ranking.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return out.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, by codebooks that are fitted to all of them."""
    out = codes.compress(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def op13_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings with a cosine of 0.9 or more."""
    return gridjoin.near_vectors(table(spark, sf_dir, "embeddings"), 0.9).select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:2] == "op" and k[2].isdigit()}


_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i + 1:i + least(len(w), 13)], ' ') AS t
  FROM (SELECT item, w, unnest(range(greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT r, i, n, array_to_string(w[i + 1:i + n], ' ') AS t
  FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, i, place.n AS n, item FROM place JOIN win ON place.t = win.t AND place.n = win.n),
word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
item AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN word USING (r) LEFT JOIN item USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": oracles.OP1, "op4_jump_sharding": oracles.OP4, "op5_minhash_neardup": oracles.OP5, "op8_decontamination": _OP8_SQL, "op9_suffix_dedup": oracles.OP9, "op11_ranked_search": oracles.OP11, "op12_vector_codes": oracles.OP12, "op13_embedding_neardup": oracles.OP13}

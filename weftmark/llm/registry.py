"""Queries of the subpackage by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark.llm import oracles, oracles_tables
from weftmark.llm.centroids import exponion_clusters, with_inertia
from weftmark.llm.conversation_trie import conversation_trie
from weftmark.llm.exact_dedup import exact_dedup
from weftmark.llm.jaccard_join import jaccard_components
from weftmark.llm.language_id import identify
from weftmark.llm.license_scan import license_scan
from weftmark.llm.line_dedup import line_dedup
from weftmark.llm.mixing import mix
from weftmark.llm.pii import find_pii
from weftmark.llm.quality_rules import ablations, apply_policy, ledger
from weftmark.llm.sentencepiece_codec import read_model, round_trip
from weftmark.llm.sharding import shard
from weftmark.llm.substring_dedup import substring_dedup

Query = Callable[[SparkSession, str], DataFrame]

#: Production parameters of the queries.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
SHARD_BYTES = 8 << 20
POLICY = "v1"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(documents(spark, sf_dir), fingerprint_all=True)
    return found.withColumnRenamed("full_hash", "text_sha256")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return identify(docs, held_out).select("doc_id", "held_out", "lang_pred", "score")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), read_model(TOKENIZER))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), SHARD_BYTES)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(documents(spark, sf_dir))
    base = apply_policy(rows, "base").withColumn("base_failed", ~F.col("kept"))
    return apply_policy(base, POLICY).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "failed_mask",
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_scan(documents(spark, sf_dir))
    places = F.transform("base", lambda b: b["place"])
    named = F.transform("base", lambda b: b["label"])
    more = F.transform("found", lambda f: f["label"])
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(named, more))), ",").alias("labels"),
        "score",
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_pii(documents(spark, sf_dir))
    kinds = ("email", "ip", "card", "phone")
    of = lambda kind: F.filter("base", lambda s: s["kind"] == kind)
    text = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return rows.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in kinds],
        F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return with_inertia(exponion_clusters(vectors)).drop("scanned")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy costs, from the counts of the ledger's masks."""
    return ablations(ledger(documents(spark, sf_dir)), POLICY)


def language_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2 that SQL can express: which documents are held out."""
    return op2_language_id(spark, sf_dir).select("doc_id", "held_out")


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op9 that SQL can express: words and base places."""
    return op9_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op10 that SQL can express: the base spans."""
    return op10_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def queries() -> dict[str, Query]:
    named = (
        op1_exact_dedup, op2_language_id, op3_sentencepiece, op4_sharding, op5_jaccard_join, op6_substring_dedup,
        op7_mixing, op8_quality_rules, op9_license_scan, op10_pii, op11_centroids, op12_conversation_trie, op13_line_dedup,
        quality_ablations, language_held_out, license_base_places, pii_base_spans,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL | oracles_tables.SQL

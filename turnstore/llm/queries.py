"""One registered query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnstore.llm import (alignment, decontamination, jaccard_join, language_id, licences, packing, pii,
                           prefix_trie, quality_classifier, quality_rules, sharding, suffix_dedup, url_filter)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
N_SHARDS = 40
TOKENIZER = "word_bpe_49k.json"
ALIGNED_TOKENIZERS = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query
def op1_license_scans(spark, sf):
    found = licences.scan(table(spark, sf, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"),
                        F.array_join("licences", ",").alias("licences"), "licence")


@query
def op2_benchmark_decontamination(spark, sf):
    found = decontamination.find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


@query
def op3_sharding(spark, sf):
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.interleave(rows, N_SHARDS, ties=["text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_ngram_jaccard_join(spark, sf):
    return jaccard_join.similarity_groups(table(spark, sf, "documents"))


@query
def op5_quality_classifier(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality_classifier.learn(docs, quality_classifier.graded_labels(labels))
    found = quality_classifier.score(docs, model)
    return found.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"),
                        F.round(F.col("tail")[0], 6).alias("p_not_toxic"),
                        F.round(F.col("tail")[1], 6).alias("p_quality"), "kept")


@query
def op6_url_filters(spark, sf):
    pages = table(spark, sf, "pages")
    found = url_filter.judge(pages, url_filter.page_outcomes(pages))
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("bad_low", 6).alias("bad_low"))


@query
def op7_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language_id.learn(docs.where(~held_out))
    return language_id.identify(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))


@query
def op8_best_fit_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), tokenizer_path())


def span_text(spans):
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query
def op9_pii(spark, sf):
    found = pii.find_personal_data(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.KINDS))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))


@query
def op10_quality_rules(spark, sf):
    found = quality_rules.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                        "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


@query
def op13_cross_tokenizer_alignment(spark, sf):
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in ALIGNED_TOKENIZERS]
    return alignment.link_scores(table(spark, sf, "documents"), *paths).drop("row")


@query
def op11_suffix_array_dedup(spark, sf):
    found = suffix_dedup.find_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query
def op12_conversation_prefix_trie(spark, sf):
    conv = F.col("conv_id")
    conversations, turns = prefix_trie.rebuilt_turns(
        table(spark, sf, "conversations"), conv - conv % 20, F.crc32(conv.cast("string")) % 4)
    return prefix_trie.prefix_trie(conversations, turns)

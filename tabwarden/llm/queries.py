"""The registered queries of the numbered operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwarden.llm import (
    chat_format,
    decontaminate,
    exact_dedup,
    filter_audit,
    jaccard_join,
    packing,
    periodic_runs,
    quality_rules,
    repeats,
    secret_scan,
    token_counts,
    toxicity,
    warc_archive,
)
from tabwarden.llm.common import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conversations = conversations.unionByName(spark.createDataFrame(own, "conv_id long, turn long, role string, text string"))
    return chat_format.chat_digests(chat_format.format_chats(chat_format.message_events(conversations)))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive.archive_pages(_table(spark, sf_dir, "pages"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(secret_scan.scan_secrets(_table(spark, sf_dir, "documents")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(repeats.remove_repeats(_table(spark, sf_dir, "documents")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_digests(found)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = token_counts.tokenizer_path("word_bpe_49k.json")
    return token_counts.with_limit(token_counts.count_tokens(_table(spark, sf_dir, "documents"), file))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.similar_documents(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.train(documents, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return periodic_runs.run_digests(periodic_runs.find_runs(_table(spark, sf_dir, "documents"), seed=seed))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), digest_all=True)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_chat_formatting,
        op3_warc_archive,
        op4_secret_scans,
        op5_suffix_dedup,
        op6_decontamination,
        op7_best_fit_packing,
        op8_token_counts,
        op9_jaccard_join,
        op10_toxicity,
        op11_periodic_runs,
        op12_filter_audit,
        op13_exact_dedup,
    )
}

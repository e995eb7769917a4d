"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.bpe import decode_ids, encode_texts
from heliograph.llm.chat import format_chats
from heliograph.llm.conversation_repair import REPAIR_SQL, audit_damaged
from heliograph.llm.decontaminate import find_leaks
from heliograph.llm.fingerprints import fingerprint_edits
from heliograph.llm.html_extract import extract_text
from heliograph.llm.merkle import manifest_sql, prove_documents
from heliograph.llm.mixing import MIX_SQL, mix_sources
from heliograph.llm.near_dedup import near_duplicates
from heliograph.llm.pii import BASE as PII_BASE
from heliograph.llm.pii import find_pii
from heliograph.llm.quality import score_documents
from heliograph.llm.secrets import BASE_RULES, find_secrets, spans_text
from heliograph.llm.substring_dedup import dedup_substrings
from heliograph.session import read_table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [r.kind for r in BASE_RULES]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    out = find_secrets(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *map(count, kinds), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A piece per given turn; the pieces of a conversation in the order of ``place`` are its repaired, rendered sequence."""
    return format_chats(read_table(spark, sf_dir, "conversations"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read_table(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(read_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["base"])
    out = find_pii(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *map(count, PII_BASE), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # the vocabulary files of the machine; a path is all that the operator needs

    path = public_tokenizers.path("word_bpe_49k.json")
    out = decode_ids(encode_texts(read_table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_damaged(read_table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prove_documents(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_benchmark_decontamination": op1_benchmark_decontamination,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_secret_scan": op4_secret_scan,
        "op5_chat_format": op5_chat_format,
        "op6_source_mix": op6_source_mix,
        "op7_fingerprints": op7_fingerprints,
        "op8_html_extract": op8_html_extract,
        "op9_pii": op9_pii,
        "op10_quality": op10_quality,
        "op11_bpe": op11_bpe,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_source_mix": "WITH " + MIX_SQL.replace("{docs}", "documents").strip() + "\nSELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed",
        "op12_conversation_repair": REPAIR_SQL,
        "op13_merkle_manifest": manifest_sql(),
    }

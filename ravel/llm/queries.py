"""Registered queries of this subpackage; each applies one operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ravel.llm import archives, bpe, decontam, jaccard, lines, quality, secrets, substrings, toxicity, turns, vectors, wavelet, whitening
from ravel.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "token-shards")
    wavelet.write_token_shards(table(spark, sf_dir, "documents"), out)
    return wavelet.read_token_shards(spark, out)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.secret_digests(secrets.find_secrets(docs, secrets.fit_secrets(docs)))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encoding_digests(bpe.encode_documents(docs.select("doc_id", "text")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "archives")
    archives.write_archives(table(spark, sf_dir, "pages"), out)
    records = archives.read_records(archives.read_index(spark, out), out, payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_quality_classifier, op3_substring_dedup, op4_jaccard_join, op5_token_shards,
    op6_toxicity, op7_decontamination, op8_secret_scan, op9_near_vectors, op10_byte_bpe, op11_whitening, op12_warc,
    op13_conversation_trie,
)}
ORACLE = {
    "op1_line_dedup": lines.LINE_DIGESTS_SQL, "op4_jaccard_join": jaccard.GROUPS_SQL, "op7_decontamination": decontam.CONTAMINATED_SQL, "op9_near_vectors": vectors.NEAR_SQL,
    "op12_warc": archives.ARCHIVES_SQL, "op13_conversation_trie": turns.TRIE_SQL,
}

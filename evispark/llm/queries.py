"""The queries opN_<name>: each operator over its whole table, with the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm import bpe, divergence, exact, hosts, langid, lines, maxent, mixing, omh, phrases, quality, simhash, warc
from evispark.llm.common import scratch_path, table


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    path = path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}"
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", *(f"__base.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), F.col("__kept").alias("kept"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), model_path())


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.coalesce(F.length("__text"), F.lit(0)).alias("kept_chars")
    return found.select("doc_id", *(F.col(f"__{c}").cast("long").alias(f"n_{c}") for c in ("lines", "gone", "fuzzy")), size, F.sha2(F.coalesce("__text", F.lit("")), 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.fingerprints(table(spark, sf_dir, "documents"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scores(table(spark, sf_dir, "documents"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", *(F.col(f"__{c}").alias(c) for c in ("size", "source_size", "target", "taken")))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_quality_rules, op3_sentencepiece, op4_line_dedup, op5_simhash, op6_language_id, op7_order_minhash, op8_lm_scores, op9_mix, op10_url_filters, op11_source_divergence, op12_exact_dedup, op13_collocations)}
ORACLE_SQL = {"op1_warc": warc.WARC_SQL, "op2_quality_rules": quality.QUALITY_SQL, "op9_mix": mixing.MIX_SQL, "op10_url_filters": hosts.HOSTS_SQL}
ORACLE_SQL |= {"op11_source_divergence": divergence.DIVERGENCE_SQL, "op12_exact_dedup": exact.EXACT_SQL, "op13_collocations": phrases.PHRASES_SQL}

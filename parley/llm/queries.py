"""Registered queries of the training-data operators: thin callers that read whole
tables, apply an operator with production parameters and derive the result columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import count_kind, read_table, scratch_path, spans_text
from parley.llm.decontaminate import HITS_SQL, find_hits
from parley.llm.divergence import AUDIT_SQL, audit
from parley.llm.fingerprints import compare_with_next
from parley.llm.langid import held_out, learn, predict_languages
from parley.llm.licenses import find_licenses
from parley.llm.mixture import MIX_SQL, mix
from parley.llm.pii import KINDS, find_pii, in_order
from parley.llm.quality_model import fit, score
from parley.llm.quality_model import held_out as quality_held_out
from parley.llm.quality_rules import RULES_SQL, apply_policy, build_ledger
from parley.llm.secret_scan import BASE_KINDS, BlobLedger, findings_by_path, scan
from parley.llm.simhash_balls import hex_fingerprint, near_duplicates
from parley.llm.tokens import count_tokens
from parley.llm.vector_codes import CODES_SQL, compress

BYTE_BPE = "byte_bpe_50k.json"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents"))
    base = in_order(F.col("base"))
    every = in_order(F.concat("base", "added"))
    counts = [count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
                        spans_text(every).alias("spans"), F.size("added").cast("bigint").alias("n_added"),
                        (F.size("base") + F.size("added")).cast("bigint").alias("n_spans"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    ledger = BlobLedger(spark, scratch_path(spark, "blob-ledger"))
    scan(docs, ledger)
    found = findings_by_path(docs, ledger, ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [count_kind(F.col("spans"), k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
                        spans_text(F.col("spans")).alias("spans"), "blob")


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """The rule model, fitted on labelled rows outside the held-out fold."""
    labels = read_table(spark, sf_dir, "labels")
    return fit(docs, labels.filter(~quality_held_out()))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, quality_model(spark, docs, sf_dir), ["doc_id"])
    return scored.select("doc_id", quality_held_out().alias("held_out"), "score", "predicted")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = build_ledger(read_table(spark, sf_dir, "documents"))
    base = apply_policy(ledger, "base", "passed")
    return apply_policy(base.withColumn("base_failed", ~base["passed"]).drop("passed"), "v2")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    langs, logp = learn(docs.filter(~held_out()))
    predicted = predict_languages(docs, langs, logp)
    return predicted.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(spark, read_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = near_duplicates(read_table(spark, sf_dir, "documents"))
    return marked.select("doc_id", hex_fingerprint(marked["fp"]).alias("fingerprint"), "component_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = find_hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                       F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(read_table(spark, sf_dir, "embeddings"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(read_table(spark, sf_dir, "documents"))


# name -> (query, DuckDB twin or None)
REGISTRY = {
    "op1_pii": (op1_pii, None),
    "op2_token_counts": (op2_token_counts, None),
    "op3_secrets": (op3_secrets, None),
    "op4_quality_classifier": (op4_quality_classifier, None),
    "op5_quality_rules": (op5_quality_rules, RULES_SQL),
    "op6_language": (op6_language, None),
    "op7_licenses": (op7_licenses, None),
    "op8_simhash": (op8_simhash, None),
    "op9_decontaminate": (op9_decontaminate, HITS_SQL),
    "op10_mixture": (op10_mixture, MIX_SQL),
    "op11_vector_codes": (op11_vector_codes, CODES_SQL),
    "op12_divergence": (op12_divergence, AUDIT_SQL),
    "op13_fingerprints": (op13_fingerprints, None),
}

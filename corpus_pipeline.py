"""The corpus pipeline: stages from documents to a mixed training set.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that it is given and returns
a DataFrame, which ``run`` writes to the shared folder and reads back as the next stage's
input:

* quality       documents that the rule ensemble rejects go;
* near_dups     of each group of linked fingerprints the document with the smallest id stays;
* benchmark     documents that hold a benchmark window go;
* secrets       documents stay, found secrets are replaced in their text;
* mixture       the documents (without text) that the mix takes, with their copies.

All but the last return the columns of documents.

Defined cases: a null text is an empty one for every stage, and stays null; empty texts have
fingerprint zero, so of those that the quality stage keeps one stays; rows with a null or a
repeated id are judged each by its own text, and equal rows by equal rules (of near copies one
row stays); columns besides those of documents pass through all stages but the last, whatever
their names; an empty table gives no rows, and so does one that the quality stage rejects as a whole.
Without usable labels every score is 0.5, and every document passes the quality stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import decontaminate, mixture, quality_model, secret_scan, simhash_balls
from parley.llm.common import materialise, read_table, scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").filter(~quality_model.held_out())
    model = quality_model.fit(docs, labels)
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), "text")
    # written before the filter: pushed below the statistics, it would copy each of them
    # into every rule condition
    scored = materialise(quality_model.score(packed, model, ["_doc"]).select("_doc", "predicted"), "scored")
    return scored.filter("predicted = 1").select("_doc.*")


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_balls.keep_first(docs, simhash_balls.near_duplicates(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, decontaminate.find_hits(docs, read_table(spark, sf_dir, "benchmark")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ledger = secret_scan.BlobLedger(spark, scratch_path(spark, "blob-ledger"))
    secret_scan.scan(docs, ledger)
    clean = secret_scan.redact(docs, secret_scan.findings_by_path(docs, ledger, ["doc_id"]))
    if "n_chars" in docs.columns:   # still the length of the text
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
                                 .cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mix(docs).filter("copies > 0")


STAGES = [("quality", quality), ("near_dups", near_dups), ("benchmark", benchmark), ("secrets", secrets), ("mixture", mixed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""The corpus pipeline: from raw documents to token ids in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that its predecessor kept. All but the last
return the columns of documents:

1. quality_rules: rows that fail the policy ("web", 2) go;
2. line_dedup: repeated and nearly repeated lines are taken out of texts (n_chars follows), no row goes;
3. simhash_near_dedup: of each group of near copies (fingerprints of five-word shingles within RADIUS bits) the row of the
   least doc_id stays;
4. benchmark_decontamination: rows whose text holds a near copy of a benchmark item go;
5. bpe: doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the SHA-256 of the decoded text.

run() writes each stage's rows to the cluster's shared folder and reads them back, so a stage is computed once and a lost
executor costs no earlier stage; a stage's rows are removed when the next one's are written. Empty tables pass through; extra columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.llm import bpe, common, decontamination, line_dedup, quality_rules, simhash, warc


def by_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(docs)


def by_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(docs)


def by_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(docs, SHINGLE, RADIUS)


def by_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def by_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, bpe.vocabulary(), REMEMBERED).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


#: Five-word shingles, and the bits in which their fingerprints may differ. Pairs of similarity s differ in about 64 / pi *
#: arccos(2 s / (1 + s)) bits; larger radii need keys so short that unrelated texts meet.
SHINGLE, RADIUS = 5, 6

#: Fewer words are remembered than in a job of its own, for the workers keep their memory between stages.
REMEMBERED = 40_000

STAGES = [
    ("quality_rules", by_quality_rules),
    ("line_dedup", by_line_dedup),
    ("simhash_near_dedup", by_simhash),
    ("benchmark_decontamination", by_decontamination),
    ("bpe", by_bpe),
]

#: Edit distances over all lines, fingerprint components and BPE merges have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = warc.shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            common.remove_folder(spark, before)
        before = path
    return docs

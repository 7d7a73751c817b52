"""The corpus pipeline: five stages over documents, each writing a table that the next one reads.

quality: documents that the quality classifier rejects go. lines: repeated lines go. near: one document of each
near-duplicate group stays, the one with the smallest doc_id; of rows that repeat an id each is judged by its text. leaks: documents with a benchmark item in them go.
pack: what is left is packed into bins; its rows are the pieces.

Rows without doc_id are kept by the first four stages, each judged on its own text, and belong to no group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import drop_dir, keep, new_dir
from gridloom.llm.decontamination import decontaminate
from gridloom.llm.line_dedup import dedup_lines
from gridloom.llm.packing import pack_tokenized
from gridloom.llm.quality import fit_quality, keep_quality, measured
from gridloom.llm.simhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(COLUMNS)
    model, _ = fit_quality(keep(measured(docs), "quality-measures"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_quality(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs, extra=("lang", "source"))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = docs.withColumn("text_hash", F.xxhash64("text"))
    gone = near_duplicates(named, extra=("text_hash",)).where("doc_id <> component_id").select("doc_id", "text_hash").distinct()
    return named.join(gone, ["doc_id", "text_hash"], "left_anti").select(COLUMNS)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_tokenized(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("leaks", leaks), ("pack", pack)]

#: A trained classifier and components have no SQL; tests/llm hold the pipeline against its stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            drop_dir(spark, last)
        last = path
    return docs

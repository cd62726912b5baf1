"""The corpus pipeline: language ID, near-duplicate join, substring dedup, decontamination, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and reread as the next stage's docs. All but the last return the columns of
``documents``; doc_id is taken to name a row, as it does there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontamination, jaccard_join, language_id, piece_sampling, substring_dedup
from strandline.llm.common import drop_table, table, whole_row


#: Rows of one Arrow batch; texts are long, and ten thousand of them are too much for the memory beside a full heap.
BATCH_ROWS = "1000"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; what the model says replaces a null lang."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    identifier = language_id.learn(docs.select("text", "lang"))
    rows = docs.select("text", whole_row(docs).alias("_row"))
    kept = language_id.identify(rows, identifier, carry="_row").where("accepted")
    return kept.select(*(F.coalesce("_row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard 0.8 or more."""
    return jaccard_join.keep_one(docs, size=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words that an earlier document has; a text left empty goes."""
    return substring_dedup.keep_rest(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; a document that is mostly benchmark goes."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.keep_clean(docs, benchmark)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every text: their ids, scores and digests."""
    # Little is remembered: the executors' heaps are full of the stages before.
    return piece_sampling.sample_digest(docs, with_ids=True, remembered=60_000, step_bytes=400_000)


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("piece_sampling", encoding_stage),
]

#: Language models and sampled segmentations have no SQL; tests/llm hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; the setting that the first one makes for those after it is as before once they are written."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows_before = spark.conf.get(setting)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    try:
        for _, stage in STAGES[:-1]:
            docs = table(spark, stage(spark, docs, sf_dir))
            if before is not None:
                drop_table(before)
            before = docs
    finally:
        spark.conf.set(setting, rows_before)
    return STAGES[-1][1](spark, docs, sf_dir)

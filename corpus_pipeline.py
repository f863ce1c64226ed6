"""A corpus from documents to packed sequences, in five stages; each stage's result is written and read again.

1. quality: documents that the classifier rejects go.
2. lines: lines on too large a share of their source's documents go from the texts; copies count as one document, and
   documents that are little else are left whole for stage 3.
3. near duplicates: one document of each group stays, that with the smallest id.
4. benchmarks: documents that overlap with a benchmark text go.
5. packing: what is left is cut and packed into sequences; one row a piece.

All stages but the last return the columns of ``documents``; other columns are left out. Defined cases, besides those of the
operators: a null or empty text is judged by the classifier like any other, has no lines, is no copy of anything and overlaps with
nothing; rows that repeat an id are rows of their own, and of rows alike in id and text one stays; rows without an id take part
and stay if no row of their group has one; an empty table passes every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelaudit.llm import decontam, line_dedup, near_dup, packing, quality
from modelaudit.llm.storage import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; without labels, or documents that have one, all score alike."""
    model = quality.trained(spark, docs, sf_dir)
    # the text is read beside its statistics, so nothing is joined back
    measured = quality.with_statistics(docs.select(*COLUMNS).withColumn("_text", F.col("text")), text="_text")
    return measured.filter(model.score() >= quality.THRESHOLD).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with shorter texts and their new number of characters. A null source is a source; null texts stay null."""
    out = line_dedup.drop_boilerplate(docs.select(*COLUMNS), spare_copies=True)
    return out.withColumn("text", F.col("clean_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, found by id and text, and every row without words."""
    return near_dup.one_of_each(docs.select(*COLUMNS))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap, found by id and text; an empty benchmark leaves all."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontam.decontaminate(docs.select(*COLUMNS), benchmark)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's pieces and their places; a null or empty text is one piece of the end id."""
    return packing.pack(docs, packing.TOKENIZER).placed.drop("task", "local_rank")


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_dup_stage), ("benchmarks", benchmark_stage), ("packing", pack_stage)]

#: Trees, signatures and a tokenizer have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

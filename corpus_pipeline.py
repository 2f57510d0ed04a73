"""Documents to packed training sequences: quality, repeated lines, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. Rows are told apart by id and text: of rows that have both in
common one is left after the near-copy stage, and rows with one id are judged each by
its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.decontaminate import find_contamination
from tessera.llm.line_dedup import drop_repeated_lines, row_key
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.quality_crf import keep_good, quality_model
from tessera.lineage import checkpointed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return keep_good(docs, quality_model(spark, sf_dir, docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of lines; those that lose all their words go."""
    found = drop_repeated_lines(docs)
    lost = F.size("removed_lines") > 0
    left = found.filter(~(lost & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))))
    return left.withColumn("n_chars", F.when(lost, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(row_key("doc_id", "text").alias("row"), "text")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the least id, once."""
    firsts = near_duplicates(keyed(docs), id_col="row").filter("doc_id = class_id").select(F.col("doc_id").alias("row")).distinct()
    return docs.withColumn("row", row_key("doc_id", "text")).join(firsts, "row", "left_semi").dropDuplicates(["row"]).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = find_contamination(keyed(docs), table(spark, sf_dir, "benchmark"), id_col="row").filter("n_hit > 0").select(F.col("doc_id").alias("row")).distinct()
    return docs.withColumn("row", row_key("doc_id", "text")).join(found, "row", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return pack_documents(spark, docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("decontamination", benchmark), ("packing", packing)]

#: The classifier, the sketches and the tokenizer are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what its predecessor kept, from the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs

"""A training-data pipeline: each stage reads what the one before it kept.

Order: quality classifier, quality rules, near duplicates, decontamination, packing. The columns
of documents, whatever else they are called, go through every stage but the last, which returns packed pieces.

Defined results: a null doc_id names no document and does not enter; null and empty texts fail the
quality classifier; a very long text goes through whole; of exact and near copies the one with the least id
stays, of rows that repeat an id each; without labels the classifier rejects empty texts alone; without
benchmark items nothing is contaminated; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import shared_dir, table
from strandline.llm.decontaminate import decontaminate
from strandline.llm.near_dup import near_duplicates
from strandline.llm.packing import pack
from strandline.llm.quality_model import quality
from strandline.llm.quality_rules import quality_rules


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality(docs, table(spark, sf_dir, "labels"), rows=True).filter("kept").select("row.*")


def passes_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs, rows=True).filter("kept").select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component stays; of rows that repeat an id, each."""
    least = near_duplicates(docs).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(least, "doc_id", "left_semi").select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; op1's ``contaminated`` (two items or more) would let whole copies of one item through."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), rows=True).filter("n_items = 0").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("quality rules", passes_rules),
    ("near duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("packing", packed),
]

#: SQL can't express the classifier, SimHash or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(F.col("doc_id").isNotNull())
    for _, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

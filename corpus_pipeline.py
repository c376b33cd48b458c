"""A training-data pipeline over documents: quality rules, line dedup, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next one.
All but the last return the columns of documents (doc_id, text, lang, source, n_chars), n_chars being the text's code points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplework.llm.common import materialize
from ripplework.llm.line_dedup import dedup_lines
from ripplework.llm.packing import pack_documents
from ripplework.llm.pii import find_pii, masked
from ripplework.llm.quality_rules import judge_documents
from ripplework.llm.shingle_join import shingle_components

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _sized(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew in the type that it came in."""
    return docs.withColumn("n_chars", F.length("text").cast(dict(like.dtypes)["n_chars"])).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failed lines.

    A null, empty or wordless text is rejected; repeated rows are judged alike, one by one; a null doc_id passes through;
    extra columns go no further; an empty table stays empty.
    """
    return _sized(judge_documents(docs, ("lang", "source")).where("kept").withColumn("text", F.col("cleaned")), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a later one keeps. A null text becomes an empty one.

    Rows that share a doc_id are one document to the counts; a null doc_id ranks below all others; extra columns go no further.
    """
    return _sized(dedup_lines(docs, ("lang", "source")).withColumnRenamed("kept_text", "text"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document, with the least doc_id (null last). Documents without words all stay.

    Rows with the same doc_id and text are one document, and one of them stays.
    """
    found = shingle_components(docs).select("doc_id", "text_hash", "n_shingles", "component_id")
    least = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id"), F.col("text_hash"))).alias("x"))
    # without a component's id (all its doc_ids are null) its texts are told apart by themselves
    known = least.where("component_id IS NOT NULL").select("x.doc_id", "x.text_hash")
    rest = found.where("n_shingles = 0 OR component_id IS NULL").select("doc_id", "text_hash")
    first = known.unionByName(rest).distinct().select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"))
    full = docs.select(*COLUMNS).withColumn("f_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    return full.join(first, full["doc_id"].eqNullSafe(first["f_id"]) & (full["f_text"] == first["f_hash"]), "left_semi").dropDuplicates(["doc_id", "f_text"]).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data masked by its kind. A null text becomes an empty one.

    Repeated rows are masked alike and count once as evidence; rows that share a doc_id are kept apart; extra columns go no further.
    """
    return _sized(find_pii(docs, ("lang", "source")).withColumn("text", masked("text", "spans")), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents.

    A null or empty text is the end token alone; repeated rows are packed one by one; a null doc_id passes through.
    """
    return pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing)]

#: Near duplicates, bootstrapping and packing are beyond SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result stored before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs

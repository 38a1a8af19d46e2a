"""Documents to packed training sequences, in five stages.

Each stage reads what its predecessor wrote as Parquet and returns a DataFrame; all but
the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugebook.llm import jaccard, lines, mixing, packing, quality
from gaugebook.session import stage

#: The pipeline has no SQL form: models are fitted and lines compared by edit distance.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Rows of one doc_id go or stay together, by the best of their scores; null ids are one id.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.classify(docs, labels).groupBy("doc_id").agg(F.max("predicted").alias("_predicted"))
    good = judged.where("_predicted = 1").select(F.col("doc_id").alias("_id"))
    return docs.join(good, docs["doc_id"].eqNullSafe(good["_id"]), "left_semi")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stood before; those that lose every line go."""
    cut = lines.dedup(docs, "_lines", "_removed")
    left = cut.where(F.col("_removed") < F.greatest(F.lit(1), F.col("_lines")))
    length = F.when(F.col("_removed") == 0, F.col("n_chars")).otherwise(F.length("text"))
    return left.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id (null last) of every group of near duplicates."""
    first = jaccard.heads(docs).withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
    kept = docs.join(first, (jaccard.row_mark(docs) == first["_mark"]) & docs["doc_id"].eqNullSafe(first["_id"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics come in their target weights."""
    return mixing.mix(docs, prefix="_mix_").where("_mix_kept").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

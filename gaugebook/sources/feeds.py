"""JSON feeds, as files or as a stream of files. Schemas are fixed, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gaugebook.schemas import ARRIVALS, CORRUPT, LEGACY_ARRIVALS, SITE_FEED


def _keeping_bad_lines(schema: T.StructType) -> T.StructType:
    """A line that can't be read as a record keeps its text, and becomes a reject of its own."""
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def read_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: current-format batches, one JSON object per line."""
    return spark.read.schema(_keeping_bad_lines(ARRIVALS)).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_legacy_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: legacy batches. Grams are read straight into a decimal."""
    return spark.read.schema(_keeping_bad_lines(LEGACY_ARRIVALS)).option(
        "columnNameOfCorruptRecord", CORRUPT
    ).json(path)


def read_site_feed(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: site registrations; `metadata` is the JSON text of the object sent."""
    return spark.read.schema(_keeping_bad_lines(SITE_FEED)).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def stream_arrivals(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    return _stream(spark, path, ARRIVALS, files_per_batch)


def stream_legacy_arrivals(
    spark: SparkSession, path: str, files_per_batch: int | None = None
) -> DataFrame:
    return _stream(spark, path, LEGACY_ARRIVALS, files_per_batch)


def _stream(spark, path, schema, files_per_batch):
    reader = spark.readStream.schema(_keeping_bad_lines(schema))
    reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)

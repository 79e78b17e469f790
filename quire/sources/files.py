"""File readers and writers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from quire.functions import text as T
from quire.operators.metrics import LOG_SCHEMA


def read_file_catalogue(
    spark: SparkSession, path: str, area: str, recursive: bool = True,
    pattern: str | None = None, after: str | None = None, before: str | None = None,
) -> DataFrame:
    """Files under a folder with size and time; their content is never read.

    ``pattern`` (of the file name), ``after`` and ``before`` (of the modification time, as 2024-01-31T00:00:00) are
    applied to the listing itself.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    for option, value in (("pathGlobFilter", pattern), ("modifiedAfter", after), ("modifiedBefore", before)):
        if value is not None:
            reader = reader.option(option, value)
    raw = reader.load(path)
    root = path.rstrip("/") + "/"
    rel = F.substring_index("path", root, -1)
    return raw.select(
        F.col("path").alias("url"),
        F.lit(area).alias("area"),
        rel.alias("rel_path"),
        T.base_name(F.col("path")).alias("name"),
        F.col("length").alias("size_bytes"),
        F.unix_timestamp("modificationTime").alias("modified_s"),
        F.lit(None).cast("string").alias("access_error"),
    )


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Whole files as rows of name and bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(
        T.base_name(F.col("path")).alias("name"), "content"
    )


@F.pandas_udf(StringType())
def _decode_other(content: pd.Series) -> pd.Series:
    """GBK, else UTF-8 without its bad bytes; rows that need neither arrive as null."""

    def one(raw):
        if raw is None:
            return None
        try:
            return bytes(raw).decode("gbk")
        except UnicodeDecodeError:
            return bytes(raw).decode("utf-8", errors="ignore")

    return content.map(one)


def decode_text(content: Column) -> Column:
    """Text of bytes: UTF-8 in the JVM; only rows that are not UTF-8 go to Python."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(utf8, _decode_other(F.when(utf8.isNull(), content)))


def read_text_robust(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("text", decode_text(F.col(content))).drop(content)


def read_json_logs(spark: SparkSession, path: str) -> DataFrame:
    """Structured log lines by fixed schema; bad lines keep their text in ``_corrupt_record``."""
    return spark.read.schema(LOG_SCHEMA).option("mode", "PERMISSIVE").json(path)


def output_name(stem: Column, task_id: Column, target: Column) -> Column:
    return F.concat(stem, F.lit("_"), task_id, F.lit("."), target)


def write_extracted_text(texts: DataFrame, path: str) -> None:
    """One row per source document, foldered by target format, under its output name."""
    named = texts.withColumn("file_name", output_name(F.col("stem"), F.col("task_id"), F.col("target_format")))
    named.write.mode("overwrite").partitionBy("target_format").parquet(path)


def write_chapters(chapters: DataFrame, path: str, buckets: int = 64) -> None:
    """Chapter rows foldered by a hash bucket of the document, so folders stay few and a
    document is found without a full scan."""
    (
        chapters.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
        .write.mode("overwrite").partitionBy("bucket").parquet(path)
    )


def write_routed_logs(routed: DataFrame, path: str) -> None:
    """Log records foldered by sink."""
    routed.write.mode("overwrite").partitionBy("sink").parquet(path)

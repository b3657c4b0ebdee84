"""Documents as files: one for each recording, written again only for the recordings that come again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_documents(made: DataFrame, path: str) -> None:
    """made (recording_id, document) -> a folder a recording below ``path`` with one file: its document and a line end.

    Only folders of recordings that are among the rows are replaced; those of others stay. A recording must come once: two documents of one raise and
    nothing is replaced. Rows without id or document are left out.
    """
    whole = made.where("recording_id IS NOT NULL AND document IS NOT NULL").groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.any_value("document").alias("value"))
    once = whole.withColumn("value", F.when(F.col("n") == 1, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("several documents of recording "), F.col("recording_id").cast("string")))))
    once.select("value", "recording_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("recording_id").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """recording_id, document: what write_documents has written, byte for byte."""
    files = spark.read.schema("value string, recording_id bigint").text(path, wholetext=True)
    return files.select("recording_id", F.regexp_replace("value", "\n$", "").alias("document"))

"""Streams: jobs with a time to live, and tags of text as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalised_tag, parse_normalised


def tagged_stream(texts: DataFrame) -> DataFrame:
    return texts.withColumn("_t", normalised_tag(F.col("text"))).withColumn("tag", parse_normalised(F.col("_t"))).drop("_t")


def job_counts(jobs: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Jobs by status and window of their creation; late ones are waited for and then left out."""
    return jobs.withWatermark("created_at", late).groupBy(F.window("created_at", window), "status").agg(F.count("*").alias("n"))


def once(jobs: DataFrame, late: str = "24 hours") -> DataFrame:
    """Each job once, remembered as long as it lives."""
    return jobs.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])

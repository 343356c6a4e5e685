"""Cutting a plan where several consumers share it, and lists that are small enough to broadcast."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a list of classes that may be broadcast, some hundred bytes each.
LISTED = 100_000


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder of spark.checkpoint.dir, where executors that come and go don't
    matter.  A local session without the setting gets a temporary folder; on a cluster that's an error, as only the
    cluster knows a folder that all share."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp())
    return df.checkpoint()


def listed(df: DataFrame, most: int = LISTED) -> DataFrame:
    """df, to be broadcast if it has at most so many rows; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df

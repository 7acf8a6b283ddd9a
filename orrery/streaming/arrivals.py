"""Arriving files as a stream: new pictures by content, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files under ``path``; one row per content, the state is kept without expiry."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256")).dropDuplicates(["sha256"])

"""Continuous indexing: each batch of new files goes through the same hashing as a full run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import index_files

BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def file_stream(spark: SparkSession, root: str) -> DataFrame:
    """dir, name, mtime, content of files as they appear under root."""
    found = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True).load(root)
    return found.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.element_at(F.split("path", "/"), -1).alias("name"), F.unix_timestamp("modificationTime").alias("mtime"), "content")


def index_stream(files: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands each batch's indexed rows to sink; its checkpoint makes every batch count once."""
    return files.writeStream.foreachBatch(lambda batch, epoch: sink(index_files(batch), epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

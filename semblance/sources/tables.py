"""The driver's tables read as files with contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str, min_size: int = 1024) -> DataFrame:
    """file_id, dir, name, content, size, mtime, inode: documents as files /source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("/"), "source", F.lit("/"), "lang").alias("dir"), F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("content"))
    return rows.withColumns({"size": F.octet_length("content").cast("long"), "mtime": F.col("file_id"), "inode": F.col("file_id")}).where(F.col("size") >= min_size)


def hashed_files(files: DataFrame) -> DataFrame:
    """file_id, dir, name, size, inode, fullsha1 and contentid: the least file_id of the content."""
    rows = files.select("file_id", "dir", "name", "size", "inode", hashing.full_sha1(F.col("content")).alias("fullsha1"))
    return rows.join(rows.groupBy("fullsha1").agg(F.min("file_id").alias("contentid")), "fullsha1")

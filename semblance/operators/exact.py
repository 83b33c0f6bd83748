"""Bit-equal files: pairs and buckets of files that share a content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import with_global_rank


def multi_referenced(files: DataFrame, n: int = 2) -> DataFrame:
    """(contentid, size, n_files) of contents that at least n files share."""
    return files.groupBy("contentid").agg(F.any_value("size").alias("size"), F.count("*").alias("n_files")).where(F.col("n_files") >= n)


def equal_pairs(files: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Each unordered pair of files of one content, in path order, with its context.

    files: contentid, size, dir, name, inode. shown: the files that still exist under the roots; contents are ranked
    and counted before that filter. A pair is one row, so a content with n files has n (n - 1) / 2; for large
    groups use buckets or classes instead.
    """
    many = multi_referenced(files)
    ranked = with_global_rank(many, [F.desc("size"), F.asc("contentid")], "ctxt_index")
    total = many.agg(F.count("*").alias("ctxt_size"))
    use = (files if shown is None else shown).select("contentid", "dir", "name", "inode", F.concat_ws("/", "dir", "name").alias("path"))
    rows = use.withColumns({"rn": F.row_number().over(Window.partitionBy("contentid").orderBy("dir", "name")).cast("long"), "n": F.count("*").over(Window.partitionBy("contentid"))})
    left, right = rows.select("contentid", "n", F.col("rn").alias("rn1"), F.col("path").alias("path1"), F.col("inode").alias("inode1")), rows.select("contentid", F.col("rn").alias("rn2"), F.col("path").alias("path2"), F.col("inode").alias("inode2"))
    pairs = left.join(right, "contentid").where("rn1 < rn2")
    # pairs whose first file comes before, of which the i-th has n - i, and those of the same first file
    place = F.expr("(rn1 - 1) * n - rn1 * (rn1 - 1) div 2 + rn2 - rn1 - 1")
    return (
        pairs.withColumn("ctxt_subindex", place.cast("long")).join(ranked.select("contentid", "size", "ctxt_index"), "contentid").join(F.broadcast(total), F.lit(True))
        .select("contentid", "size", F.coalesce(F.col("inode1") == F.col("inode2"), F.lit(False)).alias("hardlinked"), "path1", "path2", "ctxt_index", "ctxt_size", "ctxt_subindex")
    )


def without_hard_links(files: DataFrame) -> DataFrame:
    """The first path of each inode of a content; files without an inode are all kept."""
    rank = F.row_number().over(Window.partitionBy("contentid", "inode").orderBy("dir", "name"))
    return files.withColumn("_rn", rank).where("_rn = 1 or inode is null").drop("_rn")


def equal_buckets(files: DataFrame) -> DataFrame:
    """(contentid, size, n_files, files, is_first): files without further hard links, in path order, two at least."""
    rows = without_hard_links(files).select("contentid", "size", F.struct("dir", "name").alias("at"))
    made = rows.groupBy("contentid").agg(F.any_value("size").alias("size"), F.array_sort(F.collect_list("at")).alias("at")).where(F.size("at") > 1)
    ranked = with_global_rank(made, [F.desc("size"), F.asc("contentid")], "_rank")
    return ranked.select("contentid", "size", F.size("at").cast("long").alias("n_files"), F.transform("at", lambda x: F.concat_ws("/", x["dir"], x["name"])).alias("files"), (F.col("_rank") == 0).alias("is_first"))


def equal_classes(files: DataFrame) -> DataFrame:
    """(path, contentid, keeper): each file of a shared content with the first path of its class; one row a file."""
    rows = files.select("contentid", F.struct("dir", "name").alias("at"))
    first = rows.groupBy("contentid").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, "contentid").select(F.concat_ws("/", "at.dir", "at.name").alias("path"), "contentid", F.concat_ws("/", "first.dir", "first.name").alias("keeper"))


def wasted_bytes(files: DataFrame) -> DataFrame:
    return multi_referenced(files).agg(F.count("*").alias("contents"), F.sum(F.col("n_files") - 1).alias("extra_files"), F.sum((F.col("n_files") - 1) * F.col("size")).alias("wasted_bytes"))

"""Truncated files: a content that is a strict prefix of another one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import with_global_rank


def hashed_prefixes(contents: DataFrame, needed: DataFrame) -> DataFrame:
    """(large_id, size, sha1) of the prefixes needed (large_id, sizes) from contents' column content."""
    rows = needed.join(contents.select(F.col("id").alias("large_id"), "content"), "large_id")
    cut = F.transform("sizes", lambda n: F.struct(n.alias("size"), F.sha1(F.substr("content", F.lit(1), n.cast("int"))).alias("sha1")))
    return rows.select("large_id", F.explode(cut).alias("cut")).select("large_id", "cut.size", "cut.sha1")


def truncated_contents(contents: DataFrame, prefixes: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(first1ksha1, large_id, large_size, small_id, small_size) of contents with id, size, first1ksha1, fullsha1, parts.

    A small content meets those that share its longest hashed prefix, the largest power of two below its size or the
    first KiB, which both catalogs hold. Only for these are bytes read, once for each large content: prefixes gives
    (large_id, size, sha1) of (large_id, sizes); without it contents has a column content.
    """
    rows = contents.select("id", "size", "first1ksha1", "fullsha1", "parts")
    first = F.struct(F.lit(1024).cast("long").alias("n"), F.col("first1ksha1").alias("part"))
    marks = F.transform(F.map_entries("parts"), lambda e: F.struct(e["key"].alias("n"), e["value"].alias("part")))
    small = rows.select(F.col("id").alias("small_id"), F.col("size").alias("small_size"), F.col("fullsha1").alias("small_sha1"), F.array_max(F.concat(F.array(first), marks)).alias("at"))
    large = rows.select("first1ksha1", F.col("id").alias("large_id"), F.col("size").alias("large_size"), F.explode(F.concat(F.array(first), marks)).alias("at"))
    pairs = large.join(small, "at").where("large_size > small_size").drop("at")
    needed = pairs.groupBy("large_id").agg(F.collect_set("small_size").alias("sizes"))
    found = prefixes(needed) if prefixes else hashed_prefixes(contents, needed)
    same = found.select("large_id", F.col("size").alias("small_size"), F.col("sha1").alias("small_sha1"))
    return pairs.join(same, ["large_id", "small_size", "small_sha1"]).select("first1ksha1", "large_id", "large_size", "small_id", "small_size")


def truncated_pairs(contents: DataFrame, files: DataFrame, prefixes: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The files of each pair of contents, with the rank and number of first-KiB groups and the place in the group."""
    groups = contents.groupBy("first1ksha1").count().where("count > 1").select("first1ksha1")
    ranked = with_global_rank(groups, [F.asc("first1ksha1")], "ctxt_index")
    total = groups.agg(F.count("*").alias("ctxt_size"))
    path = F.concat_ws("/", "dir", "name")
    side = lambda s: files.select(F.col("contentid").alias(f"{s}_id"), path.alias(f"{s}_path"), F.col("dir").alias(f"{s}_dir"), F.col("name").alias(f"{s}_name"))
    rows = truncated_contents(contents, prefixes).join(side("large"), "large_id").join(side("small"), "small_id")
    order = [F.desc("large_size"), F.asc("large_id"), F.desc("small_size"), F.asc("small_id"), "large_dir", "large_name", "small_dir", "small_name"]
    place = F.row_number().over(Window.partitionBy("first1ksha1").orderBy(*order)) - 1
    return (
        rows.withColumn("ctxt_subindex", place.cast("long")).join(ranked, "first1ksha1").join(F.broadcast(total), F.lit(True))
        .select("large_size", "large_path", "small_size", "small_path", "ctxt_index", "ctxt_size", "ctxt_subindex")
    )

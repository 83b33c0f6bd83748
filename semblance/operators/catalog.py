"""Incremental content catalog: snapshot differences, counters, contents and roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formatting, hashing

MIN_SIZE = 1024


def classify(old: DataFrame, new: DataFrame, keys: list[str], stamp: str = "mtime") -> DataFrame:
    """keys, state: new, changed, unchanged or deleted, by one full outer join. Only the stamp decides on a change."""
    a, b = old.select(*keys, F.col(stamp).alias("_old"), F.lit(1).alias("_in_old")), new.select(*keys, F.col(stamp).alias("_new"), F.lit(1).alias("_in_new"))
    state = (
        F.when(F.col("_in_old").isNull(), "new").when(F.col("_in_new").isNull(), "deleted")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    )
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state"))


def exclude_names(listing: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    return listing.where(~F.col(column).rlike(formatting.globs_to_regex(patterns))) if patterns else listing


def under_roots(path: Column, roots: list[str], *, strict_compat: bool = False) -> Column:
    """Whether the path lies under a root, by whole components; strict_compat compares bare string prefixes."""
    hit = F.lit(False)
    for root in roots:
        bare = root.rstrip("/")
        hit |= F.startswith(path, F.lit(root)) if strict_compat else (path == bare) | F.startswith(path, F.lit(bare + "/"))
    return hit if roots else F.lit(True)


def still_there(files: DataFrame, listing: DataFrame, keys: list[str]) -> DataFrame:
    return files.join(listing.select(*keys).distinct(), keys, "left_semi")


def index_files(listed: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """Rows with dir, name, mtime, content become rows with size, hashes, prefix map and image flag."""
    content = F.col("content")
    return listed.where(F.octet_length(content) >= min_size).select(
        "dir", "name", "mtime", F.octet_length(content).cast("long").alias("size"), hashing.first1k_sha1(content).alias("first1ksha1"), hashing.full_sha1(content).alias("fullsha1"),
        hashing.prefix_sha1s(content).alias("parts"), hashing.image_kind(content).isNotNull().alias("isimage"),
    )


def contents_of(files: DataFrame, key: str = "file_id") -> DataFrame:
    """One row for each distinct content; its id is the least id of its files."""
    return files.groupBy("fullsha1", "size").agg(F.min(key).alias("id"), F.any_value("first1ksha1").alias("first1ksha1"), F.count("*").alias("n_files"))


def index_counters(listing: DataFrame, states: DataFrame, keys: list[str], file_globs: list[str], dir_globs: list[str]) -> DataFrame:
    """One row of counters of an indexing run over a listing with dir, name, size, regular and a failed flag."""
    named = listing.join(states, keys, "left")
    skip_dir = F.element_at(F.split("dir", "/"), -1).rlike(formatting.globs_to_regex(dir_globs))
    skip_file = F.col("name").rlike(formatting.globs_to_regex(file_globs))
    kind = (
        F.when(skip_dir, "dir").when(skip_file, "name").when(~F.col("regular"), "special").when(F.col("size") < MIN_SIZE, "small")
        .when(F.col("failed"), "error").otherwise(F.col("state"))
    )
    rows = named.withColumn("kind", kind)
    count = lambda k: F.count_if(F.col("kind") == k)
    hashed, seen = F.col("kind").isin("new", "changed"), F.col("kind").isin("unchanged")
    done = rows.agg(
        F.countDistinct(F.when(F.col("kind") != "dir", F.col("dir"))).alias("visited_dirs"), count("dir").alias("skipped_by_dir"), count("name").alias("skipped_by_name"), count("special").alias("not_regular"),
        count("small").alias("too_small"), count("unchanged").alias("unchanged"), count("new").alias("new"), count("changed").alias("modified"), count("error").alias("read_errors"),
        F.coalesce(F.sum(F.when(hashed, F.col("size"))), F.lit(0)).alias("hashed_bytes"), F.coalesce(F.sum(F.when(seen, F.col("size"))), F.lit(0)).alias("examined_bytes"),
    )
    gone = states.agg(F.count_if(F.col("state") == "deleted").alias("deleted"))
    return done.join(F.broadcast(gone), F.lit(True)).withColumn("known_bytes", F.col("hashed_bytes") + F.col("examined_bytes"))

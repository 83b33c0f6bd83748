"""Files as rows: a listing without contents first, contents only for what changed."""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formatting import globs_to_regex
from ..functions.hashing import sha1s_of_stream
from ..schema import LISTING, pairs_from_text


def list_store(spark: SparkSession, roots: list[str], min_size: int = 0) -> DataFrame:
    """path, dir, name, size, mtime of files that Spark's file source sees; contents are not read.

    That source follows symbolic links and passes over names that begin with ``.`` or ``_``; list_local does neither.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).where(F.col("length") >= min_size)
    return found.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))


def read_contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    found = spark.read.format("binaryFile").load(paths)
    return found.select("path", "content", F.unix_timestamp("modificationTime").alias("mtime"))


def list_local(spark: SparkSession, roots: list[str], skip_dirs: list[str] = (), batch: int = 50_000) -> DataFrame:
    """Every entry under local roots by name, links not followed, with device and inode; matching directories are not entered.

    The driver walks the tree, so this is for a machine's own disk; stores go through list_store.
    """
    import re

    skip = re.compile(globs_to_regex(list(skip_dirs)))
    out, rows = None, []

    def flush():
        nonlocal out, rows
        part = spark.createDataFrame(rows, LISTING)
        out, rows = part if out is None else out.unionByName(part), []

    for root in roots:
        stack = [os.path.realpath(root)]
        while stack:
            here = stack.pop()
            for entry in sorted(os.scandir(here), key=lambda e: e.name, reverse=True):
                if entry.is_dir(follow_symlinks=False):
                    if not skip.match(entry.name):
                        stack.append(entry.path)
                    continue
                s = entry.stat(follow_symlinks=False)
                rows.append((here, entry.name, s.st_size, int(s.st_mtime), s.st_dev, s.st_ino, stat.S_ISREG(s.st_mode)))
                if len(rows) >= batch:
                    flush()
    flush()
    return out


def hash_large_files(listing: DataFrame, chunk: int = 4 << 20) -> DataFrame:
    """dir, name, fullsha1, first1ksha1, parts, size, head (first bytes) of files on a path that all executors mount, read in pieces.

    For files beyond what a row can hold. A file that cannot be read has nulls.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for d, n in zip(pdf["dir"], pdf["name"], strict=True):
                try:
                    with open(os.path.join(d, n), "rb") as file:
                        head = file.read(16)
                        file.seek(0)
                        out.append((d, n, *sha1s_of_stream(iter(lambda: file.read(chunk), b"")), head))
                except OSError:
                    out.append((d, n, None, None, None, None, None))
            yield pd.DataFrame(out, columns=["dir", "name", "fullsha1", "first1ksha1", "parts", "size", "head"])

    return listing.select("dir", "name").mapInPandas(run, "dir string, name string, fullsha1 string, first1ksha1 string, parts map<bigint, string>, size long, head binary")


def hash_file_prefixes(needed: DataFrame, paths: DataFrame, chunk: int = 4 << 20) -> DataFrame:
    """(large_id, size, sha1) of needed (large_id, sizes) prefixes, each file read once as far as needed. paths: large_id, path.

    Files lie on a path that all executors mount; of one that cannot be read, or is too short, nothing comes.
    """

    def run(batches):
        import hashlib

        import pandas as pd

        for pdf in batches:
            out = []
            for large, path, sizes in zip(pdf["large_id"], pdf["path"], pdf["sizes"], strict=True):
                try:
                    with open(path, "rb") as file:
                        state, at = hashlib.sha1(), 0
                        for size in sorted(sizes):
                            while at < size and (data := file.read(min(chunk, size - at))):
                                state.update(data)
                                at += len(data)
                            if at == size:
                                out.append((large, size, state.copy().hexdigest()))
                except OSError:
                    continue
            yield pd.DataFrame(out, columns=["large_id", "size", "sha1"])

    return needed.join(paths, "large_id").select("large_id", "path", "sizes").mapInPandas(run, "large_id long, size long, sha1 string")


def read_batch_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, path) of a list with a line for each file: an id, a blank, the path."""
    parts = F.regexp_extract("value", r"^([^ ]+) (.*)$", 1), F.regexp_extract("value", r"^([^ ]+) (.*)$", 2)
    return spark.read.text(path).select(parts[0].alias("id"), parts[1].alias("path")).where("id <> ''")


def read_kernel_results(spark: SparkSession, path: str) -> DataFrame:
    """id, score, total, counts, pairs of lines that render.kernel_lines writes."""
    pattern = r"^(\d+): (\d+) (\d+)=([\d,]*) ?(.*)$"
    field = lambda i: F.regexp_extract("value", pattern, i)
    counts = F.transform(F.split(field(4), ","), lambda c, d: F.struct(d.cast("int").alias("distance"), F.try_to_number(F.nullif(c, F.lit("")), F.lit("9" * 18)).cast("long").alias("count")))
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(
        field(1).cast("long").alias("id"), field(2).cast("long").alias("score"), field(3).cast("long").alias("total"), F.filter(counts, lambda c: c["count"].isNotNull()).alias("counts"), pairs_from_text(field(5)).alias("pairs")
    )


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, line) of a file's lines after the first, from 0, read in as many pieces as the file has blocks; blank ones are none."""
    from ..operators.ranking import with_global_rank

    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")]
    lines = spark.read.text(path).select("value", *at)
    ranked = with_global_rank(lines, [F.asc("file"), F.asc("block"), F.asc("place")], "rank")
    return ranked.where("rank > 0 and trim(value) <> ''").select((F.col("rank") - 1).cast("long").alias("id"), F.trim("value").alias("line"))


def read_hamming_text(spark: SparkSession, path: str) -> DataFrame:
    """(id, h) of a signature file: after a header, one line an id, ``na`` for none."""
    from ..functions.hashing import hex_to_long

    return _numbered_lines(spark, path).where(~F.col("line").startswith("na")).select("id", hex_to_long(F.col("line")).alias("h"))


def read_histogram_text(spark: SparkSession, path: str) -> DataFrame:
    """(id, h) of a histogram file: lines of 32 hex digits a channel, two for each bin."""
    lines = _numbered_lines(spark, path)
    digits = F.replace(F.col("line"), F.lit(" "), F.lit(""))
    bins = F.transform(F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int")), lambda i: F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return lines.where(~F.col("line").startswith("na")).select("id", bins.alias("h"))

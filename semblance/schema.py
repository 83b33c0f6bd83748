"""Schemas (DDL) of the catalog tables; encoded text columns of older stores are maps and arrays here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


DIR = "id BIGINT, name STRING"
FILE = "id BIGINT, dirid BIGINT, name STRING, contentid BIGINT, mtime BIGINT"
CONTENT = "id BIGINT, first1ksha1 STRING, fullsha1 STRING, size BIGINT, parts MAP<BIGINT,STRING>, isimage BOOLEAN"
IMAGEHASH = "id BIGINT, contentid BIGINT, iht INT, hash STRING"
IMAGECMP = "contentid BIGINT, iht INT, similarity_threshold DOUBLE, score BIGINT, numpairs BIGINT, pairs ARRAY<STRUCT<contentid:BIGINT,distance:INT>>"
IMAGEFEEDBACK = "contentid1 BIGINT, contentid2 BIGINT, aresimilar INT"
LISTING = "dir STRING, name STRING, size BIGINT, mtime BIGINT, dev BIGINT, inode BIGINT, regular BOOLEAN"

#: Columns that are unique together.
UNIQUE = {"dir": ["name"], "file": ["dirid", "name"], "content": ["fullsha1", "size"], "imagehash": ["contentid", "iht"], "imagecmp": ["contentid", "iht"], "imagefeedback": ["contentid1", "contentid2"]}


def parts_from_text(text: Column) -> Column:
    """``"2048:<sha1> 4096:<sha1>"`` as a map from length to hash; empty text is an empty map."""
    pairs = F.filter(F.split(text, " "), lambda p: p != "")
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.split(p, ":")[0].cast("long"), F.split(p, ":")[1])))


def parts_to_text(parts: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(parts)), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"])), " ")


def pairs_from_text(text: Column) -> Column:
    """``"7:0 9:4"`` as an array of (contentid, distance)."""
    pairs = F.filter(F.split(text, " "), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(F.split(p, ":")[0].cast("long").alias("contentid"), F.split(p, ":")[1].cast("int").alias("distance")))


def pairs_to_text(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["contentid"].cast("string"), F.lit(":"), p["distance"].cast("string"))), " ")

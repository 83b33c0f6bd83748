"""Content hashes and image sniffing as column expressions over binary content."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST, LONGEST_PREFIX_BIT = 1024, 30


def full_sha1(content: Column) -> Column:
    return F.sha1(content)


def first1k_sha1(content: Column) -> Column:
    return F.sha1(F.substring(content, 1, FIRST))


def range_sha1(content: Column, start: int, n: int) -> Column:
    """Hash of n bytes from the 0-based place start."""
    return F.sha1(F.substring(content, start + 1, n))


def prefix_sha1s(content: Column) -> Column:
    """Map from each power of two from 2048 that is less than the length to the hash of that prefix."""
    size = F.octet_length(content).cast("long")
    bits = F.filter(F.sequence(F.lit(11), F.lit(LONGEST_PREFIX_BIT)), lambda k: F.expr("1L") * F.pow(F.lit(2), k).cast("long") < size)
    return F.map_from_entries(F.transform(bits, lambda k: F.struct(F.pow(F.lit(2), k).cast("long"), F.sha1(F.substr(content, F.lit(1), F.pow(F.lit(2), k).cast("int"))))))


def sha1s_of_stream(chunks) -> tuple[str, str, dict[int, str], int]:
    """(full, first 1 KiB, prefix map, size) of content that arrives in pieces, read once: for files too large for a row."""
    full, first, parts, size, mark = hashlib.sha1(), None, {}, 0, FIRST
    for chunk in chunks:
        view = memoryview(chunk)
        while size + len(view) >= mark:
            full.update(view[: mark - size])
            view, size = view[mark - size :], mark
            if mark == FIRST:
                first = full.copy().hexdigest()
            else:
                parts[mark] = full.copy().hexdigest()
            mark *= 2
        full.update(view)
        size += len(view)
    parts.pop(size, None)
    return full.hexdigest(), first if first else full.hexdigest(), parts, size


# Magic numbers of image formats, as (kind, offset, bytes in hex).
MAGIC = [
    ("jpeg", 6, "4A464946"), ("jpeg", 6, "45786966"), ("png", 0, "89504E470D0A1A0A"), ("gif", 0, "474946383761"), ("gif", 0, "474946383961"), ("tiff", 0, "4D4D"), ("tiff", 0, "4949"),
    ("rgb", 0, "01DA"), ("rast", 0, "59A66A95"), ("xbm", 0, "23646566696E6520"), ("bmp", 0, "424D"),
]


def image_kind(content: Column) -> Column:
    """The image format that the first bytes announce, or null. Only the magic counts."""
    head = F.hex(F.substring(content, 1, 16))
    kind = None
    for name, offset, magic in MAGIC:
        hit = F.substring(head, 2 * offset + 1, len(magic)) == magic
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    for name, digits in (("pbm", "14"), ("pgm", "25"), ("ppm", "36")):
        kind = kind.when(head.rlike(f"^503[{digits}](20|09|0A|0D)"), name)
    return kind


def hex_to_long(text: Column) -> Column:
    """16 hex digits as the 64-bit number of the same bits."""
    return F.conv(text, 16, -10).cast("long")


def long_to_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))

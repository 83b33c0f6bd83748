"""Shared pieces of the training-data operators: selection, Arrow batches, number crunching over words.

Words are the runs of bytes matched by ``[^\\x20\\x09-\\x0D]+`` after A-Z has been lower-cased. They are
never materialised as Python strings here; a word is a 64-bit hash taken from running sums over the bytes.
"""

from __future__ import annotations

import ctypes
import inspect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once, unless one word is longer.
BLOCK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another system's library
    _libc = None
#: Odd multipliers for the places of a shingle.
_PLACE = np.random.default_rng(97).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, np.uint64(base))
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def runs_of(*keys: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of rows alike in all keys; no rows have no runs."""
    n = len(keys[0])
    if not n:
        return []
    change = np.zeros(n - 1, bool)
    for key in keys:
        change |= key[1:] != key[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and their len + 1 offsets. Null reads as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if column.offset:
        column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """(first row, rows, from byte, to byte) over whole rows, or over parts of one long row cut at white space."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1
        if last > row:
            yield row, last - row, int(offsets[row]), int(offsets[last])
            row = last
            continue
        at, end = int(offsets[row]), int(offsets[row + 1])
        while at < end:
            to = min(at + BLOCK, end)
            if to < end:
                spaces = np.flatnonzero(_SPACE[data[at:to]])
                if len(spaces):
                    to = at + int(spaces[-1]) + 1
                else:
                    while to < end and not _SPACE[data[to]]:
                        to += 1
            yield row, 1, at, to
            at = to
        row += 1


def words_of(column: pa.Array):
    """Yields (first row, row count, word hashes, word offsets of those rows, starts, ends).

    Starts and ends are byte places in the column's buffer. The rows of a yield together hold about BLOCK bytes,
    or are one long row.
    """
    data, offsets = text_buffers(column)
    held: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for row, rows, at, to in _pieces(data, offsets):
        block = _LOWER[data[at:to]]
        inside = ~_SPACE[block]
        edge = np.zeros(to - at + 1, bool)
        cuts = offsets[row : row + rows + 1]
        edge[cuts[(cuts >= at) & (cuts <= to)] - at] = True
        edge[0] = edge[-1] = True
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        if len(inside):
            before[0] = after[-1] = False
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        power, inverse = _power_tables(len(block) + 1)
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(_BYTE[block] * power[: len(block)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        counts = np.searchsorted(starts, cuts - at)
        counts[-1] = len(starts)
        part = (row, rows, hashes, counts.astype(np.int64), starts + at, ends + at)
        if rows == 1 and to < offsets[row + 1]:
            held.append(part)
            continue
        if held:
            held.append(part)
            hashes, s, e = (np.concatenate([x[i] for x in held]) for i in (2, 4, 5))
            part = (row, 1, hashes, np.array([0, len(hashes)], np.int64), s, e)
            held = []
        part[3][0] = 0
        yield part


def shingles_of(hashes: np.ndarray, offsets: np.ndarray, n: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles, in order, with the row of each.

    A row of fewer than n words gives its whole sequence as one (whole) or nothing.
    """
    counts = np.diff(offsets)
    rows = np.repeat(np.arange(len(counts)), counts)
    if len(hashes) >= n:
        total = np.zeros(len(hashes) - n + 1, np.uint64)
        for i in range(n):
            total += hashes[i : len(hashes) - n + 1 + i] * _PLACE[i]
        same = rows[: len(total)] == rows[n - 1 :]
        out, where = mix(total[same]), rows[: len(total)][same]
    else:
        out, where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if whole:
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for j, r in enumerate(short):
                part = hashes[offsets[r] : offsets[r + 1]]
                extra[j] = (part * _PLACE[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
            out, where = np.concatenate([out, mix(extra)]), np.concatenate([where, short])
            order = np.argsort(where, kind="stable")
            out, where = out[order], where[order]
    return out, where


def stretches_of(text: str, longest: int, parts: int = 20) -> str:
    """The text, or, of one of more than longest bytes, about longest bytes in stretches from all over it.

    One stretch lies in each of equal parts, at a place by the text's hash, and ends at blanks where it has some.
    """
    data = text.encode()
    if len(data) <= longest:
        return text
    size, out = max(1, longest // parts), []
    places = mix(np.arange(parts, dtype=np.uint64) + np.uint64(zlib.crc32(data)))
    for k, place in enumerate(places.tolist()):
        a, b = k * len(data) // parts, (k + 1) * len(data) // parts
        a += place % max(1, b - a - size + 1)
        cut = data[a : a + size].decode("utf-8", "ignore")
        words = cut.split(" ")
        out.append(" ".join(words[1:-1]) if len(words) > 2 else cut)
    return " ".join(out)


def in_stretches(rows: DataFrame, longest: int) -> DataFrame:
    """rows with long texts (column text) by stretches_of."""

    def run(batches):
        for batch in batches:
            texts = pa.array([None if t is None else stretches_of(t, longest) for t in batch.column("text").to_pylist()], pa.string())
            yield batch.set_column(batch.schema.names.index("text"), "text", texts)

    return rows.mapInArrow(lean(run), rows.schema)


def _give_back() -> None:
    """Returns freed memory to the system, which Arrow's and the C library's allocators keep else for the worker's life."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def lean(run):
    """A task's function over batches, or over one group, after which the worker gives back what it has freed."""
    if inspect.isgeneratorfunction(run):

        def over(batches):
            try:
                yield from run(batches)
            finally:
                _give_back()

        return over

    def group(*args):
        try:
            return run(*args)
        finally:
            _give_back()

    return (lambda key, table: group(key, table)) if len(inspect.signature(run).parameters) == 2 else (lambda table: group(table))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): whatever other columns there are, and whatever they are called, stays behind."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def crc_fold(id_col: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def nested(df: DataFrame, text_col: str = "text", **more: F.Column) -> DataFrame:
    """All columns of df but the text as one, named row, beside text and others: no name of df's can clash with them."""
    rest = [df[f"`{c}`"] for c in df.columns if c != text_col] or [F.lit(0).alias("none")]
    return df.select(F.struct(*rest).alias("row"), df[f"`{text_col}`"].alias("text"), *[c.alias(name) for name, c in more.items()])


def flat(rows: DataFrame, columns: list[str], text_col: str = "text", **changed: F.Column) -> DataFrame:
    """The columns that nested() put into row and text, some of them changed."""
    return rows.select(*[changed.get(c, F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in columns])

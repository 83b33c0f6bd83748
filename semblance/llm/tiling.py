"""Benchmark decontamination by greedy string tiling (operator 3).

Every text is scanned for seeds, the ``least``-word runs of benchmark items. An item whose seeds could cover enough
of it is then tiled against the text: the longest run of words that neither side has marked is found by running
Karp-Rabin hashes, every occurrence that overlaps no other is marked, and so on down to runs of ``least`` words.
Tiles may stand in any order, so reordered passages count. A text is contaminated by an item of whose words its
tiles cover at least ``percent``.

The benchmark goes to the executors in blocks of at most ``block_words`` words, so that what is broadcast is
bounded however large the benchmark; each block is one pass over the documents' scan.

Defined results: an item of fewer words than ``least`` must occur as a whole; null or empty texts and items match
nothing; repeated documents or items give a row for each pair of rows; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, keyed_texts, lean, mix, nested, read_table, runs_of, shingles_of, words_of

_BASE = np.uint64(0xD6E8FEB86659FD93)


def _runs(words: np.ndarray, free: np.ndarray, n: int, power: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the n-word runs without a marked word, by running sums."""
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    busy = np.concatenate([[0], np.cumsum(~free)])
    starts = np.flatnonzero(busy[n:] == busy[:-n])
    return starts, mix((sums[starts + n] - sums[starts]) * inverse[starts])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
        table = np.full(n + 1, base)
        table[0] = 1
        out.append(np.multiply.accumulate(table))
    return out[0], out[1]


def greedy_tiles(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in the text, place in the item, words), longest first, that overlap on neither side."""
    free_text, free_item, tiles = np.ones(len(text), bool), np.ones(len(item), bool), []
    power, inverse = _powers(max(len(text), len(item)))
    most = min(len(text), len(item))

    def common(n: int):
        at, h = _runs(item, free_item, n, power, inverse)
        if not len(at):
            return None
        places, g = _runs(text, free_text, n, power, inverse)
        hit = np.isin(g, h)
        return (at, h, places[hit], g[hit]) if hit.any() else None

    while most >= least:
        low, high, best = least, most, None  # the longest common run, by bisection: shorter runs are common too
        while low <= high:
            n = (low + high) // 2
            if (found := common(n)) is None:
                high = n - 1
            else:
                best, low = (n, found), n + 1
        if best is None:
            break
        n, (at, h, places, g) = best
        by_hash: dict[int, list[int]] = {}
        for a, x in zip(at.tolist(), h.tolist(), strict=True):
            by_hash.setdefault(x, []).append(a)
        for b, x in zip(places.tolist(), g.tolist(), strict=True):
            if not free_text[b : b + n].all():
                continue
            for a in by_hash[x]:
                if free_item[a : a + n].all() and (text[b : b + n] == item[a : a + n]).all():
                    free_text[b : b + n] = free_item[a : a + n] = False
                    tiles.append((b, a, n))
                    break
        most = n
        if common(n) is None:
            most = n - 1
    return tiles


def _blocks(benchmark: DataFrame, block_words: int):
    """Lists of (item_id, words) of at most so many words, or of one item."""
    held, size = [], 0
    for row in benchmark.toLocalIterator():
        for _, _, hashes, _, _, _ in words_of(pa.array([row.text], pa.large_string())):
            if not len(hashes):
                continue
            if held and size + len(hashes) > block_words:
                yield held
                held, size = [], 0
            held.append((row.item_id, hashes))
            size += len(hashes)
    if held:
        yield held


def _seeded(items: list[tuple[int, np.ndarray]], least: int) -> tuple:
    """(items, sorted seeds, the item and the place of each, lengths of seeds)."""
    seeds, owner, place = [], [], []
    for k, (_, words) in enumerate(items):
        shingles, _ = shingles_of(words, np.array([0, len(words)]), min(least, len(words)))
        seeds.append(shingles)
        owner.append(np.full(len(shingles), k))
        place.append(np.arange(len(shingles)))
    seeds, owner, place = (np.concatenate(x) for x in (seeds, owner, place))
    order = np.argsort(seeds, kind="stable")
    return items, seeds[order], owner[order], place[order], sorted({min(least, len(w)) for _, w in items})


def _tiled(words: np.ndarray, hits: np.ndarray, table: tuple, least: int, percent: int):
    """(item_id, words of the item, words covered, tiles) of the items that cover enough."""
    items, seeds, owner, place, _ = table
    low, high = np.searchsorted(seeds, np.unique(hits)), np.searchsorted(seeds, np.unique(hits), "right")
    pick = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
    for k in np.unique(owner[pick]):
        item_id, item = items[k]
        n = min(least, len(item))
        cover = np.zeros(len(item) + 1, np.int64)
        at = place[pick[owner[pick] == k]]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + n, -1)
        if 100 * (np.cumsum(cover)[:-1] > 0).sum() < percent * len(item):
            continue
        tiles = greedy_tiles(words, item, n)
        covered = sum(t[2] for t in tiles)
        if 100 * covered >= percent * len(item):
            yield item_id, len(item), covered, sorted(tiles)


def _matches(column: pa.Array, table: tuple, least: int, percent: int):
    """(row, item_id, words of the item, words covered, tiles) over a column of texts."""
    _, seeds, _, _, lengths = table
    for first, _, hashes, offsets, _, _ in words_of(column):
        found: dict[int, list[np.ndarray]] = {}
        for n in lengths:
            shingles, where = shingles_of(hashes, offsets, n, whole=False)
            at = np.searchsorted(seeds, shingles)
            at[at == len(seeds)] = 0
            hit = np.flatnonzero(seeds[at] == shingles)
            for a, b in runs_of(where[hit]):
                found.setdefault(int(where[hit[a]]), []).append(shingles[hit[a:b]])
        for r in sorted(found):
            for match in _tiled(hashes[offsets[r] : offsets[r + 1]], np.concatenate(found[r]), table, least, percent):
                yield first + r, *match


def _scan(docs: DataFrame, items: list[tuple[int, np.ndarray]], least: int, percent: int) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(_seeded(items, least))  # of at most block_words words, or one item
    tile = pa.list_(pa.struct([("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))

    def run(batches):
        for batch in batches:
            ids, marks = batch.column("doc_id"), batch.column("text_hash")
            rows: dict[str, list] = {k: [] for k in ("doc_id", "text_hash", "item_id", "item_words", "covered", "tiles")}
            for r, item_id, n, covered, tiles in _matches(batch.column("text"), shipped.value, least, percent):
                values = (ids[r].as_py(), marks[r].as_py(), item_id, n, covered, [{"doc_word": t[0], "item_word": t[1], "words": t[2]} for t in tiles])
                for k, v in zip(rows, values, strict=True):
                    rows[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, tile if k == "tiles" else pa.int64()) for k, v in rows.items()], list(rows))

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, text_hash long, item_id long, item_words long, covered long, tiles array<struct<doc_word: long, item_word: long, words: long>>")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, least: int = 5, percent: int = 80, block_words: int = 2_000_000, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs (with text, all columns) that no item contaminates: one pass for all blocks, without a shuffle."""
    rows = nested(docs)
    for block in _blocks(keyed_texts(benchmark, item_col, item_text_col).withColumnRenamed("doc_id", "item_id"), block_words):
        rows = _filtered(rows, block, least, percent)
    return flat(rows, docs.columns)


def _filtered(docs: DataFrame, items: list[tuple[int, np.ndarray]], least: int, percent: int) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(_seeded(items, least))

    def run(batches):
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for r, *_ in _matches(batch.column("text"), shipped.value, least, percent):
                clean[r] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(lean(run), docs.schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, least: int = 5, percent: int = 80, block_words: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, item_id, item_words, covered, tiles for each contaminated pair."""
    if least < 1:
        raise ValueError("a run has at least one word")
    texts = keyed_texts(docs, id_col, text_col)
    items = keyed_texts(benchmark, item_col, item_text_col).withColumnRenamed("doc_id", "item_id")
    out = None
    for block in _blocks(items, block_words):
        part = _scan(texts, block, least, percent)
        out = part if out is None else out.unionByName(part)
    if out is None:
        schema = "doc_id long, text_hash long, item_id long, item_words long, covered long, tiles array<struct<doc_word: long, item_word: long, words: long>>"
        return docs.sparkSession.createDataFrame([], schema)
    return out


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "covered", F.size("tiles").cast("long").alias("n_tiles"))

"""Near-duplicate passages by compact windows (operator 4).

The tokens of a text are its n-word shingles. Under a min-hash function the nodes of the Cartesian tree over the
tokens' hashes group all subsequences with the same min-hash: a node at place c with extent [i, j] is the minimum
of every subsequence from x to y with i <= x <= c <= y <= j. Two passages of ``least`` words that replaced, inserted or
deleted words leave ``percent`` % alike have a run of ``run`` equal shingles at least (``shared_run``: 21 of 46), and the
minimum of that run is a node of both whose extent holds the run. So nodes whose extent holds ``run`` tokens, about
2 n / run of them under one function, miss no pair.

1. Scan: windows go, packed, to ranges of their min-hash.
2. Interval join: a text that stands in many documents takes part once, for the first of them. Up to ``FEW`` windows of one
   min-hash pair each with each, if they have a run of equal shingles around the minimum.
3. Windows of a min-hash with more than that get the shingles around them, as far as the shortest similar passage can
   reach. A shingle that at most ``RARE`` of them hold pairs these. Two that have no rare one in common are alike by the
   others alone, and so are all with the same pattern of these: a pattern that is similar enough in itself, or to another,
   pairs its windows with the first of its kind. Windows with ``width`` equal shingles are joined by a hash of these, and then
   patterns of different texts are compared until none that are alike stay apart. A task's windows stand in a file of its own.
4. Pairs of documents are verified, word by word, a word being 32 bits of its
   hash: from the joined minima equal shingles are followed to both sides, over replaced, inserted and deleted words, to passages of at least ``least``
   words whose shingles have a Jaccard similarity of at least ``percent`` %.

A pair of different texts with a passage in common is thus a row, or both hang together by rows with others that hold it:
by 3., and where the passages of both are rows with the earliest source of the one, which then stand for the pair. A text
that an earlier document holds whole is reported for that document, not for all others that are like it.
A passage's earliest document by doc_id is its source and is not reported for it; passages that a text repeats
within itself alone are left alone.

Defined results: null or empty texts and those of fewer than ``least`` words have no passage; rows alike in id and
text count once; rows of one id with different texts are different documents, ordered by their text's hash; a
null id stands before all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import tempfile
from bisect import bisect_right, insort
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import kept
from .common import BLOCK, flat, keyed_texts, lean, mix, nested, read_table, runs_of, shingles_of, text_buffers, words_of

#: Bytes of text whose windows a range holds, about; windows that a task sorts at once; pairs compared at once.
RANGE_BYTES, BLOCK_WINDOWS, BLOCK_PAIRS = 8 << 20, 100_000, 4000
#: Pairs of windows that are held before they are compared; numbers that are held in memory, not in a file.
BLOCK_CODES, MEMORY_NUMBERS = 500_000, 2 << 20
#: Windows of one min-hash that pair each with each; windows with a shingle in common that do, where there are more.
FEW, RARE = 8, 16
#: Patterns that are compared each with each.
FEW_PATTERNS = 32
#: Texts that are cut at once.
CUT_ROWS = 500
_SEEDS = np.random.default_rng(411).integers(1, 1 << 63, 64, dtype=np.uint64)


def _window(run: int) -> np.dtype:
    """Extents, whether an equal minimum is near, and a byte of each shingle that a run around the minimum can hold."""
    return np.dtype([("key", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("at", "<u4"), ("left", "<u4"), ("right", "<u4"), ("tied", "u1"), ("near", "u1", (2 * run - 1,))])


_WINDOW = _window(1)


def least_equal(n: int, width: int, percent: int, gaps: int) -> int:
    """The fewest equal shingles of two passages of width shingles at least, similar enough, with so many gaps.

    A replaced, inserted or deleted word costs both together 2 n - 1 shingles at least.
    """
    if not gaps:
        return width
    most = max(2 * width, (2 * n - 1) * gaps)
    return min(max(-(-percent * g // max(100 - percent, 1)), -(-(2 * width - g) // 2)) for g in range((2 * n - 1) * gaps, most + 1))


@lru_cache
def shared_run(n: int, width: int, percent: int) -> int:
    """The length that the longest run of equal shingles of two similar passages has at least."""
    gaps = range(1 if percent < 100 else 0)
    return max(1, min([width, *(-(-least_equal(n, width, percent, k) // (k + 1)) for g in gaps for k in range(g + 1, width + 1))]))


def _slide(values: np.ndarray, width: int, op) -> np.ndarray:
    """op (minimum or maximum) over each run of width values; len(values) - width + 1 of them."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    grid = np.full(rows * width, values[-1], values.dtype)
    grid[: len(values)] = values
    grid = grid.reshape(rows, width)
    ahead = op.accumulate(grid, axis=1).ravel()
    back = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[width - 1 : width - 1 + n])


def _smaller_before(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Place of the nearest smaller value before each within its group, or -1."""
    at = np.arange(len(values)) - 1
    while True:
        ok = at >= 0
        ok[ok] = group[at[ok]] == group[ok]
        at[~ok] = -1
        big = np.flatnonzero(ok)
        big = big[values[at[big]] >= values[big]]
        if not len(big):
            return at
        at[big] = at[at[big]]


def cartesian_windows(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, extent to the left, extent to the right) of tree nodes whose extents hold at least width tokens.

    rows: the text of each token. Equal minima nearer than width to each other are one node.
    """
    empty = np.zeros(0, np.int64)
    if len(hashes) < width:
        return empty, empty, empty
    lowest = _slide(hashes, width, np.minimum)
    lowest[rows[: len(lowest)] != rows[width - 1 :]] = 0  # windows over two texts
    padded = np.concatenate([np.zeros(width - 1, np.uint64), lowest, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(_slide(padded, width, np.maximum) == hashes)
    value, row = hashes[chosen], rows[chosen]
    begin, end = np.searchsorted(rows, row), np.searchsorted(rows, row, "right")
    before = _smaller_before(value, row)
    after = len(chosen) - 1 - _smaller_before(value[::-1], row[::-1])[::-1]  # len(chosen) where there is none
    left = chosen - np.where(before >= 0, chosen[before] + 1, begin)
    right = np.where(after < len(chosen), chosen[np.minimum(after, len(chosen) - 1)] - 1, end - 1) - chosen
    same = np.zeros(len(chosen), bool)
    same[1:] = (value[1:] == value[:-1]) & (row[1:] == row[:-1]) & (chosen[1:] - chosen[:-1] < width)
    run = np.maximum.accumulate(np.where(same, 0, np.arange(len(chosen))))
    step = (chosen - chosen[run]) // width
    use = ~same
    use[1:] |= same[1:] & (step[1:] != step[:-1])
    use[:-1] |= same[:-1] & ~same[1:]  # the last of such a run as well: texts meet at either end of it
    use[-1:] = True
    return chosen[use], left[use], right[use]


def _packed(held: list[np.ndarray], ranges: int) -> pa.RecordBatch:
    """(part, blob): rows by range of their key."""
    got = np.concatenate(held)
    part = ((got["key"] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    part, got = part[order], got[order]
    edges = runs_of(part)
    names, blobs = pa.array([int(part[a]) for a, _ in edges], pa.int64()), pa.array([got[a:b].tobytes() for a, b in edges], pa.binary())
    return pa.RecordBatch.from_arrays([names, blobs], ["part", "blob"])


def windows_of(docs: DataFrame, n: int, run: int, ranges: int) -> DataFrame:
    """(part, blob): packed windows by range of their key."""
    reach = np.arange(1 - run, run)

    def scan(batches):
        held, count = [], 0
        for batch in batches:
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
            for first, _, words, offsets, _, _ in words_of(batch.column("text")):
                tokens, rows = shingles_of(words, offsets, n, whole=False)
                hashes = mix(tokens + _SEEDS[0]) | np.uint64(1)
                at, left, right = cartesian_windows(hashes, rows, run)
                if not len(at):
                    continue
                starts = np.searchsorted(rows, np.arange(len(offsets) - 1))
                got, row = np.zeros(len(at), _window(run)), rows[at]
                got["key"], got["doc"], got["tag"], got["at"] = mix(tokens[at] + _SEEDS[1]), ids[first + row], tags[first + row], at - starts[row]
                got["left"], got["right"] = left, right
                tied = (hashes[at[1:]] == hashes[at[:-1]]) & (row[1:] == row[:-1]) & (at[1:] - at[:-1] < 2 * run)
                got["tied"][1:] |= tied
                got["tied"][:-1] |= tied
                got["near"] = (tokens >> np.uint64(56)).astype(np.uint8)[np.clip(at[:, None] + reach, 0, len(tokens) - 1)]
                held.append(got)
                count += len(got)
                if count >= BLOCK_WINDOWS:
                    yield _packed(held, ranges)
                    held, count = [], 0
        if count:
            yield _packed(held, ranges)

    return docs.mapInArrow(lean(scan), "part long, blob binary")


_JOINED = "doc_id long, tag long, at long, source_id long, source_tag long, source_at long, key long"


def _groups(table: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ordered by key, doc, tag and place, each once, and where each key's begin and how many they are."""
    rows = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column("blob")])
    rows = rows[np.lexsort((rows["at"], rows["tag"], rows["doc"], rows["key"]))]
    if len(rows):
        rows = rows[np.r_[True, np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in ("key", "doc", "tag", "at")])]]
    return rows, *_sizes(rows)


def _sizes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.r_[True, rows["key"][1:] != rows["key"][:-1]]) if len(rows) else np.zeros(0, np.int64)
    return cut, np.diff(np.r_[cut, len(rows)])


def _pairs_table(rows: np.ndarray, own: np.ndarray, source: np.ndarray, alone: np.ndarray = np.zeros(0, np.int64)) -> pa.Table:
    """Pairs of rows, and rows without a source."""
    both, k = np.r_[own, alone], len(own)
    columns = [rows[c][both].astype(np.int64) for c in ("doc", "tag", "at")] + [np.r_[rows[c][source].astype(np.int64), np.zeros(len(alone), np.int64)] for c in ("doc", "tag", "at")]
    none = np.arange(len(both)) >= k
    arrays = [pa.array(x) for x in columns[:3]] + [pa.array(x, mask=none) for x in columns[3:]] + [pa.array(rows["key"][both].view(np.int64))]
    return pa.table({c.split()[0]: x for c, x in zip(_JOINED.split(", "), arrays, strict=True)})


def _other_text(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (rows["doc"][a] != rows["doc"][b]) | (rows["tag"][a] != rows["tag"][b])


def _run_around(rows: np.ndarray, a: np.ndarray, b: np.ndarray, run: int) -> np.ndarray:
    """Which pairs of windows have equal shingles, run of them at least, around their minimum."""
    out = np.zeros(len(a), bool)
    for x in range(0, len(a), BLOCK_WINDOWS):
        i, j = a[x : x + BLOCK_WINDOWS], b[x : x + BLOCK_WINDOWS]
        same = rows["near"][i] == rows["near"][j]
        before = np.logical_and.accumulate(same[:, : run - 1][:, ::-1], axis=1).sum(1)
        after = np.logical_and.accumulate(same[:, run:], axis=1).sum(1)
        left, right = np.minimum(rows["left"][i], rows["left"][j]), np.minimum(rows["right"][i], rows["right"][j])
        out[x : x + BLOCK_WINDOWS] = np.minimum(before, left) + np.minimum(after, right) + 1 >= run
        out[x : x + BLOCK_WINDOWS] |= (rows["tied"][i] & rows["tied"][j]).astype(bool)  # other places of the run may be chosen
    return out


def interval_join(windows: DataFrame, ranges: int, run: int) -> DataFrame:
    """Pairs of windows of one min-hash in different documents, and, without a source, windows of which there are more than FEW."""

    def join(key, table):
        rows, cut, size = _groups(table, _window(run))
        # copies of a text: the first by doc_id takes part for all, and each other pairs with it
        order = np.lexsort((rows["doc"], rows["at"], rows["tag"], rows["key"]))
        new = np.ones(len(rows), bool)
        new[1:] = np.logical_or.reduce([rows[c][order[1:]] != rows[c][order[:-1]] for c in ("key", "tag", "at")])
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        found = [np.stack([order[~new], first[~new]])]
        held = np.sort(order[new])
        rows_left = rows[held]
        cut, size = _sizes(rows_left)
        for m in range(2, FEW + 1):
            begin = cut[size == m]
            a, b = np.triu_indices(m, 1)
            i, j = (begin[:, None] + b).ravel(), (begin[:, None] + a).ravel()
            use = _other_text(rows_left, i, j)
            i, j = i[use], j[use]
            use = _run_around(rows_left, i, j, run)
            found.append(np.stack([held[i[use]], held[j[use]]]))
        many = np.repeat(size > FEW, size)
        if many.any():  # of several texts
            group = np.repeat(np.arange(len(cut)), size)
            start = cut[group]
            many &= np.bincount(group, _other_text(rows_left, np.arange(len(rows_left)), start))[group] > 0
        own, source = np.concatenate(found, 1)
        return _pairs_table(rows, own, source, held[many])

    return windows.repartition(ranges, "part").groupBy("part").applyInArrow(lean(join), _JOINED)


def _around(reach: int) -> np.dtype:
    """Windows with 32 bits of each shingle so far to both sides, 0 beyond the text."""
    return np.dtype([("key", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("at", "<u4"), ("near", "<u4", (2 * reach + 1,))])


def surrounded(rows: DataFrame, n: int, reach: int, ranges: int) -> DataFrame:
    """(part, blob): packed windows with the shingles around them, of rows (doc_id, tag, text, places: key and at)."""
    kind, step = _around(reach), np.arange(-reach, reach + 1)

    def scan(batches):
        held, count = [], 0
        for batch in batches:
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
            places = batch.column("places")
            for first, many, words, offsets, _, _ in words_of(batch.column("text")):
                for r in range(many):
                    mine = words[offsets[r] : offsets[r + 1]]
                    tokens, _ = shingles_of((mine >> np.uint64(32)), np.array([0, len(mine)]), n, whole=False)
                    small = np.maximum((tokens >> np.uint64(32)).astype("<u4"), 1)
                    flat_places = places[first + r].values
                    keys, ats = (flat_places.field(c).to_numpy(zero_copy_only=False) for c in ("key", "at"))
                    for x in range(0, len(ats), BLOCK_PAIRS):
                        at = ats[x : x + BLOCK_PAIRS, None] + step
                        got = np.zeros(len(at), kind)
                        got["key"], got["doc"], got["tag"], got["at"] = keys[x : x + BLOCK_PAIRS].view(np.uint64), ids[first + r], tags[first + r], ats[x : x + BLOCK_PAIRS]
                        got["near"] = np.where((at >= 0) & (at < len(small)), small[np.clip(at, 0, len(small) - 1)], 0)
                        held.append(got)
                        count += len(got)
                        if count >= BLOCK_PAIRS * 2:
                            yield _packed(held, ranges)
                            held, count = [], 0
        if count:
            yield _packed(held, ranges)

    return rows.select("doc_id", "tag", "text", "places").mapInArrow(lean(scan), "part long, blob binary")


def _room(shape: tuple[int, int], kind: np.dtype) -> np.ndarray:
    """Room for so many numbers, of many in a file, which has no name."""
    if math.prod(shape) <= MEMORY_NUMBERS:
        return np.empty(shape, kind)
    with tempfile.TemporaryFile() as file:
        return np.asarray(np.memmap(file, kind, "w+", shape=shape))


def _numbered(near: np.ndarray) -> np.ndarray:
    """near by rows in order, equal shingles of a row numbered, so that rows compare as multisets; 0 is of its row alone."""
    near = np.sort(near, axis=1)
    place = np.arange(near.shape[1])
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    out = (near.astype(np.uint64) << np.uint64(16)) + (place - np.maximum.accumulate(np.where(new, place, 0), axis=1)).astype(np.uint64)
    return out


def _in_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many numbered shingles the rows of x and y have in common."""
    both = np.sort(np.concatenate([x, y], axis=1), axis=1)
    return ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 1 << 16)).sum(1)


def _by_rare(near: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows with a rare shingle and at least so many shingles in common; and the shingles that are not rare.

    Shingles are counted by ranges of their hash, so that no more than some million are sorted at once.
    """
    m, codes, waiting, good, hot = len(near), [], 0, np.zeros(0, np.int64), []
    parts = -(-m // BLOCK_PAIRS)
    numbered = _numbered(near) if parts == 1 else None

    def enough(codes):
        """Which of the pairs have enough in common."""
        codes = np.unique(np.concatenate(codes))
        use = np.zeros(len(codes), bool)
        for x in range(0, len(codes), BLOCK_PAIRS):
            both = np.divmod(codes[x : x + BLOCK_PAIRS], m)
            use[x : x + BLOCK_PAIRS] = _in_common(*[numbered[y] if parts == 1 else _numbered(np.asarray(near[y])) for y in both]) >= least
        return codes[use]

    for k in range(parts):
        seen = []
        for x in range(0, m, BLOCK_PAIRS):
            part = near[x : x + BLOCK_PAIRS]
            if parts > 1:
                row, place = np.nonzero((part.astype(np.uint64) * np.uint64(parts)) >> np.uint64(32) == k)
                seen.append(np.unique((part[row, place].astype(np.uint64) << np.uint64(32)) + (row + x).astype(np.uint64)))
            else:
                seen.append(((part.astype(np.uint64) << np.uint64(32)) + np.arange(m, dtype=np.uint64)[:, None]).ravel())
        seen = np.sort(np.concatenate(seen))
        seen = seen[np.searchsorted(seen, np.uint64(1 << 32)) :]
        seen = seen[np.r_[True, seen[1:] != seen[:-1]]] if len(seen) else seen
        if not len(seen):
            continue
        value, row = (seen >> np.uint64(32)).astype(np.uint32), (seen & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        size = np.diff(np.r_[cut, len(value)])
        hot.append(value[cut[size > RARE]])
        for many in np.unique(size[(size > 1) & (size <= RARE)]).tolist():
            begin = cut[size == many]
            a, b = np.triu_indices(many, 1)
            step = max(1, BLOCK_CODES // len(a))
            for x in range(0, len(begin), step):
                i, j = row[(begin[x : x + step, None] + b).ravel()], row[(begin[x : x + step, None] + a).ravel()]
                codes.append(np.unique(np.maximum(i, j) * m + np.minimum(i, j)))
                waiting += len(codes[-1])
                if waiting > 4 * BLOCK_CODES:  # few of them hold in the end
                    good, codes, waiting = np.union1d(good, enough(codes)), [], 0
    if codes:
        good = np.union1d(good, enough(codes))
    return *np.divmod(good, m), np.concatenate(hot) if hot else np.zeros(0, np.uint32)


def _best_score(held: np.ndarray, reach: int, width: int, percent: int) -> np.ndarray:
    """The best that a passage of width shingles at least around the middle can score, by which shingles the other text holds.

    Two passages are similar enough if their scores together are not below 0.
    """
    sums = np.cumsum(np.where(held, np.int32(100 - percent), np.int32(-2 * percent)), axis=1, dtype=np.int32)
    ahead = np.maximum.accumulate(sums[:, ::-1], axis=1)[:, ::-1]
    start = np.arange(min(reach + 1, held.shape[1] - width + 1))
    before = np.concatenate([np.zeros((len(held), 1), sums.dtype), sums], axis=1)
    return (ahead[:, np.maximum(reach, start + width - 1)] - before[:, start]).max(1)


def _first_others(group: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order, dealt into groups: the first row of each row's group that is of another text, or -1; and the first."""
    order = np.argsort(group, kind="stable")
    cut = np.flatnonzero(np.r_[True, group[order[1:]] != group[order[:-1]]])
    which = np.repeat(np.arange(len(cut)), np.diff(np.r_[cut, len(order)]))
    first = order[cut]
    differs = np.flatnonzero(text[order] != text[first[which]])
    other = np.full(len(cut), -1)
    held, at = np.unique(which[differs], return_index=True)
    other[held] = order[differs[at]]
    out, heads = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
    out[order] = np.where(text[order] != text[first[which]], first[which], other[which])
    heads[order] = first[which]
    return out, heads


def _joined_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, the least row that hangs together with each, after rows a and b are joined."""
    a, b = label[a], label[b]
    while True:
        x, y = label[a], label[b]
        use = x != y
        if not use.any():
            return label
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y)[use], np.minimum(x, y)[use])
        while (label[label] != label).any():
            label = label[label]


def _by_runs(near: np.ndarray, text: np.ndarray, width: int) -> list[np.ndarray]:
    """Pairs of rows that join all with a run of width equal shingles, not 0, around the middle.

    A run's rows pair with its first one, or that one's with the next of another text.
    """
    reach, found, label = near.shape[1] // 2, [], np.arange(len(near))
    powers = np.multiply.accumulate(np.full(near.shape[1], _SEEDS[3] | np.uint64(1)))
    hashes, starts = _room((width, len(near)), np.dtype(np.uint64)), np.arange(reach - width + 1, reach + 1)  # 0: not a whole run
    for x in range(0, len(near), BLOCK_PAIRS):
        part = near[x : x + BLOCK_PAIRS]
        full = np.zeros((len(part), near.shape[1] + 1), np.int16)
        np.cumsum(part != 0, axis=1, out=full[:, 1:])
        sums = np.zeros((len(part), near.shape[1] + 1), np.uint64)
        np.cumsum(part * powers, axis=1, out=sums[:, 1:])
        whole = full[:, starts + width] - full[:, starts] == width
        hashes[:, x : x + BLOCK_PAIRS] = np.where(whole, np.maximum(sums[:, starts + width] - sums[:, starts], np.uint64(1)), np.uint64(0)).T
    for mine in hashes:
        rows = np.flatnonzero(mine)
        if len(rows) < 2:
            continue
        partner, _ = _first_others(mine[rows], text[rows])
        own, partner = rows[partner >= 0], rows[partner[partner >= 0]]
        x, y = label[own], label[partner]
        _, use = np.unique(np.minimum(x, y) * len(near) + np.maximum(x, y), return_index=True)
        use = use[x[use] != y[use]]
        found.append(np.stack([own[use], partner[use]]))
        label = _joined_labels(label, own[use], partner[use])
    return found


def _by_pattern(near: np.ndarray, hot: np.ndarray, text: np.ndarray, n: int, width: int, percent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of near that are similar by common shingles (hot) alone: all that are alike hang together.

    text: a number for the text of each row. Rows with a run of width in common are joined by its hash; after that,
    patterns are compared only with those that do not hang together with them yet.
    """
    reach = near.shape[1] // 2
    kept_rows, digests, patterns, count = [], [], _room(near.shape, near.dtype), 0
    weights = _SEEDS[4:6] * mix(np.arange(near.shape[1]))[:, None] | np.uint64(1)
    for x in range(0, len(near), BLOCK_PAIRS):
        part = np.array(near[x : x + BLOCK_PAIRS])
        at = np.minimum(np.searchsorted(hot, part), len(hot) - 1)
        part *= hot[at] == part
        # a passage around the minimum ends where the shingles up to there make up for the gaps, with the best of the other side
        score = np.where(part != 0, np.int32(100 - percent), np.int32(-percent))
        sides = [np.cumsum(score[:, reach - 1 :: -1], axis=1, dtype=np.int32), np.cumsum(score[:, reach + 1 :], axis=1, dtype=np.int32)]
        best = [np.maximum(y.max(1), 0) + 100 - percent for y in sides]
        for side, y, other in ((part[:, reach - 1 :: -1], sides[0], best[1]), (part[:, reach + 1 :], sides[1], best[0])):
            side *= np.logical_or.accumulate((y + other[:, None] >= 0)[:, ::-1], axis=1)[:, ::-1]
        use = np.flatnonzero((part != 0).sum(1) >= least)
        kept_rows.append(use + x)
        patterns[count : count + len(use)] = part[use]
        digests.append(mix(patterns[count : count + len(use)]) @ weights)
        count += len(use)
    rows, near = np.concatenate(kept_rows), patterns[:count]
    none = np.zeros(0, np.int64)
    if len(rows) < 2:
        return none, none
    text = text[rows]
    _, begin, kind = np.unique(np.concatenate(digests).view("V16").ravel(), return_index=True, return_inverse=True)  # 128 bits of a pattern
    begin = np.sort(begin)  # patterns by their first row
    kind = np.searchsorted(begin, _first_others(kind, text)[1])
    partner, _ = _first_others(kind, text)
    shapes = _gathered(near, begin)

    def alike(p, q):
        x, y = (np.where(shape != 0, shape, blank) for shape, blank in zip((shapes[p], shapes[q]), blanks, strict=True))
        return bool(joined_runs(aligned_runs(x, y, [(reach, reach)], width, percent), n, width, percent))

    blanks = np.arange(near.shape[1], dtype=np.uint64) + np.array([[1 << 40], [2 << 40]], np.uint64)  # alike to nothing
    # copies of a pattern that is similar to itself
    several = np.unique(kind[partner >= 0])
    itself = np.zeros(len(begin), bool)
    ahead = lambda rows: sum(np.logical_and.accumulate(rows[:, side] != 0, axis=1).sum(1) for side in (slice(reach, None, -1), slice(reach, None)))
    run = _in_blocks(lambda x: ahead(shapes[x]), several) > width
    itself[several] = [exact or alike(p, p) for p, exact in zip(several.tolist(), run.tolist(), strict=True)]
    own = np.flatnonzero((partner >= 0) & itself[kind])
    found = [np.stack([own, partner[own]])]
    # runs of width: of patterns whose rows hang together the first row and the first of another text
    if len(begin) > FEW_PATTERNS:
        seen = np.unique(np.concatenate([begin, partner[begin][partner[begin] >= 0], np.flatnonzero(~itself[kind])]))
        found += [seen[x] for x in _by_runs(_gathered(near, seen), text[seen], width)]
    part = np.arange(len(near))
    for a, b in found:
        part = _joined_labels(part, a, b)
    part, of_kind = part[begin].copy(), np.argsort(kind, kind="stable")
    count = np.bincount(kind)
    until = np.cumsum(count)

    def members(p):
        """All rows of a pattern, or, if they hang together already, its first and the first of another text."""
        mine = of_kind[until[p] - count[p] : until[p]]
        return mine[np.r_[0, np.flatnonzero(text[mine] != text[mine[0]])[:1]]] if itself[p] else mine

    def pair(p, q):
        one, other = members(p), members(q)
        for x, y in ((one, other), (other, one)):
            another = y[text[y] != text[y[0]]]
            first = np.where(text[x] != text[y[0]], y[0], another[0] if len(another) else y[0])
            use = text[x] != text[first]
            found.append(np.stack([x[use], first[use]]))
        itself[[p, q]] = True

    alone = np.where(partner[begin] < 0, text[begin], -1)  # the text of patterns that one text alone has
    _compare_parts(shapes, part, alone, reach, n, width, percent, least, alike, pair)
    own, source = np.concatenate(found, 1)
    own, source = rows[own], rows[source]
    own, source = np.unique(np.stack([np.maximum(own, source), np.minimum(own, source)]), axis=1)
    return own, source


def _compare_parts(shapes: np.ndarray, part: np.ndarray, alone: np.ndarray, reach: int, n: int, width: int, percent: int, least: int, alike, pair) -> None:
    """Calls pair for patterns that are alike, until all that are have one part. The largest part is not gone through."""
    names, size = np.unique(part, return_counts=True)
    if len(names) == 1:
        return
    largest = part == names[np.argmax(size)]
    mine, to = np.flatnonzero(~largest), np.r_[np.flatnonzero(largest), np.flatnonzero(~largest)]
    run = min(shared_run(n, width, percent), reach)
    core = shapes[:, reach - run + 1 : reach + run]
    tied = _in_blocks(lambda x: (shapes[x, max(0, reach - 2 * run) : reach + 2 * run + 1] == shapes[x, reach, None]).sum(1), np.arange(len(shapes))) > 1
    rank = np.empty(len(to), np.int64)
    rank[to] = np.arange(len(to))
    for x in range(0, len(mine), 256):
        block = mine[x : x + 256]
        numbered = _numbered(shapes[block])
        columns = np.unique(numbered[numbered >= 1 << 16])
        holds = _held(numbered, columns)
        step = max(64, min(BLOCK_PAIRS, BLOCK_PAIRS * 1000 // max(len(columns), 1)))
        until = rank[block[-1]]
        for y in range(0, until, step):
            others = to[y : min(y + step, until)]
            theirs = _held(_numbered(shapes[others]), columns)
            equal = holds @ theirs.T
            for k, p in enumerate(block.tolist()):
                q = np.flatnonzero((equal[k] >= least) & (part[others] != part[p]) & (rank[others] < rank[p]) & ((alone[others] != alone[p]) | (alone[p] < 0)))
                # a run around the minimum; where it occurs again, other places of it may be chosen
                same = core[others[q]] == core[p]
                there = np.logical_and.accumulate(same[:, run - 1 :: -1], axis=1).sum(1) + np.logical_and.accumulate(same[:, run:], axis=1).sum(1) >= run
                q = q[there | (tied[others[q]] & tied[p])]
                if not len(q):
                    continue
                same = (shapes[others[q]] == shapes[p]) & (shapes[p] != 0)
                exact = sum(np.logical_and.accumulate(z, axis=1).sum(1) for z in (same[:, reach::-1], same[:, reach:])) > width
                for other in others[q[exact]].tolist():
                    if part[other] != part[p]:
                        pair(p, other)
                        part[part == part[p]] = part[other]
                q = q[~exact]
                q = q[part[others[q]] != part[p]]
                if not len(q):
                    continue
                code = np.minimum(np.searchsorted(columns, shapes[p].astype(np.uint64) << np.uint64(16)), len(columns) - 1)
                q = q[_best_score((theirs[q][:, code] > 0) & (shapes[p] != 0), reach, width, percent) >= 0]
                if not len(q):
                    continue
                kinds = np.sort(shapes[p])
                at = np.minimum(np.searchsorted(kinds, shapes[others[q]]), len(kinds) - 1)
                q = q[_best_score((kinds[at] == shapes[others[q]]) & (shapes[others[q]] != 0), reach, width, percent) >= 0]
                for other in others[q[np.argsort(-equal[k][q], kind="stable")]].tolist():  # likely ones first
                    if part[other] != part[p] and alike(max(p, other), min(p, other)):
                        pair(p, other)
                        part[part == part[p]] = part[other]


def _held(numbered: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Which of the numbered shingles in columns each row has."""
    out = np.zeros((len(numbered), len(columns)), np.float32)
    at = np.minimum(np.searchsorted(columns, numbered), len(columns) - 1)
    row, place = np.nonzero(columns[at] == numbered)
    out[row, at[row, place]] = 1
    return out


def _gathered(near: np.ndarray, order: np.ndarray) -> np.ndarray:
    """near[order]; of many rows in a file, which has no name."""
    out = _room((len(order), near.shape[1]), near.dtype)
    for x in range(0, len(order), BLOCK_PAIRS):
        out[x : x + BLOCK_PAIRS] = near[order[x : x + BLOCK_PAIRS]]
    return out


def _in_blocks(number, rows: np.ndarray) -> np.ndarray:
    """A number for each of the rows, of BLOCK_PAIRS of them at once."""
    return np.concatenate([np.zeros(0, np.int64), *[number(rows[x : x + BLOCK_PAIRS]) for x in range(0, len(rows), BLOCK_PAIRS)]])


def frequent_join(windows: DataFrame, ranges: int, n: int, width: int, percent: int, reach: int) -> DataFrame:
    """Pairs of windows of min-hashes with more than FEW, by the shingles around them.

    A task's windows stand in a file; memory holds their ids, and the shingles of BLOCK_PAIRS of them at once.
    """
    least = min(least_equal(n, width, percent, k) for k in range(2 if percent < 100 else 1))
    kind = _around(reach)

    def join(batches):
        with tempfile.TemporaryFile() as file:
            for batch in batches:
                for blob in batch.column("blob"):
                    file.write(blob.as_buffer())
            file.flush()
            if not file.tell():
                return
            held = np.memmap(file, kind, "r")
        ids = np.empty(len(held), [(c, kind[c]) for c in ("key", "doc", "tag", "at")])
        for c in ids.dtype.names:
            ids[c] = held[c]
        order = np.lexsort((ids["at"], ids["tag"], ids["doc"], ids["key"]))
        ids = ids[order]
        new = np.r_[True, np.logical_or.reduce([ids[c][1:] != ids[c][:-1] for c in ids.dtype.names])]
        ids, order = ids[new], order[new]
        found, count = [], 0
        for begin, m in zip(*(x.tolist() for x in _sizes(ids)), strict=True):
            mine = ids[begin : begin + m]
            near = _gathered(held["near"], order[begin : begin + m])
            own, source, hot = _by_rare(near, least)
            pairs = [np.stack([own, source])]
            if len(hot):
                text = np.cumsum(np.r_[0, (mine["doc"][1:] != mine["doc"][:-1]) | (mine["tag"][1:] != mine["tag"][:-1])])
                pairs.append(np.stack(_by_pattern(near, hot, text, n, width, percent, least)))
            own, source = np.unique(np.concatenate(pairs, 1), axis=1) + begin
            use = _other_text(ids, own, source)
            found.append(np.stack([own[use], source[use]]))
            count += int(use.sum())
            if count >= BLOCK_WINDOWS:
                yield from _pairs_table(ids, *np.concatenate(found, 1)).to_batches()
                found, count = [], 0
        if count:
            yield from _pairs_table(ids, *np.concatenate(found, 1)).to_batches()

    return windows.repartition(ranges, "part").mapInArrow(lean(join), _JOINED)


def matching_passages(same: np.ndarray, n: int, width: int, percent: int) -> list[tuple[int, int, int]]:
    """(from word, to word, equal shingles) of passages of aligned words: width shingles at least, similar enough.

    same: which words are equal. Runs of equal shingles are joined while the whole stays similar enough.
    """
    if len(same) < n:
        return []
    bad = np.concatenate([[0], np.cumsum(~same)])
    equal = bad[n:] == bad[:-n]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    return [(a, b, e) for a, b, _, _, e in joined_runs([(a, b, a) for a, b in edges.reshape(-1, 2).tolist()], n, width, percent)]


def joined_runs(runs: list[tuple[int, int, int]], n: int, width: int, percent: int) -> list[tuple[int, int, int, int, int]]:
    """(from word, to word, from and to in the source, equal shingles) of passages.

    runs: (from, to, from in the source) of equal shingles. Runs that follow each other in both texts are joined while
    the whole stays similar enough.
    """
    done, open_ = [], []
    for a, b, c in sorted(runs):
        best, still = None, []
        for p in open_:  # [from, to, source from, source to, equal]
            # the best that any later run can do: what is missing up to a must be made up by equal shingles
            if a - p[1] > p[4] + b - a + width:
                done.append(p)
                continue
            still.append(p)
            over = max(0, p[1] - a, p[3] - c)
            more = b - a - over
            if more > 0 and (100 + percent) * (p[4] + more) >= percent * (b - p[0] + c + b - a - p[2]) and (best is None or p[4] > best[0][4]):
                best = p, more
        open_ = still
        if best:
            p, more = best
            p[1], p[3], p[4] = b, c + b - a, p[4] + more
        else:
            open_.append([a, b, c, c + b - a, b - a])
    return sorted((a, b + n - 1, c, d + n - 1, e) for a, b, c, d, e in done + open_ if b - a >= width and d - c >= width)


def _equal_ahead(x: np.ndarray, y: np.ndarray) -> int:
    """How many of the first places of x and y are equal."""
    m, at, size = min(len(x), len(y)), 0, 64
    while at < m:
        bad = x[at : min(at + size, m)] != y[at : min(at + size, m)]
        first = int(bad.argmax())
        if bad[first]:
            return at + first
        at, size = at + size, size * 2
    return m


def _next_equal(x: np.ndarray, y: np.ndarray, most: int) -> tuple[int, int] | None:
    """The nearest places in x and y, below most, with equal values."""
    size = min(16, most)
    while True:
        p, q = x[:size], y[:size]
        if size <= 64:  # each with each costs less than to sort them
            i, j = (p[:, None] == q).nonzero()
        else:
            order = np.argsort(q, kind="stable")
            at = np.searchsorted(q[order], p)
            i = np.flatnonzero(at < len(q))
            i = i[q[order[at[i]]] == p[i]]
            j = order[at[i]]
        if len(i):
            k = int((i + j).argmin())
            return int(i[k]), int(j[k])
        if size >= most:
            return None
        size = min(size * 2, most)


def _followed(x: np.ndarray, y: np.ndarray, equal: int, width: int, percent: int) -> list[tuple[int, int, int]]:
    """(from, to, from in y) of the run at the beginning of x and y and of those that follow it within reach.

    A gap that the shingles so far and a run of width cannot make up for ends it: beyond are minima of its own.
    """
    i = j = 0
    out = []
    while True:
        m = _equal_ahead(x[i:], y[j:])
        if m:
            out.append((i, i + m, j))
        i, j, equal = i + m, j + m, equal + m
        step = _next_equal(x[i:], y[j:], (equal + width) * (100 - percent) // percent + 1) if i < len(x) and j < len(y) else None
        if step is None:
            return out
        i, j = i + step[0], j + step[1]


def aligned_runs(x: np.ndarray, y: np.ndarray, seeds: list[tuple[int, int]], width: int, percent: int) -> list[tuple[int, int, int]]:
    """(from, to, from in y) of runs of equal shingles around seeds, which are places in x and y."""
    runs: set[tuple[int, int, int]] = set()
    by_shift: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, j in sorted(seeds):
        if not (0 <= i < len(x) and 0 <= j < len(y)) or x[i] != y[j]:
            continue
        near = by_shift[i - j]
        at = bisect_right(near, (i, len(x)))
        if at and near[at - 1][1] > i:
            continue
        back = _equal_ahead(x[i::-1], y[j::-1]) - 1
        a, c = i - back, j - back
        found = [(a + p, a + q, c + r) for p, q, r in _followed(x[a:], y[c:], 0, width, percent)]
        if a and c:
            most = found[0][1] - a
            found += [(a - q, a - p, c - r - (q - p)) for p, q, r in _followed(x[a - 1 :: -1], y[c - 1 :: -1], most, width, percent)]
        for p, q, r in set(found) - runs:
            insort(by_shift[p - r], (p, q))
        runs.update(found)
    return sorted(runs)


def duplicate_passages(docs: DataFrame, *, n: int = 5, least: int = 50, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag (xxhash64 of the text), start, end (words), source_id, source_tag, source_start, equal (shingles)."""
    if least < n:
        raise ValueError("a passage holds a shingle at least")
    spark, width = docs.sparkSession, least - n + 1
    run = shared_run(n, width, percent)
    texts = keyed_texts(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES))
    joined = kept(interval_join(windows_of(texts, n, run, ranges), ranges, run))
    many = joined.where("source_at is null").groupBy("doc_id", "tag").agg(F.collect_set(F.struct("key", "at")).alias("places"))
    # a passage holds a similar one of less than 5/2 width, with a run to which the minimum belongs or is near
    around = surrounded(texts.join(many, ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"]), n, 5 * width // 2 + run, ranges)
    joined = joined.where("source_at is not null").union(frequent_join(around, ranges, n, width, percent, 5 * width // 2 + run))
    pair = ["doc_id", "tag", "source_id", "source_tag"]
    # runs too short for a window of their own stand beside the others, no farther than twice as long as these
    edge = lambda c: F.greatest(F.min(c) - 2 * (F.max(c) - F.min(c)) - 4 * width, F.lit(0))
    end = lambda c: F.max(c) + 2 * (F.max(c) - F.min(c)) + 4 * width + n
    agreed = joined.groupBy(*pair).agg(
        edge("at").alias("low"), end("at").alias("high"), edge("source_at").alias("source_low"), end("source_at").alias("source_high"),
        F.collect_set(F.struct("at", (F.col("at") - F.col("source_at")).alias("shift"))).alias("seeds"),
    )
    candidates = kept(agreed)
    side = lambda d, t, low, high: candidates.select(F.col(d).alias("doc_id"), F.col(t).alias("tag"), F.col(low).alias("low"), F.col(high).alias("high"))
    wanted = side("doc_id", "tag", "low", "high").union(side("source_id", "source_tag", "source_low", "source_high")).groupBy("doc_id", "tag").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    parts = kept(_parts(texts.join(wanted, ["doc_id", "tag"])).dropDuplicates(["doc_id", "tag"]))
    cut = lambda low, high: F.substr("words", ((F.col(low) - F.col("first")) * 4 + 1).cast("int"), ((F.col(high) - F.col(low)) * 4).cast("int"))
    own = candidates.join(parts, ["doc_id", "tag"]).select(*candidates.columns, cut("low", "high").alias("own"))
    both = own.join(parts.select(F.col("doc_id").alias("source_id"), F.col("tag").alias("source_tag"), "first", "words"), ["source_id", "source_tag"])
    both = both.select(*candidates.columns, "own", cut("source_low", "source_high").alias("other"))
    return _without_implied(kept(_verified(both, n, width, percent))).withColumns({c: F.nullif(F.col(c), F.lit(-(1 << 63))) for c in ("doc_id", "source_id")})


def _without_implied(found: DataFrame) -> DataFrame:
    """found without rows whose passage and whose source's passage are both rows of the passage's earliest source."""
    place = ["source_id", "source_tag", "source_start"]
    first = F.min(F.struct(*place)).over(Window.partitionBy("doc_id", "tag", "start", "end"))
    linked = found.select(*[F.col(c).alias(f"source_{name}") for c, name in (("doc_id", "id"), ("tag", "tag"), ("start", "start"), ("end", "end"))], F.struct(*place).alias("first")).distinct()
    return found.withColumn("first", first).join(linked, [*place, "source_end", "first"], "left_anti").select([c for c in found.columns if c != "source_end"])


def _parts(rows: DataFrame) -> DataFrame:
    """(doc_id, tag, first, words): 32-bit hashes of the words from low to high."""

    def run(batches):
        for batch in batches:
            low, high = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("low", "high"))
            for first, count, hashes, offsets, _, _ in words_of(batch.column("text")):
                small = (hashes >> np.uint64(32)).astype("<u4")
                blobs = [small[a + max(0, x) : min(a + y, b)].tobytes() for a, b, x, y in zip(offsets[:-1], offsets[1:], low[first : first + count], high[first : first + count], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, count), batch.column("tag").slice(first, count), pa.array(np.maximum(low[first : first + count], 0)), pa.array(blobs, pa.binary())], ["doc_id", "tag", "first", "words"])

    return rows.select("doc_id", "tag", "text", "low", "high").mapInArrow(lean(run), "doc_id long, tag long, first long, words binary")


def _words_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all rows, and their len + 1 offsets."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
    return np.frombuffer(column.buffers()[2] or b"", "<u4"), offsets


def _shingles_by_row(words: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    tokens, rows = shingles_of(words[offsets[0] : offsets[-1]].astype(np.uint64), offsets - offsets[0], n, whole=False)
    return np.split(tokens, np.searchsorted(rows, np.arange(1, len(offsets) - 1)))


def _verified(rows: DataFrame, n: int, width: int, percent: int) -> DataFrame:
    names = ["doc_id", "tag", "start", "end", "source_id", "source_tag", "source_start", "source_end", "equal"]

    def run(batches):
        for batch in batches:
            cuts = np.r_[0, np.cumsum(batch.column("seeds").value_lengths().to_numpy(zero_copy_only=False))]
            ats, shifts = (batch.column("seeds").flatten().field(c).to_numpy(zero_copy_only=False) for c in ("at", "shift"))
            own, other = (_words_in(batch.column(c)) for c in ("own", "other"))
            size = own[1] + other[1]
            first = 0
            while first < len(batch):
                last = max(first + 1, int(np.searchsorted(size, size[first] + BLOCK // 4, "right")) - 1)
                out: list[tuple] = []
                columns = [batch.column(c).slice(first, last - first).to_pylist() for c in ("doc_id", "tag", "source_id", "source_tag", "low", "source_low")]
                pieces = [_shingles_by_row(words, offsets[first : last + 1], n) for words, offsets in (own, other)]
                for r, (doc, tag, source, source_tag, low, source_low, x, y) in enumerate(zip(*columns, *pieces, strict=True), first):
                    at = ats[cuts[r] : cuts[r + 1]]
                    seeds = zip((at - low).tolist(), (at - shifts[cuts[r] : cuts[r + 1]] - source_low).tolist(), strict=True)
                    for start, end, source_start, source_end, equal in joined_runs(aligned_runs(x, y, seeds, width, percent), n, width, percent):
                        out.append((doc, tag, low + start, low + end, source, source_tag, source_low + source_start, source_low + source_end, equal))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)
                first = last

    return rows.mapInArrow(lean(run), ", ".join(f"{c} long" for c in names)).distinct()


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs (all columns, doc_id and text among them) without the words of the passages; a text left without words goes."""
    drop = passages.groupBy(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_doc"), F.col("tag").alias("_tag")).agg(F.collect_set(F.struct("start", "end")).alias("_drop"))
    rows = nested(docs, _doc=F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), _tag=F.xxhash64("text")).join(drop, ["_doc", "_tag"], "left")

    def cut(batches):
        for batch in (b.slice(x, CUT_ROWS) for b in batches for x in range(0, len(b), CUT_ROWS)):
            column = batch.column("text")
            data, _ = text_buffers(column)
            texts = column.to_pylist()
            drops = batch.column("_drop").to_pylist()
            for first, _, _, offsets, starts, ends in words_of(column):
                for r in range(len(offsets) - 1):
                    if not drops[first + r]:
                        continue
                    gone = np.zeros(int(offsets[r + 1] - offsets[r]) + 1, np.int64)
                    for d in drops[first + r]:
                        gone[d["start"]] += 1
                        gone[min(d["end"], len(gone) - 1)] -= 1
                    lost = np.cumsum(gone)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], (~lost).view(np.int8), [0]]))).reshape(-1, 2)
                    s, e = starts[offsets[r] : offsets[r + 1]], ends[offsets[r] : offsets[r + 1]]
                    texts[first + r] = b" ".join(data[s[a] : e[b - 1]].tobytes() for a, b in edge).decode() or None
            out = pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])
            yield out.filter(pa.array([t is not None or not d for t, d in zip(texts, drops, strict=True)]))

    left = rows.select("row", "text", "_drop").mapInArrow(lean(cut), T.StructType([rows.schema["row"], rows.schema["text"]]))
    return flat(left, docs.columns)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = duplicate_passages(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", "source_id", "source_start", "equal")

"""All-pairs similarity of compact signatures: candidate joins, saturating scores, top centres, neighbour lists.

Rows with one and the same signature are one class; pairs are found between classes and weighted by their sizes, so
identical signatures never multiply. Candidates meet on equal keys that every pair within the distance shares, or, of
signatures few enough that this is cheaper, in blocks. Scores need only how many neighbours each signature has at each
distance: blocks send these counts, never the pairs. Lists are made for the top centres alone, block by block.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .ranking import with_global_rank

BANDS, SATURATED = 4, 255
#: Values of a block; nanoseconds, about, of comparing two, of joining two, and of a row to join on.
BLOCK, COMPARE_NS, MEET_NS, ROW_NS = 32768, 1.5, 150.0, 1000.0
#: Blocks of a small table, for tasks; the least values of such a block; how many times fewer centres a block has.
SPREAD, SMALL, CENTRES = 12, 512, 16
#: Values compared side by side, pairs compared at once, found pairs held.
WIDE, TILE, HELD = 4096, {"hamming": 1 << 18, "histogram": 1 << 16}, 1 << 20
HAMMING_FACTORS = [80 - 5 * d for d in range(16)]
HISTOGRAM_FACTORS = [40 - d for d in range(32)]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def difference(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two arrays of bins."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda s, e: s + e)


def histogram_percent(a: Column, b: Column) -> Column:
    """Difference in percent: gray 100 sad div 4096; three channels are averaged first, whole numbers at each step."""
    sad = difference(a, b)
    return F.floor(100 * F.when(F.size(a) == 48, F.floor(sad / 3)).otherwise(sad) / 4096).cast("int")


def _classes(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def _mask_words(radius: int) -> list[int]:
    """All 16-bit words with at most radius bits."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(16), r)]


def _masks(radius: int) -> Column:
    return F.array(*[F.lit(m).cast("long") for m in _mask_words(radius)])


def close_hashes(classes: DataFrame, max_dist: int) -> DataFrame:
    """(h1, h2, distance), h1 < h2: distinct 64-bit values at most max_dist bits apart.

    Two such values differ in at most max_dist // 4 bits in one of four 16-bit bands. Both sides list the words
    around their bands, near enough that such bands meet, and join on them. What that costs follows from how often
    each band has each word, 4 x 65 536 counts; where comparing all values in blocks is cheaper they are compared in
    blocks. Both ways are exact. Values without structure meet at 12 bits in about 4 of 100 pairs, at 6 in 1 of 1000.
    """
    if not 0 <= max_dist <= 15:
        raise ValueError("a distance is 0 to 15 bits")
    return _close_in_blocks(classes, "hamming", max_dist) if _blocks_cost_less(classes, max_dist) else _close_by_bands(classes, max_dist)


def _blocks_cost_less(classes: DataFrame, max_dist: int) -> bool:
    words = classes.select(F.explode(F.array(*[_band(F.col("h"), b) + F.lit(b << 16) for b in range(BANDS)])).alias("word")).groupBy("word").count().toArrow()
    counts = np.zeros((BANDS, 1 << 16))
    counts.ravel()[words.column("word").to_numpy()] = words.column("count").to_numpy()
    n = int(counts[0].sum())
    return n * n / 2 * COMPARE_NS < band_cost(counts, max_dist)


def _band(h: Column, b: int) -> Column:
    return F.shiftrightunsigned(h, b * 16).bitwiseAND(F.lit(65535).cast("long"))


def band_cost(counts: np.ndarray, max_dist: int) -> float:
    """Nanoseconds, about, to join values by their bands, from how many have each word in each band."""
    radius = max_dist // BANDS
    places, listed, near = np.arange(1 << 16), 0, []
    for reach in (radius // 2, radius - radius // 2):
        masks = _mask_words(reach)
        listed += len(masks)
        near.append(sum(counts[:, places ^ m] for m in masks))
    return ROW_NS * listed * counts.sum() + MEET_NS * float((near[0] * near[1]).sum())


def _packed(rows: DataFrame, kind: str, value: str, size: int) -> DataFrame:
    """(bins, b, lo, hi, hs, vs): blocks of about size rows, their signatures and values as bytes.

    Histograms of one length lie in order of their sums, from lo to hi in a block.
    """
    n = rows.count()
    blocks = max(1, math.ceil(n / size), min(SPREAD, math.ceil(n / SMALL)))
    rows = rows.select("h", F.col(value).cast("long").alias("v"))
    if kind == "hamming":
        dealt = rows.select(F.lit(0).alias("bins"), F.pmod(F.xxhash64("h", "v"), F.lit(blocks)).cast("int").alias("b"), F.lit(0).cast("long").alias("total"), "h", "v")
    else:
        total = F.aggregate("h", F.lit(0).cast("long"), lambda t, x: t + x)
        ordered = rows.select(F.size("h").alias("bins"), total.alias("total"), "h", "v").repartitionByRange(blocks, "bins", "total", F.xxhash64("h", "v"))
        dealt = kept(ordered.withColumn("b", F.spark_partition_id()))

    def pack(key, table):
        hs = table.column("h").combine_chunks()
        data = hs.to_numpy(zero_copy_only=False).astype("<i8") if kind == "hamming" else hs.flatten().to_numpy(zero_copy_only=False).astype("<i4")
        totals, vs = (table.column(c).to_numpy() for c in ("total", "v"))
        row = [*(k.as_py() for k in key), int(totals.min()), int(totals.max()), data.tobytes(), vs.astype("<i8").tobytes()]
        return pa.table({c: [x] for c, x in zip(("bins", "b", "lo", "hi", "hs", "vs"), row, strict=True)}, schema=pa.schema([("bins", pa.int32()), ("b", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("hs", pa.binary()), ("vs", pa.binary())]))

    return kept(dealt.groupBy("bins", "b").applyInArrow(pack, "bins int, b int, lo long, hi long, hs binary, vs binary"))


def _most(bins: int, limit: int) -> int:
    """The largest sum of absolute differences of histograms that differ by less than limit percent."""
    most = -(-limit * 4096 // 100) - 1
    return 3 * most + 2 if bins == 48 else most


def _units(left: DataFrame, right: DataFrame, kind: str, limit: int, *, once: bool) -> DataFrame:
    """(bins, b1, b2, hs1, vs1, hs2, vs2): the blocks that may hold close rows; once: of one table, each two blocks once."""
    reach = F.when(F.col("bins") == 48, _most(48, limit)).otherwise(_most(0, limit)) if kind == "histogram" else F.lit(0)
    a = left.select("bins", F.col("b").alias("b1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    b = right.select("bins", F.col("b").alias("b2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))  # a row for each block
    met = a.join(F.broadcast(b), "bins").where((F.col("lo2") - F.col("hi1") <= reach) & (F.col("lo1") - F.col("hi2") <= reach))
    met = kept((met.where("b1 <= b2") if once else met).select("bins", "b1", "b2"))
    n = met.count()
    for side, table in (("1", left), ("2", right)):
        met = met.join(table.select("bins", *[F.col(c).alias(c + side) for c in ("b", "hs", "vs")]).hint("merge"), ["bins", "b" + side])
    return met.repartition(max(1, min(2000, n)), "bins", "b1", "b2")


def _close(x: np.ndarray, y: np.ndarray, kind: str, limit: int):
    """(places in x, places in y, distances) of close ones, about HELD of them at a time. Histograms: bins x rows."""
    found, held = [], 0
    bins = len(x)
    if kind == "histogram":
        low, high = int(min(x.min(initial=0), y.min(initial=0))), int(max(x.max(initial=0), y.max(initial=0)))
        number = np.int16 if (high - low) * max(bins, 1) < 32768 else np.int64
        x, y, most = x.astype(number), y.astype(number), _most(bins, limit)
    width = min(WIDE, max(1, y.shape[-1]))
    tall = max(1, TILE[kind] // width)
    for to in range(0, y.shape[-1], width):
        for at in range(0, x.shape[-1], tall):
            if kind == "hamming":
                d = np.bitwise_count((x[at : at + tall, None] ^ y[to : to + width]).view(np.uint64)).ravel()  # of signed numbers it would count the absolute value
                hit = np.flatnonzero(d <= limit)
                d = d[hit].astype(np.int64)
            else:
                s = np.zeros((min(tall, x.shape[1] - at), min(width, y.shape[1] - to)), number)
                for p, q in zip(x[:, at : at + tall], y[:, to : to + width], strict=True):
                    gap = p[:, None] - q
                    s += np.abs(gap, out=gap)
                hit = np.flatnonzero(s.ravel() <= most)
                d = s.ravel()[hit].astype(np.int64)
                d = 100 * (d // 3 if bins == 48 else d) // 4096
            if len(hit):
                i, j = np.divmod(hit, min(width, y.shape[-1] - to))
                found.append((at + i, to + j, d))
                held += len(hit)
                if held >= HELD:
                    yield tuple(np.concatenate(z) for z in zip(*found, strict=True))
                    found, held = [], 0
    if found:
        yield tuple(np.concatenate(z) for z in zip(*found, strict=True))


def _compared(units: DataFrame, kind: str, limit: int, give, schema: str) -> DataFrame:
    """give(x, vx, y, vy, same block, found pairs) yields Arrow batches for each two blocks."""

    def read(hs, vs, bins):
        values = np.frombuffer(vs.as_buffer(), "<i8")
        data = np.frombuffer(hs.as_buffer(), "<i8" if kind == "hamming" else "<i4")
        return (data if kind == "hamming" else np.ascontiguousarray(data.reshape(len(values), bins).T)), values

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                bins, b1, b2 = (batch.column(c)[r].as_py() for c in ("bins", "b1", "b2"))
                (x, vx), (y, vy) = (read(batch.column("hs" + c)[r], batch.column("vs" + c)[r], bins) for c in "12")
                yield from give(x, vx, y, vy, b1 == b2, _close(x, y, kind, limit))

    return units.mapInArrow(run, schema)


def _arrow(h: np.ndarray) -> pa.Array:
    """64-bit values, or histograms as bins x rows."""
    if h.ndim == 1:
        return pa.array(h)
    return pa.ListArray.from_arrays(pa.array(np.arange(h.shape[1] + 1) * len(h), pa.int32()), pa.array(h.T.ravel(), pa.int32()))


def _type(kind: str) -> str:
    return "long" if kind == "hamming" else "array<int>"


def _close_in_blocks(classes: DataFrame, kind: str, limit: int) -> DataFrame:
    """Blocks of values against blocks, each two blocks once: n * n / 2 comparisons at most, few rows out."""

    def give(x, vx, y, vy, same, found):
        for i, j, d in found:
            if same:
                once = i < j
                i, j, d = i[once], j[once], d[once]
            a, b = x[..., i], y[..., j]
            turn = _after(a, b)
            a, b = np.where(turn, b, a), np.where(turn, a, b)
            yield pa.RecordBatch.from_arrays([_arrow(a), _arrow(b), pa.array(d.astype(np.int32))], ["h1", "h2", "distance"])

    blocks = _packed(classes.select("h", F.lit(1).alias("n")), kind, "n", _size(kind))
    return _compared(_units(blocks, blocks, kind, limit, once=True), kind, limit, give, f"h1 {_type(kind)}, h2 {_type(kind)}, distance int")


def _after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a are greater than their b; of histograms at the first bin that differs."""
    if a.ndim == 1:
        return a > b
    if not len(a):
        return np.zeros(a.shape[1], bool)
    at = np.argmax(a != b, axis=0)
    return a[at, np.arange(a.shape[1])] > b[at, np.arange(a.shape[1])]


def _size(kind: str) -> int:
    return BLOCK if kind == "hamming" else max(1, BLOCK // 4)


def _counts_in_blocks(classes: DataFrame, kind: str, limit: int) -> DataFrame:
    """(h, distance, count) as neighbour_counts: blocks of classes against blocks, of which counts alone go on."""
    width = limit + 1

    def give(x, vx, y, vy, same, found):
        counts = [np.zeros((x.shape[-1], width), np.int64), np.zeros((y.shape[-1], width), np.int64)]
        for i, j, d in found:
            for side, own, worth in ((0, i, vy[j] - (i == j if same else 0)), (1, j, vx[i])):  # a row is not its own neighbour
                if side and same:
                    continue
                at = own * width + d
                order = np.argsort(at, kind="stable")
                at = at[order]
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                counts[side].ravel()[at[first]] += np.add.reduceat(worth[order], first)
        for h, got in zip((x, y), counts, strict=True):
            use = np.flatnonzero(got.any(1))
            for a in range(0, len(use), 8192):
                at = use[a : a + 8192]
                yield pa.RecordBatch.from_arrays([_arrow(h[..., at]), *[pa.array(got[at, c]) for c in range(width)]], ["h", *[f"c{c}" for c in range(width)]])

    names = [f"c{c}" for c in range(width)]
    blocks = _packed(classes, kind, "n", _size(kind))
    found = _compared(_units(blocks, blocks, kind, limit, once=True), kind, limit, give, ", ".join([f"h {_type(kind)}", *[f"{c} long" for c in names]]))
    summed = found.groupBy("h").agg(*[F.sum(c).alias(c) for c in names])
    each = F.array(*[F.struct(F.lit(c).alias("distance"), F.col(name).alias("count")) for c, name in enumerate(names)])
    return summed.select("h", F.explode(each).alias("c")).select("h", "c.distance", "c.count").where("count > 0")


def _close_by_bands(classes: DataFrame, max_dist: int) -> DataFrame:
    radius = max_dist // BANDS
    left, right = radius // 2, radius - radius // 2

    def side(name: str, reach: int) -> DataFrame:
        rows = classes.select(F.col("h").alias(name), F.explode(F.array(*[F.lit(b) for b in range(BANDS)])).alias("band"))
        word = F.expr(f"shiftrightunsigned({name}, band * 16)").bitwiseAND(F.lit(65535).cast("long"))
        return rows.select(name, "band", F.explode(F.transform(_masks(reach), lambda m: word.bitwiseXOR(m))).alias("word"))

    pairs = side("h1", left).join(side("h2", right), ["band", "word"]).where("h1 < h2").select("h1", "h2", hamming(F.col("h1"), F.col("h2")).alias("distance"))
    return pairs.where(F.col("distance") <= max_dist).distinct()


def close_histograms(classes: DataFrame, max_percent: int) -> DataFrame:
    """(h1, h2, distance), h1 < h2: distinct histograms of one length that differ by less than max_percent.

    They meet in blocks in order of their sums, which differ by no more than the bins do.
    """
    return _close_in_blocks(_whole(classes), "histogram", _percent(max_percent))


def _percent(most: int) -> int:
    if not 0 < most <= 32:
        raise ValueError("a difference is 1 to 32 percent")
    return most


def _whole(rows: DataFrame) -> DataFrame:
    """Histograms without null bins: others are near none."""
    return rows.where(~F.exists("h", lambda x: x.isNull()))


def close_classes(rows: DataFrame, kind: str, limit: int) -> DataFrame:
    """(h, other, distance) in both directions, each signature with itself at 0 included. kind: hamming or histogram."""
    classes = _classes(rows, "h") if kind == "hamming" else _whole(_classes(rows, "h"))
    pairs = close_hashes(classes, limit) if kind == "hamming" else close_histograms(classes, limit)
    both = F.array(F.struct(F.col("h1").alias("h"), F.col("h2").alias("other")), F.struct(F.col("h2").alias("h"), F.col("h1").alias("other")))
    directed = pairs.select(F.explode(both).alias("p"), F.col("distance").cast("int").alias("distance")).select("p.h", "p.other", "distance")
    return directed.unionByName(classes.select("h", F.col("h").alias("other"), F.lit(0).alias("distance")))


def neighbour_counts(rows: DataFrame, near: DataFrame) -> DataFrame:
    """(h, distance, count): how many other rows a row with signature h has at each distance."""
    sizes = _classes(rows, "h")
    counted = near.join(sizes.withColumnRenamed("h", "other"), "other").groupBy("h", "distance").agg(F.sum("n").alias("count"))
    return counted.withColumn("count", F.col("count") - (F.col("distance") == 0).cast("long")).where("count > 0")


def counted_neighbours(rows: DataFrame, kind: str, limit: int) -> DataFrame:
    """(h, distance, count) over rows with h, in the way that costs less; both are exact."""
    classes = kept(_classes(rows, "h") if kind == "hamming" else _whole(_classes(rows, "h")))
    if kind == "histogram":
        return _counts_in_blocks(classes, kind, _percent(limit))
    if not 0 <= limit <= 15:
        raise ValueError("a distance is 0 to 15 bits")
    return _counts_in_blocks(classes, kind, limit) if _blocks_cost_less(classes, limit) else neighbour_counts(rows, close_classes(rows, kind, limit))


def scores(counts: DataFrame, factors: list[int]) -> DataFrame:
    """(h, score, total, counts): counts saturate at 255 in the score, at each distance, and not elsewhere."""
    worth = F.element_at(F.array(*[F.lit(f) for f in factors]), F.col("distance") + 1)
    return counts.groupBy("h").agg(
        F.sum(F.least("count", F.lit(SATURATED)) * worth).alias("score"), F.sum("count").alias("total"),
        F.array_sort(F.collect_list(F.struct("distance", "count"))).alias("counts"),  # one entry for each distance
    )


def top_centres(rows: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """The k rows of highest positive score, ties to the smaller id: id, h, score, total, counts."""
    scored = kept(scored.where("score > 0"))
    best = rows.select("id", "h").join(scored.select("h", "score"), "h").orderBy(F.desc("score"), "id").limit(k)
    return best.join(scored.drop("score"), "h").orderBy(F.desc("score"), "id")


def neighbour_lists(centres: DataFrame, rows: DataFrame, kind: str, limit: int) -> DataFrame:
    """centres with pairs: their neighbours as (contentid, distance), ids rising. Lists exist for centres only."""

    def give(x, vx, y, vy, same, found):
        for i, j, d in found:
            use = vx[i] != vy[j]
            i, j, d = i[use], j[use], d[use]
            order = np.argsort(i, kind="stable")
            i, j, d = i[order], j[order], d[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(vy[j]), pa.array(d.astype(np.int32))], ["contentid", "distance"])
            yield pa.RecordBatch.from_arrays([pa.array(vx[i[first]]), pa.ListArray.from_arrays(pa.array(np.r_[first, len(i)], pa.int32()), pairs)], ["id", "part"])

    if kind == "histogram":
        rows = _whole(rows)
    left, right = _packed(centres.where("id is not null"), kind, "id", max(1, _size(kind) // CENTRES)), _packed(rows.where("id is not null"), kind, "id", _size(kind))
    parts = _compared(_units(left, right, kind, limit, once=False), kind, limit, give, "id long, part array<struct<contentid: long, distance: int>>")
    lists = parts.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("part"))).alias("pairs"))
    empty = F.array().cast("array<struct<contentid: long, distance: int>>")
    return centres.join(lists, "id", "left").select("id", "score", "total", "counts", F.coalesce("pairs", empty).alias("pairs"))


def compare(rows: DataFrame, kind: str, limit: int, factors: list[int], k: int = 10_000, listed: int | None = None) -> DataFrame:
    """id, score, total, counts, pairs of the top k centres over rows (id, h).

    listed: the limit of the listed neighbours, where only nearer ones are wanted than the scores count.
    """
    rows = rows.where("h is not null")
    centres = kept(top_centres(rows, scores(counted_neighbours(rows, kind, limit), factors), k))
    return neighbour_lists(centres, rows, kind, limit if listed is None else listed)


def similar_pairs(rows: DataFrame, kind: str, limit: int) -> DataFrame:
    """(id1, id2, distance), id1 < id2: every pair of rows within the limit."""
    rows = rows.where("h is not null")
    if kind == "histogram":
        return _row_pairs(rows, limit)
    near = close_classes(rows, kind, limit)
    a, b = rows.select(F.col("id").alias("id1"), "h"), rows.select(F.col("id").alias("id2"), F.col("h").alias("other"))
    return a.join(near, "h").join(b, "other").where("id1 < id2").select("id1", "id2", "distance")


def _row_pairs(rows: DataFrame, limit: int) -> DataFrame:
    """Pairs of rows with histograms: their ids go on, not the bins; equal rows are pairs of the result anyway."""

    def give(x, vx, y, vy, same, found):
        for i, j, d in found:
            a, b = vx[i], vy[j]
            use = a < b if same else a != b  # of one block both directions are found
            a, b = a[use], b[use]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d[use].astype(np.int32))], ["id1", "id2", "distance"])

    blocks = _packed(_whole(rows.where("id is not null")), "histogram", "id", _size("histogram"))
    return _compared(_units(blocks, blocks, "histogram", _percent(limit), once=True), "histogram", limit, give, "id1 long, id2 long, distance int")


def with_paths(compared: DataFrame, paths: DataFrame, divisor: float, least: float, *, all_paths: bool = False) -> DataFrame:
    """Pairs of a comparison as first paths with their similarity, or buckets of all paths. paths: contentid, dir, name.

    Pairs carry their centre's place among all centres, by falling score and then id, and the number of centres.
    """
    at = paths.select("contentid", F.struct("dir", "name").alias("at"))
    text = lambda x: F.concat_ws("/", x["dir"], x["name"])
    known = at.groupBy("contentid").agg(F.transform(F.array_sort(F.collect_list("at")), text).alias("p")) if all_paths else at.groupBy("contentid").agg(text(F.min("at")).alias("p"))
    compared = kept(compared)  # read three times
    near = compared.select("id", "score", F.explode("pairs").alias("o")).select("id", "score", "o.contentid", (1 - F.col("o.distance") / F.lit(divisor)).alias("similarity")).where(F.col("similarity") >= least)
    rows = near.join(known.select(F.col("contentid").alias("id"), F.col("p").alias("p1")), "id").join(known.withColumnRenamed("p", "p2"), "contentid")
    if not all_paths:
        ranked = with_global_rank(compared.select("id", "score"), [F.desc("score"), F.asc("id")], "ctxt_index").select("id", "ctxt_index")
        total = compared.agg(F.count("*").alias("ctxt_size"))
        named = rows.join(ranked, "id").join(F.broadcast(total), F.lit(True))
        return named.select(F.col("id").alias("content_id1"), F.col("contentid").alias("content_id2"), "score", "similarity", F.col("p1").alias("path1"), F.col("p2").alias("path2"), F.col("ctxt_index").cast("long").alias("ctxt_index"), "ctxt_size")
    others = F.array_sort(F.collect_list(F.struct("contentid", "similarity", F.col("p2").alias("paths"))))
    return rows.groupBy("id", "score").agg(F.any_value("p1").alias("center"), others.alias("others"))


def listed_counts(compared: DataFrame) -> DataFrame:
    """(id, numpairs, listed, consistent): the counted and the listed neighbours of each centre, which must agree."""
    return compared.select("id", F.col("total").alias("numpairs"), F.size("pairs").cast("long").alias("listed")).withColumn("consistent", F.col("numpairs") == F.col("listed"))

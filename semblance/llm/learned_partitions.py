"""Approximate nearest neighbours over learned partitions (operator 2).

A neighbour graph of a bounded sample is cut into balanced parts with few edges between them; a small classifier
learns, from a vector, in which parts its neighbours lie. Every row is indexed under its most probable part. A
query goes to its most probable parts, as many as reach ``recall`` on sample vectors that the graph holds back,
and the rows there are ranked by their exact distance in double precision.

Sample: at most ``sample`` distinct vectors by a hash of the id. Parts grow with the table, one for each
``rows_per_part`` rows, up to ``most_parts`` and to one for 20 vectors of the sample; a part's rows, and the queries routed to it, are split by a
hash of the id, and each piece of the ones meets each piece of the others, so no task holds more than about
``rows_per_task`` rows and ``queries_per_task`` queries. Where few parts reach the recall, all may be searched: a table of less than twice
rows_per_part rows has one part. Of rows with one and the same
vector only the ``k + 1`` of least id can be among the k nearest, so only they are indexed: the others could not
be in any result.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite
components take no part, neither does a null id; rows alike in id and vector count once; of an id's different
vectors each is a query or candidate of its own, never its own id's candidate; ties go to the smaller id; fewer
than k candidates are all returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from .common import read_table


def neighbours(points: np.ndarray, queries: np.ndarray, k: int, own: bool) -> np.ndarray:
    """Places of the k nearest points of each query; own: queries are the points, which are not their own neighbours."""
    out = []
    norms = (points**2).sum(1)
    for a in range(0, len(queries), 512):
        d = norms[None] - 2 * queries[a : a + 512] @ points.T
        if own:
            d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
        out.append(np.argpartition(d, min(k, d.shape[1] - 1), 1)[:, :k])
    return np.concatenate(out) if out else np.zeros((0, k), int)


def balanced_cut(near: np.ndarray, points: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 1.1, rounds: int = 12) -> np.ndarray:
    """Part of each node: near-equal parts, refined by moves that lessen the edges cut while room lasts."""
    n, most = len(points), math.ceil(slack * len(points) / parts)
    centres = points[rng.choice(n, parts, replace=False)]
    for _ in range(5):
        d = (centres**2).sum(1)[None] - 2 * points @ centres.T
        where, room = np.empty(n, int), np.full(parts, most)
        for i in np.argsort(d.min(1) - np.partition(d, 1, 1)[:, 1] if parts > 1 else np.zeros(n), kind="stable"):
            j = int(np.argmin(np.where(room > 0, d[i], np.inf)))
            where[i], room[j] = j, room[j] - 1
        centres = np.stack([points[where == j].mean(0) if (where == j).any() else points[rng.integers(n)] for j in range(parts)])
    edges = np.concatenate([np.stack([np.repeat(np.arange(n), near.shape[1]), near.ravel()], 1), np.stack([near.ravel(), np.repeat(np.arange(n), near.shape[1])], 1)])
    for _ in range(rounds):
        ties = np.zeros((n, parts))
        np.add.at(ties, (edges[:, 0], where[edges[:, 1]]), 1)
        gain = ties.max(1) - ties[np.arange(n), where]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            j = int(ties[i].argmax())
            if room[j] > 0:
                room[where[i]] += 1
                room[j] -= 1
                where[i] = j
                moved += 1
        if not moved:
            break
    return where


class Router:
    """One hidden layer from a vector to the probabilities of the parts."""

    def __init__(self, points: np.ndarray, targets: np.ndarray, rng: np.random.Generator, hidden: int = 128, steps: int = 300, rate: float = 0.01):
        self.mean, self.spread = points.mean(0), points.std() + 1e-12
        x = (points - self.mean) / self.spread
        n, parts = targets.shape
        self.weights = [rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), (hidden, parts)), np.zeros(parts)]
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        for t in range(1, steps + 1):
            pick = rng.choice(n, min(n, 512), replace=False)
            h = np.maximum(x[pick] @ self.weights[0] + self.weights[1], 0)
            p = self._soft(h @ self.weights[2] + self.weights[3])
            d = (p - targets[pick]) / len(pick)
            back = (d @ self.weights[2].T) * (h > 0)
            for i, g in enumerate((x[pick].T @ back, back.sum(0), h.T @ d, d.sum(0))):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                self.weights[i] -= rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        h = np.maximum((points - self.mean) / self.spread @ self.weights[0] + self.weights[1], 0)
        return self._soft(h @ self.weights[2] + self.weights[3])


def fit_router(points: np.ndarray, parts: int, recall: float, k: int = 10, seed: int = 3) -> tuple[Router, int]:
    """The classifier, and how many parts a query must visit for the recall on held-back points."""
    rng = np.random.default_rng(seed)
    aside = rng.random(len(points)) < (min(0.2, 500 / len(points)) if len(points) > 50 else 0)
    base, held = points[~aside], points[aside]
    parts = max(1, min(parts, len(base) // 20))
    near = neighbours(base, base, min(k, max(1, len(base) - 1)), True) if len(base) > 1 else np.zeros((len(base), 1), int)
    where = balanced_cut(near, base, parts, rng) if parts > 1 else np.zeros(len(base), int)
    targets = np.zeros((len(base), parts))
    np.add.at(targets, (np.repeat(np.arange(len(base)), near.shape[1]), where[near.ravel()]), 1.0)
    np.add.at(targets, (np.arange(len(base)), where), near.shape[1] / 2)
    router = Router(base, targets / targets.sum(1, keepdims=True), rng)
    if not len(held) or parts == 1:
        return router, parts
    home = router(base).argmax(1)  # rows are indexed by the classifier, not by the cut
    order = np.argsort(-router(held), 1)
    place = np.argsort(order, 1)
    seen = np.sort(np.take_along_axis(place, home[neighbours(base, held, min(k, len(base)), False)], 1).ravel())
    return router, min(parts, int(seen[min(len(seen) - 1, math.ceil(recall * len(seen)) - 1)]) + 1)


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): distinct rows whose vectors take part, components as doubles."""
    vectors = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.where(fine)


def _first_copies(rows: DataFrame, most: int) -> DataFrame:
    """(vec_id, v) without repeats, and of each vector only the rows of the least ids. Tasks thin out their copies first."""

    def thin(batches):
        seen: dict[bytes, list[int]] = {}
        for batch in batches:
            ids, v = batch.column("vec_id").to_pylist(), batch.column("v")
            flat, offsets = v.flatten().to_numpy(zero_copy_only=False), v.value_lengths().to_numpy(zero_copy_only=False).cumsum()
            keep = np.zeros(len(ids), bool)
            for i, x in enumerate(ids):
                held = seen.setdefault(hash(flat[offsets[i - 1] if i else 0 : offsets[i]].tobytes()), [])
                if x not in held and (len(held) < most or x < held[-1]):
                    held.append(x)
                    held.sort()
                    del held[most:]
                    keep[i] = True
            yield batch.filter(pa.array(keep))

    # two vectors of one hash in a task would thin each other: the hash is of 64 bits over the whole vector
    # dealt by vector once: repeats and ranks need no other order
    thinned = rows.mapInArrow(thin, "vec_id long, v array<double>").repartition("v").dropDuplicates(["vec_id", "v"])
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return thinned.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def nearest(rows: DataFrame, queries: DataFrame, *, k: int = 10, recall: float = 0.95, sample: int = 4000, rows_per_part: int = 100, most_parts: int = 256, rows_per_task: int = 20_000, queries_per_task: int = 20_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for each query row (of the same columns as rows)."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = rows.sparkSession
    shapes = usable(rows, id_col, vec_col).groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not shapes:
        return spark.createDataFrame([], schema)
    width = shapes[0]["size"]
    base = kept(_first_copies(usable(rows, id_col, vec_col).where(F.size("v") == width), k + 1))
    count = base.count()
    place = F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1 << 30))
    chosen = base.where(place < min(1 << 30, int((1 << 30) * sample / max(1, count)))).dropDuplicates(["v"]).select("vec_id", "v").toPandas().sort_values("vec_id")
    points = np.stack(chosen["v"].to_numpy()) if len(chosen) else np.zeros((0, width))
    if len(points) < 2:
        points = np.stack([np.asarray(r.v) for r in base.limit(2).collect()])
    router, probes = fit_router(points, max(1, min(most_parts, count // rows_per_part)), recall, k)
    shipped = spark.sparkContext.broadcast((router, probes))  # of fixed size

    def matrix(batch):
        return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shipped.value[0](matrix(batch)).argmax(1)), batch.column("vec_id"), batch.column("v")], ["part", "vec_id", "v"])

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                router, probes = shipped.value
                best = np.argsort(-router(matrix(batch)), 1, kind="stable")[:, :probes]
                at = pa.array(np.repeat(np.arange(batch.num_rows), best.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(best.ravel()), batch.column("vec_id").take(at), batch.column("v").take(at)], ["part", "vec_id", "v"])

    indexed = kept(base.mapInArrow(index, "part long, vec_id long, v array<double>"))
    asked = usable(queries, id_col, vec_col).where(F.size("v") == width).dropDuplicates(["vec_id", "v"])
    routed = kept(asked.mapInArrow(route, "part long, vec_id long, v array<double>"))

    def pieces(rows, most):  # numbers for each part, of which there are most_parts at most
        sizes = {r.part: r["count"] for r in rows.groupBy("part").count().collect()}
        return F.coalesce(*[F.when(F.col("part") == p, F.lit(math.ceil(n / most))) for p, n in sizes.items() if n > most], F.lit(1))

    splits, blocks = pieces(indexed, rows_per_task), pieces(routed, queries_per_task)
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")))
    routed = routed.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("long")).withColumn("split", numbers(splits))
    stored = indexed.withColumn("split", F.pmod(F.xxhash64("vec_id"), splits).cast("long")).withColumn("block", numbers(blocks))

    def ranked(key, left, right):
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            base, ids = matrix(right.combine_chunks().to_batches()[0]), right.column("vec_id").to_numpy()
            asked, names = matrix(left.combine_chunks().to_batches()[0]), left.column("vec_id").to_numpy()
            rows = []
            for i, q in enumerate(asked):
                d = np.sqrt(((base - q) ** 2).sum(1))
                d[ids == names[i]] = np.inf
                near = np.argpartition(d, k - 1)[:k] if len(d) > k else np.arange(len(d))
                near = np.flatnonzero(d <= d[near].max())  # with all ties of the last
                near = near[np.isfinite(d[near])]
                near = near[np.lexsort((ids[near], d[near]))][:k]
                rows.append((np.full(len(near), names[i]), ids[near], d[near], np.full(len(near), zlib.crc32(q.tobytes()))))
            out = [np.concatenate([r[j] for r in rows]) for j in range(4)]
        return pa.table([pa.array(x) for x in out], ["query_id", "vec_id", "score", "which"])

    found = routed.groupBy("part", "split", "block").cogroup(stored.groupBy("part", "split", "block")).applyInArrow(ranked, "query_id long, vec_id long, score double, which long")
    best = F.row_number().over(Window.partitionBy("query_id", "which").orderBy("score", "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 100 = 0"))

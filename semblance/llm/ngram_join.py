"""N-gram Jaccard self-join with adaptive multi-match prefixes (operator 8).

A document is the set of its distinct n-word shingles, as 64-bit hashes. Documents with equal sets form a class;
everything after the scan works on classes, so copies cost nothing further.

1. Texts are packed into groups of some megabytes. Groups ask hash ranges which of them owns a class, the first that
   holds it, and then, for the shingles of the classes they own, by how many classes each is held (its frequency).
   Shingles that one class holds alone cannot be shared, so the others and the set's size are all that prefixes and
   exact verification need later. A shingle has one entry for each group, however many documents hold it.
2. Prefixes: a class of n shingles, ordered by frequency and then hash, can link only if its first
   n - ceil(s n) + l shingles have at least l in common with the partner's, for whatever l up to ``longest``. Each
   class picks the l of least estimated cost: the postings to read plus the candidates that l matches leave.
   Two classes are candidates if they share min(l, l') shingles of their prefixes.
3. Links: rounds of star candidates (one pivot for each posting list, at first the one with the fewest shingles
   of its own; lists that may hold more than ``list_most`` classes are dealt into parts, anew each round) are verified
   first; lists then give only pairs of different components, and these, filtered by
   their number of matches, are verified in turn. A group of near-copies thus costs about its size, not its
   square, and no link between components is missed: of long lists that still hold several components each part meets
   each other part in a task of its own. Pairs that cannot link are never made: a class has shingles
   alone that no partner has, and the parities of 256 hash buckets of the others (an odd sketch) differ in no more
   places than the sets do.

Defined results: a null or empty text, or one without words, is an empty set and links with nothing; a text of
fewer words than n has its whole sequence as one shingle; rows that repeat an id are documents of their own; a
null id takes no part in component_id unless all ids of its component are null; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, kept
from .common import flat, keyed_texts, lean, mix, nested, read_table, runs_of, shingles_of, words_of
from .components import components
from .exchange import GROUP, MESSAGE, TEXTS, Packer, answered, answers_to, by_group, distinct, messages, question, unpacked

#: Turns a shingle's hash into the bit that it flips in its class's sketch; deals the parts of long lists.
_PARITY, _DEAL = np.uint64(0xA0761D6478BD642F), np.uint64(0x9E3779B97F4A7C15)
#: Cost of verifying a candidate, in postings read.
VERIFY_COST = 4
#: Kinds of questions: who owns a class, and how many classes hold a shingle.
OWNER, FREQUENCY = 1, 2
_FIELDS = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("text", pa.large_binary())]


def set_table(column: pa.Array, n: int):
    """Yields (first row, rows, distinct shingles row by row, their row, set sizes, class ids)."""
    for first, rows, hashes, offsets, _, _ in words_of(column):
        shingles, where = shingles_of(hashes, offsets, n)
        order = np.lexsort((shingles, where))
        shingles, where = shingles[order], where[order]
        new = np.ones(len(shingles), bool)
        new[1:] = (shingles[1:] != shingles[:-1]) | (where[1:] != where[:-1])
        shingles, where = shingles[new], where[new]
        sizes = np.bincount(where, minlength=rows)
        sums = np.zeros(len(shingles) + 1, np.uint64)
        np.cumsum(mix(shingles), out=sums[1:])
        ends = np.cumsum(sizes)
        yield first, rows, shingles, where, sizes, mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64))


def packed_documents(docs: DataFrame, group_bytes: int) -> DataFrame:
    """(g, blob): rows of doc_id, text_hash (xxhash64 of the text) and text, some megabytes together."""

    def run(batches):
        packer = Packer(_FIELDS, group_bytes)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string()).cast(pa.large_binary())
            for doc, mark, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), texts, strict=True):
                text = text.as_py()
                yield from packer.add((doc, mark, text), len(text or b""))
        yield from packer.flush()

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(lean(run), "g long, blob binary")


class Group:
    """A group's documents and their sets; classes are numbered as they first occur."""

    def __init__(self, blob, n: int):
        self.docs = unpacked(blob)
        parts = list(set_table(self.docs.column("text").combine_chunks().cast(pa.large_string()), n))
        join = lambda i, kind: np.concatenate([p[i] for p in parts]).astype(kind, copy=False) if parts else np.zeros(0, kind)
        self.shingles, self.sizes, self.cls = join(2, np.uint64), join(4, np.int64), join(5, np.uint64)
        self.row = np.concatenate([p[3] + p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        self.first = np.zeros(len(self.cls), bool)  # rows that stand for their class here
        _, at = np.unique(self.cls, return_index=True)
        self.first[at] = True
        self.first &= self.sizes > 0

    def classes(self, ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct classes, and the place among them of each row that stands for one."""
        return distinct(self.cls[self.first], ranges)

    def owned(self, ranges: int, answers: np.ndarray) -> np.ndarray:
        """Which rows stand for a class that this group owns."""
        out = np.zeros(len(self.cls), bool)
        out[self.first] = answers[self.classes(ranges)[1]] > 0
        return out


def _put_together(kind, which, n, values, groups):
    """Of a class 1 for the first group that holds it; of a shingle the sum of its counts."""
    if kind == OWNER:
        first = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(first, which, groups)
        return (groups == first[which]).astype(np.int64)
    return np.bincount(which, values[0], minlength=n).astype(np.int64)[which]


def choose_prefix(size: int, freq: np.ndarray, least: int, longest: int) -> tuple[int, int]:
    """(l, how many of the shared shingles, by rising frequency, stand in the l-prefix); (0, 0) if no link is possible.

    ``size - len(freq)`` shingles that nobody else holds come before the shared ones.
    """
    shared = len(freq)
    if shared < least:
        return 0, 0
    free = shared - least  # of the shared ones, those before the last `least`
    cost = np.cumsum(freq[: free + longest] - 1)
    best = (math.inf, 0, 0)
    for match in range(1, min(longest, least) + 1):
        read = float(cost[free + match - 1])
        best = min(best, (read + VERIFY_COST * read / match, match, free + match))
    return best[1], best[2]


_PROFILE = [("kind", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("cls", pa.int64()), ("size", pa.int64()), ("shared", pa.int64()), ("match", pa.int64()), ("sketch", pa.binary()), ("tokens", pa.binary()), ("prefix", pa.binary()), ("parts", pa.binary())]
_PROFILE_DDL = "kind int, doc_id long, text_hash long, cls long, size long, shared long, match long, sketch binary, tokens binary, prefix binary, parts binary"
DOCUMENT, CLASS = 0, 1


def _profiled(group: Group, ranges: int, owned: np.ndarray, answers: np.ndarray, percent: int, longest: int, list_most: int) -> pa.Table:
    """Rows of two kinds: documents with class and size of their set, and the classes owned that can link at all.

    tokens: the shared shingles, sorted; prefix: those of the prefix, and in how many parts the lists of these may come.
    """
    docs = pa.table([pa.array(np.full(len(group.cls), DOCUMENT, np.int32)), group.docs.column("doc_id"), group.docs.column("text_hash"), pa.array(group.cls.view(np.int64)), pa.array(group.sizes)], ["kind", "doc_id", "text_hash", "cls", "size"])
    use = owned[group.row]
    row, token = group.row[use], group.shingles[use]
    freq = answers[distinct(token, ranges)[1]] if len(token) else np.zeros(0, np.int64)
    more = freq > 1
    row, token, freq = row[more], token[more], freq[more]
    order = np.lexsort((token, freq, row))
    row, token, freq = row[order], token[order], freq[order]
    cuts = runs_of(row)
    owner = np.repeat(np.arange(len(cuts)), [b - a for a, b in cuts])
    out: dict[str, list] = {name: [] for name, _ in _PROFILE}
    bit = (mix(token ^ _PARITY) & np.uint64(255)).astype(np.int64)
    for at in range(0, len(cuts), 4096):  # so many sketches at once
        some = cuts[at : at + 4096]
        inside = slice(some[0][0], some[-1][1])
        odd = np.bincount((owner[inside] - at) * 256 + bit[inside], minlength=256 * len(some)).reshape(len(some), 256) & 1
        for (a, b), sketch in zip(some, np.packbits(odd.astype(bool), axis=1), strict=True):
            size = int(group.sizes[row[a]])
            match, length = choose_prefix(size, freq[a:b], -(-percent * size // 100), longest)
            if match:
                parts = np.minimum(-(-freq[a : a + length] // list_most), 65535).astype("<u2")
                cls = int(group.cls[row[a]].view(np.int64))
                for k, v in zip(out, (CLASS, None, None, cls, size, b - a, match, sketch.tobytes(), np.sort(token[a:b]).tobytes(), token[a : a + length].tobytes(), parts.tobytes()), strict=True):
                    out[k].append(v)
    classes = pa.table(out, schema=pa.schema(_PROFILE))
    return pa.concat_tables([classes, docs], promote_options="default").select([name for name, _ in _PROFILE])


#: cell: the part of a long list, or the two parts that meet; own: the part that the class is in.
_POSTING = np.dtype([("token", "<u8"), ("cell", "<u8"), ("cls", "<i8"), ("root", "<i8"), ("size", "<u4"), ("shared", "<u4"), ("match", "<u4"), ("own", "<u2"), ("sketch", "<u8", (4,))])


def _rooted(profiles: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Classes with root: a class that has none yet is its own."""
    rows = profiles.select("cls", "size", "shared", "match", "sketch", "prefix", "parts")
    if roots is None:
        return rows.withColumn("root", F.col("cls"))
    return rows.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _part_of(cls: np.ndarray, parts: np.ndarray, deal: int) -> np.ndarray:
    return mix(cls.view(np.uint64) + np.uint64(deal) * _DEAL) % parts.astype(np.uint64)


def _long_lists(rooted: DataFrame) -> np.ndarray:
    """Tokens whose lists come in parts and hold several components. Their number is that of all postings over list_most at most."""

    def run(batches):
        for batch in batches:
            for root, prefix, parts in zip(batch.column("root").to_pylist(), batch.column("prefix"), batch.column("parts"), strict=True):
                token = np.frombuffer(prefix.as_buffer(), np.int64)[np.frombuffer(parts.as_buffer(), "<u2") > 1]
                if len(token):
                    yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.full(len(token), root))], ["token", "root"])

    long = rooted.where(F.col("parts") != F.unhex(F.repeat(F.lit("0100"), (F.octet_length("parts") / 2).cast("int"))))
    ends = long.select("root", "prefix", "parts").mapInArrow(run, "token long, root long").groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return np.sort(ends.where("low < high").select("token").toArrow().column("token").to_numpy().view(np.uint64))


def _postings(rooted: DataFrame, ranges: int, star: int | None) -> DataFrame:
    """(part, blob): prefix postings by hash range. Parts of long lists are dealt by the round, or each meets each."""
    shipped = rooted.sparkSession.sparkContext.broadcast(_long_lists(rooted) if star is None else np.zeros(0, np.uint64))

    def run(batches):
        for batch in batches:
            prefix = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("prefix")]
            if not prefix:
                continue
            counts = np.array([len(x) for x in prefix])
            parts = np.concatenate([np.frombuffer(x.as_buffer(), "<u2") for x in batch.column("parts")])
            got = np.zeros(int(counts.sum()), _POSTING)
            got["token"] = np.concatenate(prefix)
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, 4)
            got["sketch"] = np.repeat(sketch, counts, axis=0)
            for name in ("cls", "root", "size", "shared", "match"):
                got[name] = np.repeat(batch.column(name).to_numpy(zero_copy_only=False), counts)
            got["own"] = _part_of(got["cls"], parts, star or 0)
            if star is None:
                long = parts > 1
                at = np.searchsorted(shipped.value, got["token"][long])
                at[at == len(shipped.value)] = 0
                open_ = shipped.value[at] == got["token"][long] if len(shipped.value) else np.zeros(int(long.sum()), bool)
                several, each = got[long][open_], parts[long][open_].astype(np.int64)
                other = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
                several = np.repeat(several, each)
                several["cell"] = (np.minimum(several["own"], other).astype(np.uint64) << np.uint64(16)) | np.maximum(several["own"], other).astype(np.uint64)
                got = np.concatenate([got[~long], several])
            else:
                got["cell"] = got["own"]
            key = mix(got["token"] ^ mix(got["cell"]))
            to = ((key >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            order = np.argsort(to, kind="stable")
            to, got = to[order], got[order]
            edges = runs_of(to)
            yield pa.RecordBatch.from_arrays([pa.array([int(to[a]) for a, _ in edges], pa.int64()), pa.array([got[a:b].tobytes() for a, b in edges], pa.binary())], ["part", "blob"])

    return rooted.mapInArrow(lean(run), "part long, blob binary")


def _lists(table: pa.Table):
    """The posting lists of a range, or their parts, each sorted by component and class."""
    rows = np.concatenate([np.frombuffer(x.as_buffer(), _POSTING) for x in table.column("blob")])
    rows = rows[np.lexsort((rows["cls"], rows["root"], rows["cell"], rows["token"]))]
    for a, b in runs_of(rows["token"], rows["cell"]):
        if rows["root"][a] != rows["root"][b - 1]:
            yield rows[a:b]


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("need", pa.int64()), ("hits", pa.int64())])


def _summed(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Pairs once each, with their hits added up."""
    a, b, need, hits = (np.concatenate([x[i] for x in found]) for i in range(4))
    if not len(a):
        return a, b, need, hits
    order = np.lexsort((b, a))
    a, b, need, hits = a[order], b[order], need[order], hits[order]
    cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[cut], b[cut], need[cut], np.add.reduceat(hits, cut)


def _pair_rows(x, y, percent: int) -> tuple[np.ndarray, ...]:
    """Pairs of postings, row by row, that can link.

    The sets differ in at least the shingles that each has alone and the odd bits of their sketches.
    """
    total = x["size"].astype(np.int64) + y["size"]
    differ = total - x["shared"] - y["shared"] + np.bitwise_count(x["sketch"] ^ y["sketch"]).sum(1, dtype=np.int64)
    most = np.minimum(np.minimum(x["shared"], y["shared"]).astype(np.int64), (total - differ) // 2)
    fit = 100 * most >= percent * (total - most)
    x, y = x[fit], y[fit]
    return np.minimum(x["cls"], y["cls"]), np.maximum(x["cls"], y["cls"]), np.minimum(x["match"], y["match"]).astype(np.int64), np.ones(len(x), np.int64)


def _candidates(postings: DataFrame, ranges: int, percent: int, star: int | None) -> DataFrame:
    """Candidate pairs (a, b) of different components: with a pivot only (star: its round), or all with enough matches."""

    def run(key, table):
        found, held = [], 0
        for rows in _lists(table):
            if star is not None:
                roots, counts = np.unique(rows["root"], return_counts=True)
                own = np.flatnonzero(rows["root"] == roots[np.argmax(counts)]) if star else np.arange(len(rows))
                lone = (rows["size"] - rows["shared"])[own] / rows["size"][own] if star == 0 else 0
                pivot = own[np.lexsort((mix(rows["cls"][own].view(np.uint64) + np.uint64(star)), lone * np.ones(len(own))))[0]]
                other = rows[rows["root"] != rows["root"][pivot]]
                found.append(_pair_rows(np.repeat(rows[pivot : pivot + 1], len(other)), other, percent))
                held += len(found[-1][0])
            else:
                crossing = rows["cell"][0] >> np.uint64(16) != rows["cell"][0] & np.uint64(65535)  # two parts meet
                for i in range(len(rows) - 1):  # sorted by component: those after its end are of others
                    after = int(np.searchsorted(rows["root"], rows["root"][i], "right"))
                    if after < len(rows):
                        other = rows[after:][rows["own"][after:] != rows["own"][i]] if crossing else rows[after:]
                        found.append(_pair_rows(np.repeat(rows[i : i + 1], len(other)), other, percent))
                        held += len(found[-1][0])
                        if held > 2_000_000:
                            found = [_summed(found)]
                            held = len(found[0][0]) // 2
            if held > 2_000_000:
                found = [_summed(found)]
                held = len(found[0][0]) // 2
        return pa.table(list(_summed(found)), schema=_PAIRS) if found else _PAIRS.empty_table()

    pairs = postings.repartition(ranges, "part").groupBy("part").applyInArrow(lean(run), "a long, b long, need long, hits long")
    if star is not None:
        return pairs.select("a", "b").distinct()
    return pairs.groupBy("a", "b").agg(F.sum("hits").alias("hits"), F.max("need").alias("need")).where("hits >= need").select("a", "b")


def _verified(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """(u, v, shared): the pairs that link, by their whole sets."""
    side = profiles.select("cls", "size", "tokens")
    rows = pairs.join(side.toDF("a", "size_a", "tokens_a"), "a").join(side.toDF("b", "size_b", "tokens_b"), "b").select("a", "b", "size_a", "size_b", "tokens_a", "tokens_b")

    def run(batches):
        for batch in batches:
            common = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) < len(y) else (y, x)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common[i] = (y[at] == x).sum()
            union = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy() - common
            keep = pa.array(100 * common >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(common).filter(keep)], ["u", "v", "shared"])

    return rows.mapInArrow(lean(run), "u long, v long, shared long")


def near_duplicates(docs: DataFrame, *, n: int = 5, percent: int = 80, longest: int = 6, star_rounds: int = 3, group_bytes: int = 4 << 20, range_bytes: int = 12 << 20, list_most: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), cls (class id), n_shingles, root (component), component_id for each row.

    group_bytes, range_bytes: of text that a task works on at once, and whose shingles a range holds, about. list_most:
    classes of a posting list that a task gets, about.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent is over 0 and at most 100")
    spark, texts = docs.sparkSession, keyed_texts(docs, id_col, text_col)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges, groups = (max(2, partitions, math.ceil(size / x)) for x in (range_bytes, group_bytes))
    packed = kept(packed_documents(texts, group_bytes), **{"parquet.block.size": 4 * group_bytes})

    def owners(table):
        g, blob, _ = answered(table)
        names, _ = Group(blob, n).classes(ranges)
        return messages(question(g, OWNER, ranges, names, np.ones(len(names), np.int64)))

    parts = [packed.select("g", F.lit(TEXTS).alias("kind"), F.lit(0).cast("long").alias("part"), "blob")]
    done = [packed, kept(answers_to(by_group(parts, groups).applyInArrow(lean(owners), MESSAGE), ranges, _put_together).select(*GROUP))]
    parts.append(done[1])

    def frequencies(table):
        g, blob, found = answered(table)
        group = Group(blob, n)
        token = group.shingles[group.owned(ranges, found.get(OWNER, np.zeros(0, np.int64)))[group.row]]
        names, which = distinct(token, ranges)
        return messages(question(g, FREQUENCY, ranges, names, np.bincount(which, minlength=len(names))))

    done.append(kept(answers_to(by_group(parts, groups).applyInArrow(lean(frequencies), MESSAGE), ranges, _put_together).select(*GROUP)))
    parts.append(done[2])

    def profiled(table):
        _, blob, found = answered(table)
        group, none = Group(blob, n), np.zeros(0, np.int64)
        return _profiled(group, ranges, group.owned(ranges, found.get(OWNER, none)), found.get(FREQUENCY, none), percent, longest, list_most)

    rows = kept(by_group(parts, groups).applyInArrow(lean(profiled), _PROFILE_DDL))
    for x in done:
        discard(x)
    profiles = rows.where(F.col("kind") == CLASS)
    roots = None
    for star in [*range(star_rounds), None]:
        pairs = _candidates(_postings(_rooted(profiles, roots), ranges, star), ranges, percent, star)
        new = kept(_verified(pairs, profiles, percent).select("u", "v"))
        count = new.count()
        if count:
            edges = new if roots is None else new.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
            roots = kept(components(edges))
    classes = rows.where(F.col("kind") == DOCUMENT).select("doc_id", "text_hash", "cls", F.col("size").alias("n_shingles"))
    return components_of_rows(classes, roots)


def components_of_rows(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows with the root class of their component and its least doc_id."""
    own = rows.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    if roots is not None:
        member = own.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        least = member.groupBy("root").agg(F.min("least").alias("component_id"))
        own = member.join(least, "root").select("cls", "root", "component_id")
    else:
        own = own.select("cls", F.col("cls").alias("root"), F.col("least").alias("component_id"))
    joined = rows.join(own, "cls", "left")
    linked = F.col("n_shingles") > 0
    return joined.select("doc_id", "text_hash", "cls", "n_shingles", F.when(linked, F.col("root")).alias("root"), F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and others) that stand for their component: its least doc_id, then text hash.

    Rows without words link with nothing and all stay. Of rows alike in id and text one stays.
    """
    best = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best")).select("best.doc_id", "best.text_hash")
    rows = nested(docs, id=F.col("doc_id"), hash=F.xxhash64("text"))
    stays = rows.join(best.toDF("_id", "_best"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_best")), "left_semi").dropDuplicates(["id", "hash"])
    blank = rows.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return flat(stays.unionByName(blank), docs.columns)


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"), n=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def reachable_sql(n: int, percent: int) -> str:
    """SQL that gives rid, doc_id, n_shingles and component (least rid's doc) for each row of documents."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT rid, doc_id, list_distinct(CASE WHEN len(ws) >= {n} THEN list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w
), g AS (SELECT rid, len(sh) AS n, unnest(sh) AS t FROM s
), pairs AS (SELECT x.rid AS a, y.rid AS b, any_value(x.n) + any_value(y.n) AS n, count(*) AS c FROM g x JOIN g y ON x.t = y.t AND x.rid <> y.rid GROUP BY 1, 2
), links AS (SELECT a, b FROM pairs WHERE 100 * c >= {percent} * (n - c)
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a, min(doc_id) AS d FROM reach JOIN s ON s.rid = reach.b GROUP BY a)
"""


OP8_SQL = reachable_sql(4, 85) + "SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(l.d, s.doc_id)) AS component_id FROM s LEFT JOIN least l ON l.a = s.rid"

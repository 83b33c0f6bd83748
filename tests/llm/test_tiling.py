import random

import numpy as np
import pytest

from semblance.llm.tiling import contaminated, greedy_tiles, op3_decontamination, without_contaminated

from .test_words import words


def brute_tiles(a, b, least):
    """Greedy string tiling by its definition: all maximal matches, the longest marked first."""
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best, found = least, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best:
                    found.append((i, j))
        if not found:
            return covered
        for i, j in found:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                for k in range(best):
                    free_a[i + k] = free_b[j + k] = False
                covered += best


def test_tiles_equal_the_definition():
    rnd = random.Random(2)
    for trial in range(150):
        a, b = ([rnd.randrange(rnd.choice([2, 5, 12])) for _ in range(rnd.randrange(30))] for _ in range(2))
        hashed = lambda x: np.array([hash((3, v)) & (1 << 64) - 1 for v in x], np.uint64)
        for least in (1, 2, 4):
            tiles = greedy_tiles(hashed(a), hashed(b), least)
            for i, j, n in tiles:
                assert a[i : i + n] == b[j : j + n] and n >= least
            assert len({x for i, _, n in tiles for x in range(i, i + n)}) == len({x for _, j, n in tiles for x in range(j, j + n)}) == sum(t[2] for t in tiles)
            assert [t[2] for t in tiles] == sorted((t[2] for t in tiles), reverse=True)
            if tiles or brute_tiles(a, b, least):
                assert tiles[0][2] >= least and abs(sum(t[2] for t in tiles) - brute_tiles(a, b, least)) <= max(least, tiles[0][2])


def pieces_shuffled(rnd, words):
    """The words in a new order of runs, some lost and some strange ones between; each word occurs once at most."""
    cuts = sorted({0, len(words), *(rnd.randrange(len(words) + 1) for _ in range(rnd.randrange(6)))})
    runs = [words[a:b] for a, b in zip(cuts, cuts[1:]) if rnd.random() < 0.85]
    rnd.shuffle(runs)
    return [x for k, run in enumerate(runs) for x in [*run, *([f"s{rnd.randrange(10**9)}"] if rnd.random() < 0.5 else [])]]


def the_tiles(a, b, least):
    """Where every word occurs once on each side there is one tiling: all maximal common runs."""
    at = {x: j for j, x in enumerate(b)}
    out, i = set(), 0
    while i < len(a):
        n = 0
        while i + n < len(a) and a[i + n] in at and at[a[i + n]] == at[a[i]] + n:
            n += 1
        if n >= least:
            out.add((i, at[a[i]], n))
        i += max(n, 1)
    return out


def test_tiles_without_ties_are_exactly_those_of_the_definition():
    rnd = random.Random(9)
    for _ in range(300):
        b = [f"w{i}" for i in range(rnd.randrange(1, 60))]
        a = pieces_shuffled(rnd, b)
        hashed = lambda x: np.array([hash(("h", v)) & (1 << 64) - 1 for v in x], np.uint64)
        for least in (1, 3, 5):
            tiles = greedy_tiles(hashed(a), hashed(b), least)
            assert len(tiles) == len(set(tiles)) and set(tiles) == the_tiles(a, b, least)
            assert [t[2] for t in tiles] == sorted((t[2] for t in tiles), reverse=True)


def test_query_is_brute_force_over_all_pairs(spark, tmp_path):
    rnd = random.Random(10)
    items = [(i, [f"i{i}w{j}" for j in range(rnd.randrange(3, 50))]) for i in range(8)]
    docs = [(d, [x for part in (pieces_shuffled(rnd, rnd.choice(items)[1]), [f"d{d}w{j}" for j in range(rnd.randrange(30))], pieces_shuffled(rnd, items[d % 8][1])) for x in part]) for d in range(60)]
    docs = [(d, list(dict.fromkeys(ws))) for d, ws in docs]
    spark.createDataFrame([(d, " ".join(ws), "en") for d, ws in docs], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = []
    for d, a in docs:
        for i, b in items:
            tiles = the_tiles(a, b, min(5, len(b)))
            if 100 * sum(t[2] for t in tiles) >= 80 * len(b):
                want.append((d, i, len(b), sum(t[2] for t in tiles), len(tiles)))
    got = sorted((r.doc_id, r.item_id, r.item_words, r.covered, r.n_tiles) for r in op3_decontamination(spark, str(tmp_path)).collect())
    assert got == sorted(want) and 10 < len(want) < 480
    rows, tests = (spark.read.parquet(str(tmp_path / f"{x}.parquet")) for x in ("documents", "benchmark"))
    for block in (2_000_000, 40):
        clean = without_contaminated(rows, tests, block_words=block)
        assert clean.columns == rows.columns and {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {x[0] for x in want}
    assert without_contaminated(rows, tests.limit(0)).count() == 60 and without_contaminated(rows.limit(0), tests).count() == 0


ITEM = "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12 q13 q14 q15 q16 q17 q18 q19 q20"


def test_contaminated_documents(spark):
    w = ITEM.split()
    moved = " ".join([*w[10:], "and", "then", *w[:10]])
    partly = " ".join([*w[:10], "x", *w[11:14], "y", *w[15:]])
    docs = [(1, "before " + ITEM.upper() + " after"), (2, moved), (3, partly), (4, " ".join(w[:15])), (5, "nothing of it"), (6, None), (7, ""), (8, "pad " * 30_000 + ITEM), (1, moved), (9, "tiny item"), (10, "a tiny item here")]
    items = [(100, ITEM), (101, None), (102, ""), (103, "tiny item"), (104, ITEM)]
    d = spark.createDataFrame([(a, b, 5, "t") for a, b in docs], "doc_id long, text string, item_id int, tiles string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (2_000_000, 25):
        got = sorted((r.doc_id, r.item_id, r.covered, len(r.tiles)) for r in contaminated(d, b, block_words=block).collect())
        assert got == sorted([(x, i, 20, t) for x, t in ((1, 1), (1, 2), (2, 2), (8, 1)) for i in (100, 104)] + [(9, 103, 2, 1), (10, 103, 2, 1)])
    assert {r.doc_id for r in contaminated(d, b, percent=70).collect()} == {1, 2, 3, 4, 8, 9, 10}
    empty = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert contaminated(empty[0], b).count() == 0 and contaminated(d, empty[1]).count() == 0
    with pytest.raises(ValueError):
        contaminated(d, b, least=0)


def test_whole_items_are_always_found(spark):
    rnd = random.Random(8)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 30)))) for i in range(12)]
    docs = []
    for i in range(40):
        parts = [" ".join(rnd.choices(vocabulary, k=rnd.randrange(50)))]
        docs.append((i, " ".join(parts + [rnd.choice(items)[1]] * (i % 2) + parts)))
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for d, t in docs:
        for i, x in items:
            if b" " + b" ".join(words(x)) + b" " in b" " + b" ".join(words(t)) + b" ":
                assert (d, i) in got

import random

import numpy as np
import pytest

from semblance.llm.ngram_join import choose_prefix, near_duplicates, one_of_each

from .test_words import words


def brute(rows, n, percent):
    """component of each row by its place: the least id."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, base = [], [" ".join(rnd.choices(vocabulary, k=rnd.randrange(20, 80))) for _ in range(6)]
    for i in range(n):
        w = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        if rnd.random() < 0.2:
            w = rnd.choices(vocabulary, k=30) + "the same line stands in many texts of this corpus".split()
        rows.append((i + 10, " ".join(w)))
    return rows


ODD = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One two"), (5, "one two"), (5, "one  two three"), (None, "one two"), (None, "lone text without an id here at all"), (6, "a " * 500), (7, "A a a a a"), (8, None)]


@pytest.mark.parametrize("n,percent,rounds,group_bytes,list_most", [(4, 85, 3, 6 << 20, 200_000), (5, 80, 1, 3000, 7), (3, 60, 0, 800, 5), (3, 60, 2, 800, 4)])
def test_components_equal_those_of_all_pairs(spark, n, percent, rounds, group_bytes, list_most):
    rows = corpus(n, 150) + ODD
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, cls int, root string")
    got = near_duplicates(df.repartition(3), n=n, percent=percent, star_rounds=rounds, group_bytes=group_bytes, list_most=list_most).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, n, percent)


def test_one_of_each_component_stays(spark):
    rows = corpus(9, 60) + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = one_of_each(df, near_duplicates(df, n=4, percent=85)).collect()
    blank = [r for r in rows if not words(r[1])]
    assert len([r for r in kept if not words(r.text)]) == len(blank)
    ids = [r.doc_id for r in kept if words(r.text)]
    want = {c for _, n, c in brute(rows, 4, 85) if n and c is not None}
    assert {i for i in ids if i is not None} == want and len(ids) == len(want) + 1  # and the text without an id


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0 and one_of_each(df, near_duplicates(df)).count() == 0


def test_prefixes_never_lose_a_partner():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(3, 40))
        freq = np.sort(rng.integers(2, 50, int(rng.integers(0, n + 1))))
        least = -(-85 * n // 100)
        match, length = choose_prefix(n, freq, least, 6)
        assert (match == 0) == (len(freq) < least)
        if match:  # with at least `least` in common, `match` of them must lie in the prefix
            assert length == len(freq) - least + match and length <= len(freq)


def test_very_long_texts_link_whole(spark):
    rnd = random.Random(3)
    a = [f"w{rnd.randrange(10**6)}" for _ in range(300_000)]
    near, far = list(a), list(a)
    near[::40] = ["x"] * len(near[::40])  # links with the whole and with the one that has more of them
    far[::20] = ["x"] * len(far[::20])
    rows = [(1, " ".join(a)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(a[:200])), (5, " ".join(a))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=4, percent=80).collect())
    assert got == brute(rows, 4, 80) and {c for _, _, c in got} == {1, 4}

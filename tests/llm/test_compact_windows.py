import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from semblance.llm import compact_windows as cw
from semblance.llm.compact_windows import cartesian_windows, duplicate_passages, matching_passages, without_passages

from .test_words import words


def test_windows_are_the_large_nodes_of_cartesian_trees():
    rng = np.random.default_rng(0)
    for trial in range(200):
        width, lengths = int(rng.integers(1, 8)), rng.integers(0, 30, 4)
        rows = np.repeat(np.arange(4), lengths)
        h = rng.integers(1, [8, 10**6][trial % 2], len(rows)).astype(np.uint64)
        at, left, right = cartesian_windows(h, rows, width)
        got, want = set(zip(at.tolist(), (at - left).tolist(), (at + right).tolist())), set()
        for c in range(len(h)):
            i = j = c
            while i and rows[i - 1] == rows[c] and h[i - 1] >= h[c]:
                i -= 1
            while j + 1 < len(h) and rows[j + 1] == rows[c] and h[j + 1] >= h[c]:
                j += 1
            if j - i + 1 >= width:
                want.add((c, i, j))
        assert got <= want and {x[1:] for x in got} == {x[1:] for x in want}
        if trial % 2 and len(set(h.tolist())) == len(h):
            assert got == want


def test_passages_on_an_alignment():
    same = np.array([True] * 60 + [False] + [True] * 60)
    assert matching_passages(same, 5, 46, 80) == [(0, 121, 112)]
    assert matching_passages(same[:60], 5, 46, 80) == [(0, 60, 56)]
    assert matching_passages(same[12:110][:49], 5, 46, 80) == []
    assert matching_passages(~same, 5, 46, 80) == [] and matching_passages(same[:3], 5, 46, 80) == []


def text(rnd, n):
    return [f"t{rnd.randrange(4000)}" for _ in range(n)]


def corpus():
    rnd = random.Random(6)
    shared = [text(rnd, n) for n in (51, 60, 90, 200)]
    docs = []
    for i in range(80):
        w = text(rnd, rnd.randrange(10, 150))
        if i % 2:
            at = rnd.randrange(len(w))
            w[at:at] = rnd.choice(shared)
        docs.append((100 - i, " ".join(w)))
    return docs, shared


ODD = [(None, None), (500, ""), (501, " "), (502, "junk " * 300), (503, "junk " * 260), (504, "short")]


def test_every_exact_passage_is_found(spark):
    docs, _ = corpus()
    rows = docs + ODD + [docs[1], (docs[1][0], docs[3][1])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, start int")
    got = duplicate_passages(df).collect()
    covered = defaultdict(set)
    for r in got:
        covered[r.doc_id].update(range(r.start, r.end))
        assert r.end - r.start >= 50 and (r.doc_id != r.source_id or r.tag != r.source_tag)
    by_id = sorted(docs + ODD[1:], key=lambda r: r[0])
    seen = {}
    for doc, t in by_id:
        w = words(t)
        mine = [tuple(w[i : i + 51]) for i in range(len(w) - 50)]
        for i, g in enumerate(mine):
            if seen.get(g, doc) != doc:
                assert doc in covered, doc
                assert len(set(range(i, i + 51)) - covered[doc]) <= 1
        for g in mine:
            seen.setdefault(g, doc)
    clean = {a for a, b in docs[::2]} | {504, 500, 501}
    assert not clean & set(covered)


def test_near_copies_and_cutting(spark):
    rnd = random.Random(7)
    base = text(rnd, 120)
    near = list(base)
    near[60] = "changed"
    docs = [(1, " ".join(text(rnd, 40) + base)), (2, " ".join(["Lead", "in"] + near + ["And", "tail\tend"])), (3, " ".join(base)), (4, "clean text"), (5, None)]
    df = spark.createDataFrame([(a, b, "k") for a, b in docs], "doc_id long, text string, _drop string")
    found = duplicate_passages(df)
    got = {(r.doc_id, r.start, r.end, r.source_id, r.source_start) for r in found.collect()}
    assert got == {(2, 2, 122, 1, 40), (3, 0, 120, 1, 40)}
    left = {r.doc_id: r.text for r in without_passages(df.drop("_drop"), found).collect()}
    assert left == {1: docs[0][1], 2: "Lead in And tail\tend", 4: "clean text", 5: None}


def test_empty_table_and_arguments(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert duplicate_passages(df).count() == 0
    with pytest.raises(ValueError):
        duplicate_passages(df, n=5, least=4)


def test_inserted_and_deleted_words(spark):
    rnd = random.Random(8)
    short, long = text(rnd, 60), text(rnd, 400)
    more = short[:30] + ["inserted"] + short[30:]
    other = [w for i in range(0, 400, 45) for w in [*long[i : i + 45], f"extra{i}"][(i // 45) % 2 :]]  # a word more, a word less
    docs = [short, text(rnd, 20) + more + text(rnd, 30), text(rnd, 25) + long, text(rnd, 7) + other + text(rnd, 9)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs, 1)], "doc_id long, text string")
    got = {(r.doc_id, r.source_id, r.source_start, r.start, r.end) for r in duplicate_passages(df).collect()}
    assert {x[:2] for x in got} == {(2, 1), (4, 3)}
    assert (2, 1, 0, 20, 81) in got
    assert sum(e - s for d, _, _, s, e in got if d == 4) > 0.9 * len(other)


def test_copies_meet_though_earlier_documents_hold_parts_of_them(spark):
    rnd = random.Random(9)
    docs, pairs = [], []
    for _ in range(40):
        t = text(rnd, 60)
        at = len(docs)
        docs += [text(rnd, 40) + t[:30] + text(rnd, 40), text(rnd, 40) + t[30:] + text(rnd, 40), text(rnd, 40) + t[10:50] + text(rnd, 40)]
        docs += [text(rnd, 30) + t + text(rnd, 30), text(rnd, 35) + t + text(rnd, 30)]
        pairs.append((at + 4, at + 3))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = duplicate_passages(df).collect()
    assert {(r.doc_id, r.source_id) for r in got} == set(pairs)
    assert all(r.start <= 35 and r.end >= 95 for r in got)


def test_extents_are_not_clipped():
    """The least of 200 000 shingles is the minimum of all subsequences that hold it."""
    hashes = np.random.default_rng(3).integers(1 << 20, 1 << 62, 200_000, dtype=np.uint64)
    hashes[100_000] = 1
    at, left, right = cw.cartesian_windows(hashes, np.zeros(len(hashes), np.int64), 46)
    where = int(np.flatnonzero(at == 100_000)[0])
    assert (left[where], right[where]) == (100_000, 99_999)
    packed = np.zeros(1, cw._WINDOW)
    packed["left"], packed["right"] = left[where], right[where]
    assert (int(packed["left"][0]), int(packed["right"][0])) == (100_000, 99_999)


def test_recall_of_planted_near_passages(spark):
    """Passages of 60 to 120 words in two to six documents, copies with up to two words replaced, inserted or deleted."""
    rnd = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, planted = [], []
    for k in range(120):
        passage = rnd.choices(vocabulary, k=rnd.randrange(60, 121))
        for j in range(rnd.choice([2, 2, 3, 6])):
            copy = list(passage)
            for _ in range(rnd.randrange(3) if j else 0):
                at = rnd.randrange(len(copy))
                copy[at : at + rnd.randrange(2)] = rnd.choices(vocabulary, k=rnd.randrange(2))
            a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (passage, copy))
            before = rnd.choices(vocabulary, k=rnd.randrange(150))
            if j and len(a & b) >= 0.8 * len(a | b):
                planted.append((len(rows), len(before), len(before) + len(copy)))
            rows.append((len(rows), " ".join(before + copy + rnd.choices(vocabulary, k=rnd.randrange(150)))))
    cover = defaultdict(set)
    for r in duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        cover[r.doc_id].update(range(r.start, r.end))
    caught = sum(len(cover[d] & set(range(a, b))) >= 0.7 * (b - a) for d, a, b in planted)
    assert len(planted) > 150 and caught >= 0.97 * len(planted)
    clean = sum(len(w - set().union(*[set(range(a - 6, b + 6)) for e, a, b in planted if e == d])) for d, w in cover.items() if any(e == d for e, _, _ in planted))
    assert clean <= 0.01 * sum(b - a for _, a, b in planted)


def test_a_passage_deep_in_very_long_texts(spark):
    rnd = random.Random(13)
    texts = [[f"{k}v{rnd.randrange(10**6)}" for _ in range(250_000)] for k in (1, 2)]
    texts[1][200_000:200_080] = texts[0][120_000:120_080]
    got = duplicate_passages(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.start, r.end, r.source_id, r.source_start, r.equal) for r in got] == [(1, 200_000, 200_080, 0, 120_000, 76)]


def linked_parts(pairs):
    """The smallest of those that hang together with each."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def edited(rnd, passage, at):
    """The passage with one word replaced, deleted or inserted."""
    copy, kind = list(passage), rnd.randrange(3)
    copy[at : at + (kind < 2)] = [f"new{rnd.randrange(10**9)}"] * (kind != 1)
    return copy


def test_later_documents_meet_though_an_earlier_one_shares_their_minima(spark):
    """Two near copies of a passage, and before them documents that hold the stretch around each of its minima."""
    rnd = random.Random(21)
    docs, pairs = [], []
    for _ in range(60):
        t = text(rnd, 60)
        docs += [text(rnd, 20) + t[a : a + 28] + text(rnd, 20) for a in (0, 8, 16, 24, 32)]
        docs += [text(rnd, 30) + t + text(rnd, 30), text(rnd, 35) + edited(rnd, t, 30) + text(rnd, 30)]
        pairs.append((len(docs) - 1, len(docs) - 2))
    texts = [" ".join(w) for w in docs]
    want = {(b, a) for b, a in pairs if brute_force_near(texts[b].split(), texts[a].split())}
    assert len(want) == 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert want <= {(r.doc_id, r.source_id) for r in duplicate_passages(df).collect()}


def brute_force_near(x, y, n=5, least=50):
    """Whether any two passages that begin and end with common shingles are similar enough."""
    a, b = ([hash(tuple(w[i : i + n])) for i in range(len(w) - n + 1)] for w in (x, y))
    at = {v: j for j, v in enumerate(b)}
    both = [(i, at[v]) for i, v in enumerate(a) if v in at]
    width = least - n + 1
    for p, (i, j) in enumerate(both):
        for q, (k, m) in enumerate(both[p:], p):
            if k - i + 1 >= width and m - j + 1 >= width and 9 * (q - p + 1) >= 4 * (k - i + 1 + m - j + 1):
                return True
    return False


def test_no_similar_pair_of_a_frequent_line_is_lost(spark):
    """A line of 27 words in 150 documents, in some of them within passages that only two, or few, or many have in common."""
    rnd = random.Random(22)
    line, frame = text(rnd, 27), text(rnd, 40)
    docs = []
    for i in range(150):
        kind = i % 5
        if kind < 2:
            body = line
        elif kind == 2:  # a passage of two documents
            if i % 10 == 2:
                own = text(rnd, 15), text(rnd, 15)
            body = edited(rnd, own[0], 7) + line + own[1]
        elif kind == 3:  # a passage of many, a word of it different in each
            body = edited(rnd, frame[:20], 9) + line + frame[20:]
        else:  # 23 words more, too few to be similar with a gap
            body = line + frame[20:36]
        docs.append(" ".join(text(rnd, 40) + body + text(rnd, 40)))
    want = {(b, a) for b in range(len(docs)) for a in range(b) if brute_force_near(docs[b].split(), docs[a].split())}
    got = {(r.doc_id, r.source_id) for r in duplicate_passages(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert len(want) > 400 and got <= want
    assert linked_parts(got) == linked_parts(want)
    assert {b for b, _ in got} == {b for b, _ in want}
    assert {(b, a) for b, a in want if b % 5 == 2} <= got


def test_copies_of_whole_texts_among_near_ones(spark):
    rnd = random.Random(23)
    base = text(rnd, 70)
    near = [" ".join(edited(rnd, base, 20 + k)) for k in range(4)]
    rows = [(k * 100 + c, near[k]) for k in range(4) for c in range(30)]
    got = {(r.doc_id, r.source_id) for r in duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(linked_parts(got).values()) == {0} and {b for b, _ in got} == {i for i, _ in rows} - {0}
    assert len(got) <= len(rows) + 6


def test_a_frequent_minimum_is_worked_on_in_pieces():
    """20 000 windows of one line, pairs of which share more: memory holds ranges of their shingles, not all."""
    rng = np.random.default_rng(31)
    near = rng.integers(1, 1 << 32, (20_000, 273), dtype=np.uint32)
    near[:, 125:148] = np.arange(7, 30, dtype=np.uint32)
    near[1::2, 100:150] = near[::2, 100:150]
    tracemalloc.start()
    own, source, hot = cw._by_rare(near, 41)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(zip(own.tolist(), source.tolist())) == {(i + 1, i) for i in range(0, 20_000, 2)}
    assert set(hot.tolist()) == set(range(7, 30))
    assert most < 120 << 20


def test_runs_join_all_rows_of_other_texts():
    rng = np.random.default_rng(32)
    near = rng.integers(1, 1 << 32, (60, 273), dtype=np.uint32)
    near[:40, 120:170] = near[0, 120:170]
    near[40:, 92:137] = near[40, 92:137]  # a shingle less than width
    text = np.arange(60) // 2
    pairs = np.concatenate(cw._by_runs(near, text, 46), 1)
    assert (text[pairs[0]] != text[pairs[1]]).all()
    assert linked_parts(pairs.T.tolist()) == dict.fromkeys(range(40), 0)


def test_each_place_of_a_text_meets_the_other_text():
    """Two unlike places of one text, each alike to a later text: neither stands for the other."""
    line = np.arange(100, 130, dtype=np.uint32)
    near = np.zeros((20, 273), np.uint32)
    for i in range(20):
        near[i, 120:150] = line
        near[i, 160 + i % 4 : 190 + i % 4] = np.arange(200, 230)  # a word more or less between two stretches
    text = np.repeat([0, 1], 10)
    own, source = cw._by_pattern(near, np.unique(near)[1:], text, 5, 46, 60, 30)
    assert set(own.tolist()) | set(source.tolist()) == set(range(20))
    assert (text[own] != text[source]).all()


def peak_of(run):
    tracemalloc.start()
    out = run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_patterns_of_a_frequent_minimum_stand_in_a_file():
    """20 000 windows, all of different patterns of frequent shingles: memory holds some thousand of them at once."""
    rng = np.random.default_rng(33)
    near = rng.integers(100, 300, (20_000, 273), dtype=np.uint32)
    near[:, 110:160] = np.arange(7, 57, dtype=np.uint32)
    (own, source), most = peak_of(lambda: cw._by_pattern(near, np.unique(near), np.arange(20_000) // 2, 5, 46, 80, 41))
    assert linked_parts(zip(own.tolist(), source.tolist())) == dict.fromkeys(range(20_000), 0)
    assert (own // 2 != source // 2).all()
    assert most < 150 << 20


class Batches:
    """Stands for a DataFrame of these batches."""

    def __init__(self, *batches):
        self.batches = batches

    def mapInArrow(self, run, schema):
        return Batches(*run(iter(self.batches)))

    def distinct(self):
        return self


def test_pairs_of_a_batch_are_verified_in_pieces():
    """2 000 pairs of texts with 300 minima each: of a batch from Spark, only some pairs' are Python objects at once."""
    rng = np.random.default_rng(34)
    texts = rng.integers(1, 1 << 32, (2000, 400), dtype=np.uint32)
    ats = np.tile(np.arange(300), len(texts))
    seeds = pa.StructArray.from_arrays([pa.array(ats + 1000), pa.array(np.full(len(ats), 993))], ["at", "shift"])
    numbers = {"doc_id": np.arange(2000) + 5000, "tag": np.arange(2000), "source_id": np.arange(2000), "source_tag": np.arange(2000), "low": np.full(2000, 1000), "source_low": np.full(2000, 7)}
    columns = {k: pa.array(v) for k, v in numbers.items()} | {"seeds": pa.ListArray.from_arrays(pa.array(np.arange(2001, dtype=np.int32) * 300), seeds)}
    columns |= {c: pa.array([x.tobytes() for x in texts], pa.binary()) for c in ("own", "other")}
    got, most = peak_of(lambda: cw._verified(Batches(pa.RecordBatch.from_pydict(columns)), 5, 46, 80))
    rows = pa.Table.from_batches(got.batches).to_pylist()
    assert rows == [{"doc_id": k + 5000, "tag": k, "start": 1000, "end": 1400, "source_id": k, "source_tag": k, "source_start": 7, "source_end": 407, "equal": 396} for k in range(2000)]
    assert most < 60 << 20


def test_gaps_of_a_few_words_cost_no_sort(monkeypatch):
    """Most of op4's gaps end within 16 shingles: there all places are compared at once."""
    rng = np.random.default_rng(35)
    cases = [(rng.integers(0, 60, rng.integers(1, 30)), rng.integers(0, 60, rng.integers(1, 30)), int(rng.integers(1, 40))) for _ in range(300)]

    def nearest(x, y, most):
        for size in (16, 32, 64):
            size = min(size, most)
            found = [(i + j, i, j) for i, a in enumerate(x[:size]) for j, b in enumerate(y[:size]) if a == b]
            if found or size == most:
                return min(found)[1:] if found else None

    def fail(*a, **b):
        raise AssertionError("sorted")

    monkeypatch.setattr(cw.np, "argsort", fail)
    got = [cw._next_equal(*c) for c in cases]
    monkeypatch.undo()
    assert got == [nearest(*c) for c in cases] and None in got


def test_equal_places_ahead():
    rng = np.random.default_rng(36)
    for m in (0, 1, 63, 64, 65, 200, 1000):
        x = rng.integers(0, 9, m)
        for at in {0, m // 2, m - 1, m} - {-1}:
            y = x.copy()
            y[at : at + 1] += 1
            assert cw._equal_ahead(x, np.r_[y, 1, 2]) == at

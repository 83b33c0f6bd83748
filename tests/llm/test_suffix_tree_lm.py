import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from semblance.llm import suffix_tree_lm as lm

from .test_words import words

END, BEGIN = b" end", b" begin"


def held(d):
    return d is None or zlib.crc32(str(d).encode()) % 10 == 0


def rows():
    rnd = random.Random(2)
    syllables = ["an", "ta", "ri", "so", "é", "k", "mo"]
    vocabulary = ["".join(rnd.choices(syllables, k=rnd.randrange(1, 5))) for _ in range(200)] + ["The", "a"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))][::-1]
    passages = [rnd.choices(vocabulary, k=30) for _ in range(8)]
    out = []
    for i in range(300):
        w = rnd.choices(vocabulary, weights, k=rnd.randrange(0, 120))
        if i % 3 == 0:
            at = rnd.randrange(len(w) + 1)
            w[at:at] = rnd.choice(passages)
        out.append((i, " ".join(w)))
    return out + [(301, None), (302, ""), (None, "The a"), (5, out[5][1]), (304, "the " * 7_000), (305, "\t\n  "), (306, " x" * 3)]


class Tree:
    """The same model from dictionaries."""

    def __init__(self, texts, depth, least=2, divergence=2.0, smoothing=2.0):
        self.depth, self.smoothing = depth, smoothing
        self.next = defaultdict(Counter)
        for ws in texts:
            line = [BEGIN, *ws, END]
            for t in range(1, len(line)):
                for k in range(min(depth, t) + 1):
                    self.next[tuple(line[t - k : t])][line[t]] += 1
        self.n = {c: sum(x.values()) for c, x in self.next.items()}
        self.tokens, self.symbols = self.n.get((), 0), len(self.next[()])
        self.kept = set()
        for c, follow in self.next.items():
            if c and self.n[c] >= least:
                s = c[1:]
                gain = sum(n * math.log(n * self.n[s] / (self.n[c] * self.next[s][w])) for w, n in follow.items())
                if gain > divergence * len(follow):
                    self.kept.add(c)

    def p(self, context, word):
        """Of the longest retained suffix of the context."""
        while context and context not in self.kept:
            context = context[1:]
        if not context:
            return (self.next[()][word] + 0.1) / (self.tokens + 0.1 * (self.symbols + 1))
        m = self.smoothing * len(self.next[context])
        return (self.next[context][word] + m * self.p(context[1:], word)) / (self.n[context] + m)

    def score(self, ws):
        line = [BEGIN, *ws, END]
        return sum(math.log10(self.p(tuple(line[max(0, t - self.depth) : t]), line[t])) for t in range(1, len(line)))


def expected(data, depth):
    texts = [(d, words(t)) for d, t in data]
    tree = Tree([ws for d, ws in texts if not held(d)], depth)
    c, n, v = tree.next[()], tree.tokens, tree.symbols
    out = []
    for d, ws in texts:
        ts = [*ws, END]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts)
        out.append((d, held(d), len(ts), sum(c[w] > 0 for w in ts), n, base, tree.score(ws)))
    return tree, sorted(out, key=str)


@pytest.mark.parametrize("depth,group_bytes", [(1, 12 << 20), (2, 20_000), (3, 900)])
def test_scores_of_whole_texts_are_those_of_the_tree(spark, depth, group_bytes):
    data = rows()
    df = spark.createDataFrame([(a, b, "k", 1.0) for a, b in data], "doc_id long, text string, row string, score double").repartition(3)
    got = sorted((tuple(r) for r in lm.score_texts(df, depth=depth, group_bytes=group_bytes).collect()), key=str)
    tree, want = expected(data, depth)
    assert len(tree.kept) > 50 and all(len([c for c in tree.kept if len(c) == k]) > 5 for k in range(1, depth + 1))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) and abs(g[6] - w[6]) < 1e-6 * max(1, abs(w[6])), (g, w)
    out = [g for g in got if g[1] and g[0] is not None]
    assert sum(g[6] for g in out) > sum(g[5] for g in out) and all(g[6] < 0 for g in got)


def test_distributions_add_up():
    tree, _ = expected(rows(), 2)
    seen = list(tree.next[()])
    for context in [(), *sorted(tree.kept)[::9]]:
        assert abs(sum(tree.p(context, w) for w in [*seen, b"never seen"]) - 1) < 1e-9


def test_pieces_hold_every_word_once_and_what_stands_before():
    rnd = random.Random(8)
    for depth in (1, 2, 3):
        for size in (1, 7, 40, 10_000):
            text = "".join(rnd.choices(["ab", "c", "déf" * 5, " ", "\n", "  \t"], k=200)).encode()
            done = []
            pieces = list(lm.pieces_of(text, size, depth))
            for k, (piece, skip, opens, last) in enumerate(pieces):
                ws = piece.split()
                assert skip == min(depth, len(done)) and ws[:skip] == done[len(done) - skip :] and last == (k == len(pieces) - 1)
                assert opens == (lm.FIRST if k == 0 else lm.AGAIN if len(done) <= depth else 0)
                done += ws[skip:]
            assert done == text.split()


def test_empty_and_untaught(spark):
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = next(i for i in range(100) if held(i))
    r = lm.score_texts(spark.createDataFrame([(only, "ab")], "doc_id long, text string")).first()
    assert r.train_tokens == 0 and r.n_known == 0 and r.n_tokens == 2 and abs(r.base_score) < 1e-9 and abs(r.score) < 1e-9


def test_scores_of_long_texts_grow_with_their_length(spark):
    rnd = random.Random(4)
    a, b = [i for i in range(1000, 1100) if held(i)][:2]
    ws = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=9)) for _ in range(40_000)]
    df = spark.createDataFrame([*rows()[:60], (a, " ".join(ws[:10_000])), (b, " ".join(ws))], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score_texts(df, group_bytes=50_000).where(f"doc_id in ({a}, {b})").collect()}
    assert got[a] < -40_000 and 3.9 < got[b] / got[a] < 4.1

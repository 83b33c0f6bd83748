import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from semblance.llm import toxicity as tox
from semblance.llm.common import words_of
from semblance.llm.toxicity import fit_toxicity, score_toxicity

from .test_words import words


def corpus(n=900):
    rnd = random.Random(3)
    plain, rude = [f"p{i}" for i in range(400)], [f"rude{i}" for i in range(12)]
    docs, labels = [], []
    for i in range(n):
        w = rnd.choices(plain, k=rnd.randrange(20, 200)) + [f"once{rnd.randrange(10**9)}" for _ in range(5)]
        toxic = i % 5 == 0
        for _ in range(len(w) // 15 + 2 if toxic else 0):
            w[rnd.randrange(len(w))] = rnd.choice(rude).upper()
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_texts(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([(a, b, "x") for a, b in docs] + [(10_000, None, "x"), (10_001, "", "x"), (None, "no id", "x"), (1, docs[1][1], "x")], "doc_id long, text string, evidence string")
    lab = spark.createDataFrame(labels + [(2, None), (None, 1), (5, 0), (77_777, 1)], "doc_id long, toxic int")
    teach = F.col("doc_id") % 3 != 1
    model = fit_toxicity(d.select("doc_id", "text").where(teach), lab.where(teach))
    got = [(r.doc_id, r.score) for r in score_toxicity(d.select("doc_id", "text"), model).collect()]
    assert len(got) == len(docs) + 4 and all(0 <= s <= 1 for _, s in got)
    score, truth = dict(got), dict(labels)
    held = [i for i in truth if i % 3 == 1]
    right = sum((score[i] >= 0.7) == bool(truth[i]) for i in held)
    assert right >= 0.97 * len(held) and score[10_000] == score[10_001]


def test_one_class_or_none(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 1), (2, 1)], [(1, 0), (2, 1)]):
        model = fit_toxicity(d, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert [r.score for r in score_toxicity(d, model).collect()] == [0.0, 0.0]
    assert score_toxicity(d.limit(0), model).count() == 0


def hashed(text):
    (_, _, h, offsets, _, _), = words_of(pa.array([text], pa.large_string()))
    return h, offsets


class ByHand:
    """The same models from sets of word strings."""

    def __init__(self, texts):
        runs = [set(), set()]
        for text, toxic in texts:
            line = ["<<", "<", *(w.decode() for w in words(text))]
            runs[toxic] |= {tuple(line[i - 2 : i + 1]) for i in range(2, len(line))}
        pairs = [{x[1:] for x in r} for r in runs]
        self.seen = sorted({w for p in pairs for _, w in p})
        scale = [min(map(len, pairs)) / len(p) for p in pairs]
        self.n2 = [lambda u, w, k=k: scale[k] * sum(x[1:] == (u, w) for x in runs[k]) for k in (0, 1)]
        self.n1 = [{w: scale[k] * sum(x == w for _, x in pairs[k]) for w in self.seen} for k in (0, 1)]
        self.follow = {w: sum(x == w for _, x in pairs[0] | pairs[1]) for w in self.seen}

    def p(self, u):
        """[ordinary, toxic] distributions after u over the seen words and an unseen one."""
        total = sum(self.follow.values())
        shared = {w: (self.follow.get(w, 0) + 0.5) / (total + 0.5 * (len(self.seen) + 1)) for w in [*self.seen, None]}
        out = []
        pair = [{w: n(u, w) for w in self.seen} for n in self.n2]
        both = {w: pair[0][w] + pair[1][w] for w in self.seen}
        for k in (0, 1):
            n = sum(self.n1[k].values())
            taken = sum(min(x, tox.WORD) for x in self.n1[k].values()) / n
            q = {w: max(self.n1[k].get(w, 0) - tox.WORD, 0) / n + taken * s for w, s in shared.items()}

            def over(counts, back):
                c = sum(counts.values())
                mass = sum(min(x, tox.PAIR) for x in counts.values())
                return {w: (max(counts.get(w, 0) - tox.PAIR, 0) + mass * back[w]) / c for w in back} if c else back

            out.append(over(pair[k], over(both, q)))
        return out


def test_probabilities_are_those_of_the_definition_and_add_up(spark):
    rnd = random.Random(5)
    texts = [(" ".join(rnd.choices("abcdefgh", [9, 8, 5, 4, 3, 2, 2, 1], k=rnd.randrange(0, 40))), 0) for _ in range(30)]
    texts += [(" ".join(rnd.choices("abcdefghX", [1, 2, 9, 4, 3, 2, 2, 1, 6], k=rnd.randrange(0, 40))), 1) for _ in range(12)]
    texts += [texts[0], texts[0], texts[33]]
    rows = spark.createDataFrame([(t, 2 * y + i % 2) for i, (t, y) in enumerate(texts)], "text string, flag int")
    model, hand = tox._model(tox._pairs(rows), "o", "t"), ByHand(texts)
    assert len(model.pairs) > 20 and len(model.words) == len(hand.seen)
    names = [*hand.seen, "never"]
    w = hashed(" ".join(names))[0]
    for u in ["<", "a", "c", "x", "h", "never"]:
        before = np.full(len(w), tox.START if u == "<" else hashed(u)[0][0])
        got, want = model.probabilities(w, before), hand.p(u)
        assert np.allclose(got.sum(1), 1) and all(np.allclose(got[k], [want[k][x if x != "never" else None] for x in names]) for k in (0, 1))
        ratio = lambda m: np.log(np.divide(*m.probabilities(w, before)[::-1]))
        assert np.allclose(ratio(model), ratio(model.trimmed()))


def test_expressions_of_ordinary_words_and_their_order_count(spark):
    rnd = random.Random(6)
    plain = [f"p{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(900):
        w = rnd.choices(plain, k=60)
        for j in range(0, 60, 6):
            w[j : j + 2] = ["you", "fool"] if i % 4 == 0 else ["fool", "you"] if j % 12 else rnd.choices(["you", "fool"], k=1) + w[j + 1 : j + 2]
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    fitted = fit_toxicity(d.where("doc_id % 3 != 1"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in score_toxicity(d, fitted).collect()}
    held = [(i, y) for i, y in labels if i % 3 == 1]
    assert sum((got[i] >= 0.7) == bool(y) for i, y in held) >= 0.97 * len(held)


def test_labels_that_lie_on_long_texts_teach(spark):
    docs, labels = corpus(200)
    long = [(i, " ".join([t] * 250) if i % 5 == 0 else t) for i, t in docs]
    assert all(len(t) > 20_000 for i, t in long if i % 5 == 0)
    d = spark.createDataFrame(long, "doc_id long, text string")
    model = fit_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in score_toxicity(d, model).collect()}
    assert sum((got[i] >= 0.7) == bool(y) for i, y in labels) >= 0.95 * len(labels)


def test_very_long_texts_are_scored_whole(spark):
    docs, labels = corpus(300)
    rude = " ".join(t for i, t in docs if i % 5 == 0)
    calm = " ".join(t for i, t in docs if i % 5)
    long = calm * (1 + 3_000_000 // len(calm))
    d = spark.createDataFrame([*docs, (900, long), (901, long + " " + rude * (1 + len(long) // len(rude)))], "doc_id long, text string")
    fitted = fit_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in score_toxicity(d, fitted).collect()}
    assert got[900] < 0.3 and got[901] > 0.7

import random

import numpy as np
import pytest

from semblance.llm import language_crf as crf


@pytest.mark.parametrize("segment", [1, 3, 64])
def test_marginals_equal_forward_backward(monkeypatch, segment):
    monkeypatch.setattr(crf, "SEGMENT", segment)
    rng = np.random.default_rng(segment)
    scores, moves = rng.normal(size=(300, 3)) * 3, rng.normal(size=(3, 3))
    offsets = np.array([0, 1, 70, 70, 200, 264, 300])
    want = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        n = b - a
        if n:
            f, g = np.zeros((n, 3)), np.zeros((n, 3))
            f[0] = scores[a]
            for t in range(1, n):
                f[t] = np.logaddexp.reduce(f[t - 1][:, None] + moves, 0) + scores[a + t]
            for t in range(n - 2, -1, -1):
                g[t] = np.logaddexp.reduce(moves + (scores[a + t + 1] + g[t + 1])[None], 1)
            p = np.exp(f + g - (f + g).max(1, keepdims=True))
            want.append(p / p.sum(1, keepdims=True))
    assert np.allclose(np.concatenate(want), crf.marginals(scores, moves, offsets))


def log_partition(scores, moves, offsets):
    total = 0.0
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b > a:
            f = scores[a]
            for t in range(a + 1, b):
                f = np.logaddexp.reduce(f[:, None] + moves, 0) + scores[t]
            total += np.logaddexp.reduce(f)
    return total


@pytest.mark.parametrize("segment", [2, 64])
def test_marginals_and_expected_moves_are_the_gradient(monkeypatch, segment):
    """Of the likelihood's logarithm the derivatives are what is true less what is expected."""
    monkeypatch.setattr(crf, "SEGMENT", segment)
    rng = np.random.default_rng(9)
    scores, moves, offsets = rng.normal(size=(40, 3)) * 2, rng.normal(size=(3, 3)) * 2, np.array([0, 0, 1, 18, 18, 40])
    post, expected = crf.expected_moves(scores, moves, offsets)
    for value, want in ((scores, post), (moves, expected)):
        for at in [(0, 0), (1, 2), (2, 1), *([(17, 0), (18, 1), (39, 2)] if value is scores else [])]:
            sums = []
            for step in (1e-5, -1e-5):
                value[at] += step
                sums.append(log_partition(scores, moves, offsets))
                value[at] -= step
            assert abs((sums[0] - sums[1]) / 2e-5 - want[at]) < 1e-6
    assert abs(expected.sum() - 37) < 1e-9


PARTS = {"aa": ["ka", "lo", "ni", "tu", "é"], "bb": ["sch", "ung", "ver", "en", "ß"], "cc": ["ing", "th", "wh", "ou", "ed"]}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choices(PARTS[lang], k=rnd.randrange(1, 4))) for _ in range(n))


def test_held_out_languages_and_spans(spark):
    rnd = random.Random(1)
    rows = [(i, text(rnd, lang, rnd.randrange(3, 80)), lang, "s") for i in range(300) for lang in [rnd.choice(list(PARTS))]]
    odd = [(1000, None, "aa", "s"), (1001, "", "bb", "s"), (1002, "12 34 !?", "cc", "s"), (1003, text(rnd, "aa", 4000), None, "s"), (None, text(rnd, "bb", 9), "bb", "s"), (1004, text(rnd, "cc", 30) + " " + text(rnd, "bb", 20), "cc", "s")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    model = crf.fit_crf(df.where("doc_id % 3 != 1"), docs_per_language=60)
    got = {r.doc_id: r for r in crf.tag_languages(df, model, spans=True).collect()}
    assert len(got) == len(rows) + len(odd)
    held = [r for r in rows if r[0] % 3 == 1]
    assert sum(got[i]._lang_pred == lang for i, _, lang, _ in held) >= 0.98 * len(held)
    assert [got[i]._lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "aa", "bb"] and got[1002]._lang_score == 0
    spans = got[1004]._spans
    assert spans[0].start == 0 and spans[-1].end == 50 and all(a.end == b.start for a, b in zip(spans, spans[1:]))
    labels = [s.lang for s in spans for _ in range(s.start, s.end)]
    assert sum(x == y for x, y in zip(labels, ["cc"] * 30 + ["bb"] * 20)) >= 46
    assert got[1004].score == "s" and got[1000]._spans == []


def test_nothing_labelled(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "x")], "doc_id long, text string, lang string")
    model = crf.fit_crf(df)
    assert [(r._lang_pred, r._lang_score) for r in crf.tag_languages(df, model).collect()] == [("und", 0.0)] * 2
    assert crf.tag_languages(df.limit(0), model).count() == 0


def test_a_text_without_blanks_is_seen_whole(spark):
    rnd = random.Random(5)
    rows = [(i, text(rnd, lang, 40), lang) for i in range(120) for lang in [rnd.choice(list(PARTS))]]
    model = crf.fit_crf(spark.createDataFrame(rows, "doc_id long, text string, lang string"), docs_per_language=60)
    long = text(rnd, "aa", 12).replace(" ", "") + "".join(text(rnd, "bb", 2000).split())
    got = crf.tag_languages(spark.createDataFrame([(1, long), (2, "x " + long + " " + text(rnd, "cc", 9))], "doc_id long, text string"), model, spans=True).collect()
    assert [r._lang_pred for r in got] == ["bb", "bb"] and got[0]._lang_score > 0.9
    assert [(s.start, s.end) for s in got[0]._spans] == [(0, 1)] and got[1]._spans[-1].end == 11


def test_pieces_cover_all_bytes_and_have_the_grams_of_the_whole():
    data = np.frombuffer(("ab " + "é語x" * 100).encode(), np.uint8)
    starts, ends = np.array([0, 3]), np.array([2, len(data)])
    _, offsets, s, e, opens, closes, word = crf.pieces_of(data, np.array([5, 6], np.uint64), np.array([0, 1, 2]), starts, ends)
    assert s[0] == 0 and e[0] == 2 and s[1] == 3 and e[-1] == len(data) and (s[2:] == e[1:-1]).all() and offsets.tolist() == [0, 1, len(s)]
    assert ((data[s] & 192) != 128).all() and (e - s).max() <= crf.WORD_BYTES + 3 and word.tolist() == [0] + [1] * (len(s) - 1)
    whole, parts = crf.grams_of(data, starts, ends)[0], crf.grams_of(data, s, e, opens, closes)[0]
    assert sorted(whole.tolist()) == sorted(parts.tolist())


def test_languages_of_long_texts_and_rare_languages_are_learned(spark):
    rnd = random.Random(6)
    rows = [(i, text(rnd, "aa", 40), "aa") for i in range(60)] + [(i, text(rnd, "cc", 9000), "cc") for i in range(60, 70)]
    assert all(len(t) > 20_000 for i, t, _ in rows[60:])
    model = crf.fit_crf(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = crf.tag_languages(spark.createDataFrame([(1, text(rnd, "cc", 50)), (2, text(rnd, "aa", 50))], "doc_id long, text string"), model).collect()
    assert [r._lang_pred for r in got] == ["cc", "aa"]
    many = spark.createDataFrame([(i, f"word{i}", f"l{i:03}") for i in range(300)], "doc_id long, text string, lang string")
    assert len({r.label for r in crf.sample_of(many, "lang", 5, 100)}) == 300

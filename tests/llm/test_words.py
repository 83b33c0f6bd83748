import random
import re

import numpy as np
import pyarrow as pa
import pytest

from semblance.llm import common

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_words_are_those_of_the_pattern(monkeypatch, block):
    monkeypatch.setattr(common, "BLOCK", block)
    rnd = random.Random(block)
    texts = [None, "", " ", "a", "A a", "é É x y", "\x0b\x0cq\x1cz\x85", "x" * 300, "w " * 200, *("".join(rnd.choice("abAB \n\té") for _ in range(rnd.randrange(60))) for _ in range(80))]
    column = pa.array(["skip", *texts], pa.string())[1:]
    data, _ = common.text_buffers(column)
    seen, by_hash, row = [], {}, 0
    for first, rows, hashes, offsets, starts, ends in common.words_of(column):
        assert first == row and len(offsets) == rows + 1 and offsets[0] == 0 and offsets[-1] == len(hashes)
        row += rows
        for r in range(rows):
            got = [data[s:e].tobytes().translate(LOWER) for s, e in zip(starts[offsets[r] : offsets[r + 1]], ends[offsets[r] : offsets[r + 1]])]
            seen.append(got)
            for w, h in zip(got, hashes[offsets[r] : offsets[r + 1]].tolist()):
                assert by_hash.setdefault(w, h) == h
    assert seen == [words(t) for t in texts] and len(set(by_hash.values())) == len(by_hash)


def test_shingles():
    hashes = np.arange(1, 8, dtype=np.uint64)
    offsets = np.array([0, 0, 2, 7])
    s, rows = common.shingles_of(hashes, offsets, 3)
    assert rows.tolist() == [1, 2, 2, 2]
    again, _ = common.shingles_of(hashes[2:], np.array([0, 5]), 3)
    assert s[1:].tolist() == again.tolist() and len(set(s.tolist())) == 4
    assert common.shingles_of(hashes, offsets, 3, whole=False)[1].tolist() == [2, 2, 2]
    assert len(common.shingles_of(hashes[:0], np.array([0, 0]), 3)[0]) == 0


def test_runs():
    assert common.runs_of(np.zeros(0)) == [] and common.runs_of(np.array([1, 1, 2]), np.array([1, 2, 2])) == [(0, 1), (1, 2), (2, 3)]

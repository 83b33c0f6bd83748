import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from semblance.llm.packing import Bins, is_wordwise, pack_documents, pack_group

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(pieces, docs, capacity):
    """docs: (id, ids) rows; every id of every row lies in one piece, sequences have no gaps."""
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append(p)
        by_doc[p.doc_id, p.doc_tokens].append(p)
    for rows in by_seq.values():
        rows.sort(key=lambda p: p.offset)
        at = 0
        for p in rows:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
    want = defaultdict(int)
    for doc, ids in docs:
        for i, x in enumerate(ids):
            want[doc, i, x] += 1
    for p in pieces:
        for i, x in enumerate(np.frombuffer(p.ids, "<u4").tolist()):
            want[p.doc_id, p.start + i, x] -= 1
        assert zlib.crc32(p.ids) >= 0 and len(p.ids) == 4 * p.length
    assert not any(want.values())
    return sum(0 if (n := sum(p.length for p in rows)) & (n - 1) == 0 else capacity - n for rows in by_seq.values())


def test_pieces_hold_every_id_once(spark):
    t = Tokenizer.from_file(PATH)
    rnd = random.Random(1)
    texts = [None, "", " \n", "Hello, world's <|endoftext|> 12 don't", "é́ ẛ̣ ﬁ İI ΣΑΣ  x y \x1c \x85z", "word " * 9000, "x" * 5000, "日本語 テキスト", *(" ".join(rnd.choice(["the", "Rain", "in.", "spain\n", "42", "naïve"]) for _ in range(rnd.randrange(400))) for _ in range(60))]
    rows = [(i if i != 3 else None, x, "clash", b"k") for i, x in enumerate(texts)] + [(5, texts[5], "c", b""), (5, texts[5], "c", b""), (5, "other", "c", b"")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, ids binary")
    pieces = pack_documents(df, PATH, group_tokens=4000).collect()
    docs = [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows]
    total = sum(len(d[1]) for d in docs)
    assert check(pieces, docs, 2048) < 0.1 * total
    again = pack_documents(df, PATH, group_tokens=4000).collect()
    assert sorted(map(str, again)) == sorted(map(str, pieces))


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_groups():
    rnd = random.Random(3)
    for trial in range(60):
        sizes = [rnd.randrange(1, rnd.choice([5, 40, 300])) for _ in range(rnd.randrange(1, 60))]
        sequences = pack_group(sizes, 64, 4)
        left = {(k, i) for k, n in enumerate(sizes) for i in range(n)}
        for seq in sequences:
            assert 0 < sum(x[2] for x in seq) <= 64
            for k, start, n in seq:
                for i in range(start, start + n):
                    left.remove((k, i))
        assert not left


def test_bins_take_the_first_that_fits():
    rnd = random.Random(4)
    tree, room = Bins(50, 100), [100] * 64
    for _ in range(50):
        n = rnd.randrange(1, 100)
        want = next(i for i, r in enumerate(room) if r >= n)
        room[want] -= n
        assert tree.place(n) == want


def test_tokenizers_that_need_whole_texts_get_them(spark):
    for name, wordwise in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            assert is_wordwise(t, file.read()) == wordwise
    texts = [None, "", "Hello World  hello world\n", " x" * 3000, "The the THE", "Café  <|endoftext|> z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = pack_documents(df, public_tokenizers.path("byte_bpe_50k.json"), group_tokens=2000).collect()
    check(pieces, [(i, t.encode(x or "", add_special_tokens=False).ids + [1]) for i, x in enumerate(texts)], 2048)

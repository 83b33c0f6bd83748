"""Packing of tokenised documents into fixed-length sequences (operator 10).

First-fit decreasing with a tournament tree of bin capacities, run independently in randomised groups of
documents. A group is the documents of one shuffle partition, in the order of a random key, cut whenever
``group_tokens`` tokens are together; so no task holds more than that and one document.

Documents are cut into full sequences first; what remains of each goes through first-fit decreasing. Then the
emptiest bins of the group are dissolved into the gaps of the others, in pieces of at least ``least_piece``
tokens, and the one bin left with a gap is split into sequences whose lengths are powers of two, which need
no padding.

Any tokenizer of the tokenizers library will do. Of one that works word by word and lowers the case, which is tested,
each word is encoded once; others encode whole texts.

Defined results: a null or empty text is the end token alone; rows that repeat an id, or are alike in every
column, are documents of their own; a null id stays null; other columns are ignored; an empty table packs into
no sequences.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, lean, mix, text_buffers, words_of

_models: dict[int, "_Words"] = {}
#: Words whose ids a worker remembers, about 30 bytes each.
CACHE_WORDS = 1_500_000


#: Texts whose ids a tokenizer that works word by word, and lowers the case, gets from their runs alone.
_PROBES = ["A b", " It's  10,000.5\t(x)\n\nÉté ", "don't STOP! e.g. a_b-c", "\r\nÜber\x0bstraße\x0c日本 語 x²  ", "MiXeD cAsE \u00a0 no\u2003break", "a  b", "<| x |>"]


def is_wordwise(tokenizer, spec: str) -> bool:
    """Whether the ids of a text are those of its runs between ASCII white space, whatever the case of A-Z.

    Special tokens have a case; all of them must have ``<|`` in them, for runs with that are encoded as they are.
    """
    parts = json.loads(spec)
    if any("<|" not in t["content"] for t in parts.get("added_tokens") or []) or '"Lowercase"' not in json.dumps(parts.get("normalizer")):
        return False
    encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    lower = {i: i + 32 for i in range(65, 91)}
    return all(encode(x) == [i for run in x.encode().split() for i in encode(run.decode().translate(lower))] for x in _PROBES)


class _Words:
    """A tokenizer and the ids of words it has seen, in a few flat arrays.

    A wordwise tokenizer gives runs between ASCII white space, alike but for A-Z, the same ids, so they are encoded
    once; only a run with ``<|`` may hold a special token, which has case. Others are given whole texts.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.wordwise = is_wordwise(self.tokenizer, spec)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.forget()

    def forget(self) -> None:
        self.hashes, self.start, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, self.kind)

    def encode(self, runs: list[bytes]) -> list[list[int]]:
        out = []
        for i in range(0, len(runs), 20_000):
            out += [e.ids for e in self.tokenizer.encode_batch_fast([r.decode() for r in runs[i : i + 20_000]], add_special_tokens=False)]
        return out

    def learn(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        size = np.fromiter((len(x) for x in ids), np.int32, len(ids))
        start = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in ids for i in x), self.kind, int(size.sum()))])
        both = np.concatenate([self.hashes, hashes])
        order = np.argsort(both, kind="stable")
        self.hashes, self.start, self.size = both[order], np.concatenate([self.start, start])[order], np.concatenate([self.size, size])[order]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return at, self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)


def _model(spec: str) -> _Words:
    key = hash(spec)
    if key not in _models:
        _models[key] = _Words(spec)
    return _models[key]


def _encode(column: pa.Array, spec: str, end_id: int):
    """Yields (first row, ids of each row and then end_id, as little-endian bytes)."""
    model = _model(spec)
    if not model.wordwise:
        yield from _encode_whole(column, model, end_id)
        return
    data, _ = text_buffers(column)
    for first, rows, hashes, offsets, starts, ends in words_of(column):
        words, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(model.hashes) + len(words) > CACHE_WORDS:
            model.forget()
        _, known = model.find(words)
        new = np.flatnonzero(~known)
        if len(new):
            model.learn(words[new], model.encode([data[starts[i] : ends[i]].tobytes() for i in at[new]]))
        place, _ = model.find(words)
        start, size = model.start[place][which], model.size[place][which].astype(np.int64)
        pool = model.ids
        odd = _with_special(data, starts, ends)
        if len(odd):
            own = model.encode([data[starts[i] : ends[i]].tobytes() for i in odd])
            size[odd] = [len(x) for x in own]
            start[odd] = len(pool) + np.cumsum(size[odd]) - size[odd]
            pool = np.concatenate([pool, np.array([i for x in own for i in x], model.kind)])
        counts = np.diff(offsets)
        row = np.repeat(np.arange(rows), counts)
        total = int(size.sum())
        begin = np.cumsum(size) - size
        out = np.full(total + rows, end_id, model.kind)
        out[np.repeat(row, size) + np.arange(total)] = pool[np.repeat(start - begin, size) + np.arange(total)]
        lengths = np.bincount(row, size, minlength=rows).astype(np.int64) + 1
        edges = np.concatenate([[0], np.cumsum(lengths)]) * model.kind.itemsize
        yield first, pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(out)])


def _encode_whole(column: pa.Array, model: _Words, end_id: int):
    for first in range(0, len(column), 256):
        texts = [(x or "").encode() for x in column.slice(first, 256).to_pylist()]
        yield first, pa.array([np.array([*ids, end_id], model.kind).tobytes() for ids in model.encode(texts)], pa.large_binary())


def _with_special(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of the runs that hold ``<|``."""
    if not len(starts):
        return np.zeros(0, np.int64)
    a, b = int(starts[0]), int(ends[-1])
    block = data[a:b]
    hits = np.flatnonzero((block[:-1] == 60) & (block[1:] == 124)) + a
    at = np.unique(np.searchsorted(starts, hits, "right") - 1)
    return at[(at >= 0)]


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(key, doc_id, ids): a random key, which the row's content and its place among its equals decide."""
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())  # a tokenizer's file: of fixed size

    def run(batches):
        import zlib

        seen: dict[tuple, int] = {}
        for batch in batches:
            names = batch.column("doc_id")
            for first, ids in _encode(batch.column("text"), spec.value, end_id):
                docs, keys = names.slice(first, len(ids)), []
                for doc, x in zip(docs.to_pylist(), ids, strict=True):
                    what = (doc, zlib.crc32(x.as_buffer()), x.as_buffer().size)
                    seen[what] = place = seen.get(what, -1) + 1
                    keys.append(hash((*what, place)) & 0xFFFFFFFFFFFFFFFF)
                key = mix(np.array(keys, np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), docs, ids.cast(pa.binary())], ["key", "doc_id", "ids"])

    return docs.mapInArrow(lean(run), "key long, doc_id long, ids binary")


class Bins:
    """Bins of one capacity under a tournament tree: each node holds the largest room below it."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for size, which is then taken."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        found = node - self.leaves
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
        return found


def pack_group(sizes: list[int], capacity: int, least_piece: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token of the documents once."""
    full: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int]] = []
    for k, n in enumerate(sizes):
        whole = n // capacity
        full += [[(k, i * capacity, capacity)] for i in range(whole)]
        if n % capacity:
            rest.append((n % capacity, k))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree = Bins(max(1, len(rest)), capacity)
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(len(rest))]
    for n, k in rest:
        bins[tree.place(n)].append((k, sizes[k] - n, n))
    bins = [b for b in bins if b]
    fill = [sum(x[2] for x in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (fill[i], -i))
    gaps = [i for i in reversed(order) if capacity - fill[i] >= least_piece]  # the fullest first
    free = sum(capacity - fill[i] for i in gaps)
    dissolved: set[int] = set()
    for i in order:
        if capacity - fill[i] < least_piece or free - (capacity - fill[i]) < fill[i]:
            break
        gaps.pop()
        free -= capacity - fill[i]
        at, pieces = 0, bins[i]
        for doc, start, n in pieces:
            while n and at < len(gaps):
                j = gaps[at]
                room = capacity - fill[j]
                if room == 0:
                    at += 1
                    continue
                take = min(n, room)
                bins[j].append((doc, start, take))
                fill[j] += take
                free -= take
                start, n = start + take, n - take
        gaps = [j for j in gaps[at:] if capacity - fill[j] > 0]
        dissolved.add(i)
    out = full
    ragged = [i for i in range(len(bins)) if i not in dissolved and capacity - fill[i] >= least_piece]
    for i, pieces in enumerate(bins):
        if i in dissolved:
            continue
        out += _powers_of_two(pieces, fill[i]) if i in ragged[:1] else [pieces]
    return out


def _powers_of_two(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    out, left = [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            need, seq = 1 << bit, []
            while need:
                doc, start, n = left.pop()
                take = min(n, need)
                seq.append((doc, start, take))
                need -= take
                if take < n:
                    left.append((doc, start + take, n - take))
            out.append(seq)
    return out


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1,
    group_tokens: int = 4 << 20, least_piece: int = 16,
) -> DataFrame:
    """One row for each piece: doc_id, start, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    rows = tokenize(keyed_texts(docs, id_col, text_col), tokenizer_path, end_id)
    dealt = rows.repartition("key").sortWithinPartitions("key", "doc_id", "ids")
    with open(tokenizer_path, encoding="utf-8") as file:
        from tokenizers import Tokenizer

        kind = np.dtype("<u2" if Tokenizer.from_str(file.read()).get_vocab_size() <= 65536 else "<u4")
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def packed(group: list[tuple], first: int):
        sequences = pack_group([len(x[1]) for x in group], capacity, least_piece)
        out: list[tuple] = []
        size = 0
        for number, pieces in enumerate(sequences, first):
            offset = 0
            for k, start, n in pieces:
                doc, ids = group[k]
                out.append((doc, start, n, ids[start : start + n].astype("<u4").tobytes(), len(ids), number, offset))
                offset += n
                size += n
            if size > 1 << 20:
                yield out
                out, size = [], 0
        if out:
            yield out

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        used, group, tokens = 0, [], 0

        def flush():
            nonlocal used, group, tokens
            last = 0
            for part in packed(group, base + used):
                last = part[-1][5] - base + 1
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if isinstance(x[0], bytes) else pa.int64()) for x in zip(*part, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            used, group, tokens = max(used, last), [], 0

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                group.append((doc, np.frombuffer(ids.as_buffer(), kind)))
                tokens += len(group[-1][1])
                if tokens >= group_tokens:
                    yield from flush()
        if group:
            yield from flush()

    return dealt.mapInArrow(lean(run), schema)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

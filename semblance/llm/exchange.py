"""Questions of groups of texts to hash ranges, and their answers.

Texts are packed into groups of some megabytes, each one row. A group asks about keys, 64-bit hashes of words, runs of
words or sets, each key once, with numbers of its own; it sends one message to each range of hashes. A range puts
together what all groups say of a key and answers each message in its order. So a key has at most one entry for each
group, however many texts hold it, and neither groups nor ranges grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import lean, runs_of

#: Kind of the rows that hold a group's texts; kinds of messages are greater.
TEXTS = 0
ROWS_OF_GROUP = 200_000
MESSAGE = "part long, g long, kind int, blob binary"
ANSWER = "g long, kind int, part long, blob binary, symbols long, total long"
GROUP = ["g", "kind", "part", "blob"]
#: A range's answers to all entries of a kind, from (kind, key of each entry, number of keys, numbers of each, group of each).
Answers = Callable[[int, np.ndarray, int, np.ndarray, np.ndarray], np.ndarray]


class Packer:
    """Collects rows of one task into groups."""

    def __init__(self, fields: list[tuple[str, pa.DataType]], group_bytes: int):
        self.fields, self.group_bytes = fields, group_bytes
        self.held: list[list] = [[] for _ in fields]
        self.group, self.size = TaskContext.get().partitionId() << 32, 0

    def add(self, values: tuple, size: int):
        """Yields a group when one is full."""
        for x, value in zip(self.held, values, strict=True):
            x.append(value)
        self.size += size
        if self.size >= self.group_bytes or len(self.held[0]) >= ROWS_OF_GROUP:
            yield from self.flush()

    def flush(self):
        if not self.held[0]:
            return
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(self.held, self.fields, strict=True)], [name for name, _ in self.fields])
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([self.group], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["g", "blob"])
        self.held, self.group, self.size = [[] for _ in self.fields], self.group + 1, 0


def unpacked(blob) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    part = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return part.astype(np.uint16 if ranges <= 65536 else np.uint32)


def distinct(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, range by range as they occur, and the place of each key among them."""
    which, found = pd.factorize(keys)
    order = np.argsort(range_of(found, ranges), kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    return found[order], place[which]


def numbers(x: np.ndarray) -> bytes:
    """Counts, most of which are small, a byte each."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype(np.int64).tobytes()


def read_numbers(data: np.ndarray, n: int) -> np.ndarray:
    out = data[:n].astype(np.int64)
    out[out == 255] = np.frombuffer(data[n:].tobytes(), np.int64)
    return out


def question(g: int, kind: int, ranges: int, keys: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """Messages of distinct keys, 48 bits of each beside its range, with counts (whole numbers) or sums (then in single precision).

    Bytes stand by place, which compresses.
    """
    part = range_of(keys, ranges)
    out = []
    for a, b in runs_of(part):
        planes = keys[a:b].view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()
        rest = b"".join(numbers(x[a:b]) if x.dtype.kind == "i" else x[a:b].astype("<f4").tobytes() for x in values)
        out.append((int(part[a]), g, kind, np.uint32(b - a).tobytes() + planes + rest))
    return out


def messages(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.table([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["part", "g", "kind", "blob"])


def answers_to(asked: DataFrame, ranges: int, answers: Answers, sums: int = 1 << 30, counted: int = -1) -> DataFrame:
    """(g, kind, part, blob, symbols, total): the answers to each message, in its order.

    Kinds from sums on carry two single-precision sums, others a count. Of the kind counted, with g null: how many of
    a range's keys have an answer above 0, and the total of these.
    """

    def run(key, table):
        rows, part = [], int(key[0].as_py())
        groups, kinds, blobs = table.column("g").to_numpy(), table.column("kind").to_numpy(), table.column("blob")
        for kind in np.unique(kinds).tolist():
            mine = np.flatnonzero(kinds == kind)
            mine = mine[np.argsort(groups[mine], kind="stable")]  # so that sums do not depend on who was first
            keys, values = [], []
            for i in mine.tolist():
                data = np.frombuffer(blobs[i].as_buffer(), np.uint8)
                n = int(data[:4].view(np.uint32)[0])
                wide = np.zeros((n, 8), np.uint8)
                wide[:, :6] = data[4 : 4 + 6 * n].reshape(6, n).T
                keys.append(wide.view(np.uint64).ravel())
                rest = data[4 + 6 * n :]
                values.append(np.frombuffer(rest.tobytes(), "<f4").reshape(2, n).astype(float) if kind >= sums else read_numbers(rest, n)[None])
            size = np.array([len(k) for k in keys])
            which, found = pd.factorize(np.concatenate(keys))
            out = answers(kind, which, len(found), np.concatenate(values, 1), np.repeat(groups[mine], size))
            if kind == counted:
                each = np.zeros(len(found), np.int64)
                each[which] = out
                rows.append((None, 0, part, None, int((each > 0).sum()), int(each.sum())))
            for i, a, b in zip(mine.tolist(), np.cumsum(size) - size, np.cumsum(size), strict=True):
                rows.append((int(groups[i]), kind, part, np.uint32(b - a).tobytes() + numbers(out[a:b]), 0, 0))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], [c.split()[0] for c in ANSWER.split(", ")])

    return asked.repartition(ranges, "part").groupBy("part").applyInArrow(lean(run), ANSWER)


def by_group(parts: list[DataFrame], groups: int):
    """Groups' texts and answers, to be worked on together."""
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    return rows.repartition(groups, "g").groupBy("g")


def answered(table: pa.Table) -> tuple[int, object, dict[int, np.ndarray]]:
    """(g, its texts' blob, answers to each kind in the order of its keys) of a group's rows."""
    found: dict[int, list[tuple[int, np.ndarray]]] = {}
    texts = None
    for i, (kind, part) in enumerate(zip(table.column("kind").to_pylist(), table.column("part").to_pylist(), strict=True)):
        blob = table.column("blob")[i].as_buffer()
        if kind == TEXTS:
            texts = blob
        else:
            data = np.frombuffer(blob, np.uint8)
            found.setdefault(kind, []).append((part, read_numbers(data[4:], int(data[:4].view(np.uint32)[0]))))
    return table.column("g")[0].as_py(), texts, {kind: np.concatenate([x for _, x in sorted(parts, key=lambda p: p[0])]) for kind, parts in found.items()}

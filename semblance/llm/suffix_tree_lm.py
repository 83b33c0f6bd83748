"""Language-model scores from a probabilistic suffix tree over words (operator 6).

Symbols are words, one end for each text, and one symbol for all words that training has not seen. A context is the
last one to ``depth`` words before a symbol, the beginning of the text counting as a word. The tree holds the empty
context and every context c that stands at least ``least`` times in training and whose next-symbol distribution
diverges from that of its suffix s, the context without its oldest word: the log-likelihood gain
sum over w of n(c, w) log(n(c, w) n(s) / (n(c) n(s, w))) must exceed ``divergence`` nats for each of the t(c)
different symbols after c, so the test asks more of contexts that say more, however often they stand.

The root's distribution is that of the base, (n(w) + 0.1) / (N + 0.1 (V + 1)), which with the unseen words' symbol
adds up to 1. The distribution of a retained context is smoothed with that of its longest retained proper suffix,
P(w | c) = (n(c, w) + m P(w | suffix)) / (n(c) + m) with m = ``smoothing`` t(c), which adds up to 1 too. Every symbol
is scored in the state of its longest retained suffix; a text's score is the sum of their log10, in double
precision, each occurrence by itself.

The tree is never in one place. Texts are packed into groups of about ``group_bytes``. In each round every group
asks for what it does not know of the runs of words in its texts: it sends their hashes (48 bits beside the range
of 64), each once, with its own sums, to hash ranges, which add up and answer each group in the order of its question. So a key has at most one
entry for each group, however frequent it is, and no range grows with the documents that hold a word.

* Round 0: counts of words and of pairs.
* Round j, for contexts of j words: gain and t; and the counts of runs of j + 2 words whose context may be retained.
* Last: each group scores its texts.

Nothing that grows with the corpus is broadcast or collected. Of partial sums of gain and t only single precision is
sent; t is rounded to a whole number.

Defined results: null and empty texts are the end alone; texts of more than group_bytes are worked on in pieces,
with the same sums; repeated rows count as often as they stand and are scored alike; without training texts
every symbol is the unseen one and base and score are 0; an empty table gives no rows; other columns are ignored. A
null id counts as held out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .common import crc_fold, keyed_texts, lean, mix, read_table, _SPACE, words_of
from .exchange import GROUP, MESSAGE, TEXTS, Packer, answered, answers_to, by_group, distinct, messages, question, unpacked

#: Hashes of the end and the beginning of a text; what tells runs of words apart from words.
END, BEGIN, _STEP = np.uint64(1), np.uint64(2), np.uint64(0x9E3779B97F4A7C15)
#: Kinds of questions: 1, 2, … ask the counts of runs of so many words, SUMS + j of contexts of j words.
SUMS = 100
FIRST, AGAIN = 2, 1
_FIELDS = [("row", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("skip", pa.int64()), ("opens", pa.int64()), ("last", pa.bool_()), ("text", pa.large_binary())]
_SCORES = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


# ---- groups of texts


def pieces_of(data: bytes, size: int, depth: int):
    """(text, words that it repeats, opens, whether it ends the text) of pieces of about size bytes.

    A piece begins with the depth words before it, which are its first one's contexts. opens: FIRST of a text's first
    piece, AGAIN of others that the text's beginning is a context of, else 0.
    """
    at, before, opens = 0, b"", FIRST
    while True:
        to = len(data)
        if to - at > size:
            spaces = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, size, at)])
            if len(spaces):
                to = at + int(spaces[-1]) + 1
            else:
                rest = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, -1, at + size)])
                to = at + size + int(rest[0]) + 1 if len(rest) else to
        text = before + data[at:to]
        yield text, len(before.split()), opens, to == len(data)
        if to == len(data):
            return
        words = text.rsplit(None, depth)
        opens = AGAIN if opens and len(words) <= depth else 0
        at, before = to, b" ".join(words[-depth:]) + b" "


def packed_texts(texts: DataFrame, group_bytes: int, depth: int) -> DataFrame:
    """(g, blob): texts of about group_bytes together, compressed, from rows with doc_id, text, held_out."""

    def run(batches):
        packer, row = Packer(_FIELDS, group_bytes), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string()).cast(pa.large_binary())
            for doc, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), texts, strict=True):
                for piece, skip, opens, last in pieces_of(text.as_py() or b"", group_bytes, depth):
                    yield from packer.add((row, doc, out, skip, opens, last, piece), len(piece))
                row += 1
        yield from packer.flush()

    return texts.select("doc_id", "text", "held_out").mapInArrow(lean(run), "g long, blob binary")


class Group:
    """The symbols of a group's texts, the runs of words that end at each, and what is known of them."""

    def __init__(self, blob: bytes, ranges: int, depth: int, least: int, divergence: float):
        self.texts = unpacked(blob)
        column = lambda c: self.texts.column(c).to_numpy()
        opens, last, skip, self.held = column("opens"), column("last"), column("skip"), column("held")
        text = self.texts.column("text").combine_chunks().cast(pa.large_string())
        seq, row, place, own = [], [], [], []
        for first, rows, hashes, offsets, _, _ in words_of(text):
            b, e = (opens[first : first + rows] > 0).astype(np.int64), last[first : first + rows].astype(np.int64)
            size = np.diff(offsets) + b + e
            begin = np.cumsum(size) - size
            out, is_word = np.empty(int(size.sum()), np.uint64), np.ones(int(size.sum()), bool)
            starts, ends = begin[b > 0], (begin + size - 1)[e > 0]
            is_word[starts] = is_word[ends] = False
            out[starts], out[ends], out[is_word] = BEGIN, END, hashes
            which = np.repeat(np.arange(rows), size)
            at = np.arange(len(out)) - begin[which]
            index = at - b[which]  # -1: the beginning
            counted = np.where(index < 0, opens[first : first + rows][which] == FIRST, index >= skip[first : first + rows][which])
            seq.append(out)
            row.append(which + first)
            place.append(at)
            own.append(counted)
        self.seq, self.row, self.place, self.own = (np.concatenate(x).astype(kind, copy=False) if x else np.zeros(0, kind) for x, kind in ((seq, np.uint64), (row, np.int32), (place, np.int32), (own, bool)))
        self.train, self.scored = ~self.held[self.row], self.own & (self.seq != BEGIN)
        self.ranges, self.depth, self.least, self.divergence = ranges, depth, least, divergence
        keys = mix(self.seq * _STEP)
        self.keys = [None, keys]  # of the runs of 1, 2, … symbols that end at each place
        for _ in range(depth):
            longer = np.zeros_like(keys)
            longer[1:] = mix(keys[:-1] * _STEP + self.seq[1:])
            self.keys.append(longer)
            keys = longer
        self.counts: list = [None]

    def before(self, x: np.ndarray, k: int) -> np.ndarray:
        """x at the place before each, where k symbols of the text stand before it, and 0 elsewhere."""
        out = np.zeros_like(x)
        out[1:] = x[:-1]
        out[self.place < k] = 0
        return out

    def may_be_retained(self, j: int, tokens: int) -> np.ndarray:
        """Places whose context of j words stands often enough, and whose gain can exceed the least by any chance."""
        times = self.before(self.counts[j], j)
        longer = tokens if j == 1 else self.before(self.counts[j - 1], j)
        with np.errstate(divide="ignore", invalid="ignore"):
            most = times * np.log(longer / times)  # no symbol stands more often after a context than after its suffix
        return (times >= self.least) & (most > self.divergence)

    def open_runs(self, k: int, tokens: int) -> np.ndarray:
        """Places at which the count of the run of k symbols must be asked for."""
        if k <= 2:
            return self.place >= k - 1
        here = self.may_be_retained(k - 1, tokens) if k - 1 == self.depth else self.before(self.counts[k - 1], k - 1) >= self.least
        return here & (self.counts[k - 1] > 0)  # a run does not stand where the shorter one does not

    def own_counts(self, k: int, tokens: int) -> tuple[np.ndarray, np.ndarray]:
        use = self.open_runs(k, tokens)
        keys, which = distinct(self.keys[k][use], self.ranges)
        return keys, np.bincount(which, (self.train & self.own)[use], minlength=len(keys)).astype(np.int64)

    def learn_counts(self, k: int, tokens: int, totals: np.ndarray) -> None:
        use = self.open_runs(k, tokens)
        out = np.zeros(len(self.seq), np.int64)
        out[use] = totals[distinct(self.keys[k][use], self.ranges)[1]]
        self.counts.append(out)

    def contexts(self, j: int, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places with a context of j words that may be retained, its distinct hashes, and which of them each has."""
        use = np.flatnonzero(self.may_be_retained(j, tokens) & self.scored)
        return use, *distinct(self.keys[j][use - 1], self.ranges)

    def own_gain(self, j: int, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts of j words, and this group's shares of their gain and of their number of next symbols."""
        use, keys, which = self.contexts(j, tokens)
        taught = self.train[use]
        at, which = use[taught], which[taught]
        n, shorter = self.counts[j + 1][at], self.counts[j][at]
        longer = tokens if j == 1 else self.counts[j - 1][at - 1]
        gain = np.log(n / self.counts[j][at - 1] * (longer / shorter))
        return keys, *(np.bincount(which, x, minlength=len(keys)).astype(float) for x in (gain, 1 / n))

    def scores(self, tokens: int, symbols: int, smoothing: float, followers: list[np.ndarray]) -> pa.Table:
        """followers: for each length of contexts how many symbols follow each of contexts(), 0 of those not retained."""
        base = (self.counts[1] + 0.1) / (tokens + 0.1 * (symbols + 1))
        state = base.copy()
        for j, t in enumerate(followers, 1):
            use, _, which = self.contexts(j, tokens)
            m = smoothing * t[which]
            use, m = use[m > 0], m[m > 0]
            state[use] = (self.counts[j + 1][use] + m * state[use]) / (self.counts[j][use - 1] + m)
        rows = self.texts.num_rows
        where = self.row[self.scored]
        add = lambda x: np.bincount(where, x[self.scored], minlength=rows)
        numbers = [add(np.ones(len(self.seq))).astype(np.int64), add(self.counts[1] > 0).astype(np.int64), add(np.log10(base)), add(np.log10(state))]
        return pa.table([self.texts.column("row"), self.texts.column("doc_id"), self.texts.column("held"), *map(pa.array, numbers)], [c.split()[0] for c in _SCORES.split(", ")])


def _put_together(divergence: float):
    """Sums of counts; of contexts the number of next symbols, or 0 if they are not retained."""

    def answers(kind, which, n, values, groups):
        sums = [np.bincount(which, x, minlength=n) for x in values]
        if kind < SUMS:
            return sums[0].astype(np.int64)[which]  # whole numbers, exact below 2 ** 53
        follow = np.rint(sums[1]).astype(np.int64)
        return np.where(sums[0] > divergence * follow, follow, 0)[which]

    return answers


def score_texts(docs: DataFrame, *, folds: int = 10, depth: int = 2, least: int = 2, divergence: float = 2.0, smoothing: float = 2.0, group_bytes: int = 6 << 20, range_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; rows whose id's crc32 is 0 modulo folds are held out.

    group_bytes, range_bytes: of text that a task works on at once, and whose runs a range holds, about. Both may grow
    with the executors' memory; a group sends one message to each range, so very large corpora want both larger.
    """
    if depth < 1 or least < 1 or smoothing <= 0 or divergence < 0:
        raise ValueError("depth and least are 1 or more, smoothing over 0, divergence not below 0")
    spark = docs.sparkSession
    held = F.coalesce(crc_fold("doc_id", folds) == 0, F.lit(True))
    texts = keyed_texts(docs, id_col, text_col).select("doc_id", "text", held.alias("held_out"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("all"), F.count_if(~F.col("held_out")).alias("taught")).first()
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size["all"] / range_bytes))
    groups = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size["all"] / group_bytes))
    packed = kept(packed_texts(texts, group_bytes, depth), **{"parquet.block.size": 4 * group_bytes})

    model = (ranges, depth, least, divergence)
    asked = lambda rows: kept(answers_to(rows, ranges, _put_together(divergence), SUMS, 1))

    def first(table):
        g, blob, _ = answered(table)
        group = Group(blob, *model)
        return messages([m for k in (1, 2) for m in question(g, k, ranges, *group.own_counts(k, 0))])

    parts = [packed.select("g", F.lit(TEXTS).alias("kind"), F.lit(0).cast("long").alias("part"), "blob")]
    known = asked(by_group(parts, groups).applyInArrow(lean(first), MESSAGE))
    row = known.where("g is null").agg(F.sum("symbols").alias("symbols"), F.sum("total").alias("total")).first()
    # the beginning of each training text is counted as a word
    tokens, symbols = (row.total or 0) - size.taught, (row.symbols or 0) - (size.taught > 0)
    parts.append(known.where("g is not null").select(*GROUP))

    def restored(table: pa.Table, rounds: int):
        """(g, the group with the counts of so many rounds after the first, answers on contexts)."""
        g, blob, found = answered(table)
        group, none = Group(blob, *model), np.zeros(0, np.int64)
        for k in range(1, rounds + 2):
            group.learn_counts(k, tokens, found.get(k, none))
        return g, group, [found.get(SUMS + j, none) for j in range(1, depth + 1)]

    def asks(j: int):
        def run(table):
            g, group, _ = restored(table, j)
            rows = question(g, SUMS + j, ranges, *group.own_gain(j, tokens))
            if j < depth:
                rows += question(g, j + 2, ranges, *group.own_counts(j + 2, tokens))
            return messages(rows)

        return run

    for j in range(1, depth + 1):
        parts.append(asked(by_group(parts, groups).applyInArrow(lean(asks(j)), MESSAGE)).select(*GROUP))

    def last(table):
        _, group, followers = restored(table, depth)
        return group.scores(tokens, symbols, smoothing, followers)

    rows = by_group(parts, groups).applyInArrow(lean(last), _SCORES)
    sums = {"n_tokens": "n_tokens", "n_known": "n_known", "base": "base_score", "score": "score"}
    whole = rows.groupBy("row").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("held_out").alias("held_out"), *[F.sum(a).alias(b) for a, b in sums.items()])
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_suffix_tree_lm(spark, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))

"""Toxicity by class-conditional Kneser-Ney models (operator 5).

Each class, toxic and ordinary, has an interpolated Kneser-Ney model of a word after the word before it. Counts are
continuation counts throughout, so copies teach once: a pair (u, w) counts the different words that stand before it
in texts of the class, a word the different words before it. The larger class's counts are scaled to the smaller
one's total, so both are discounted alike. With c the counts of a class, p those of both together:

* P(w | u) = (max(c(u, w) - PAIR, 0) + the mass so taken from u times B(w | u)) / c(u)
* B(w | u) = (max(p(u, w) - PAIR, 0) + the mass so taken from u times Q(w)) / p(u)
* Q(w) = (max(c(w) - WORD, 0) + the mass so taken times S(w)) / c
* S(w) = (p'(w) + 0.5) / (p' + 0.5 (words + 1)), of unscaled counts p'; one part is left for unseen words

Rare expressions thus take their probability from counts that both classes share, B and S, and say little. All four
add up to 1. A word's difference log P(w | u, toxic) - log P(w | u, ordinary) counts as far as it is beyond ``MARGIN``
nats, for classes also differ a little in what their texts are about. A text's evidence is the sum of these divided
by its words. A logistic curve over the logarithm of the evidence, rising, gives the score; it is fitted on a third of the
sample, by a hash of the id, with the evidence that models of the other two thirds give. Nothing else is an input.

Counts come from about ``texts_per_class`` labelled texts of each class, chosen by a hash of the id; of longer
ones about ``longest_bytes`` are taken, in stretches from all over them. So the model's size is bounded.

Defined results: a null or empty text has evidence 0 and the score that the curve gives to none; with labels of
one class or none every score is 0; where a third of the sample is of one class, the curve is fitted on all of it; a
doc_id with several labels is toxic if one says so; null labels teach nothing; repeated documents are scored alike;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .common import crc_fold, in_stretches, keyed_texts, lean, mix, read_table, words_of

WORD, PAIR, MARGIN = 0.75, 2.0, 2.0
#: What stands before a text's first word and the word before that; evidence that is as good as none.
START, BEFORE_START, FAINT = np.uint64(2), np.uint64(3), 0.02
_STEP = np.uint64(0x9E3779B97F4A7C15)


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * _STEP + words)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of those wanted are keys (sorted), and the places of these."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    known = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
    return known, at[known]


@dataclass
class KneserNey:
    """Both classes' models; row 0 is ordinary, row 1 toxic. Counts are scaled."""

    words: np.ndarray  # sorted hashes
    counts: np.ndarray  # 2 x words
    follows: np.ndarray  # words before each, in either class, unscaled
    pairs: np.ndarray  # sorted hashes of pairs, those of more than PAIR counts at least
    pair_counts: np.ndarray  # 2 x pairs
    contexts: np.ndarray  # sorted hashes
    context_counts: np.ndarray  # 5 x contexts: counts and discounted mass of both classes, discounted mass together
    totals: np.ndarray  # of counts
    taken: np.ndarray  # share of the words' mass that the discount takes
    follow_total: float
    types: int

    def probabilities(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        """2 x words: of each after the one before it."""
        known, at = _found(self.words, words)
        count, follow = np.zeros((2, len(words))), np.zeros(len(words))
        count[:, known], follow[known] = self.counts[:, at], self.follows[at]
        shared = (follow + 0.5) / (self.follow_total + 0.5 * (self.types + 1))
        out = np.maximum(count - WORD, 0) / self.totals[:, None] + self.taken[:, None] * shared
        use, at = _found(self.contexts, before)
        use = np.flatnonzero(use)
        held, place = _found(self.pairs, pair_keys(before[use], words[use]))
        pair = np.zeros((2, len(use)))
        pair[:, held] = self.pair_counts[:, place]
        n, mass, both = self.context_counts[:2, at], self.context_counts[2:4, at], self.context_counts[4, at]
        middle = (np.maximum(pair.sum(0) - PAIR, 0) + both * out[:, use]) / n.sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[:, use] = np.where(n > 0, (np.maximum(pair - PAIR, 0) + mass * middle) / n, middle)
        return out

    def evidence(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text: the sum of its words' differences beyond the margin, divided by its words."""
        n = np.diff(offsets)
        ordinary, toxic = self.probabilities(words, previous(words, offsets, START))
        x = np.log(toxic / ordinary)
        x = np.sign(x) * np.maximum(np.abs(x) - MARGIN, 0)
        return np.bincount(np.repeat(np.arange(len(n)), n), x, minlength=len(n)) / np.maximum(n, 1)

    def trimmed(self) -> KneserNey:
        """The same differences, without words whose two probabilities are as far apart as an unseen word's."""
        use = (self.counts > WORD).any(0)
        return KneserNey(self.words[use], self.counts[:, use], self.follows[use], self.pairs, self.pair_counts, self.contexts, self.context_counts, self.totals, self.taken, self.follow_total, self.types)


@dataclass
class Toxicity:
    model: KneserNey | None  # None: nothing was labelled both ways
    curve: np.ndarray | None  # of 1 and the logarithm of the evidence

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * _strength(evidence), -30, 30)))


def _strength(evidence: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(evidence, 0) + FAINT)


def previous(words: np.ndarray, offsets: np.ndarray, start: np.uint64) -> np.ndarray:
    """The word before each in its text, and start before a text's first."""
    out = np.empty_like(words)
    out[1:] = words[:-1]
    out[offsets[:-1][np.diff(offsets) > 0]] = start
    return out


def _pairs(texts: DataFrame) -> DataFrame:
    """(u, w, o, t, co, ct): words before each pair in ordinary and toxic texts, and in those not set aside."""

    def run(batches):
        for batch in batches:
            flag = batch.column("flag").to_numpy(zero_copy_only=False).astype(np.uint64)
            for first, count, words, offsets, _, _ in words_of(batch.column("text")):
                if not len(words):
                    continue
                u = previous(words, offsets, START)
                v = previous(u, offsets, BEFORE_START)
                bit = np.uint64(1) << np.repeat(flag[first : first + count], np.diff(offsets))
                _, at = np.unique(mix(pair_keys(u, words) * _STEP + v) * np.uint64(16) + bit, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(x[at].view(np.int64)) for x in (v, u, words, bit)], ["v", "u", "w", "bit"])

    runs = texts.select("text", "flag").mapInArrow(run, "v long, u long, w long, bit long").groupBy("v", "u", "w").agg(F.bit_or("bit").alias("bits"))
    some = lambda bits: F.sum(F.when(F.col("bits").bitwiseAND(F.lit(bits)) > 0, 1).otherwise(0))
    return runs.groupBy("u", "w").agg(some(3).alias("o"), some(12).alias("t"), some(1).alias("co"), some(4).alias("ct"))


def _model(pairs: DataFrame, o: str, t: str) -> KneserNey | None:
    """From pairs with their counts in ordinary and toxic texts; None if one of them is empty."""
    pairs = pairs.select("u", "w", F.col(o).alias("o"), F.col(t).alias("t")).where("o + t > 0")
    sums = pairs.agg(F.count_if(F.col("o") > 0).alias("o"), F.count_if(F.col("t") > 0).alias("t"), F.count("*").alias("f")).first()
    totals = np.array([sums.o, sums.t], float)
    if not totals.all():
        return None
    scale = totals.min() / totals
    words = pairs.groupBy("w").agg(F.count_if(F.col("o") > 0).alias("o"), F.count_if(F.col("t") > 0).alias("t"), F.count("*").alias("f")).toArrow()
    key = lambda table, c: table.column(c).to_numpy().view(np.uint64)
    hashes = key(words, "w")
    order = np.argsort(hashes)
    counts = np.stack([words.column(c).to_numpy()[order] * s for c, s in zip("ot", scale, strict=True)])
    taken = np.minimum(counts, WORD).sum(1) / counts.sum(1)
    c = [F.col("o") * float(scale[0]), F.col("t") * float(scale[1])]
    mass = lambda x: F.sum(F.least(x, F.lit(PAIR)))
    numbers = [F.sum(c[0]), F.sum(c[1]), mass(c[0]), mass(c[1]), mass(c[0] + c[1])]
    # a context none of whose pairs is above the discount says what its backoff says
    contexts = pairs.groupBy("u").agg(F.max(c[0] + c[1]).alias("most"), *[x.alias(f"n{i}") for i, x in enumerate(numbers)]).where(F.col("most") > PAIR).toArrow()
    strong = pairs.where(c[0] + c[1] > PAIR).toArrow()
    names, both = key(contexts, "u"), pair_keys(key(strong, "u"), key(strong, "w"))
    by_name, by_pair = np.argsort(names), np.argsort(both)
    return KneserNey(
        hashes[order], counts, words.column("f").to_numpy()[order].astype(float), both[by_pair], np.stack([strong.column(x).to_numpy()[by_pair] * s for x, s in zip("ot", scale, strict=True)]),
        names[by_name], np.stack([contexts.column(f"n{i}").to_numpy()[by_name] for i in range(5)]), counts.sum(1), taken, float(sums.f), len(hashes),
    )


def fitted_curve(evidence: np.ndarray, toxic: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Intercept and slope, not below 0, of a logistic curve over the logarithm of the evidence."""
    x = _strength(evidence)
    mean, spread = x.mean(), x.std() + 1e-9
    z, b = np.c_[np.ones(len(x)), (x - mean) / spread], np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        b += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (toxic - p) - ridge * b)
    slope = max(b[1], 0.0) / spread
    return np.array([b[0] - slope * mean, slope])


def with_evidence(docs: DataFrame, model: KneserNey) -> DataFrame:
    """docs, which has text, with evidence."""
    shipped = docs.sparkSession.sparkContext.broadcast(model.trimmed())  # bounded by the sample

    def run(batches):
        for batch in batches:
            for first, count, words, offsets, _, _ in words_of(batch.column("text")):
                part = batch.slice(first, count)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shipped.value.evidence(words, offsets))], [*part.schema.names, "evidence"])

    return docs.mapInArrow(lean(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", evidence double")


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, texts_per_class: int = 8_000, longest_bytes: int = 20_000) -> Toxicity:
    """docs has doc_id, text; labels has doc_id, toxic. Both are all rows that may teach."""
    flagged = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counts = {r.toxic: r["count"] for r in flagged.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return Toxicity(None, None)
    place = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 30))
    share = {k: min(1 << 30, int((1 << 30) * texts_per_class / n)) for k, n in counts.items()}
    chosen = flagged.where(place < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    # about texts_per_class rows of each class, by the share above
    aside = (F.pmod(F.xxhash64(F.lit("aside"), "doc_id"), F.lit(3)) == 0).cast("int")
    texts = kept(in_stretches(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", (F.col("toxic") * 2 + aside).alias("flag")), longest_bytes))
    pairs = kept(_pairs(texts))
    model, other = _model(pairs, "o", "t"), _model(pairs, "co", "ct")
    if model is None:
        return Toxicity(None, None)
    held = texts.where("flag in (1, 3)")
    if other is None or held.agg(F.count_distinct("toxic")).first()[0] < 2:
        other, held = model, texts
    rows = with_evidence(held.select("toxic", "text"), other).select("toxic", "evidence").toArrow()
    return Toxicity(model, fitted_curve(rows.column("evidence").to_numpy(), rows.column("toxic").to_numpy().astype(float)))


def score_toxicity(docs: DataFrame, fitted: Toxicity) -> DataFrame:
    """doc_id, text_hash, evidence (length-normalised difference of log-likelihoods), score."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    if fitted.model is None:
        return rows.select("doc_id", "text_hash", F.lit(0.0).alias("evidence"), F.lit(0.0).alias("score"))
    found = with_evidence(rows, fitted.model).select("doc_id", "text_hash", "evidence")
    strength = F.log(F.greatest("evidence", F.lit(0.0)) + FAINT)
    return found.withColumn("score", 1 / (1 + F.exp(-(F.lit(float(fitted.curve[0])) + float(fitted.curve[1]) * strength))))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = keyed_texts(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "labels")
    teaches = crc_fold("doc_id", 3) != 1
    fitted = fit_toxicity(docs.where(teaches), labels.where(teaches))
    return score_toxicity(docs, fitted).select("doc_id", F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

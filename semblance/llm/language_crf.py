"""Language identification of words by a linear-chain conditional random field (operator 7).

Every word is labelled with a language. Its features are the byte n-grams of the word between boundary marks
(those with a mark are its affixes) and membership in each language's learned lexicon; transitions between labels
are learned too. Training concatenates stretches of documents of different languages, so that switches occur, and
maximises the likelihood by steps along its gradient, from the marginals of words and of neighbouring pairs. It sees a bounded sample of labelled
rows: at most ``docs_per_language`` documents of each language, chosen by a hash of the id, and of longer ones about
``longest_bytes`` in stretches from all over them. Labels are whole texts' labels; prediction runs over every word of every text.
Words of more than ``WORD_BYTES`` bytes, as in scripts without blanks, are labelled in consecutive pieces that cover
all their bytes; n-grams run on over the cuts, and only a word's own ends are marked.

Forward-backward is exact over whole texts: products of transition matrices over segments of 64 words carry the
messages between segments, and all segments of a batch are worked on at once.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text when nothing is
labelled; the score is the mean marginal of the predicted language over the words and
pieces; a span's word has the label of the greatest sum over its pieces; ties go to the language that
sorts first; repeated rows are predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_fold, flat, in_stretches, keyed_texts, lean, _LOWER, mix, nested, read_table, text_buffers, words_of

#: Hashed n-gram features; lengths of n-grams in bytes; words of a segment; bytes of a word that are labelled at once, about.
FEATURES, GRAMS, SEGMENT, WORD_BYTES = 1 << 16, (1, 2, 3, 4), 64, 48


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # features x languages
    lexicon: np.ndarray  # sorted word hashes
    members: np.ndarray  # words of the lexicon x languages
    lexical: np.ndarray  # languages x languages
    moves: np.ndarray  # from x to, log scale


def pieces_of(data: np.ndarray, hashes: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(hashes, offsets, starts, ends, opens, closes, word) with long words as pieces, cut between characters."""
    lengths = ends - starts
    count = np.maximum(1, -(-lengths // WORD_BYTES))
    word = np.repeat(np.arange(len(starts)), count)
    nth = np.arange(len(word)) - (np.cumsum(count) - count)[word]
    begin = starts[word] + nth * lengths[word] // count[word]
    for _ in range(3):
        begin[nth > 0] -= (data[begin[nth > 0]] & 192) == 128
    closes = nth == count[word] - 1
    end = np.where(closes, ends[word], np.roll(begin, -1))
    own = np.where(count[word] > 1, mix(hashes[word] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), hashes[word])
    return own, np.concatenate([[0], np.cumsum(count)])[offsets], begin, end, nth == 0, closes, word


def grams_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, opens: np.ndarray | None = None, closes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all n-grams of the words, word by word, and each word's count.

    opens, closes: which begin and end a word; a piece that does not end it sees the first bytes of the next.
    """
    opens = np.ones(len(starts), np.int64) if opens is None else opens.astype(np.int64)
    closes = np.ones(len(starts), np.int64) if closes is None else closes.astype(np.int64)
    lengths = ends - starts
    padded = opens + lengths + np.where(closes, 1, max(GRAMS) - 1)
    offsets = np.cumsum(padded) - padded
    total = int(padded.sum())
    word = np.repeat(np.arange(len(starts)), padded)
    place = np.arange(total) - offsets[word]
    symbol = np.ones(total, np.uint64)  # 1 marks both boundaries
    inside = (place >= opens[word]) & (place < (padded - closes)[word])
    symbol[inside] = _LOWER[data[(starts - opens)[word[inside]] + place[inside]]]
    own = (place < (opens + lengths)[word]) | (closes[word] > 0)
    features, owners, rolling = [], [], np.zeros(total, np.uint64)
    for n in GRAMS:
        rolling = np.roll(rolling, -1) if n > 1 else rolling
        rolling = symbol.copy() if n == 1 else symbol + rolling * np.uint64(257)
        ok = own & (place + n <= padded[word])
        features.append((mix(rolling[ok] + np.uint64(n << 40)) % np.uint64(FEATURES)).astype(np.int32))
        owners.append(word[ok])
    owner, feature = np.concatenate(owners), np.concatenate(features)
    order = np.argsort(owner, kind="stable")
    return feature[order], np.bincount(owner, minlength=len(starts))


def emissions(model: Crf, hashes: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Scores of words for each language: mean n-gram weight plus lexicon weight."""
    ends = np.cumsum(counts)
    out = np.empty((len(counts), len(model.languages)))
    for k in range(out.shape[1]):
        sums = np.concatenate([[0.0], np.cumsum(model.weights[:, k][grams])])
        out[:, k] = (sums[ends] - sums[ends - counts]) / np.sqrt(counts)
    if len(model.lexicon):
        at = np.searchsorted(model.lexicon, hashes)
        at[at == len(model.lexicon)] = 0
        known = model.lexicon[at] == hashes
        out[known] += model.members[at[known]] @ model.lexical
    return out


def marginals(scores: np.ndarray, moves: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Forward-backward over each text's words: rows of scores between consecutive offsets are one text."""
    return messages(scores, moves, offsets)[0]


def expected_moves(scores: np.ndarray, moves: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marginals, and how often each label is expected after each: sums of the pairwise marginals."""
    post, after = messages(scores, moves, offsets)
    inner = np.ones(len(scores), bool)
    inner[offsets[:-1][np.diff(offsets) > 0]] = False
    t = np.flatnonzero(inner)
    # a label's chance after another one: its move, its word, and all that follows
    ahead = np.exp(scores[t] - scores[t].max(1, keepdims=True)) * after[t]
    chance = np.exp(moves - moves.max())[None] * ahead[:, None, :]
    chance /= chance.sum(2, keepdims=True)
    return post, np.einsum("ti,tij->ij", post[t - 1], chance)


def messages(scores: np.ndarray, moves: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals, backward messages) of each word's labels; a message is up to a factor."""
    k = scores.shape[1]
    if not len(scores):
        return scores, scores
    lengths = np.diff(offsets)
    pieces = -(-lengths // SEGMENT)
    first = np.cumsum(pieces) - pieces  # segment number of each text's first
    text = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(len(text)) - first[text]
    begin = offsets[:-1][text] + nth * SEGMENT
    size = np.minimum(SEGMENT, offsets[1:][text] - begin)
    grid = np.minimum(begin[:, None] + np.arange(SEGMENT), len(scores) - 1)
    live = np.arange(SEGMENT) < size[:, None]
    emit = np.exp(scores - scores.max(1, keepdims=True))[grid]
    move = np.exp(moves - moves.max())
    step = lambda m, t: (m @ move) * emit[:, t, None, :]
    # the product over a segment, from the label before its first word to the label of its last
    product = np.broadcast_to(np.eye(k), (len(text), k, k)).copy()
    for t in range(SEGMENT):
        now = step(product, t)
        now /= now.sum((1, 2), keepdims=True)
        product = np.where(live[:, t, None, None], now, product)
    into, out_of = np.empty((len(text), k)), np.empty((len(text), k))
    order = np.argsort(nth, kind="stable")
    cuts = np.searchsorted(nth[order], np.arange(int(pieces.max()) + 1))
    flat = np.linalg.pinv(move)  # so that a text's first word sees even odds
    start = np.ones(k) @ flat
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        seg = order[a:b]
        if nth[seg[0]] == 0:
            into[seg] = start
        else:
            message = np.einsum("si,sij->sj", into[seg - 1], product[seg - 1])
            into[seg] = message / message.sum(1, keepdims=True)
    last = nth == pieces[text] - 1
    for a, b in zip(cuts[:-1][::-1], cuts[1:][::-1], strict=True):
        seg = order[a:b]
        end = seg[last[seg]]
        out_of[end] = 1.0
        mid = seg[~last[seg]]
        if len(mid):
            message = np.einsum("sij,sj->si", product[mid + 1], out_of[mid + 1])
            out_of[mid] = message / message.sum(1, keepdims=True)
    forward = np.empty((SEGMENT, len(text), k))
    at = into
    for t in range(SEGMENT):
        now = (at @ move) * emit[:, t]
        now /= now.sum(1, keepdims=True)
        forward[t] = at = np.where(live[:, t, None], now, at)
    result, after, at = np.empty_like(scores), np.empty_like(scores), out_of
    for t in reversed(range(SEGMENT)):
        rows = live[:, t]
        both = forward[t][rows] * at[rows]
        result[grid[rows, t]] = both / both.sum(1, keepdims=True)
        after[grid[rows, t]] = at[rows]
        now = (emit[:, t] * at) @ move.T
        now /= now.sum(1, keepdims=True)
        at = np.where(rows[:, None], now, at)
    return result, after


def train(texts: list[str], labels: list[str], *, epochs: int = 6, rate: float = 0.5, stretch: int = 12, lexicon_words: int = 4000, seed: int = 7) -> Crf:
    """A field fitted by AdaGrad over sequences of stretches of texts of different languages."""
    languages = sorted(set(labels))
    k, rng = len(languages), np.random.default_rng(seed)
    column = pa.array(texts, pa.large_string())
    data, _ = text_buffers(column)
    parts, label = [], []
    for row, _, h, offsets, s, e in words_of(column):
        h, offsets, *rest, _ = pieces_of(data, h, offsets, s, e)
        parts.append((h, *rest))
        label.append(np.repeat([languages.index(x) for x in labels[row : row + len(offsets) - 1]], np.diff(offsets)))
    hashes, starts, ends, opens, closes = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 5
    label = np.concatenate(label) if label else np.zeros(0, np.int64)
    words, at, inverse = np.unique(hashes.astype(np.uint64), return_index=True, return_inverse=True)
    grams, counts = grams_of(data, starts[at], ends[at], opens[at], closes[at]) if len(words) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    table = np.zeros((len(words), k))
    np.add.at(table, (inverse, label), 1)
    kept = np.zeros(len(words), bool)
    for j in range(k):
        top = np.argsort(-table[:, j], kind="stable")[:lexicon_words]
        kept[top[table[top, j] >= 3]] = True
    members = (table[kept] >= 3).astype(float)
    model = Crf(languages, np.zeros((FEATURES, k)), words[kept], members, np.zeros((k, k)), np.zeros((k, k)))
    if len(words) == 0 or k < 2:
        return model
    pools = [np.flatnonzero(label == j) for j in range(k)]
    owner = np.repeat(np.arange(len(words)), counts)
    lex_row = np.full(len(words), -1)
    lex_row[kept] = np.arange(int(kept.sum()))
    squares = [np.full_like(x, 1e-3) for x in (model.weights, model.lexical, model.moves)]
    for _ in range(epochs * 5):
        chosen, gold = [], []
        for _ in range(300):  # stretches; two of a language in a row are one longer stretch
            j = int(rng.integers(k))
            a = int(rng.integers(max(1, len(pools[j]) - stretch)))
            part = pools[j][a : a + int(rng.integers(2, stretch * 2))]
            chosen.append(inverse[part])
            gold.append(np.full(len(part), j))
        word, gold = np.concatenate(chosen), np.concatenate(gold)
        used, local = np.unique(word, return_inverse=True)
        pick = np.isin(owner, used)
        own, gram = np.searchsorted(used, owner[pick]), grams[pick]
        scores = emissions(model, words[used], gram, counts[used])
        size = 400
        cut = np.arange(0, len(word) + size, size).clip(max=len(word))
        cut = np.unique(cut)
        post, expected = expected_moves(scores[local], model.moves, cut)
        wanted = np.eye(k)[gold]
        step = np.zeros((len(used), k))
        np.add.at(step, local, wanted - post)
        gw = np.zeros_like(model.weights)
        np.add.at(gw, gram, (step / np.sqrt(counts[used])[:, None])[own])
        rows = lex_row[used]
        gl = members[rows[rows >= 0]].T @ step[rows >= 0]
        inner = np.ones(len(word), bool)
        inner[cut[:-1]] = False
        t = np.flatnonzero(inner)
        true = np.zeros((k, k))
        np.add.at(true, (gold[t - 1], gold[t]), 1)
        gm = true - expected
        for value, grad, square in zip((model.weights, model.lexical, model.moves), (gw, gl, gm), squares, strict=True):
            grad = grad / len(word) - 1e-7 * value
            square += grad * grad
            value += rate * grad / np.sqrt(square)
    return model


def sample_of(labelled: DataFrame, label: str, per_label: int, longest_bytes: int) -> list:
    """At most per_label (text, label) rows of each label, by a hash of the id; counts come from all rows.

    Texts of more than longest_bytes are taken in as stretches from all over them.
    """
    usable = labelled.select("doc_id", "text", F.col(label).alias("label")).where(F.col("label").isNotNull() & (F.trim("text") != ""))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30))
    share = usable.groupBy("label").agg((F.lit((1 << 30) * (1.3 * per_label + 20)) / F.count("*")).alias("share"))
    chosen = usable.withColumn("place", place).join(F.broadcast(share), "label").where("place < share").select("text", "label", "place")
    rows = in_stretches(chosen, longest_bytes).collect()
    out, taken = [], Counter()
    for r in sorted(rows, key=lambda r: (r.place, r.text)):
        if taken[r.label] < per_label:
            taken[r.label] += 1
            out.append(r)
    return out


def fit_crf(labelled: DataFrame, *, docs_per_language: int = 250, longest_bytes: int = 20_000) -> Crf:
    """labelled has doc_id, text, lang; rows without a language teach nothing."""
    rows = sample_of(labelled, "lang", docs_per_language, longest_bytes)
    return train([r.text for r in rows], [r.label for r in rows])


SPANS = "array<struct<start: long, end: long, lang: string>>"


ADDED = {"_lang_pred": "string", "_lang_score": "double", "_spans": SPANS}


def tag_languages(docs: DataFrame, model: Crf, *, text_col: str = "text", spans: bool = False) -> DataFrame:
    """docs with all its columns and _lang_pred, _lang_score and, if asked for, _spans: runs of words of one label.

    These three replace columns of docs that have their names.
    """
    added = list(ADDED)[: 2 + spans]
    return flat(_tagged(docs, model, text_col, added), [*[c for c in docs.columns if c not in added], *added], text_col, **{c: F.col(c) for c in added})


def in_learned_languages(docs: DataFrame, model: Crf, least: float, *, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter and a predicted language of at least this score."""
    found = _tagged(docs, model, text_col, list(ADDED)[:2])
    return flat(found.where((F.col("_lang_pred") != "und") & (F.col("_lang_score") >= least)), docs.columns, text_col)


def _tagged(docs: DataFrame, model: Crf, text_col: str, added: list[str]) -> DataFrame:
    """nested rows with the columns added."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: features x languages, bounded lexicon
    rows = nested(docs, text_col, letters=F.coalesce(F.col(f"`{text_col}`").cast("string").rlike(r"\p{L}"), F.lit(False)))
    schema = T.StructType([*rows.schema.fields[:2], *T.StructType.fromDDL(", ".join(f"{k} {ADDED[k]}" for k in added)).fields])
    spans = "_spans" in added

    def run(batches):
        field = shipped.value
        languages = np.array(field.languages, object)
        for batch in batches:
            column, letters = batch.column("text").cast(pa.string()), batch.column("letters").to_numpy(zero_copy_only=False)
            data, _ = text_buffers(column)
            for first, count, hashes, offsets, starts, ends in words_of(column):
                begin = offsets  # of the texts' words
                hashes, offsets, starts, ends, opens, closes, _ = pieces_of(data, hashes, offsets, starts, ends)
                words, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                post = np.zeros((len(hashes), max(1, len(languages))))
                if len(words) and len(languages):
                    grams, sizes = grams_of(data, starts[at], ends[at], opens[at], closes[at])
                    post = marginals(emissions(field, words, grams, sizes)[inverse], field.moves, offsets)
                sums = np.vstack([np.zeros(post.shape[1]), np.cumsum(post, 0)])
                share = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)[:, None]
                ok = letters[first : first + count] & (np.diff(offsets) > 0) & (len(languages) > 0)
                names = languages if len(languages) else np.array(["und"], object)
                out = [batch.column(c).slice(first, count) for c in ("row", "text")]
                out += [pa.array(np.where(ok, names[share.argmax(1)], "und"), pa.string()), pa.array(np.where(ok, share.max(1).clip(0, 1), 0.0))]
                if spans:
                    whole = np.add.reduceat(post, np.flatnonzero(opens)) if len(post) else post
                    label, runs = whole.argmax(1), []
                    for a, b, fine in zip(begin[:-1], begin[1:], ok, strict=True):
                        edges = [0, *(np.flatnonzero(np.diff(label[a:b])) + 1), b - a] if fine else []
                        runs.append([{"start": int(s), "end": int(e), "lang": names[label[a + s]]} for s, e in zip(edges[:-1], edges[1:], strict=True)])
                    out.append(pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(out, ["row", "text", *added])

    return rows.mapInArrow(lean(run), schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_crf(docs.select("doc_id", "text", "lang").where(crc_fold("doc_id", 3) != 1))
    found = tag_languages(keyed_texts(docs), model)
    return found.select("doc_id", F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))

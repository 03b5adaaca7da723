"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its hashed character n-grams, a chunk of words is the mean of its words, and
a linear softmax reads the chunk; a document scores as its most toxic chunk, so a short insult in a long text is
not averaged away. Vectors and softmax are trained together on the driver, on a bounded sample of labelled rows.
As reading is linear, a trained model is one number a bucket; tasks score whole texts with these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import WORD_BYTES, small_batches, text_blocks, word_spans, words_of

#: Hash buckets, vector width, lengths of character n-grams, words of a chunk.
BUCKETS, WIDTH, GRAMS, CHUNK = 1 << 17, 4, (4, 5, 6, 7), 24
#: Training rows at most, by label, and passes over them.
MAX_TOXIC, MAX_CLEAN, STEPS = 1500, 3000, 60
#: First step of the optimiser (steps shrink evenly to none), and the gradient, as a share of the first largest, at which steps reach half of it; share that vectors lose a step.
RATE, FLOOR, DECAY = 8.0, 1.0, 0.01
#: The part of the labels' log odds that the bias takes; the classes weigh the same in training.
PRIOR = 0.2
#: Bytes of a word that are read; a longer word is split into words of so many.
LONGEST = 64


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ``<word>`` and, for each bucket, the word; every word has at least one (itself)."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8)
    size = np.diff(offsets)
    padded = size + 2
    start = np.concatenate([[0], np.cumsum(padded)])
    text = np.zeros(start[-1], np.uint64)
    at = np.repeat(start[:-1] + 1 - offsets[:-1], size) + np.arange(offsets[0], offsets[-1])
    text[at] = raw[offsets[0] : offsets[-1]]
    text[start[:-1]] = 60
    text[start[1:] - 1] = 62
    owner = np.repeat(np.arange(len(words)), padded)
    room = np.repeat(start[1:], padded) - np.arange(len(text))
    buckets, owners = [], []
    mixed = np.zeros(len(text), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        fits = room >= n
        step = np.zeros(len(text), np.uint64)
        step[: max(len(text) - n + 1, 0)] = text[n - 1 :]
        mixed = (mixed ^ (step + np.uint64(n))) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        if n in GRAMS:
            buckets.append((mixed[fits] % np.uint64(BUCKETS)).astype(np.int64))
            owners.append(owner[fits])
    turn = np.arange(1, len(text) + 1, dtype=np.uint64) - np.repeat(start[:-1], padded).astype(np.uint64)
    whole = np.bitwise_xor.reduceat((text + np.uint64(7)) * (turn * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)), start[:-1])
    buckets.append(((whole >> np.uint64(17)) % np.uint64(BUCKETS)).astype(np.int64))
    owners.append(np.arange(len(words)))
    return np.concatenate(buckets), np.concatenate(owners)


def _tokens(raw: bytes, offsets: np.ndarray):
    """Codes of the words, the distinct words, and first words of documents."""
    shown = np.frombuffer(raw.translate(WORD_BYTES), np.uint8)
    starts, ends, first = word_spans(shown, offsets)
    if len(starts) and int((ends - starts).max()) > LONGEST:
        pieces = (ends - starts + LONGEST - 1) // LONGEST
        more = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(starts, pieces) + more * LONGEST
        ends = np.minimum(np.repeat(ends, pieces), starts + LONGEST)
        first = np.searchsorted(starts, offsets)
    coded = words_of(shown, starts, ends).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, first


def _bags(codes: np.ndarray, first: np.ndarray, kinds: int):
    """Distinct words of each chunk, the chunks these are of, and each chunk's document; documents without words have none.

    All chunks count as CHUNK words, the missing and repeated ones with zero vectors.
    """
    counts = np.diff(first)
    doc_of_word = np.repeat(np.arange(len(counts)), counts)
    pieces = (counts + CHUNK - 1) // CHUNK
    before = np.cumsum(pieces) - pieces
    chunk = before[doc_of_word] + (np.arange(len(codes)) - first[doc_of_word]) // CHUNK
    pairs = np.unique(chunk * max(kinds, 1) + codes)
    return pairs % max(kinds, 1), pairs // max(kinds, 1), np.repeat(np.arange(len(counts)), pieces)


class Model:
    """``buckets``: a number for each bucket; ``bias``: of the softmax, with the labels' shares."""

    def __init__(self, buckets: np.ndarray, bias: float):
        self.buckets, self.bias = buckets, bias

    def score(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        codes, words, first = _tokens(raw, offsets)
        docs = len(first) - 1
        best = np.full(docs, -np.inf)
        if len(codes):
            bucket, owner = subwords(words)
            word = np.bincount(owner, self.buckets[bucket], len(words)) / np.bincount(owner, minlength=len(words))
            codes, chunk, doc = _bags(codes, first, len(words))
            np.maximum.at(best, doc, np.bincount(chunk, word[codes], len(doc)) / CHUNK)
        return 1 / (1 + np.exp(-np.clip(np.where(np.isfinite(best), best, 0) + self.bias, -30, 30)))


def train(texts: list, labels: np.ndarray, share: float, steps: int = STEPS, seed: int = 11) -> Model:
    """Vectors and softmax of the texts by full-batch Adam; ``share``: of label 1 among all labelled rows."""
    encoded = [(x or "").encode() for x in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int64)
    codes, words, first = _tokens(b"".join(encoded), offsets)
    ones = labels.sum()
    if not len(codes) or not 0 < ones < len(labels):
        return Model(np.zeros(BUCKETS), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    bucket, owner = subwords(words)
    spread = 1 / np.bincount(owner, minlength=len(words))
    codes, chunk, doc = _bags(codes, first, len(words))
    rng = np.random.default_rng(seed)
    size = BUCKETS * WIDTH
    state = np.concatenate([rng.normal(0, 1e-4, size), np.full(WIDTH, WIDTH**-0.5), [0.0]])
    first_moment, second_moment = np.zeros_like(state), np.zeros_like(state)
    # a document's loss is that of its most toxic chunk; chunks share the slope by their softmax, at first evenly
    docs = len(labels)
    weight_of = np.where(labels == 1, 0.5 / ones, 0.5 / (len(labels) - ones))
    for step in range(1, steps + 1):
        vectors, reader, bias = state[:size].reshape(BUCKETS, WIDTH), state[size:-1], state[-1]
        word = np.stack([np.bincount(owner, vectors[bucket, k], len(words)) for k in range(WIDTH)], 1) * spread[:, None]
        flat = word @ reader
        logit = np.bincount(chunk, flat[codes], len(doc)) / CHUNK + bias
        order = np.lexsort((-logit, doc))
        top = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
        p = 1 / (1 + np.exp(-np.clip(logit[top], -30, 30)))
        pull = np.zeros(docs)
        pull[doc[top]] = weight_of[doc[top]] * (p - labels[doc[top]])
        best = np.zeros(docs)
        best[doc[top]] = logit[top]
        part = np.exp(logit - best[doc])
        slope = pull[doc] * part / np.bincount(doc, part, docs)[doc]
        by_word = np.bincount(codes, slope[chunk] / CHUNK, len(words))
        by_bucket = np.bincount(bucket, (by_word * spread)[owner], BUCKETS)
        gradient = np.concatenate([np.outer(by_bucket, reader).ravel(), by_word @ word, [slope.sum()]])
        if step == 1:  # n-grams of few texts move in proportion to their gradient, common ones at the full rate
            floor = np.full(len(state), 1.0)
            floor[:size] = FLOOR * np.abs(gradient[:size]).max()
        first_moment = 0.9 * first_moment + 0.1 * gradient
        second_moment = 0.99 * second_moment + 0.01 * gradient**2
        state[:size] *= 1 - DECAY
        state -= RATE * (1 - step / (steps + 1)) * (first_moment / (1 - 0.9**step)) / (np.sqrt(second_moment / (1 - 0.99**step)) + floor)
    vectors, reader, bias = state[:size].reshape(BUCKETS, WIDTH), state[size:-1], state[-1]
    prior = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    return Model(vectors @ reader, float(bias + PRIOR * prior))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """A model of ``labels`` (doc_id, label 0 or 1), of at most ``max_toxic`` and ``max_clean`` rows of each label, by hash order.

    Rows with null ids or labels take no part. The softmax is trained on classes of equal weight; the bias then
    takes PRIOR of the log odds of label 1 among all labelled rows.
    """
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).select("doc_id", "label")
    counts = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    total = sum(counts.values())
    if not total:
        return Model(np.zeros(BUCKETS), 0.0)
    picked = [
        labels.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, max_toxic), (0, max_clean))
    ]
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most max_toxic + max_clean rows of two numbers
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "label").collect()
    rows.sort(key=lambda r: (r[0], r[1] or ""))
    return train([r[1] for r in rows], np.array([r[2] for r in rows], np.float64), counts.get(1, 0) / total)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row; null texts are empty, texts without words get the bias alone."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def scan(batches):
        for ids, raw, offsets in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(shared.value.score(raw, offsets))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, score double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all rows of ``docs`` by a model of ``labels``; repeated rows are scored each, empty tables give none."""
    return scores(docs, fit(docs, labels))

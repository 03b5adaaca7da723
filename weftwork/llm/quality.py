"""Quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

The statistics of a whole text are standardised and mapped to random cosine features, whose inner products
approximate a Gaussian kernel. Partitions add up their cells of the normal equations, Spark sums the cells, and
the driver solves one system of fixed size. Labelled rows are halved: a fit on either half scores the other, and
pool-adjacent-violators over fixed score bins of these out-of-fold scores gives the calibration. The final
weights come from both halves. No step collects rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import KEY, keyed, small_batches, text_blocks, word_spans, words_of, written

#: Cosine features, the kernel's width in standard deviations, ridge penalty per row, score bins.
FEATURES, WIDTH, RIDGE, BINS = 160, 2.5, 1e-3, 400
#: Scores are binned over this range.
LOW, HIGH = -0.5, 1.5

_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Byte classes whose shares are statistics.
_CLASSES = [
    [(65, 90)],
    [(97, 122)],
    [(48, 57)],
    [(32, 32)],
    [(10, 10)],
    [(33, 33)],
    [(124, 124)],
    [(35, 38), (42, 42), (64, 64), (94, 94), (126, 126)],
    [(44, 44), (46, 46), (58, 59), (63, 63)],
    [(128, 255)],
    [(40, 41), (60, 62), (91, 93), (123, 123), (125, 125), (95, 95), (47, 47)],
]
N_STATS = len(_CLASSES) + 10


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[cuts[1:]] - total[cuts[:-1]]).astype(np.float64)


def _runs(codes: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: distinct codes, and how often its commonest code occurs."""
    distinct, most = np.zeros(docs), np.zeros(docs)
    if len(codes):
        pairs, times = np.unique(doc * (codes.max() + 1) + codes, return_counts=True)
        owner = pairs // (codes.max() + 1)
        distinct = np.bincount(owner, minlength=docs).astype(np.float64)
        np.maximum.at(most, owner, times)
    return distinct, most


def _codes(words: pa.Array) -> np.ndarray:
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def statistics(raw: bytes, offsets: np.ndarray) -> np.ndarray:
    """A row of N_STATS statistics for each document of a block; an empty text has zeros."""
    docs, shown = len(offsets) - 1, np.frombuffer(raw, np.uint8)
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    out = []
    for ranges in _CLASSES:
        member = np.zeros(256, bool)
        for a, b in ranges:
            member[a : b + 1] = True
        out.append(_sums(member[shown], offsets) / size)
    starts, ends, first = word_spans(shown, offsets, _SPACE)
    n = np.diff(first).astype(np.float64)
    some = np.maximum(n, 1)
    lengths = (ends - starts).astype(np.float64)
    mean = _sums(lengths, first) / some
    codes, doc = _codes(words_of(shown, starts, ends)), np.repeat(np.arange(docs), np.diff(first))
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    distinct, most = _runs(codes, doc, docs)
    twice = codes[:-1] * (codes.max(initial=0) + 1) + codes[1:]
    inner = doc[:-1] == doc[1:]
    pairs, top = _runs(np.unique(twice[inner], return_inverse=True)[1], doc[:-1][inner], docs)
    newline = np.arange(256) == 10
    lines_at, lines_to, line_first = word_spans(shown, offsets, newline)
    lines = np.diff(line_first)
    line_kinds, _ = _runs(_codes(words_of(shown, lines_at, lines_to)), np.repeat(np.arange(docs), lines), docs)
    out += [
        np.log1p(n) / 4,
        np.log1p(mean),
        np.sqrt(np.maximum(_sums(lengths**2, first) / some - mean**2, 0)) / np.maximum(mean, 1),
        distinct / some,
        _sums(again, first) / some,
        most / some,
        1 - pairs / np.maximum(n - 1, 1),
        top / some,
        np.where(lines > 0, 1 - line_kinds / np.maximum(lines, 1), 0),
        np.log1p(n / np.maximum(lines, 1)) / 4,
    ]
    found = np.stack(out, 1)
    found[np.diff(offsets) == 0] = 0
    return found


def document_statistics(docs: DataFrame) -> DataFrame:
    """key and stats (array of N_STATS doubles) of every row; whole texts, null as empty."""
    small_batches(docs.sparkSession)

    def scan(batches):
        for ids, raw, offsets in text_blocks(batches):
            stats = statistics(raw, offsets)
            flat = pa.array(stats.ravel(), pa.float64())
            rows = pa.array(np.arange(0, stats.size + 1, N_STATS), pa.int32())
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(rows, flat)], ["key", "stats"])

    return keyed(docs).mapInArrow(scan, f"key {KEY}, stats array<double>")


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), N_STATS)


class Model:
    """Standardisation, cosine features, weights and calibration; plain arrays of fixed size."""

    def __init__(self, mean, spread, seed: int = 7):
        self.mean, self.spread = np.asarray(mean), np.maximum(np.asarray(spread), 1e-6)
        rng = np.random.default_rng(seed)
        self.waves = rng.normal(0, 1 / WIDTH, (N_STATS, FEATURES))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots, self.values = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def lifted(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        return np.hstack([np.cos(z @ self.waves + self.phases) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.lifted(stats) @ self.weights, self.knots, self.values)


def isotonic(position: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins: increasing positions, and the share of ones that rises with them."""
    stack: list[list[float]] = []
    for x, n, k in zip(position, total, ones, strict=True):
        stack.append([x, x, n, k])
        while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
            _, b, n2, k2 = stack.pop()
            stack[-1][1] = b
            stack[-1][2] += n2
            stack[-1][3] += k2
    knots = np.array([x for s in stack for x in (s[0], s[1] + 1e-9)])
    values = np.array([s[3] / s[2] for s in stack for _ in (0, 1)])
    return knots, values


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """The model of labelled rows: ``stats`` (key, stats) joined with ``labels`` (doc_id, label 0 or 1).

    Rows with a null id, label or other label take no part; a repeated label row counts again. Without any
    labelled row every score is 0.5.
    """
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).select("doc_id", "label")
    rows = stats.select(F.col("key.doc_id").alias("doc_id"), "stats").join(labels, "doc_id").select(
        "stats", F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")
    )
    rows = written(rows, "quality-rows")
    cells = [f(F.get("stats", F.lit(i))).alias(f"{n}{i}") for n, f in (("m", F.avg), ("s", F.stddev_pop)) for i in range(N_STATS)]
    found = rows.agg(F.count(F.lit(1)).alias("n"), *cells).first()
    if not found["n"]:
        return Model(np.zeros(N_STATS), np.ones(N_STATS))
    model = Model([found[f"m{i}"] for i in range(N_STATS)], [found[f"s{i}"] for i in range(N_STATS)])
    wide = FEATURES + 1
    upper = np.triu_indices(wide)

    def partial(batches):
        sums = np.zeros((2, len(upper[0]) + wide + 1))
        for batch in batches:
            x = model.lifted(_matrix(batch.column(0)))
            y, half = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for k in (0, 1):
                own = x[half == k]
                sums[k] += np.concatenate([(own.T @ own)[upper], own.T @ y[half == k], [len(own)]])
        cell = pa.array(np.tile(np.arange(sums.shape[1]), 2), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], sums.shape[1]), pa.int32()), cell, pa.array(sums.ravel())], ["half", "cell", "value"]
        )

    summed = rows.mapInArrow(partial, "half int, cell int, value double").groupBy("half", "cell").agg(F.sum("value").alias("value"))
    sums = np.zeros((2, len(upper[0]) + wide + 1))
    for row in summed.toLocalIterator():  # two systems of fixed size
        sums[row[0], row[1]] = row[2]

    def solved(s):
        a = np.zeros((wide, wide))
        a[upper] = s[: len(upper[0])]
        a = a + a.T - np.diag(np.diag(a))
        penalty = np.eye(wide) * (RIDGE * max(s[-1], 1))
        penalty[-1, -1] = 1e-9
        return np.linalg.lstsq(a + penalty, s[len(upper[0]) : -1], rcond=None)[0]

    sides = np.stack([solved(sums[1]), solved(sums[0])])
    model.weights = solved(sums.sum(0))

    def binned(batches):
        total, ones = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            x = model.lifted(_matrix(batch.column(0)))
            y, half = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            raw = np.einsum("ij,ij->i", x, sides[half])
            at = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
            total += np.bincount(at, minlength=BINS)
            ones += np.bincount(at, y, minlength=BINS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BINS), pa.int32()), pa.array(total), pa.array(ones)], ["bin", "n", "k"]
        )

    bins = rows.mapInArrow(binned, "bin int, n double, k double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    bins = sorted(r for r in bins.where("n > 0").collect())  # at most BINS rows
    at = LOW + (np.array([r[0] for r in bins]) + 0.5) * (HIGH - LOW) / BINS
    model.knots, model.values = isotonic(at, np.array([r[1] for r in bins]), np.array([r[2] for r in bins]))
    return model


def scores(stats: DataFrame, model: Model) -> DataFrame:
    """key and score (0 to 1) of every row of ``stats``."""

    def scan(batches):
        for batch in batches:
            found = model.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["key", "score"])

    return stats.select("key", "stats").mapInArrow(scan, f"key {KEY}, score double")


def keyed_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """key (id and the text's mark) and score of every row of ``docs``, fitted on ``labels`` (doc_id, label)."""
    stats = written(document_statistics(docs), "quality-stats")
    return scores(stats, fit(stats, labels))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every row of ``docs``, fitted on ``labels`` (doc_id, label).

    Null texts are empty texts; repeated rows are scored each; rows with a null doc_id are scored and never
    fitted; an empty table gives no rows; other columns are ignored.
    """
    return keyed_scores(docs, labels).select("key.doc_id", "score")

"""Learned operators, given their weights: numpy over Arrow batches where a recurrence has no relational form.

Weights are arrays of fixed size that go to the tasks with the function. Rows hold whole sequences; nothing is
shuffled. Null sequences count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("none", "add_all", "replace_all", "replace_oovs")


def embedded(rows: DataFrame, index: str, table: DataFrame, policy: str = "none", example_id: str | None = None, known: int = 2, to: str = "encoding") -> DataFrame:
    """``rows`` with the vector of each index; index 0 is padding (zeros), 1 is unknown.

    Policies bring in vectors of ``table`` rows numbered ``known + own number`` (``example_id``), by which words of an
    example differ that the vocabulary does not tell apart: added to all, in place of all, or of unknown ones.
    """
    if policy not in POLICIES:
        raise ValueError(f"no such policy: {policy}")
    vectors = table.select(F.col("idx").alias("_i"), F.col("value").alias("_v"))
    found = rows.join(vectors, F.col(index) == F.col("_i"), "left").drop("_i").withColumnRenamed("_v", "_own")
    own = F.col("_own")
    if policy != "none":
        other = table.select((F.col("idx") - known).alias("_j"), F.col("value").alias("_w"))
        found = found.join(other, F.col(example_id) == F.col("_j"), "left").drop("_j")
        both = F.zip_with("_own", "_w", lambda x, y: x + y)
        own = {"add_all": both, "replace_all": F.col("_w"), "replace_oovs": F.when(F.col(index) == 1, F.col("_w")).otherwise(F.col("_own"))}[policy]
    zeros = F.transform(F.col("_own"), lambda x: x * 0.0)
    return found.withColumn(to, F.when(F.col(index) == 0, zeros).otherwise(own)).drop("_own", "_w")


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Lstm:
    """One direction of an LSTM: input, forget, cell and output gates in this order."""

    def __init__(self, width: int, hidden: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.w = rng.normal(0, hidden**-0.5, (width, 4 * hidden))
        self.u = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden))
        self.b = np.zeros(4 * hidden)

    def step(self, x: np.ndarray, h: np.ndarray, c: np.ndarray):
        i, f, g, o = np.split(x @ self.w + h @ self.u + self.b, 4, axis=-1)
        c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
        return _sigmoid(o) * np.tanh(c), c

    def run(self, items: np.ndarray) -> np.ndarray:
        h, c, out = np.zeros(self.hidden), np.zeros(self.hidden), []
        for x in items:
            h, c = self.step(x, h, c)
            out.append(h)
        return np.array(out).reshape(len(items), self.hidden)


class BiLstm:
    """Both directions, summed."""

    def __init__(self, width: int, hidden: int, seed: int = 0):
        self.there, self.back = Lstm(width, hidden, seed), Lstm(width, hidden, seed + 1)

    def run(self, items: np.ndarray) -> np.ndarray:
        return self.there.run(items) + self.back.run(items[::-1])[::-1]


def encoded_sequences(rows: DataFrame, key: str, items: str, encoder, to: str = "states") -> DataFrame:
    """key and the encoder's state at each place; ``items`` is an array of vectors."""
    typ = pa.list_(pa.list_(pa.float64()))

    def run(batches):
        for batch in batches:
            out = [encoder.run(np.array(x, np.float64)).tolist() if x else [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, typ)], [key, to])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, F.col(items).cast("array<array<double>>")).mapInArrow(run, f"{key} {kind}, {to} array<array<double>>")


class PointerDecoder:
    """A greedy LSTM decoder with attention: each step scores a row's candidates, picks the best and feeds it back."""

    def __init__(self, width: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.cell = Lstm(2 * width, width, seed)
        self.start, self.end = rng.normal(0, 1, width), rng.normal(0, 1, width)

    def decode(self, memory: np.ndarray, candidates: np.ndarray, most: int) -> list[int]:
        """Picks among ``candidates``, from 0; the end is the candidate -1 and is not returned."""
        options = np.vstack([self.end, candidates])
        h, c, x, picks = np.zeros(len(self.end)), np.zeros(len(self.end)), self.start, []
        for _ in range(most):
            score = memory @ h / np.sqrt(len(h)) if len(memory) else np.zeros(0)
            weight = np.exp(score - score.max()) if len(score) else score
            context = weight @ memory / weight.sum() if len(score) else np.zeros(len(h))
            h, c = self.cell.step(np.concatenate([x, context]), h, c)
            pick = int(np.argmax(options @ h))
            if pick == 0:
                break
            picks.append(pick - 1)
            x = options[pick]
        return picks


def decoded(rows: DataFrame, key: str, memory: str, candidates: str, decoder: PointerDecoder, most: int = 6) -> DataFrame:
    """key and picks: places of the candidates that the decoder points at, in order."""

    def run(batches):
        for batch in batches:
            out = []
            for m, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                width = len(decoder.end)
                out.append(decoder.decode(np.array(m or [], np.float64).reshape(-1, width), np.array(c or [], np.float64).reshape(-1, width), most))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], [key, "picks"])

    kind = dict(rows.dtypes)[key]
    vectors = [F.col(c).cast("array<array<double>>").alias(f"_{i}") for i, c in enumerate((memory, candidates))]
    return rows.select(key, *vectors).mapInArrow(run, f"{key} {kind}, picks array<int>")


def copy_scores(words: Column, weights: Column, candidates: Column) -> Column:
    """For each candidate the sum of the weights at which it occurs among ``words``."""
    pairs = F.arrays_zip(words.alias("w"), weights.alias("s"))
    return F.transform(candidates, lambda c: F.aggregate(F.filter(pairs, lambda p: p["w"] == c), F.lit(0.0), lambda a, p: a + p["s"]))


class TreeLstm:
    """A child-sum tree LSTM over one tree: parents follow their children in topological order."""

    def __init__(self, width: int, hidden: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.w = rng.normal(0, hidden**-0.5, (width, 4 * hidden))
        self.u = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden))

    def run(self, items: np.ndarray, parents: list[int]) -> np.ndarray:
        n, d = len(items), self.hidden
        h, c, sums, kept = np.zeros((n, d)), np.zeros((n, d)), np.zeros((n, d)), np.zeros((n, d))
        for k in range(n - 1, -1, -1):  # numbers are in pre-order: children come after their parent
            i, _, g, o = np.split(items[k] @ self.w + sums[k] @ self.u, 4)
            c[k] = _sigmoid(i) * np.tanh(g) + kept[k]
            h[k] = _sigmoid(o) * np.tanh(c[k])
            if parents[k] >= 0:
                up = parents[k]
                f = _sigmoid(items[up] @ self.w[:, d : 2 * d] + h[k] @ self.u[:, d : 2 * d])
                sums[up] += h[k]
                kept[up] += f * c[k]
        return h


def encoded_trees(rows: DataFrame, key: str, items: str, parents: str, encoder: TreeLstm) -> DataFrame:
    """key and states of the nodes of one tree per row; ``parents`` has -1 for the root."""

    def run(batches):
        for batch in batches:
            out = [encoder.run(np.array(x, np.float64), p).tolist() if x else [] for x, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.list_(pa.float64())))], [key, "states"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, F.col(items).cast("array<array<double>>"), F.col(parents).cast("array<int>")).mapInArrow(run, f"{key} {kind}, states array<array<double>>")

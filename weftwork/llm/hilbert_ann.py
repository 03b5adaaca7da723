"""Approximate nearest neighbours by shifted Hilbert orderings of projected vectors.

Each ordering projects the unit vectors on a few random directions, shifts the cube and numbers its cells along a
Hilbert curve. Quantiles of the keys cut an ordering into ranges of about equally many vectors (equal keys are told
apart by a hash, so no range grows); a vector lies in one range, a query looks into the ranges around its own. A
task keeps one range and streams the queries that look into it; the nearest found in all ranges merge, by exact
cosines of the original vectors.

Equal vectors are one vector with its smallest ids, taken by limits that Spark applies before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm.common import small_batches, written

#: Orderings, projected dimensions, bits of each, part of an ordering that a query looks into.
ORDERINGS, DIMS, BITS, PART = 5, 4, 7, 0.4
#: Ranges of an ordering at least, vectors of a range at most, and of a window at least (about).
RANGES, RANGE_ROWS, LEAST_ROWS = 32, 16384, 512


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Numbers along the Hilbert curve of integer ``cells`` (n x dims, each below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & (q - 1)
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= np.where(high, 0, swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def keys(vectors: np.ndarray, seed: int = 3) -> np.ndarray:
    """A key for each vector and ordering; the low 20 bits are a hash that tells equal places apart."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    size = unit.shape[1]
    out = []
    mark = np.zeros(len(unit), np.uint64)
    for column in unit.astype(np.float32).view(np.uint32).T:
        mark = (mark ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mark ^= mark >> np.uint64(31)
    for turn in range(ORDERINGS):
        rng = np.random.default_rng([seed, turn, size])
        axes = rng.normal(size=(size, DIMS)) / np.sqrt(size)
        # the cube holds about three standard deviations; shifts move its cells' borders
        place = (unit @ axes) * np.sqrt(size) / 6 + 0.5
        place = np.clip(place * 0.5 + rng.uniform(0, 0.5, DIMS), 0, 1 - 1e-9)
        cell = (place * (1 << BITS)).astype(np.int64)
        out.append((hilbert(cell, BITS) << 20) | (mark >> np.uint64(44)).astype(np.int64))
    return np.stack(out, 1)


def _vectors(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_size(batches, at: int):
    """Batches of vectors of one length each."""
    for batch in batches:
        sizes = np.diff(np.asarray(batch.column(at).offsets))
        for size in np.unique(sizes):
            yield batch if (sizes == size).all() else batch.filter(pa.array(sizes == size))


def _keyed(batches):
    for batch in _by_size(batches, 1):
        found = keys(_vectors(batch.column(1)))
        rows = pa.array(np.arange(0, found.size + 1, ORDERINGS), pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(rows, pa.array(found.ravel()))], [*batch.schema.names, "keys"])


def _nearest(k: int):
    def scan(batches):
        """Nearest of one range for the queries that look into it; rows: range, query, ids, vector; vectors first."""
        now, ids, vectors, lengths, stock = None, [], None, None, []
        for batch in _by_size(batches, 3):
            room = batch.column(0).to_numpy(zero_copy_only=False)
            query = np.asarray(batch.column(1).is_valid())
            cuts = np.flatnonzero(np.concatenate([[True], (room[1:] != room[:-1]) | (query[1:] != query[:-1]), [True]]))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                if room[lo] != now:
                    now, stock, vectors = room[lo], [], None
                if not query[lo]:
                    stock.append(part)
                    vectors = None
                    continue
                if not stock:
                    continue
                if vectors is None:
                    ids = [x for s in stock for x in s.column(2).to_pylist()]
                    vectors = np.concatenate([_vectors(s.column(3)) for s in stock])
                    lengths = np.linalg.norm(vectors, axis=1)
                yield from _answers(part, ids, vectors, lengths, k)

    return scan


def _answers(part, ids, vectors, lengths, k):
    wanted, own = _vectors(part.column(3)), part.column(1).to_pylist()
    own_lengths = np.linalg.norm(wanted, axis=1)
    near = (wanted @ vectors.T) / own_lengths[:, None] / lengths[None, :]
    take = min(k + 4, len(ids))
    top = np.argpartition(-near, take - 1, axis=1)[:, :take]
    edge = np.take_along_axis(near, top, 1).min(axis=1) - 1e-12
    out_q, out_v, out_s = [], [], []
    for i, q in enumerate(own):
        rows = np.flatnonzero(near[i] >= edge[i])  # what ties with the last is kept whole
        exact = np.array([np.dot(wanted[i], vectors[r]) / (own_lengths[i] * lengths[r]) for r in rows])
        found = sorted((-s, x) for s, r in zip(exact, rows, strict=True) for x in ids[r] if x != q)[:k]
        out_q += [q] * len(found)
        out_v += [x for _, x in found]
        out_s += [-s for s, _ in found]
    yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], ["query_id", "vec_id", "score"])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that have an id and a finite vector other than zero."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & good & some)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, part: float = PART) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found among ``vectors`` for each of ``queries`` (both vec_id, embedding).

    A query's own id is no candidate; ties go to smaller ids; fewer candidates give fewer rows. Vectors that are null,
    zero or hold null or non-finite components take no part, and vectors meet only those of their own length. Rows
    that share id and vector are one row. Other columns are ignored; empty tables give no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    first = Window.partitionBy("embedding").orderBy("vec_id")
    # repeated rows go first, so that the limit counts ids; Spark applies it before and after the shuffle
    ranked = usable(vectors).dropDuplicates(["vec_id", "embedding"]).withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= k + 1)
    kinds = ranked.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    kinds = written(kinds.select("ids", "embedding").mapInArrow(_keyed, "ids array<long>, embedding array<double>, keys array<long>"), "ann-vectors")
    asked = usable(queries).dropDuplicates(["vec_id", "embedding"])
    asked = asked.select(F.col("vec_id").alias("query"), "embedding").mapInArrow(_keyed, "query long, embedding array<double>, keys array<long>")
    sizes = kinds.groupBy(F.size("embedding").alias("d")).count().collect()  # one row for each length of vectors
    found = None
    for size, rows in sizes:
        one = _searched(kinds.where(F.size("embedding") == size), asked.where(F.size("embedding") == size), rows, k, part)
        found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best))
    return merged.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(kinds: DataFrame, asked: DataFrame, rows: int, k: int, part: float) -> DataFrame:
    ranges = max(RANGES, -(-rows // RANGE_ROWS))
    side = min(ranges, max(1, round(part * ranges / 2), -(-LEAST_ROWS * ranges // (2 * rows))))
    points = F.array(*[F.lit((i + 1) / ranges) for i in range(ranges - 1)])
    cuts = kinds.agg(*[F.percentile_approx(F.get("keys", F.lit(t)), points, 20 * ranges).alias(f"t{t}") for t in range(ORDERINGS)]).first()
    borders = [np.array(cuts[t], np.int64) for t in range(ORDERINGS)]

    def placed(look: int):
        def scan(batches):
            for batch in batches:
                found = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, ORDERINGS)
                for t in range(ORDERINGS):
                    own = np.searchsorted(borders[t], found[:, t])
                    low = np.clip(own - look, 0, max(0, ranges - 1 - 2 * look))  # at the ends the window moves inside
                    for step in range(min(2 * look + 1, ranges)):
                        at = pa.array(t * ranges + (low if look else own) + step, pa.int64())
                        yield pa.RecordBatch.from_arrays([at, batch.column(0), batch.column(1)], ["range", "who", "embedding"])

        return scan

    stock = kinds.select("ids", "embedding", "keys").mapInArrow(placed(0), "range long, who array<long>, embedding array<double>")
    looking = asked.select("query", "embedding", "keys").mapInArrow(placed(side), "range long, who long, embedding array<double>")
    both = stock.select("range", F.lit(None).cast("long").alias("query"), F.col("who").alias("ids"), "embedding").union(
        looking.select("range", F.col("who").alias("query"), F.lit(None).cast("array<long>").alias("ids"), "embedding")
    )
    both = both.repartition("range").sortWithinPartitions("range", F.col("query").asc_nulls_first())
    return both.mapInArrow(_nearest(k), "query_id long, vec_id long, score double")

"""Batches: numbers, offsets, re-based indices, padding, permutations, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions.arrays import collected


def numbered(rows: DataFrame, key: str, to: str = "number", ranges: int | None = None) -> DataFrame:
    """``rows`` with their place from 0 in the order of a unique numeric ``key``, without sorting all in one task.

    Quantiles of the key cut it into ranges; a range's rows are numbered by a window, and start behind the counts of
    the ranges before (a table of as many rows as there are ranges).
    """
    spark = rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.approxQuantile(key, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    borders = F.array(*[F.lit(c) for c in cuts]) if cuts else F.expr("cast(array() as array<double>)")
    cell = F.size(F.filter(borders, lambda c: c <= F.col(key)))
    placed = rows.withColumn("_cell", cell)
    counts = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_cell", before.alias("_start"))  # one row for each range
    own = F.row_number().over(Window.partitionBy("_cell").orderBy(key))
    return placed.join(F.broadcast(starts), "_cell").withColumn(to, F.col("_start") + own - 1).drop("_cell", "_start")


def batched(rows: DataFrame, key: str, size: int = 16) -> DataFrame:
    """``rows`` with batch and pos: places in the order of ``key``, cut into batches; the last one is kept."""
    found = numbered(rows, key, "_number")
    return found.withColumn("batch", F.floor(F.col("_number") / size)).withColumn("pos", F.col("_number") % size).drop("_number")


def offsets(rows: DataFrame, count: Column, batch: str = "batch", pos: str = "pos") -> DataFrame:
    """``rows`` with offset: the sum of ``count`` over the examples before it in its batch."""
    before = Window.partitionBy(batch).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(count).over(before), F.lit(0)))


def rebased(local: Column, offset: Column, start: int = 0) -> Column:
    """Indices from ``start`` on move by the example's offset; smaller ones are common and stay."""
    return F.when(local >= start, local + offset).otherwise(local)


def group_bounds(rows: DataFrame, group: str, order: str) -> DataFrame:
    """group, first, last, n of runs of equal ``group`` along ``order``."""
    return rows.groupBy(group).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def unflattened(rows: DataFrame, batch: str, example: str, item: Column, value: Column, pad: Column) -> DataFrame:
    """batch, example, values padded to the longest example of the batch, and length."""
    lists = rows.groupBy(batch, example).agg(collected(value, item).alias("values"))
    lists = lists.withColumn("length", F.size("values"))
    width = F.max("length").over(Window.partitionBy(batch))
    return lists.withColumn("values", F.concat("values", F.array_repeat(pad, (width - F.col("length")).cast("int"))))


def flattened(rows: DataFrame, values: str = "values", length: str = "length") -> DataFrame:
    """The items of padded rows again: item and value, padding left out."""
    rest = [c for c in rows.columns if c not in (values, length)]
    return rows.select(*rest, length, F.posexplode(values).alias("item", "value")).where(F.col("item") < F.col(length)).select(*rest, "item", "value")


def hashed_order(salt: str, *keys: Column) -> Column:
    """A pseudo-random order that any engine can repeat: md5 of the salted key."""
    return F.md5(F.concat_ws("|", F.lit(salt), *[k.cast("string") for k in keys]))


def permutation(rows: DataFrame, example: str, item: str, salt: str) -> DataFrame:
    """``rows`` with place: items of an example in hashed order, from 0."""
    order = Window.partitionBy(example).orderBy(hashed_order(salt, F.col(example), F.col(item)), item)
    return rows.withColumn("place", F.row_number().over(order) - 1)


def bottom_k(rows: DataFrame, group: list[str], k: int, salt: str, *keys: str) -> DataFrame:
    """A sample without replacement of ``k`` rows of each group: the smallest salted hashes.

    The limit on the row number is applied by Spark before and after the shuffle.
    """
    order = hashed_order(salt, *[F.col(c) for c in keys])
    if not group:
        return rows.withColumn("_h", order).orderBy("_h", *keys).limit(k).drop("_h")
    own = Window.partitionBy(*group).orderBy(order, *keys)
    return rows.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= k).drop("_r")


def sampled(rows: DataFrame, rate: float, salt: str, *keys: str) -> DataFrame:
    """A Bernoulli sample by salted hash; a filter, so nothing is shuffled."""
    most = f"{int(rate * 0x100000000):08x}" if rate < 1 else "g"
    return rows.where(F.substring(hashed_order(salt, *[F.col(c) for c in keys]), 1, 8) < most)


def sample_size(n: Column, rate: Column) -> Column:
    """round(rate * n), half to even, within 1 and n."""
    return F.least(F.greatest(F.bround(rate * n, 0).cast("long"), F.lit(1)), n)


def numpy_samples(rows: DataFrame, example: str, n: str, most: int, salt: str = "") -> DataFrame:
    """example and picks: places drawn by numpy's legacy generator, seeded for each example; sorted.

    The generator has no other form, so examples go through Arrow in batches; one row is one example.
    """
    import pyarrow as pa

    seeds = rows.select(F.col(example).cast("long"), F.col(n).cast("int"), _seed(salt, F.col(example)))

    def run(batches):
        import numpy as np

        for batch in batches:
            keys, sizes, seed = (batch.column(i).to_pylist() for i in range(3))
            picks = [sorted(np.random.RandomState(s).choice(k, min(k, most), replace=False).tolist()) if k else [] for k, s in zip(sizes, seed, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(picks, pa.list_(pa.int64()))], [example, "picks"])

    return seeds.mapInArrow(run, f"{example} long, picks array<long>")


def _seed(salt: str, key: Column) -> Column:
    from weftwork.functions.strings import seed_of

    return seed_of(F.lit(salt), key.cast("string"), F.lit(0))


def fragments(length: int, seed: int, least: int = 2, most: int = 20) -> list[int]:
    """Lengths of random fragments that make up ``length``; the last may be shorter."""
    import numpy as np

    draw, out = np.random.RandomState(seed), []
    while sum(out) < length:
        out.append(min(int(draw.randint(least, most + 1)), length - sum(out)))
    return out


def fragmented_order(rows: DataFrame, example: str, n: str, salt: str, least: int = 2, most: int = 20) -> DataFrame:
    """example and order: a permutation that only moves items within fragments of random length."""
    import pyarrow as pa

    seeds = rows.select(F.col(example).cast("long"), F.col(n).cast("int"), _seed(salt, F.col(example)))

    def run(batches):
        import numpy as np

        for batch in batches:
            keys, sizes, seed = (batch.column(i).to_pylist() for i in range(3))
            orders = []
            for size, s in zip(sizes, seed, strict=True):
                draw, order, at = np.random.RandomState(s ^ 1), [], 0
                for part in fragments(size, s, least, most):
                    order += (at + draw.permutation(part)).tolist()
                    at += part
                orders.append(order)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(orders, pa.list_(pa.int32()))], [example, "order"])

    return seeds.mapInArrow(run, f"{example} long, order array<int>")

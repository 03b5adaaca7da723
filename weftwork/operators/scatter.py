"""Gather and scatter of encodings: joins on indices, sums and attention by segment, combiners of sequences.

An encoding is an array of doubles. Sums by component go through (segment, component) rows, which Spark combines
before the shuffle, so a segment that holds a third of all rows costs no task more than its components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions import vectors
from weftwork.functions.arrays import collected


def gathered(refs: DataFrame, index: str, table: DataFrame, key: str, value: str, to: str = "encoding") -> DataFrame:
    """``refs`` with the encoding that each index points at; a dangling index gives null."""
    side = table.select(F.col(key).alias("_k"), F.col(value).alias(to))
    return refs.join(side, F.col(index) == F.col("_k"), "left").drop("_k")


def gathered_common(refs: DataFrame, index: str, example: str, common: DataFrame, own: DataFrame, n_common: int, mask: Column, padding: Column, to: str = "encoding") -> DataFrame:
    """Indices below ``n_common`` read ``common`` (idx, value), others ``own`` (example, idx, value) behind it; masked ones get ``padding``."""
    c = common.select(F.col("idx").alias("_c"), F.col("value").alias("_cv"))
    o = own.select(F.col("example").alias("_e"), (F.col("idx") + n_common).alias("_o"), F.col("value").alias("_ov"))
    rows = refs.join(c, F.col(index) == F.col("_c"), "left").join(o, (F.col(example) == F.col("_e")) & (F.col(index) == F.col("_o")), "left")
    found = F.when(F.col(index) < n_common, F.col("_cv")).otherwise(F.col("_ov"))
    return rows.withColumn(to, F.when(mask, found).otherwise(padding)).drop("_c", "_cv", "_e", "_o", "_ov")


def scatter_updated(old: DataFrame, updates: DataFrame, key: str = "idx", value: str = "value", add: bool = False) -> DataFrame:
    """``old`` with the rows of ``updates`` (disjoint keys) written over, or added to, what they point at."""
    new = updates.select(F.col(key).alias("_k"), F.col(value).alias("_new"))
    to = vectors.added(F.col(value), F.col("_new")) if add else F.col("_new")
    return old.join(new, F.col(key) == F.col("_k"), "left").withColumn(value, F.coalesce(to, F.col(value))).drop("_k", "_new")


def masked_scatter(rows: DataFrame, group: str, order: str, mask: Column, dense: DataFrame, zero: Column, to: str = "value") -> DataFrame:
    """The k-th row of a group whose mask is true gets the k-th of ``dense`` (group, rank, value); others get ``zero``."""
    rank = F.sum(mask.cast("long")).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    d = dense.select(F.col(group).alias("_g"), F.col("rank").alias("_r"), F.col("value").alias("_v"))
    ranked = rows.withColumn("_m", mask).withColumn("_rank", F.when(F.col("_m"), rank))
    joined = ranked.join(d, (F.col(group) == F.col("_g")) & (F.col("_rank") == F.col("_r")), "left")
    return joined.withColumn(to, F.coalesce("_v", zero)).drop("_m", "_rank", "_g", "_r", "_v")


def _components(rows: DataFrame, index: str, value: Column) -> DataFrame:
    return rows.select(F.col(index).alias("idx"), F.posexplode(value).alias("dim", "x"))


def scattered(rows: DataFrame, index: str, value: str, how: str = "sum", size: int | None = None) -> DataFrame:
    """idx, dim, x: encodings summed or averaged by index. With ``size``, indices 0 .. size-1 without rows get zeros."""
    parts = _components(rows, index, F.col(value)).groupBy("idx", "dim").agg((F.sum if how == "sum" else F.avg)("x").alias("x"))
    if size is None:
        return parts
    width = rows.agg(F.max(F.size(value))).scalar()
    dense = rows.sparkSession.range(size).withColumn("w", width).select(F.col("id").alias("idx"), F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("dim"))
    return dense.join(parts, ["idx", "dim"], "left").select("idx", "dim", F.coalesce("x", F.lit(0.0)).alias("x"))


def assembled(parts: DataFrame) -> DataFrame:
    """idx and value (array) of component rows."""
    return parts.groupBy("idx").agg(collected(F.col("x"), F.col("dim")).alias("value"))


def segment_softmax(rows: DataFrame, segment: str, score: Column, to: str = "weight") -> DataFrame:
    """``rows`` with the softmax of ``score`` within each segment.

    Maximum and sum are aggregates that combine before the shuffle and come back by a join, whose large partitions
    Spark can split; a window would put a segment into one task.
    """
    scored = rows.withColumn("_s", score)
    top = scored.groupBy(F.col(segment).alias("_g")).agg(F.max("_s").alias("_top"))
    powers = scored.join(top, F.col(segment).eqNullSafe(F.col("_g"))).withColumn("_p", F.exp(F.col("_s") - F.col("_top"))).drop("_g")
    total = powers.groupBy(F.col(segment).alias("_g")).agg(F.sum("_p").alias("_total"))
    return powers.join(total, F.col(segment).eqNullSafe(F.col("_g"))).withColumn(to, F.col("_p") / F.col("_total")).drop("_s", "_top", "_p", "_g", "_total")


def attention(rows: DataFrame, segment: str, value: str, query: Column) -> DataFrame:
    """idx, dim, x: values of a segment weighed by the softmax of their scaled products with ``query``."""
    score = vectors.dot(F.col(value), query) / F.sqrt(F.size(value))
    weighed = segment_softmax(rows, segment, score)
    return _components(weighed, segment, vectors.scaled(F.col(value), F.col("weight"))).groupBy("idx", "dim").agg(F.sum("x").alias("x"))


def head_slices(value: Column, heads: int) -> Column:
    """An encoding cut into ``heads`` parts of equal width."""
    width = (F.size(value) / heads).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.slice(value, h * width + 1, width))


def combined(items: Column, how: str, length: Column | None = None) -> Column:
    """A sequence of encodings as one: "sum", "mean" (over the true length), "last", "ends" (first + last)."""
    own = items if length is None else F.slice(items, F.lit(1), length)
    if how == "last":
        return F.element_at(own, -1)
    if how == "ends":
        return vectors.added(F.get(own, F.lit(0)), F.element_at(own, -1))
    return vectors.mean_of(own) if how == "mean" else vectors.scaled(vectors.mean_of(own), F.size(own).cast("double"))


def message_pass(nodes: DataFrame, edges: DataFrame, rounds: int = 1) -> DataFrame:
    """node and value after ``rounds`` of value = (own + mean of the values at the sources of its edges) / 2."""
    now = nodes.select("node", "value")
    for _ in range(rounds):
        sent = edges.join(now.select(F.col("node").alias("src"), "value"), "src").groupBy("dst").agg(F.avg("value").alias("_m"))
        now = now.join(sent, F.col("node") == F.col("dst"), "left")
        now = now.select("node", F.when(F.col("_m").isNull(), F.col("value")).otherwise((F.col("value") + F.col("_m")) / 2).alias("value"))
    return now


def path_occurrences(paths: DataFrame, node_of: Column, mask: Column, value: Column) -> DataFrame:
    """node and value of each unmasked place of encoded paths, to be scattered back to nodes."""
    cells = F.arrays_zip(node_of.alias("node"), mask.alias("keep"), value.alias("value"))
    return paths.select(F.explode(cells).alias("c")).where("c.keep").select("c.node", "c.value")

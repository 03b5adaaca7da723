"""Context between levels of an example: encodings of outer nodes go into inner ones, occurrences fold into nodes.

Values are arrays of doubles. All joins are equi-joins on indices; sums by component combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions import vectors
from weftwork.functions.arrays import collected
from weftwork.operators import scatter


def with_context(nodes: DataFrame, owner: Column, encodings: DataFrame, update: Callable[[Column, Column], Column], missing: str = "keep") -> DataFrame:
    """``nodes`` (value) updated by the encoding (idx, value) of the outer node that owns each.

    Nodes without an owner or an encoding keep their value ("keep"), or are updated by zeros ("zero").
    """
    side = encodings.select(F.col("idx").alias("_k"), F.col("value").alias("_c"))
    found = nodes.withColumn("_o", owner).join(side, F.col("_o") == F.col("_k"), "left")
    none = F.transform("value", lambda _: F.lit(0.0)) if missing == "zero" else F.lit(None)
    context = F.coalesce("_c", none)
    new = F.when(context.isNull(), F.col("value")).otherwise(update(F.col("value"), context))
    return found.withColumn("value", new).drop("_o", "_k", "_c")


def swapped_leaves(tree: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """``tree`` (keys, value) with the values of ``outer`` (same keys) at the leaves that stand for outer nodes."""
    side = outer.select(*keys, F.col("value").alias("_v"))
    return tree.join(side, keys, "left").withColumn("value", F.coalesce("_v", "value")).drop("_v")


def updated_places(tokens: DataFrame, occurrences: DataFrame, encodings: DataFrame, update: Callable[[Column, Column], Column]) -> DataFrame:
    """``tokens`` (expr, place, value) with the symbol's encoding (symbol, value) let in where ``occurrences`` (expr, place, symbol) stand."""
    side = encodings.select("symbol", F.col("value").alias("_s"))
    known = occurrences.join(side, "symbol").select("expr", "place", "_s")
    new = F.when(F.col("_s").isNull(), F.col("value")).otherwise(update(F.col("value"), F.col("_s")))
    return tokens.join(known, ["expr", "place"], "left").withColumn("value", new).drop("_s")


def symbol_occurrences(members: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """tree, owner, name, idx: the nodes (tree, idx, kind, name) of each subtree (``members``: tree, owner, idx) of a ``wanted`` (kind, name)."""
    named = nodes.join(wanted.select("kind", "name").distinct(), ["kind", "name"], "left_semi")
    return members.join(named, ["tree", "idx"]).select("tree", "owner", "name", "idx")


def is_symbol_leaf(children: Column, begin: Column, end: Column, symbol: Column) -> Column:
    """Leaves of a single token that has a symbol; a null among children counts as no children."""
    return (F.coalesce(F.size(children), F.lit(0)) <= 0) & (begin == end) & symbol.isNotNull()


def only_last_is(kinds: Column, kind: str) -> Column:
    """Whether the last of ``kinds`` is ``kind`` and no other is; False where there are none."""
    return F.coalesce((F.size(kinds) > 0) & (F.element_at(kinds, -1) == kind) & (F.size(F.filter(kinds, lambda k: k == kind)) == 1), F.lit(False))


def within_caps(paths: DataFrame, tree: str, most_pairs: int | None = None, most_leaves: int | None = None) -> DataFrame:
    """``paths`` (one row per leaf) of the trees within caps on leaf-to-leaf and leaf-to-root paths; counted before any pair is made."""
    n = F.count(F.lit(1))
    sizes = paths.groupBy(F.col(tree).alias("_t")).agg(n.alias("n"))
    fits = F.lit(True)
    if most_pairs is not None:
        fits = fits & (F.col("n") * (F.col("n") - 1) / 2 <= most_pairs)
    if most_leaves is not None:
        fits = fits & (F.col("n") <= most_leaves)
    return paths.join(sizes.where(fits), F.col(tree) == F.col("_t"), "left_semi")


def sampled_paths(rows: DataFrame, group: str, size: int, salt: str, *key: str) -> DataFrame:
    """The ``size`` rows of each group with the smallest salted hashes of ``key``; Spark limits groups before the shuffle."""
    mark = F.md5(F.concat_ws("|", F.lit(salt), *[F.col(k).cast("string") for k in key]))
    order = Window.partitionBy(group).orderBy(mark, *key)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= size).drop("_r")


def dense_attention(rows: DataFrame, sequence: str, value: str, query: str, heads: int, mask: Column) -> DataFrame:
    """idx, dim, x: masked multi-head attention of each sequence for its ``query`` (a column equal within a sequence).

    A head reads its own slice of keys and query, scores scale by the root of its width, masked places weigh nothing;
    a sequence without an unmasked place has no rows.
    """
    cut = F.arrays_zip(scatter.head_slices(F.col(value), heads).alias("v"), scatter.head_slices(F.col(query), heads).alias("q"))
    parts = rows.where(mask).select(F.col(sequence).alias("_row"), F.posexplode(cut).alias("_head", "_c"))
    parts = parts.select(F.struct("_row", "_head").alias("_seg"), F.col("_c.v").alias("_v"), F.col("_c.q").alias("_q"))
    weighed = scatter.segment_softmax(parts, "_seg", vectors.dot(F.col("_v"), F.col("_q")) / F.sqrt(F.size("_v")))
    cells = weighed.select("_seg", F.size("_v").alias("_w"), F.posexplode(vectors.scaled(F.col("_v"), F.col("weight"))).alias("_i", "_x"))
    dim = (F.col("_seg._head") * F.col("_w") + F.col("_i")).alias("dim")
    return cells.select(F.col("_seg._row").alias("idx"), dim, "_x").groupBy("idx", "dim").agg(F.sum("_x").alias("x"))


def window_occurrences(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """``rows`` with place: each row once for every n-gram of its key's sequence that holds it, at its place there (from 0)."""
    own = Window.partitionBy(key)
    placed = rows.withColumn("_r", F.row_number().over(own.orderBy(order))).withColumn("_c", F.count(F.lit(1)).over(own))
    cells = placed.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    first = F.col("_r") - F.col("place")
    return cells.where((first >= 1) & (first + n - 1 <= F.col("_c"))).drop("_r", "_c")


def folded(occurrences: list[DataFrame], nodes: DataFrame, update: Callable[[Column, Column], Column], how: str = "mean") -> DataFrame:
    """``nodes`` (idx, value) updated by the sum or mean of their ``occurrences`` (node, value), of n-grams of every n or of paths.

    Nodes without occurrences are updated by zeros, as a scatter over all nodes leaves them.
    """
    every = occurrences[0].select("node", "value")
    for more in occurrences[1:]:
        every = every.union(more.select("node", "value"))
    parts = scatter.assembled(scatter.scattered(every, "node", "value", how))
    return with_context(nodes, F.col("idx"), parts, update, "zero")


def into_nodes(inner: DataFrame, owners: DataFrame, how: str = "mean") -> DataFrame:
    """idx, dim, x: values of inner nodes (tree, idx, value) combined into the outer nodes that own them (tree, idx, owner)."""
    found = inner.join(owners, ["tree", "idx"]).select(F.struct("tree", "owner").alias("node"), "value")
    return scatter.scattered(found, "node", "value", how)


def in_order(occurrences: DataFrame, example: str, symbol: str, expr: str, token: str) -> DataFrame:
    """example and occurrences (array of symbol, expr, token), sorted by symbol, then expression, then token."""
    one = F.struct(F.col(symbol).alias("symbol"), F.col(expr).alias("expr"), F.col(token).alias("token"))
    return occurrences.groupBy(example).agg(F.array_sort(F.collect_list(one)).alias("occurrences"))


def closer_to_one(rate: Column, factor: Column) -> Column:
    """A constant rate, or the mean of a normal one, that nears 1 as ``factor`` falls from 1 to 0."""
    return F.least(F.lit(1.0), rate + (1 - rate) * (1 - factor))


def closer_spread(rate: Column, spread: Column, factor: Column) -> Column:
    """The normal rate's deviation beside ``closer_to_one``: it shrinks with the root of the distance to 1 that is left."""
    least = F.lit(2.220446049250313e-16)
    left = (1 - closer_to_one(rate, factor)) / (1 - rate)
    return F.when(rate >= 1, least).otherwise(F.greatest(spread * F.sqrt(left), least))


def range_samples(rows: DataFrame, key: str, seed: str, size: str, low: int, high: int, replace: bool = False) -> DataFrame:
    """key and sample: ``size`` integers of low .. high - 1 for each row, as numpy's RandomState(seed).choice draws them."""
    import numpy as np

    @F.pandas_udf("array<long>")
    def drawn(seeds: pd.Series, sizes: pd.Series) -> pd.Series:
        values = np.arange(low, high)
        return pd.Series([np.random.RandomState(int(s)).choice(values, size=int(n), replace=replace).tolist() for s, n in zip(seeds, sizes)])

    return rows.select(key, drawn(F.col(seed), F.col(size)).alias("sample"))


def names_below(paths: DataFrame, names: DataFrame) -> DataFrame:
    """tree, idx, names (distinct, sorted) of the leaves below each node; ``paths`` (tree, leaf, path), ``names`` (tree, leaf, name)."""
    up = paths.join(names.select("tree", "leaf", "name").distinct(), ["tree", "leaf"])
    rows = up.select("tree", F.explode("path").alias("idx"), "name").distinct()
    return rows.groupBy("tree", "idx").agg(F.array_sort(F.collect_list("name")).alias("names"))


def in_several(members: DataFrame, group: str, *item: str) -> DataFrame:
    """item and n: the items that stand in more than one group; none, where groups are disjoint."""
    rows = members.select(group, *item).distinct().groupBy(*item).agg(F.count(F.lit(1)).alias("n"))
    return rows.where(F.col("n") > 1)


def path_columns(pairs: DataFrame, nodes: DataFrame, most: int = 3) -> DataFrame:
    """tree, leaf_a, leaf_b, places and directions along each path of ``pairs`` (tree, leaf_a, leaf_b, lca, path).

    places: the node's place among its siblings, 0 .. ``most``, others and roots UNK. directions: UP before the lowest
    common ancestor, DOWN from it on; the path's last node has none.
    """
    own = Window.partitionBy("tree", "parent").orderBy("idx")
    place = F.row_number().over(own) - 1
    word = F.when(F.col("parent").isNull() | (place > most), F.lit("UNK")).otherwise(place.cast("string"))
    side = nodes.select(F.col("tree").alias("_t"), F.col("idx").alias("_i"), word.alias("word"))
    cells = pairs.select("tree", "leaf_a", "leaf_b", F.posexplode("path").alias("at", "node"))
    found = cells.join(side, (F.col("tree") == F.col("_t")) & (F.col("node") == F.col("_i")))
    placed = found.groupBy("tree", "leaf_a", "leaf_b").agg(collected(F.col("word"), F.col("at")).alias("places"))
    top = F.array_position("path", F.col("lca"))
    turns = F.concat(F.array_repeat(F.lit("UP"), (top - 1).cast("int")), F.array_repeat(F.lit("DOWN"), (F.size("path") - top).cast("int")))
    ways = pairs.select("tree", "leaf_a", "leaf_b", turns.alias("directions"))
    return placed.join(ways, ["tree", "leaf_a", "leaf_b"])


def node_map(pairs: DataFrame) -> DataFrame:
    """tree and by_pair: a map from the pair of leaves to the path's inner nodes; one bounded example per row."""
    inner = F.slice("path", 2, F.size("path") - 2)
    entry = F.struct(F.concat_ws("-", "leaf_a", "leaf_b").alias("k"), inner.alias("v"))
    return pairs.groupBy("tree").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("by_pair"))


def _values_of(lists: Column):
    """For a key, its value in each list of entries; null where there is none."""

    def of(key: Column) -> Column:
        return F.transform(lists, lambda entries: F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))["value"])

    return of


def collated(rows: DataFrame, batch: str, pos: str, stacked: list[str], tuples: list[str], maps: list[str]) -> DataFrame:
    """One row per batch, examples in the order of ``pos``: columns stacked into arrays, strings as tuples, maps by the union of keys.

    Null values keep their place. A map column becomes a map from each key to the values of the examples, null where
    an example lacks the key.
    """
    # entries in place of maps, which have no order
    values = {c: F.map_entries(c) if c in maps else F.col(c) for c in [*stacked, *tuples, *maps]}
    found = rows.groupBy(batch).agg(*[collected(v, F.col(pos)).alias(c) for c, v in values.items()])
    for c in maps:
        names = F.transform(F.filter(c, lambda m: m.isNotNull()), lambda m: F.transform(m, lambda e: e["key"]))
        keys = F.array_sort(F.array_distinct(F.flatten(names)))
        found = found.withColumn(c, F.map_from_arrays(keys, F.transform(keys, _values_of(F.col(c)))))
    return found


def defaulted(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """``rows`` with defaults where a field is null or absent; a default may be a function of the columns there are."""
    for name, default in defaults.items():
        value = default(rows.columns) if callable(default) else F.lit(default)
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    return rows


def declared(column: Column, name: str, **facts) -> Column:
    """The column under ``name`` with facts of its role (index group, key, reference) as the schema's metadata."""
    return column.alias(name, metadata=facts)


def top_names(rows: DataFrame, group: str, name: str, k: int) -> DataFrame:
    """group and names: the ``k`` most frequent of each group, ties by name; counts combine before the shuffle."""
    counts = rows.groupBy(group, name).agg(F.count(F.lit(1)).alias("n"))
    best = counts.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), name))).where(F.col("_r") <= k)
    return best.groupBy(group).agg(collected(F.col(name), F.col("_r")).alias("names"))


def catalogue(df: DataFrame) -> DataFrame:
    """feature, kind (Boolean, Numerical, Categorical, Sequence, Item) and parent of every field, those of structs and arrays of structs included."""
    from pyspark.sql import types as T

    def kind(t):
        if isinstance(t, T.ArrayType | T.MapType):
            return "Sequence"
        if isinstance(t, T.StructType):
            return "Item"
        return "Boolean" if isinstance(t, T.BooleanType) else "Numerical" if isinstance(t, T.NumericType) else "Categorical"

    def fields(struct, parent):
        for f in struct.fields:
            yield f.name if parent is None else f"{parent}.{f.name}", kind(f.dataType), parent
            inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            if isinstance(inner, T.StructType):
                yield from fields(inner, f.name if parent is None else f"{parent}.{f.name}")

    return df.sparkSession.createDataFrame(list(fields(df.schema, None)), "feature string, kind string, parent string")


def looked_up(rows: DataFrame, parts: dict[str, DataFrame], combine: str = "concat") -> DataFrame:
    """``rows`` with encoding: the values that each index column of ``parts`` points at in its table (idx, value), concatenated or added.

    Dangling and null indices give zeros of the table's width.
    """
    widths, cols = {}, []
    for i, (index, side) in enumerate(parts.items()):
        widths[index] = side.agg(F.max(F.size("value"))).first()[0] or 0
        rows = rows.join(side.select(F.col("idx").alias(f"_k{i}"), F.col("value").alias(f"_v{i}")), F.col(index) == F.col(f"_k{i}"), "left")
        cols.append(F.coalesce(F.col(f"_v{i}"), F.array_repeat(F.lit(0.0), widths[index])))
    out = cols[0]
    for c in cols[1:]:
        out = F.concat(out, c) if combine == "concat" else vectors.added(out, c)
    return rows.withColumn("encoding", out).drop(*[f"_{x}{i}" for i in range(len(parts)) for x in "kv"])


def symbol_encodings(symbols: DataFrame, identifiers: DataFrame, occurrences: DataFrame, how: str = "sum") -> DataFrame:
    """``symbols`` (symbol, identifier) with encoding: the identifier's value, then the sum or mean of the symbol's occurrences (symbol, value)."""
    parts = scatter.assembled(scatter.scattered(occurrences, "symbol", "value", how))
    return looked_up(symbols, {"identifier": identifiers, "symbol": parts})

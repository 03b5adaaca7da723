"""Functions on arrays; positions count from 0. Null arrays give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _range(n: Column) -> Column:
    """0 .. n-1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def inclusive_slice(items: Column, begin: Column, end: Column) -> Column:
    """Items ``begin`` to ``end``, both included."""
    return F.slice(items, begin + 1, F.greatest(end - begin + 1, F.lit(0)))


def masked_range(items: Column, begin: Column, end: Column, mask: Column) -> Column:
    """The first item of the inclusive range becomes ``mask``, the rest of it goes."""
    head = F.slice(items, F.lit(1), begin)
    tail = F.slice(items, end + 2, F.greatest(F.size(items) - end - 1, F.lit(0)))
    return F.concat(head, F.array(mask), tail)


def kept_positions(items: Column, ignored: list) -> Column:
    """Places of the items that are none of ``ignored``."""
    return F.filter(_range(F.size(items)), lambda i: ~F.coalesce(F.get(items, i).isin(ignored), F.lit(False)))


def compacted(items: Column, ignored: list) -> Column:
    return F.filter(items, lambda x: ~F.coalesce(x.isin(ignored), F.lit(False)))


def pad_truncate(items: Column, width: int, pad: Column) -> Column:
    """The first ``width`` items, filled up with ``pad``."""
    return F.slice(F.concat(items, F.array_repeat(pad, F.lit(width))), 1, width)


def length_mask(length: Column, width: int) -> Column:
    """``width`` booleans, true for the first ``length``."""
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: i <= length)


def ngrams(items: Column, n: int) -> Column:
    """All windows of ``n`` items; empty if there are fewer."""
    return F.transform(_range(F.size(items) - (n - 1)), lambda i: F.slice(items, i + 1, F.lit(n)))


def woven(a: Column, b: Column) -> Column:
    """a0 b0 a1 b1 ...; a may have one item more."""
    pairs = F.flatten(F.zip_with(F.slice(a, F.lit(1), F.size(b)), b, lambda x, y: F.array(x, y)))
    return F.concat(pairs, F.slice(a, F.size(b) + 1, F.greatest(F.size(a) - F.size(b), F.lit(0))))


def every_other(items: Column, first: int) -> Column:
    """Items 0, 2, 4 ... (``first`` = 0) or 1, 3, 5 ... (1)."""
    return F.filter(items, lambda x, i: i % 2 == first)


def inverse_permutation(order: Column) -> Column:
    return F.transform(_range(F.size(order)), lambda i: (F.array_position(order, i) - 1).cast("int"))


def permuted(items: Column, order: Column) -> Column:
    return F.transform(order, lambda i: F.get(items, i))


def sorted_kinds(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def reindexed(items: Column, kinds: Column) -> Column:
    """The place in ``kinds`` of each item; -1 if it is not there."""
    return F.transform(items, lambda x: (F.array_position(kinds, x) - 1).cast("int"))


def collected(value: Column, *order: Column) -> Column:
    """An aggregate: values in the order of ``order``."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], value.alias("v")))), lambda s: s["v"])


def argmax(items: Column) -> Column:
    """The place of the largest item, the first of equal ones."""
    return (F.array_position(items, F.array_max(items)) - 1).cast("int")

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.functions import vectors
from weftwork.operators import context
from weftwork.plans import context_queries, model_queries, structure_queries, text_queries


def both(a, b):
    return vectors.added(a, b)


def test_queries_have_names_of_their_own():
    parts = (text_queries, structure_queries, model_queries, context_queries)
    assert sum(len(p.Q) for p in parts) == len({n for p in parts for n in p.Q})


def test_context_keeps_or_zeroes_what_has_no_owner(spark):
    nodes = spark.createDataFrame([(1, 7, [1.0]), (2, None, [2.0]), (3, 9, [3.0])], "idx long, own long, value array<double>")
    side = spark.createDataFrame([(7, [10.0])], "idx long, value array<double>")
    less = lambda a, b: F.zip_with(a, b, lambda x, y: y - x)
    for missing, want in (("keep", {1: 9.0, 2: 2.0, 3: 3.0}), ("zero", {1: 9.0, 2: -2.0, 3: -3.0})):
        got = context.with_context(nodes, F.col("own"), side, less, missing).collect()
        assert {r.idx: r.value[0] for r in got} == want
    assert context.with_context(nodes.limit(0), F.col("own"), side, less).collect() == []


def test_range_samples_are_those_of_numpy(spark):
    rows = spark.createDataFrame([(1, 5, 4), (2, 5, 0), (3, 8, 10)], "id long, seed long, n long")
    got = {r.id: r.sample for r in context.range_samples(rows, "id", "seed", "n", 10, 20).collect()}
    assert got == {i: np.random.RandomState(s).choice(np.arange(10, 20), size=n, replace=False).tolist() for i, s, n in ((1, 5, 4), (2, 5, 0), (3, 8, 10))}
    again = context.range_samples(rows, "id", "seed", "n", 0, 3, replace=True).collect()
    assert all(len(r.sample) == n for r, n in zip(sorted(again), (4, 0, 10)))


def test_collation_stacks_and_joins_keys(spark):
    rows = spark.createDataFrame([(0, 1, 5, "b", {"x": 1}), (0, 0, None, "a", {"y": 2, "x": 3}), (1, 0, 6, None, None)], "batch long, pos long, n long, s string, m map<string, int>")
    got = {r.batch: r for r in context.collated(rows, "batch", "pos", ["n"], ["s"], ["m"]).collect()}
    assert (got[0].n, got[0].s, got[0].m) == ([None, 5], ["a", "b"], {"x": [3, 1], "y": [2, None]})
    assert (got[1].n, got[1].s, got[1].m) == ([6], [None], {})


def test_leaves_limits_and_disjointness(spark):
    rows = spark.createDataFrame(
        [(1, [], 3, 3, "s"), (2, [4], 3, 3, "s"), (3, None, 3, 4, "s"), (4, None, 3, 3, None), (5, None, 3, 3, "s")],
        "id long, kids array<long>, b long, e long, sym string",
    )
    leaf = context.is_symbol_leaf(F.col("kids"), F.col("b"), F.col("e"), F.col("sym"))
    assert sorted(r.id for r in rows.where(leaf).collect()) == [1, 5]
    kinds = spark.createDataFrame([(["E", "B"],), (["B", "B"],), (["B", "E"],), ([],), (None,)], "k array<string>")
    assert [r[0] for r in kinds.select(context.only_last_is(F.col("k"), "B")).collect()] == [True, False, False, False, False]
    members = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("a", 2)], "g string, i long")
    assert [tuple(r) for r in context.in_several(members, "g", "i").collect()] == [(1, 2)]


@pytest.mark.parametrize(("most_pairs", "most_leaves", "want"), [(3, None, {1, 2}), (None, 2, {2}), (None, None, {1, 2, 3}), (0, 1, set())])
def test_caps_count_before_pairs(spark, most_pairs, most_leaves, want):
    paths = spark.createDataFrame([(t, i) for t, n in ((1, 3), (2, 2), (3, 4)) for i in range(n)], "tree long, leaf long")
    assert {r.tree for r in context.within_caps(paths, "tree", most_pairs, most_leaves).collect()} == want


def test_folds_let_zeros_into_nodes_without_occurrences(spark):
    nodes = spark.createDataFrame([(0, [1.0]), (1, [1.0])], "idx long, value array<double>")
    seen = spark.createDataFrame([(0, [2.0]), (0, [4.0])], "node long, value array<double>")
    got = context.folded([seen, seen], nodes, both, "mean").collect()
    assert {r.idx: r.value for r in got} == {0: [4.0], 1: [1.0]}


def test_rates_end_at_one(spark):
    row = spark.range(1).select(
        *[F.round(context.closer_to_one(F.lit(0.4), F.lit(f)), 6).alias(f"r{i}") for i, f in enumerate((1.0, 0.5, 0.0))],
        context.closer_spread(F.lit(0.4), F.lit(0.2), F.lit(0.0)).alias("least"),
        context.closer_spread(F.lit(1.0), F.lit(0.2), F.lit(0.5)).alias("whole"),
    )
    assert tuple(row.first())[:3] == (0.4, 0.7, 1.0) and row.first().least == row.first().whole == np.finfo(float).eps


def test_defaults_declarations_and_catalogue(spark):
    rows = spark.createDataFrame([(1, None, [("a", True)])], "a long, b string, items array<struct<name: string, ok: boolean>>")
    full = context.defaulted(rows, {"b": "none", "c": 3, "d": lambda columns: F.lit(len(columns))})
    assert tuple(full.drop("items").first()) == (1, "none", 3, 4)
    declared = rows.select(context.declared(F.col("a"), "a", group="nodes", key=True))
    assert declared.schema["a"].metadata == {"group": "nodes", "key": True}
    got = [tuple(r) for r in context.catalogue(rows).collect()]
    assert got == [("a", "Numerical", None), ("b", "Categorical", None), ("items", "Sequence", None), ("items.name", "Categorical", "items"), ("items.ok", "Boolean", "items")]


def test_lookups_of_dangling_indices_are_zeros(spark):
    side = spark.createDataFrame([(0, [1.0, 2.0])], "idx long, value array<double>")
    rows = spark.createDataFrame([(0, 5), (None, 0)], "i long, j long")
    got = sorted(map(str, (r.encoding for r in context.looked_up(rows, {"i": side, "j": side}).collect())))
    assert got == ["[0.0, 0.0, 1.0, 2.0]", "[1.0, 2.0, 0.0, 0.0]"]
    assert [r.encoding for r in context.looked_up(rows, {"i": side, "j": side}, "add").collect()] == [[1.0, 2.0]] * 2

import json
import os
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.functions import arrays, strings
from weftwork.operators import batching, graphs, limits, metrics, models, trees, vocabulary
from weftwork.plans.params import NGrams, Params, for_model
from weftwork.sources import raw, schema, store


def examples():
    ranged = {"beginTokenIdx": 0, "endTokenIdx": 1}
    for i in range(3):
        call = {"hash": f"c{i}", "methodRef": {"hash": f"m{i}"}, "astNodeIdx": 1, "pdgNodeIdx": None if i == 2 else 1, "logLevel": "info"}
        ast = {"methodHash": f"m{i}", "rootNodeIdx": 0, "nodes": [{"idx": 0, "type": "Root", "childrenIdxs": [1]}, {"idx": 1, "type": "Leaf_A", "parentNodeIdx": 0}]}
        pdg = {"methodHash": f"m{i}", "entryPDGNodeIdx": 0, "exitPDGNodeIdx": 1, "identifierByIdx": ["a", "b"], "pdgNodes": [{"idx": 0, "controlKind": "METHOD_ENTRY", "hasExpression": True, "codeSubTokenRangeRef": ranged}]}
        yield f"c{i}", call, {"hash": f"m{i}", "name": "f"}, ast, pdg


def folder_of(path, rows):
    os.makedirs(path, exist_ok=True)
    for k, name in enumerate(raw.FILES.values()):
        with open(f"{path}/{name}", "w") as f:
            f.writelines((r[k] if k == 0 else json.dumps(r[k])) + "\n" for r in rows)
    return f"file://{path}"


def test_aligned_scan_decodes_and_verifies(spark, tmp_path):
    folder = folder_of(f"{tmp_path}/raw", list(examples()))
    files = raw.paths(spark, folder, required=("method_ast",))
    assert set(files) == set(raw.FILES)
    rows = raw.aligned(spark, files)
    got = rows.orderBy("line_no").collect()
    assert [r.hash for r in got] == ["c0", "c1", "c2"] and got[0].method_ast.nodes[1].type == "Leaf_A"
    assert raw.verified(rows).count() == 2
    assert rows.where(F.size(schema.broken_invariants()) > 0).count() == 0
    with pytest.raises(FileNotFoundError):
        raw.paths(spark, f"file://{tmp_path}/none")
    with pytest.raises(FileNotFoundError):
        raw.paths(spark, folder, method=f"file://{tmp_path}/none")


def test_short_file_warns_and_wrong_hash_fails(spark, tmp_path):
    rows = list(examples())
    folder = folder_of(f"{tmp_path}/raw", rows)
    with open(f"{tmp_path}/raw/method.txt", "w") as f:
        f.write(json.dumps(rows[0][2]) + "\n")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert raw.aligned(spark, raw.paths(spark, folder)).count() == 1
    assert any("differ in length" in str(w.message) for w in seen)
    rows[1][3]["methodHash"] = "other"
    folder = folder_of(f"{tmp_path}/bad", rows)
    with pytest.raises(Exception, match="of another method"):
        raw.verified(raw.aligned(spark, raw.paths(spark, folder))).collect()


def test_store_round_trip_and_discovery(spark, tmp_path):
    root = store.Store(spark, f"file://{tmp_path}/s")
    rows = spark.range(100).select(F.col("id").alias("example_idx"), (F.col("id") * 2).alias("x"))
    small, large = for_model("ast-paths", "paths"), Params.full()
    full = root.write(rows, "Train", large, codec="gzip", rows_per_file=30)
    assert root.compatible("Train", small) == full and root.compatible("Test", small) is None
    fit = root.write(rows.limit(5), "Train", small)
    assert root.compatible("Train", small) == fit
    assert sorted(r.x for r in root.lookup(full, [3, 50]).collect()) == [6, 100]
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        root.write(rows, "Train", large)
    assert root.write(rows, "Train", large, overwrite=True) == full
    assert not store.contains(store.asdict(small), store.asdict(large))
    assert store.contains({"n": {"least": 1, "most": 9}}, {"n": {"least": 2, "most": 6}})
    assert "flow.ngrams" in store.columns_of(Params(flow=for_model("tokens", "ngrams").flow)) and NGrams(2, 6).most == 6
    predicted = spark.createDataFrame([("b", ["x", "y"]), ("a", [])], "h string, names array<string>")
    store.write_predictions(predicted, f"file://{tmp_path}/p", "h", "names")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/p/predictions.txt").collect()] == ["", "x y"]


def test_vocabulary_errors_and_nulls(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "a")], "k long, w string")
    vocab = vocabulary.vocabulary(vocabulary.word_counts(rows, "w", "k"), ["<U>"])
    assert [(r.word, r.idx) for r in vocab.orderBy("idx").collect()] == [("<U>", 0), ("a", 1), ("b", 2)]
    assert [r.idx for r in vocabulary.encode(rows, "w", vocab, 0).orderBy("k").collect()] == [1, 0, 2, 1]
    with pytest.raises(Exception, match="not in the vocabulary"):
        vocabulary.encode_strict(rows, "w", vocab).collect()


def test_limits_of_nulls_and_infinities(spark):
    rows = spark.createDataFrame([(1.0,), (None,), (float("inf"),), (float("-inf"),), (7.0,)], "v double")
    found = limits.with_violations(rows, [limits.Limit("v", F.col("v"), 0, 5)])
    report = {r.reason: r for r in limits.report(found).collect()}
    assert report["v+"].n == 2 and report["v+"].n_inf == 1 and report["v+"].mean == 7.0 and report["v+"].std == 0
    assert report["v-"].n == 1 and limits.kept(rows, [limits.Limit("v", F.col("v"), 0, 5)]).count() == 2


def test_array_functions(spark):
    row = spark.sql("select array(5, 6, 7, 8) a, array(2, 0, 3, 1) p, array() e").select(
        arrays.inclusive_slice(F.col("a"), F.lit(1), F.lit(2)).alias("s"),
        arrays.ngrams(F.col("a"), 3).alias("g"),
        arrays.ngrams(F.col("a"), 5).alias("none"),
        arrays.inverse_permutation(F.col("p")).alias("inv"),
        arrays.permuted(arrays.permuted(F.col("a"), F.col("p")), arrays.inverse_permutation(F.col("p"))).alias("back"),
        arrays.masked_range(F.col("a"), F.lit(0), F.lit(3), F.lit(0)).alias("m"),
        arrays.woven(F.col("a"), F.array(F.lit(1))).alias("w"),
        arrays.pad_truncate(F.col("a"), 6, F.lit(0)).alias("pad"),
    ).first()
    assert row.s == [6, 7] and row.g == [[5, 6, 7], [6, 7, 8]] and row.none == [] and row.inv == [1, 3, 0, 2]
    assert row.back == [5, 6, 7, 8] and row.m == [0] and row.w == [5, 1, 6, 7, 8] and row.pad == [5, 6, 7, 8, 0, 0]


def test_strings(spark):
    row = spark.range(1).select(
        strings.minor(F.lit("BinaryExpr_PLUS_X")).alias("minor"),
        strings.minor(F.lit("Name")).alias("none"),
        strings.major(F.lit("BinaryExpr_PLUS")).alias("major"),
        strings.bare(F.lit("__LoG_")).alias("bare"),
        strings.file_size(F.lit(1536)).alias("size"),
        strings.clipped_place(F.lit(9)).alias("place"),
        strings.code_slice(F.lit("abcdef"), F.lit(1), F.lit(3)).alias("code"),
    ).first()
    assert tuple(row) == ("PLUS_X", None, "BinaryExpr", "log", "1.50 KB", "child_place=3", "bc")


def test_numbers_in_order_at_any_partitioning(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 10007).alias("k")).repartition(13)
    got = sorted((r.k, r.number) for r in batching.numbered(rows, "k", ranges=7).collect())
    assert [n for _, n in got] == list(range(1000))
    assert batching.numbered(rows.limit(0), "k", ranges=1).count() == 0


def test_fragments_move_items_only_within(spark):
    rows = spark.createDataFrame([(i, 30) for i in range(5)], "e long, n int")
    for r in batching.fragmented_order(rows, "e", "n", "s", 2, 5).collect():
        assert sorted(r.order) == list(range(30)) and max(abs(x - i) for i, x in enumerate(r.order)) < 5
    assert sum(batching.fragments(17, 3)) == 17


def test_quota_walks(spark):
    rows = spark.createDataFrame([(1, [(0, 1), (1, 2), (2, 1), (2, 3)], [1, 2], 0, 3)], "g int, edges array<struct<s: int, d: int>>, loops array<int>, source int, target int")
    assert sorted(r.path for r in graphs.quota_paths(rows, "g").collect()) == [[0, 1, 2, 1, 2, 3], [0, 1, 2, 3]]
    assert graphs.quota_paths(rows, "g", most=2).collect() == []


def test_deep_tree_is_an_error(spark):
    rows = spark.createDataFrame([(0, i, i - 1 if i else None) for i in range(8)], "tree int, idx int, parent int")
    assert [len(r.path) for r in trees.leaf_to_root(rows).collect()] == [8]
    with pytest.raises(ValueError, match="deeper"):
        trees.leaf_to_root(rows, depth=3)


def test_set_metrics_by_hand(spark):
    rows = spark.createDataFrame([([1, 2], [2, 1]), ([1], [2, 3]), ([], [])], "t array<int>, p array<int>")
    m = metrics.set_metrics(rows.select(*metrics.set_outcomes(F.col("t"), F.col("p")))).first()
    assert (m.tp, m.fp, m.fn, m.n) == (2, 2, 1, 3)
    assert abs(m.accuracy_any - 2 / 3) < 1e-9 and abs(m.accuracy_ordered - 1 / 3) < 1e-9 and abs(m.precision - 0.5) < 1e-6


def test_tree_lstm_of_a_chain_feeds_children_up():
    net = models.TreeLstm(3, 2)
    x = np.random.default_rng(0).normal(size=(3, 3))
    whole = net.run(x, [-1, 0, 1])
    assert np.allclose(whole[2], net.run(x[2:], [-1])[0]) and not np.allclose(whole[0], net.run(x[:1], [-1])[0])


def method_example(n_symbols=2):
    pos = {"begin": {"col": 0, "line": 0}, "end": {"col": 1, "line": 0}}
    token = lambda k, **x: {"kind": k, "positionRangeInCodeSnippetStr": {"beginIdx": 0, "endIdx": 1}, "positionRangeInFile": pos, **x}
    tokens = [token("KEYWORD", text="if"), token("IDENTIFIER", identifierIdx=0, symbolIdx=0), token("OPERATOR", operator="PLUS"), token("IDENTIFIER", identifierIdx=1), token("SEPARATOR", separator="SEMICOLON")]
    ref = lambda i, name: {"identifierIdx": i, "symbolIdx": i, "symbolName": name}
    use = {"use": {"must": [ref(1, "b"), ref(0, "LOG_")], "may": [ref(1, "b"), ref(0, "a")]}}
    ranged = lambda a, b: {"beginTokenIdx": a, "endTokenIdx": b}
    pdg = [
        {"idx": 0, "controlKind": "METHOD_ENTRY", "hasExpression": False, "controlFlowOutEdges": [{"PGDNodeIdx": 1, "type": None}]},
        {"idx": 1, "controlKind": "EXPRESSION", "hasExpression": True, "codeSubTokenRangeRef": ranged(0, 2), "controlFlowOutEdges": [{"PGDNodeIdx": 2, "type": "True"}], "dataDependencyOutEdges": [{"PGDNodeIdx": 2, "symbols": [ref(0, "a"), ref(1, "b")]}]},
        {"idx": 2, "controlKind": "EXPRESSION", "hasExpression": True, "codeSubTokenRangeRef": ranged(3, 4), "symbolsUseDefMut": use},
    ]
    ast = [
        {"idx": 0, "type": "MethodDecl", "childrenIdxs": [1, 2]},
        {"idx": 1, "type": "BinaryExpr_PLUS", "parentNodeIdx": 0, "childPlaceAtParent": 0, "identifier": "a"},
        {"idx": 2, "type": "Name", "parentNodeIdx": 0, "childPlaceAtParent": 1, "modifier": "final"},
    ]
    return {
        "hash": "h",
        "logging_call": {"hash": "h", "methodRef": {"hash": "m"}, "astNodeIdx": 2, "pdgNodeIdx": 2},
        "method": {"hash": "m", "code": {"codeStr": "x", "tokenized": tokens}},
        "method_ast": {"methodHash": "m", "rootNodeIdx": 0, "nodes": ast},
        "method_pdg": {"methodHash": "m", "entryPDGNodeIdx": 0, "exitPDGNodeIdx": 2, "identifierByIdx": ["getA", "b"], "subIdentifiersByIdx": [["get", "a"], ["b"]], "pdgNodes": pdg, "symbols": [{"idx": i, "identifierIdx": i, "symbolName": "s"} for i in range(n_symbols)]},
    }


def test_preprocessing_of_a_method(spark):
    from weftwork.plans import preprocess

    rows = [method_example(), method_example(n_symbols=60)]
    lines = spark.createDataFrame([(i, *[json.dumps(r[p]) for p in schema.PARTS]) for i, r in enumerate(rows)], f"line_no long, {', '.join(p + ' string' for p in schema.PARTS)}")
    examples_ = lines.select("line_no", *[schema.decoded(p, F.col(p)).alias(p) for p in schema.PARTS])
    loose = {"n_pdg_nodes": (1, 80), "n_expressions": (1, None), "n_symbols": (1, 55)}
    kept, rejected = preprocess.preprocessed(examples_, loose)
    assert [(r.line_no, [v.name for v in r.violations]) for r in rejected.collect()] == [(1, ["n_symbols"])]
    assert {v.name for v in preprocess.preprocessed(examples_)[1].where("line_no = 0").first().violations} == {"n_pdg_nodes", "n_expressions", "n_symbols"}
    r = kept.first()
    assert r.sub_parts == ["a", "b", "get"] and r.identifier_sub_parts == [[2, 0], [1]] and r.symbols_identifier == [0, 1]
    assert r.ast_major == ["MethodDecl", "BinaryExpr", "Name"] and r.ast_minor == ["<PAD>", "PLUS", "<PAD>"]
    assert r.ast_from_left == ["+ROOT", "+1", "+2"] and r.ast_from_right == ["-ROOT", "-2", "-1"] and r.ast_children == ["2", "0", "0"]
    assert [tuple(x) for x in r.identifier_leaves] == [(1, "a")] and [tuple(x) for x in r.modifier_leaves] == [(2, "final")]
    assert r.control_kind == ["METHOD_ENTRY", "EXPRESSION", "<LOG_PRED>"] and r.has_expression == [False, True, False]
    assert [[t.kos for t in e.tokens] for e in r.expressions] == [["kwrd_if", None, "op_PLUS"]]
    assert [tuple(e) for e in r.flow_edges] == [(0, 1, "<PAD>"), (1, 2, "True")] and [tuple(e) for e in r.ast_edges] == [(0, 1), (0, 2)]
    assert r.method_tokens == ["KEYWORD", "IDENTIFIER", "OPERATOR", "<LOG_PRED>"]
    assert r.targets == [1, 3, 4, 2, 0, 0]
    vocab = spark.createDataFrame([("MethodDecl", 2), ("Name", 3)], "word string, idx long")
    assert preprocess.encoded_column(kept, "line_no", "ast_major", vocab, 1).first().ast_major == [2, 1, 3]
    code = spark.range(1).select(preprocess.formatted(F.lit("abcdef"), F.expr("array(named_struct('k', 7, 'begin', 1, 'end', 3), named_struct('k', 8, 'begin', 4, 'end', 5))")).alias("c"))
    assert code.first().c == "a[@7 bc]d[@8 e]f"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cached_table_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert store.cached(spark, f"file://{tmp_path}/words", build).count() == 3
    assert calls == [1]

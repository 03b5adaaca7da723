import numpy as np
from cases import ODD, SF, frame, words

from weftwork.llm import decontaminate, q07_decontaminate


def brute(docs, items, window=13):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(len(v), window)
            for k in range(len(v) - n + 1) if n else ():
                for a in range(len(w) - n + 1):
                    if w[a : a + n] == v[k : k + n]:
                        hit.update(range(a, a + n))
                        found.add(item)
        found.discard(None)
        out.append((str(i), len(w), len(hit), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def rows(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in df.collect())


def test_suffix_array_is_sorted_to_its_depth():
    rng = np.random.default_rng(2)
    for n, kinds, depth in ((1, 1, 3), (50, 2, 7), (400, 3, 40), (300, 200, 13), (64, 1, 64)):
        codes = rng.integers(1, kinds + 1, n)
        padded = np.concatenate([codes, np.zeros(depth, np.int64)])
        order = decontaminate.suffix_array(codes, depth)
        seen = [tuple(padded[i : i + depth]) for i in order]
        assert sorted(order) == list(range(n)) and seen == sorted(seen)


def test_hits_agree_with_brute_force(spark):
    items = [(1, "one two three"), (2, " ".join(f"w{k}" for k in range(30))), (3, ""), (4, None), (5, "Word"), (None, "no id here"), (2, "also two")]
    w = [f"w{k}" for k in range(30)]
    docs = ODD + [(30, " ".join(["x"] + w[3:20] + ["y"] + w[:13] + ["one-two, THREE"])), (31, " ".join(w[:12])), (32, "also two " * 40), (30, "one two three one two three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontaminate.contamination(frame(spark, docs), bench))
    assert got == brute(docs, items)
    assert any(r[4] for r in got)


def test_small_shards_and_item_blocks_change_nothing(spark, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:80]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    table = decontaminate.Items([i for i, _ in items], [t for _, t in items], 13)
    halves = [decontaminate.Items([i for i, _ in p], [t for _, t in p], 13) for p in (items[:15], items[15:])]
    raw = [(t or "").encode() for _, t in docs]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    whole = decontaminate._hits(b"".join(raw), offsets, [table], 13)
    monkeypatch.setattr(decontaminate._sorted_shards, "__defaults__", (100,))
    for blocks in ([table], halves):
        for a, b in zip(whole, decontaminate._hits(b"".join(raw), offsets, blocks, 13), strict=True):
            assert list(a) == list(b)
    assert whole[1].any()


def test_longest_matches(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g"), (2, None)], "item_id long, text string")
    docs = frame(spark, [(5, "x b c d e f y"), (6, "a b c d e f g"), (7, "a b c d e f g"), (8, None)])
    got = {(r.item_id, r.item_word): (r.n_words, r.doc_id, r.doc_word) for r in decontaminate.longest_matches(docs, bench, least=5).collect()}
    assert got == {(1, 0): (7, 6, 0), (1, 1): (6, 6, 1), (1, 2): (5, 6, 2)}


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.contamination(frame(spark, ODD), bench).collect())
    assert decontaminate.contamination(frame(spark, []), bench).collect() == []
    kept = decontaminate.decontaminated(frame(spark, ODD), spark.createDataFrame([(1, "word")], "item_id long, text string"))
    assert kept.count() == len(ODD) - 1 and kept.columns == frame(spark, []).columns


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:40]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {x[0]: (x[1], x[2], len(x[3]), decontaminate.digest(x[3]), x[4]) for x in brute(docs, items)}
    got = {str(r.doc_id): tuple(r)[1:] for r in q07_decontaminate.op7_decontaminate(spark, SF).collect()}
    assert {k: got[k] for k in want} == want

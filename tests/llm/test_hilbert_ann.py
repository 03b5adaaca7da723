import numpy as np

from weftwork.llm import hilbert_ann, q03_hilbert_ann


def brute(rows, queries, k):
    out = {}
    for q, x in queries:
        found = sorted((-float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))), i) for i, y in rows if i != q)
        out[q] = [(i, -s) for s, i in found[:k]]
    return out


def test_hilbert_order_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = hilbert_ann.hilbert(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in table.collect()]
    want = brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
    got = q03_hilbert_ann.op3_hilbert_ann(spark, "/root/testdata/sf0.01").collect()
    scores = {i: dict(brute(rows, [(i, x)], len(rows))[i]) for i, x in rows if i % 50 == 0}
    assert all(abs(r.score - scores[r.query_id][r.vec_id]) < 1e-12 for r in got)
    found = {(r.query_id, r.vec_id) for r in got}
    whole = {(q, i) for q, near in want.items() for i, _ in near}
    assert len(got) == len(whole) == len(found)
    assert len(found & whole) / len(whole) >= 0.9


def test_odd_rows(spark):
    same = [float(i == 0) for i in range(8)]
    rows = [(i, same) for i in range(40)] + [(100, None), (101, []), (102, [0.0] * 8), (103, [float("nan")] + same[1:])]
    rows += [(104, [None] + same[1:]), (None, same), (105, [1.0, 2.0]), (3, same), (50, [0.5] * 8)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, ids string, query int")
    got = hilbert_ann.neighbours(frame, frame.where("vec_id in (0, 50, 100, 105)"), k=5).collect()
    near = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50, 100, 105)}
    assert near == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 100: [], 105: []}
    assert hilbert_ann.neighbours(frame.limit(0), frame, 5).collect() == []


def test_repeated_rows_hide_no_neighbours(spark):
    same = [float(i == 0) for i in range(8)]
    for times in ([3] * 6, [12, 1, 1, 1, 1, 1]):
        rows = [(i + 1, same) for i, n in enumerate(times) for _ in range(n)]
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        got = hilbert_ann.neighbours(frame, frame.where("vec_id in (1, 6)"), k=5).collect()
        near = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 6)}
        assert near == {1: [2, 3, 4, 5, 6], 6: [1, 2, 3, 4, 5]}

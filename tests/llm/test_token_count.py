import numpy as np
from cases import ODD, frame

from weftwork.llm import token_count


def test_counts_of_odd_documents(spark):
    docs = frame(spark, ODD)
    want = sorted((str(i), len((t or "").encode())) for i, t in ODD)
    assert want == sorted((str(r.doc_id), r.n_tokens) for r in token_count.document_tokens(docs).collect())
    assert token_count.document_tokens(docs.limit(0), turns=1).collect() == []


def test_blocks_are_stitched(spark, tmp_path):
    rng = np.random.default_rng(1)
    for dtype, end in (("<u2", 50256), ("<u4", 100257)):
        for name, lengths in (("a", [0, 5, 0, 700, 1, 0]), ("b", [2000]), ("c", []), ("d", [3, 4])):
            ids = np.concatenate([np.append(rng.integers(0, 50000, n), end) for n in lengths] + [np.zeros(0, np.int64)])
            ids = ids[:-1] if name == "d" else ids  # its last document has not ended
            folder = tmp_path / dtype[1:]
            folder.mkdir(exist_ok=True)
            (folder / name).write_bytes(ids.astype(dtype).tobytes())
        for block in (4, 16, 100, 1 << 20):
            rows = token_count.scan(spark, f"file://{folder}", end=end, dtype=dtype, block_bytes=block).collect()
            got = {}
            for r in sorted(rows, key=lambda r: (r.file, r.ordinal)):
                got.setdefault(r.file[-1], []).append((r.n_tokens, r.ended))
            assert got == {
                "a": [(n, True) for n in (0, 5, 0, 700, 1, 0)],
                "b": [(2000, True)],
                "d": [(3, True), (4, False)],
            }, (dtype, block)


def test_heads_over_block_borders(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(300)] + [(None, "abc")], "doc_id long, text string")
    folder = f"file://{tmp_path}/t"
    token_count.byte_token_files(docs.coalesce(1), folder)
    rows = token_count.scan(spark, f"{folder}/part-*", heads=token_count.HEAD, block_bytes=13).collect()
    assert sorted((r.head, r.n_tokens) for r in rows) == sorted([(str(i), i % 7) for i in range(300)] + [("", 3)])

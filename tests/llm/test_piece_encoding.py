import tracemalloc

import numpy as np
import pyarrow as pa
import sentencepiece
from cases import ODD, SF, frame

from weftwork.llm import piece_encoding, q09_piece_encoding
from weftwork.llm.common import text_blocks

MORE = [(20, "a  b   c "), (21, " lead"), (22, "▁ mark ▁▁x"), (23, "tab\tline\r\n\n{\r end"), (24, "\x00\x01 日本語 \U0001f600")]


def test_round_trip_and_digests(spark):
    path = q09_piece_encoding.vocabulary()
    docs = frame(spark, ODD + MORE)
    ids = piece_encoding.encoded(docs, path)
    want = sorted((str(i), t or "") for i, t in ODD + MORE)
    assert want == sorted((str(r.doc_id), r.text) for r in piece_encoding.decoded(ids, path).collect())
    rows = piece_encoding.digests(docs, path).collect()
    assert all(r.exact for r in rows)
    assert sorted((str(r.doc_id), r.n_bytes) for r in rows) == sorted((i, len(t.encode())) for i, t in want)
    assert piece_encoding.encoded(docs.limit(0), path).collect() == []


def brute(model, text):
    """Best sum of scores over all segmentations of a whole text, by the library's own pieces."""
    text = "▁" + text.replace(" ", "▁")
    usual = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    low = min(usual.values()) - 10
    best = [0.0] + [-float("inf")] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 48), end):
            score = usual.get(text[start:end], low if start == end - 1 else None)
            if score is not None:
                best[end] = max(best[end], best[start] + score)
    return best[-1]


def test_segmentations_have_the_best_score(spark):
    path = q09_piece_encoding.vocabulary()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = piece_encoding.Pieces.load(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(25).collect()
    for text in [r.text for r in docs] + ["a b c", "\u0416\u4e16 x", "don't  stop"]:
        ids, _, _, _ = pieces.encode(text.encode(), np.array([0, len(text.encode())]))
        score, at = 0.0, 0
        while at < len(ids):
            if model.is_byte(int(ids[at])):
                width = next(n for n in (1, 2, 3, 4) if model.is_byte(int(ids[at + n - 1])) and _whole([int(model.id_to_piece(int(i))[3:5], 16) for i in ids[at : at + n]]))
                score, at = score + pieces.low, at + width
            else:
                score, at = score + model.get_score(int(ids[at])), at + 1
        assert abs(score - brute(model, text)) < 1e-6 * abs(score), text


def _whole(values):
    try:
        return len(bytes(values).decode()) == 1
    except UnicodeDecodeError:
        return False


def test_shared_prefixes_change_nothing():
    pieces = piece_encoding.Pieces.load(q09_piece_encoding.vocabulary())
    words = [" the", " then", " theory", " there", " zebra", "", " th"]
    alone = {w: pieces.segment([w])[0] for w in words}
    assert {w: i for w, i in zip(sorted(words), pieces.segment(sorted(words)), strict=True)} == alone


def test_query(spark):
    rows = q09_piece_encoding.op9_piece_encoding(spark, SF).collect()
    assert len(rows) == 200 and all(r.exact for r in rows)


def test_a_worker_holds_little_at_a_time():
    # 8 MB of text in batches: what numpy and Python hold at once follows the block, not the input
    names = [" ", *"abcdefghijklmnopqrstuvwxyz"]
    pieces = piece_encoding.Pieces(names, [-1.0] * len(names), {}, set(), 0)
    text = "the quick brown fox jumps over a lazy dog " * 24
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": [text] * 1000})
    tracemalloc.start()
    try:
        tokens = sum(len(pieces.encode(raw, offsets)[0]) for _, raw, offsets in text_blocks([batch] * 8))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert tokens == 8000 * (len(text) + 1) and peak < 64 << 20

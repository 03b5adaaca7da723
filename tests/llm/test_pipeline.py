"""Each stage against a plainer version of what it decides."""

from cases import words

import corpus_pipeline
from weftwork.llm import piece_encoding, quality
from weftwork.llm.q01_quality import training_labels
from weftwork.llm.q09_piece_encoding import vocabulary

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "personal_data", "encoding"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, SF), name)
        if name != "encoding":
            assert out.schema.simpleString() == docs.schema.simpleString()
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "near_dedup":
            sets = {i: shingles(r.text) for i, r in before.items()}
            root = {i: i for i in sets}

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            for i in sets:
                for j in sets:
                    if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                        a, b = sorted((find(i), find(j)))
                        root[b] = a
            assert set(after) == {i for i in sets if find(i) == i}
        if name == "decontamination":
            windows = set()
            for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
                w = words(r.text)
                n = min(len(w), 13)
                windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
            for i, r in before.items():
                w, hit = words(r.text), set()
                for n in {len(x) for x in windows}:
                    for k in range(len(w) - n + 1):
                        if tuple(w[k : k + n]) in windows:
                            hit.update(range(k, k + n))
                assert (i in after) == (not hit or 20 * len(hit) < len(w))
        if name == "personal_data":
            assert set(after) == set(before)
            assert all(r.n_chars == len(r.text) for r in after.values())
            assert any(r.text != before[i].text for i, r in after.items())
            assert not any("@mail" in r.text for r in after.values())
        if name == "encoding":
            texts = {r.doc_id: r.text for r in piece_encoding.decoded(out, vocabulary()).collect()}
            assert texts == {i: r.text for i, r in before.items()}
            assert all(r.n_tokens == len(r.ids) for r in after.values())
        kept.append(len(after))
        docs = out
    assert kept[0] < 200 and kept[1] < kept[0] and kept[2] < kept[1]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "empty")
        assert docs.collect() == []


def test_rows_are_dropped_by_id_and_text(spark):
    # a contaminated, a clean, a junk and a repeated row, all without an id or with one id, and columns of clashing names
    passage = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text), key=len)
    clean = next(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if r.text and 60 < len(r.text.split()) < 200)
    texts = [passage, clean, clean, None, ""]
    rows = [(i, t, "en", "key", len(t or ""), [1]) for i in (None, 5) for t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key array<int>")
    out = corpus_pipeline.decontamination_stage(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(str((i, t)) for i in (None, 5) for t in texts[1:])
    out = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    want = [(None, t) for t in texts] + [(5, t) for t in (passage, clean, None, "")]
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(map(str, want))
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.quality_stage(spark, docs, SF).collect()}
    scores = {(r.key.doc_id, r.key.mark): r.score for r in quality.keyed_scores(docs, training_labels(spark, SF)).collect()}
    assert len(scores) == 8 and {t for _, t in kept} <= set(texts)
    found = corpus_pipeline.personal_data_stage(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in found) == sorted((str(r[0]), len(r[1] or "")) for r in rows)

"""Held-out accuracy of the two classifiers, and what they make of odd rows."""

import zlib

import numpy as np
from cases import ODD, frame

from weftwork.llm import q01_quality, q08_toxicity, quality, toxicity

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def held_out(spark, rows, column):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    own = [r for r in rows if r.held_out and r.doc_id in labels]
    return np.array([r.score for r in own]), np.array([r.predicted for r in own]), np.array([labels[r.doc_id] for r in own])


def test_quality_of_held_out_documents(spark):
    rows = q01_quality.op1_quality(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    score, predicted, label = held_out(spark, rows, "quality")
    assert (predicted == label).mean() > 0.95 and auc(score, label) > 0.95


def test_quality_of_odd_rows(spark):
    docs = frame(spark, ODD)
    labels = spark.createDataFrame([(1, 0), (4, 1), (5, 1), (None, 1), (8, None), (9, 0)], "doc_id long, label int")
    rows = quality.scored(docs, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(docs.limit(0), labels).collect() == []


def test_isotonic_pools_violators():
    knots, values = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]))
    assert np.interp([0, 1, 2, 3], knots, values).tolist() == [0, 0.5, 0.5, 1] and (np.diff(values) >= 0).all()


def lexicon_texts(rng, n, bad):
    """Texts of made-up words; toxic ones hold one or two misspelt words of a small lexicon."""
    words = ["".join(rng.choice(list("aeioustnrl"), 5)) for _ in range(200)]
    texts, labels = [], []
    for k in range(n):
        text = list(rng.choice(words, rng.integers(5, 300)))
        if k % 4 == 0:
            for _ in range(2):
                text[rng.integers(len(text))] = str(rng.choice(bad)) + "".join(rng.choice(list("xyz"), rng.integers(0, 3)))
        texts.append(" ".join(text))
        labels.append(float(k % 4 == 0))
    return texts, np.array(labels)


def test_toxicity_learns_stems_of_unseen_words():
    rng = np.random.default_rng(0)
    texts, labels = lexicon_texts(rng, 900, ["grumpf", "blorquo", "vexkrat"])
    model = toxicity.train(texts[:700], labels[:700], 0.25)
    raw = [t.encode() for t in texts[700:]]
    score = model.score(b"".join(raw), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    assert auc(score, labels[700:]) > 0.9
    assert ((score >= 0.3) == labels[700:]).mean() > 0.88


def test_toxicity_query_and_odd_rows(spark):
    rows = q08_toxicity.op8_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    labels = spark.createDataFrame([(1, 0), (4, 1), (5, 1), (None, 1), (8, 0)], "doc_id long, label int")
    for some in (labels, labels.limit(0), labels.where("label = 1")):
        found = toxicity.scored(frame(spark, ODD), some).collect()
        assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.scored(frame(spark, []), labels).collect() == []

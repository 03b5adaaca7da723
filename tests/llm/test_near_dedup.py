import random
import re

import numpy as np
from cases import ODD, SF, frame, lowered
from pyspark.sql import functions as F

from weftwork.llm import near_dedup, q10_near_dedup


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(docs, size):
    sets, root = [(i, shingles(t, size)) for i, t in docs], {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((str(i), len(s), str(find(i)) if i is not None else "None", i is None or find(i) == i) for i, s in sets)


def rows(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


def test_odd_documents(spark):
    for size in (2, 5):
        assert rows(near_dedup.classes(frame(spark, ODD), size)) == brute(ODD, size)
    assert near_dedup.classes(frame(spark, [])).collect() == []
    kept = near_dedup.deduplicated(frame(spark, ODD))
    assert kept.columns == frame(spark, ODD).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(i) for i, _ in ODD if i != 6})


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    one, two = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    docs = [(1, one), (2, one), (2, two), (3, two.upper()), (4, None), (4, ""), (4, None), (None, one), (None, two), (7, one), (7, one)]
    kept = near_dedup.deduplicated(frame(spark, docs)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted(
        (str(i), str(t)) for i, t in [(1, one), (2, two), (4, None), (4, ""), (4, None), (None, one), (None, two)]
    )


def test_large_groups_by_deviations(spark):
    """One group of two families, heavily changed copies of them that only meet each other, and unlike documents."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]

    def changed(text, n):
        out = list(text)
        for at in rng.sample(range(len(out)), n):
            out[at] = rng.choice(words)
        return out

    base = [rng.choice(words) for _ in range(80)]
    other = changed(base, 9)
    texts = [changed(base, rng.randrange(0, 9)) for _ in range(40)] + [changed(other, rng.randrange(0, 9)) for _ in range(40)]
    texts += [changed(t, rng.randrange(0, 5)) for t in rng.sample(texts, 30)]
    texts += [base[:40] + [rng.choice(words) for _ in range(40)] for _ in range(15)]
    texts += [t[: rng.randrange(55, 80)] for t in rng.sample(texts, 20)]
    texts += [t + [rng.choice(words) for _ in range(rng.randrange(5, 30))] for t in rng.sample(texts, 20)]
    docs = [(k, " ".join(t)) for k, t in enumerate(texts)]
    for size in (1, 2):
        found = near_dedup.features(frame(spark, docs), size)
        sets = found.select(F.col("hi").alias("id"), F.col("key.doc_id").alias("doc_id"), "n_shingles", "sketch").dropDuplicates(["id"])
        groups = near_dedup.written(sets.withColumn("component", F.lit(0).cast("long")), "group")
        by_id = {r.id: r.doc_id for r in groups.collect()}
        members = groups.select("component", "id", "sketch")
        whole = near_dedup.written(near_dedup.group_sets(frame(spark, docs), groups, size).join(groups.select("id", "component"), "id"), "whole")
        plain = {i: shingles(dict(docs)[d], size) for i, d in by_id.items()}
        ids = sorted(plain)
        want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b])}
        links = [(r.a, r.b) for part in near_dedup._large_group_links(members, whole, 80) for r in part.collect()]
        assert {tuple(sorted(x)) for x in links} <= want
        assert classes_of(ids, links) == classes_of(ids, want) and 1 < len(set(classes_of(ids, want).values())) < len(ids)


def classes_of(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Chains of edits, groups larger than a small node and than a block, and similarities about the threshold."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    docs = []
    for group in range(3):
        base = [rng.choice(words) for _ in range(60)]
        for copy in range((150, 60, 4)[group]):
            text = list(base)
            for _ in range(rng.randrange(0, 7)):
                text[rng.randrange(60)] = rng.choice(words)
            docs.append((group * 1000 + copy, " ".join(text)))
    chain = [rng.choice(words) for _ in range(50)]
    for step in range(40):
        docs.append((5000 + step, " ".join(chain)))
        chain[rng.randrange(50)] = rng.choice(words)
    docs += [(9000 + k, " ".join(rng.choice(words) for _ in range(30))) for k in range(60)]
    monkeypatch.setattr(near_dedup, "SMALL", 16)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    assert rows(near_dedup.classes(frame(spark, docs), 2)) == brute(docs, 2)


def test_linked_counts_as_sets_do():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(60)]
    a, b = near_dedup._linked(sets, 30)
    plain = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 30 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == plain and plain


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 150)] + [(7, 7), (30, 31), (31, 30)]
    got = {r.id: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 150)} | {30: 30, 31: 30}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = q10_near_dedup.op10_near_dedup(spark, SF)
    assert rows(found) == brute(docs, 2) and found.where(~F.col("kept")).count() > 0


def test_links_of_one_task_need_no_rounds(spark, monkeypatch):
    """Up to PIECE links are joined in one pass; more in pieces and by rounds, to the same components."""
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(0, 60, 2)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(50)] + [(-5, 88), (7, 7)]
    want = classes_of({x for e in edges for x in e}, edges)
    want = {i: c for i, c in want.items() if any(i in e and e[0] != e[1] for e in edges)}

    def got():
        return {r.id: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}

    monkeypatch.setattr(near_dedup, "PIECE", 8)
    assert got() == want
    monkeypatch.setattr(near_dedup, "PIECE", len(edges))
    monkeypatch.setattr(near_dedup, "_star_rounds", None)
    assert got() == want


def test_large_nodes_end_after_few_levels(spark, monkeypatch):
    """Sets of a large node that one of several pivots stands for go no further: a group of near copies is not followed through all levels."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    bases = [[rng.choice(words) for _ in range(60)]]
    for _ in range(3):
        bases.append([w if rng.random() < 0.85 else rng.choice(words) for w in bases[-1]])
    docs = []
    for copy in range(400):
        text = list(bases[copy % 4])
        text[rng.randrange(60)] = f"x{copy}"
        docs.append((copy, " ".join(text)))
    found = near_dedup.features(frame(spark, docs), 1)
    sets = near_dedup.written(found.select(F.col("hi").alias("id"), "n_shingles", "mins", "sketch"), "sets")
    rows, real = [], near_dedup.written

    def counting(df, name):
        out = real(df, name)
        if name == "nodes":
            rows.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "written", counting)
    monkeypatch.setattr(near_dedup, "SMALL", 16)
    near_dedup.candidates(sets)
    assert sum(rows[1:]) < rows[0] / 10


def test_groups_of_some_hundred_sets_take_no_rounds(spark, monkeypatch):
    """A node of a few thousand sets goes down in one task and a group of them is decided in one: no joins for levels or pivots."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(500)]
    texts = [[rng.choice(words) for _ in range(60)]]
    for _ in range(3):
        texts.append([w if rng.random() < 0.7 else rng.choice(words) for w in texts[-1]])
    docs = []
    for copy in range(400):
        text = list(texts[copy % 4])
        for _ in range(rng.randrange(1, 12)):
            text[rng.randrange(60)] = rng.choice(words)
        docs.append((copy, " ".join(text)))
    names, real = [], near_dedup.written

    def noted(df, name):
        names.append(name)
        return real(df, name)

    monkeypatch.setattr(near_dedup, "written", noted)
    want = brute(docs, 1)
    assert rows(near_dedup.classes(frame(spark, docs), 1)) == want and 1 < len({x[2] for x in want}) < 300
    assert names.count("sizes") == 1 and "large-nodes" not in names and "pivots" not in names


def test_looked_up_gives_the_classes_of_all_links():
    rng = np.random.default_rng(1)
    for likeness in (30, 50, 80):
        sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40))).astype(np.uint64) for _ in range(90)]
        sets += [np.unique(np.concatenate([s, rng.integers(0, 40, 2).astype(np.uint64)])) for s in sets[::2]]
        want = near_dedup._joined(*near_dedup._linked(sets, likeness), len(sets))
        assert near_dedup._looked_up(sets, likeness).tolist() == want.tolist()
    assert 1 < len(set(want.tolist())) < len(sets)


def test_descended_nodes_link_near_sets(monkeypatch):
    """Families of sets in nodes larger than PAIRED: each family in one piece, and no more links than grow with the sets."""
    rng = np.random.default_rng(2)
    family = np.repeat(np.arange(12), 100)
    sketch = rng.integers(0, 256, (12, near_dedup.SIGNATURE)).astype(np.uint8)[family]
    sketch[np.arange(len(family)), rng.integers(0, near_dedup.SIGNATURE, len(family))] = 1
    order = rng.permutation(len(family))
    node, ids = np.sort(np.resize(np.array([5, -7]), len(family))), rng.integers(-(1 << 63), 1 << 63, len(family))
    monkeypatch.setattr(near_dedup, "PAIRED", 16)
    a, b = near_dedup._descended(node, ids, np.full(len(family), 60), sketch[order], near_dedup.LEVELS)
    assert (family[order][a] == family[order][b]).all() and (node[a] == node[b]).all()
    assert len(a) < 40 * len(family)
    root = near_dedup._joined(a, b, len(family))
    pieces = {(f, n): len(set(root[(family[order] == f) & (node == n)].tolist())) for f in range(12) for n in (5, -7)}
    assert max(pieces.values()) <= 3

import random
import re

from cases import ODD, SF, frame, words

from weftwork.llm import license_scan, q04_license_scan


def base(text):
    w, found = words(text), []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return sorted(found)


def test_base_agrees_with_brute_force(spark):
    docs = frame(spark, ODD).select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    want = sorted((str(r[0]), len(words(r[1])), base(r[1])) for r in docs.collect())
    rows = license_scan.scan(docs).collect()
    assert want == sorted((str(r.doc_id), r.n_words, [(b.word, b.label) for b in r.base]) for r in rows)
    assert any(r.base for r in rows)


def test_rules_are_gated_by_what_they_match():
    assert len(license_scan.rules()) > 300
    texts = {
        b"licensed under cc by-nc 4.0.": "cc-by-nc-4.0",
        b"spdx-license-identifier: lgpl-2.1": "lgpl-2.1",
        b"released under the mit license": "mit",
        b"bsd 3-clause": "bsd-3",
        b"mozilla\npublic license 2.0": "mpl-2.0",
    }
    for text, label in texts.items():
        assert label in [r.label for _, _, r in license_scan.detections(text)], text


def test_keyword_gates_lose_nothing():
    text = b" ".join(re.sub(rb"\(\?[:=!<]+|[\\()\[\]?+*|]", b" ", r.pattern) for r in license_scan.rules())
    assert license_scan.detections(text)
    assert license_scan.detections(b"") == []


def test_detections_do_not_overlap():
    found = license_scan.detections(b"licensed under the gnu lesser general public license, version 2.1 or cc by-nc-sa 4.0, copyright (c) 2001")
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def test_empty_table_and_query(spark):
    assert license_scan.scan(frame(spark, [])).collect() == []
    rows = {r.doc_id: r for r in q04_license_scan.op4_license_scan(spark, SF).collect()}
    assert len(rows) == 200 and all(0 <= r.score <= 1 for r in rows.values())
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows.values())


def example(tree, pick):
    """A text that the parsed pattern matches; ``pick`` chooses among what it allows."""
    out = ""
    for op, of in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(of)
        elif op == "ANY":
            out += '"'
        elif op == "IN":
            out += pick([chr(x[1] if str(x[0]) == "LITERAL" else x[1][0]) for x in of])
        elif op == "BRANCH":
            out += example(pick(of[1]), pick)
        elif op == "SUBPATTERN":
            out += example(of[-1], pick)
        elif op == "MAX_REPEAT":
            out += "".join(example(of[2], pick) for _ in range(pick([of[0], min(of[1], of[0] + 1)])))
        else:
            assert op == "ASSERT_NOT", op
    return out


def examples(rule, n):
    """Texts that the rule's pattern matches, spaces as they are written."""
    pick, tree = random.Random(rule.name).choice, re._parser.parse(rule.pattern.decode("latin-1"))
    return [example(tree, pick).encode("latin-1") for _ in range(n)]


def ungated(text):
    return license_scan.suppressed([(m.start(), m.end(), r) for r, p, _ in license_scan._compiled()[0] for m in p.finditer(text)])


def test_gated_detections_are_those_of_all_rules():
    for rule in license_scan.rules():
        for text in examples(rule, 3):
            assert ungated(text) and license_scan.detections(text) == ungated(text), (rule.name, text)
    glued = {b"released under gplv3.": "gpl-3", b"lgplv2.1": "lgpl-2.1", b"agplv3": "agpl-3", b"mplv2.0": "mpl-2.0", b"cc by-nd 4.0": "cc-by-nd-4.0"}
    for text, label in glued.items():
        assert label in [r.label for _, _, r in license_scan.detections(text)], text


def test_every_match_opens_its_gates():
    for rule in license_scan.rules():
        for text in examples(rule, 20):
            assert re.search(rule.pattern, text), (rule.name, text)
            assert all(any(k in text.decode("latin-1") for k in one.split("|")) for one in rule.keywords), (rule.name, text)


def test_wrapped_texts_are_found():
    notices = {
        b"permission is hereby\n granted, free of charge, to any person obtaining a copy": "mit",
        b"all rights\nreserved": "proprietary",
        b"this program is free\n   software; you can redistribute it": "gpl",
        b"released into the public\r\n\tdomain": "public-domain",
    }
    for text, label in notices.items():
        assert label in [r.label for _, _, r in license_scan.detections(text)], text
    for rule in license_scan.rules():
        spaced = rule.pattern if b"[" in rule.pattern else rule.pattern.replace(b" ", b"\n  ").replace(b"\n  ?", b" ?")
        for text in examples(license_scan.Rule(rule.name, spaced, (), "", 0, 0.0), 3):
            assert license_scan.detections(text) == ungated(text), (rule.name, text)

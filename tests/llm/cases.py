"""Documents with nulls, empty and long texts, ties, repeats and clashing columns."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lowered(text))


def frame(spark, rows):
    """doc_id, text and columns whose names the operators use themselves."""
    rows = [(i, t, "x", "s", 1, 0.5, "label", [1]) for i, t in rows]
    return spark.createDataFrame(
        rows, "doc_id long, text string, n string, id string, node int, score double, label string, spans array<int>"
    )


ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t"),
    (4, "word"),
    (5, "MIT License. Licensed under the MIT license, cc-by; gnu  General\nPublic License"),
    (6, "MIT License. Licensed under the MIT license, cc-by; gnu  General\nPublic License"),
    (7, "é ü 🙂 Ünïcode 🙂🙂 a@b.co 1.2.3.4"),
    (None, "no id here, but mail x@y.org"),
    (8, "long " * 30000),
    (9, "a" * 50000),
    (9, "a" * 50000),
]

import hashlib
import re

from cases import ODD, SF, frame
from pyspark.sql import functions as F

from weftwork.llm import personal_data, q02_personal_data

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = []
    for n, (kind, p) in enumerate(KINDS.items()):
        found += [(m.start(), n, m.end()) for m in re.finditer(p, text or "") if holds(kind, m.group())]
    return sorted(found)


TRICKY = [
    "x@a.b_c@d.e", "a@b.c@d.e.f", "@@a@b", "a@b", "1.2.3.4.5.6.7.8", "01.002.0.000", "256.1.1.1", "1.2.3.999 0000.0.0.00",
    "4041894974608795 4041 8949 7460 8795 4041-8949-7460-8795-1", "4111111111111111", "+1 (456) 555-2186, +12 3", "+1 2 3 4 5 6 7 8 9 0 (",
    "🙂 a.b+c@x-y.z.w, 🙂 10.0.0.1", "é1.1.1.1é", "password=7602ad97cf5550", "9" * 5000, "a." * 4000 + "@b" + ".c" * 4000, "1 " * 5000,
    "+1" + " " * 5000, ".".join("1" * 4000), "a" * 60000,
]


def test_base_agrees_with_brute_force(spark):
    docs = frame(spark, ODD + [(100 + i, t) for i, t in enumerate(TRICKY)]).select("doc_id", "text")
    docs = docs.union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    want = sorted((str(r[0]), brute(r[1])) for r in docs.collect())
    got = personal_data.entities(docs).collect()
    assert want == sorted((str(r.doc_id), [tuple(s) for s in r.base]) for r in got)
    for r in got:
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}


def test_confident_patterns_find_what_no_expression_does(spark):
    # a value is one instance however often it occurs: a pattern needs different values
    valid = [n for n in range(4000000000000000, 4000000000009000) if luhn(str(n))][:60]
    rows = [(i, f"card={n} x") for i, n in enumerate(valid)] + [(900, "card=4000000000000001x y"), (901, "year 2001 on")]
    got = {r.doc_id: r for r in personal_data.entities(frame(spark, rows)).collect()}
    assert [s.kind for s in got[900].spans] == [2] and got[900].base == []
    assert got[901].spans == []


def test_redaction_keeps_the_rest(spark):
    rows = [(1, "mail a@b.co now 🙂 1.2.3.4."), (2, None), (3, "clean"), (1, "mail a@b.co now 🙂 1.2.3.4.")]
    got = sorted((r.doc_id, r.text) for r in personal_data.redacted(frame(spark, rows)).collect() if r.text is not None)
    assert got == [(1, "mail <EMAIL> now 🙂 <IP>.")] * 2 + [(3, "clean")]
    assert personal_data.redacted(frame(spark, rows)).columns == frame(spark, rows).columns


def test_query_and_empty_table(spark):
    assert personal_data.entities(frame(spark, [])).collect() == []
    rows = {r.doc_id: r for r in q02_personal_data.op2_personal_data(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for i, r in rows.items():
        spans = brute(texts[i])
        line = ",".join(f"{list(KINDS)[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in spans) for n in range(4)]


def test_tokens_without_digits_are_instances(spark):
    # the address that no expression finds stands between the same words as sixty that are found, all without digits
    names = [f"{a}{b}" for a in "abcdefghij" for b in "klmnop"]
    rows = [(i, f"write mail {n}@corp.example today") for i, n in enumerate(names)]
    rows += [(900, "write mail anna.schmidt[at]corp.example today"), (901, "plain words only")]
    got = {r.doc_id: r for r in personal_data.entities(frame(spark, rows)).collect()}
    assert got[900].base == [] and [tuple(s) for s in got[900].spans] == [(11, 0, 39)]
    assert got[901].spans == []


def test_longer_values_are_told_apart_by_their_ends(spark):
    # two tokens share their first 70 code points; each is an instance of its own
    texts = spark.createDataFrame([(f"in {'x' * 70}{i} at",) for i in range(2)], "text string")
    asked = texts.limit(1).select(F.lit(personal_data.SIDES).alias("of"), F.xxhash64(F.lit("in"), F.lit("at")).alias("pattern"))
    assert personal_data._edges(texts, asked).count() == 2


def test_odd_tokens(spark):
    text = "Plain words, well-known: don't (a) end. a.b 3 x=y p:q z@ ... : 'q' e.\n.net r7, é.ü"
    found = personal_data._odd(spark.createDataFrame([(text,)], "text string"))
    assert [r.token for r in found.collect()] == ["(a)", "a.b", "3", "x=y", "p:q", "z@", "...", ".net", "r7,", "é.ü"]


def test_shapes_mark_what_passes_the_check(spark):
    # sixty cards; a number twice in a row is no base match, but its tokens pass; a number of no card does not
    valid = [n for n in range(4000000000000000, 4000000000009000) if luhn(str(n))][:60]
    wrong = next(n for n in range(4000000000000000, 4000000000009000) if not luhn(str(n)))
    rows = [(i, f"{'w' * (i + 1)} {n}, {'v' * (i + 1)}") for i, n in enumerate(valid)] + [(900, f"so {valid[0]} {valid[0]}, it"), (901, f"as {wrong}, is")]
    got = {r.doc_id: r for r in personal_data.entities(frame(spark, rows)).collect()}
    assert got[900].base == [] and [tuple(s) for s in got[900].spans] == [(3, 2, 19), (20, 2, 36)]
    assert got[901].spans == []


def test_texts_of_many_matches(spark):
    many = " ".join(f"u{i}@mail.example {i}.1.1.1" for i in range(4000))
    got = personal_data.entities(frame(spark, [(1, many), (None, many)])).collect()
    assert [[tuple(s) for s in r.base] for r in got] == [brute(many)] * 2


def test_patterns_of_common_words_are_not_followed_through_all_texts(spark, monkeypatch):
    # three addresses stand between words that a thousand others stand between as well: one part of the texts tells
    rows = [(i, f"in word{i} at") for i in range(1000)] + [(2000 + i, f"in a{i}@b.co at") for i in range(3)]
    made, edges = [], personal_data._edges
    monkeypatch.setattr(personal_data, "_edges", lambda *a: made.append(edges(*a)) or made[-1])
    assert all(r.spans == r.base for r in personal_data.entities(frame(spark, rows)).collect())
    assert made and sum(e.where(F.col("of") == personal_data.SIDES).count() for e in made) < 500


def test_bounded_edges_are_all_edges_of_small_patterns(spark):
    rows = [(f"in w{i} at",) for i in range(300)] + [(f"by v{i % 6} to {i}",) for i in range(300)]
    texts = spark.createDataFrame(rows, "text string")
    pairs = spark.createDataFrame([("in", "at", 6), ("by", "to", 6), ("by", "to", 5)], "l string, r string, most int")
    asked = pairs.select(F.lit(personal_data.SIDES).alias("of"), F.xxhash64("l", "r").alias("pattern"), "most")
    for most, left in ((6, 6), (5, 0)):
        assert personal_data._bounded_edges(texts, asked.where(F.col("most") == most)).count() == left


def test_texts_are_not_shuffled(spark):
    """Few spans meet the texts by a broadcast, whatever Spark estimates of them, and seeds are read where their texts are."""
    docs = [(k, f"call +1 (555) 010-{1000 + k} or mail user{k}@example.org") for k in range(20)] + [(50, None), (51, "none"), (None, "a@b.co")]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = personal_data.redacted(frame(spark, docs))
        plan = found._jdf.queryExecution().executedPlan().toString()
        texts = {r.doc_id: r.text for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert texts == {k: "call <PHONE> or mail <EMAIL>" for k in range(20)} | {50: None, 51: "none", None: "<EMAIL>"}

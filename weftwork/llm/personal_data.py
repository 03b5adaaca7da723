"""PII by bootstrapped contextual extraction, in DataFrame functions alone.

Base entities come from regular expressions: split() gives what stands between matches, regexp_extract_all() the
matches, and running lengths their places. They seed a graph of instances (values of all tokens) and lexical patterns
(a name before "=" or ":", the token's shape, the words at its sides). In each round a pattern's confidence is the
share of its instances that are held to be of a kind, an instance's the best of its patterns. Patterns of high
confidence then mark tokens that no expression finds: names and sides any token, a shape those that pass the kind's
own check. Tokens are never written: every round passes over the texts and keeps what belongs to a pattern that could
gain confidence; a plain word has no shape, as the shape of all words never does. Patterns are written so that matching
never goes back over what it has read, and Java's matcher does not recurse over long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import few, keyed, text_mark, written

KINDS = ("email", "ip", "card", "phone")
#: The kinds' expressions, with possessive quantifiers and guards that leave the matches as they are.
EXPRESSIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a match holds; cheap to look for.
GATES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")),
    "card": lambda t: F.rlike(t, F.lit(r"(?:[0-9][\x20-]?){14}")),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
TOKEN = r"\S++"
#: What makes a token odd: signs and digits, and a colon or a full stop inside it.
ODD = r"[0-9@=_+/\[\](){}<>#~%&*|\\^$]|[:.](?=\S)"
#: Rounds of scoring, weight of doubt in a pattern's confidence, least confidence and instances of a pattern that marks.
ROUNDS, DOUBT, CONFIDENT, SUPPORT = 2, 2.0, 0.8, 5
#: Parts of the texts (of their sum, by a hash) that patterns' instances are counted in, one after the other.
PARTS = (2, 14, 48)
#: What patterns are of.
SIDES, NAME, SHAPE = 0, 1, 2
#: Matches whose places are gathered, or spans that are compared, at a time.
BLOCK = 256
SPAN = "struct<start: long, kind: int, end: long>"


def _placed(text: Column, expression: str) -> Column:
    """array<struct<start, end, value>> of the matches; places in code points, end exclusive."""
    between = F.split(text, expression, -1)
    found = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    pairs = F.slice(F.zip_with(between, found, lambda b, m: F.struct(b.alias("b"), m.alias("m"))), 1, F.size(found))
    none = F.expr("cast(array() as array<struct<start: long, end: long, value: string>>)")

    def step(state, p):
        first = state["at"] + F.length(p["b"])
        last = first + F.length(p["m"])
        one = F.struct(first.alias("start"), last.alias("end"), p["m"].alias("value"))
        return F.struct(last.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    def places(pairs):
        def block(state, i):
            done = F.aggregate(F.slice(pairs, i * BLOCK + 1, F.lit(BLOCK)), F.struct(state["at"].alias("at"), none.alias("out")), step)
            return F.get(F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(state["out"], F.array(d["out"])).alias("out"))), F.lit(0))

        start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<array<struct<start: long, end: long, value: string>>>)").alias("out"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), (F.size(pairs) / BLOCK).cast("int")), start, block)["out"])

    return F.get(F.transform(F.array(pairs), places), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def weighed(i):
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), weighed), F.lit(0), lambda a, b: a + b) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.rlike(value, F.lit(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|(?<=0))(?:\.|$)){4}$"))
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _empty() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")


def _base(text: Column, kind: str) -> Column:
    found = F.filter(_placed(text, EXPRESSIONS[kind]), lambda m: _holds(kind, m["value"]))
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))
    return F.when(GATES[kind](text), spans).otherwise(_empty())


def _bare(token: Column) -> Column:
    """The token without marks at its end."""
    marks = r"[.,;:!?)\]}>\"']"
    return F.when(F.rlike(token, F.lit(marks + "$")), F.regexp_replace(token, f"(?<!{marks}){marks}++$", "")).otherwise(token)


def _named(token: Column) -> Column:
    """The name before a token's value, with its sign; else empty."""
    return F.when(F.contains(token, F.lit("=")) | F.contains(token, F.lit(":")), F.regexp_extract(token, r"^([A-Za-z_.-]++[=:])", 1)).otherwise("")


def _shape(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_bare(token), "[0-9]", "9"), r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "a")


def _pattern(of: int, *parts) -> Column:
    return F.struct(F.lit(of).alias("of"), F.xxhash64(*parts).alias("pattern"))


def _written_patterns(token: Column) -> Column:
    """Patterns of how an odd token (lowered) is written: the name before its value, its shape."""
    return F.array_compact(F.array(F.when(_named(token) != "", _pattern(NAME, _named(token))), _pattern(SHAPE, _shape(token))))


def _all_patterns(left: Column, token: Column, right: Column) -> Column:
    sides = F.array(_pattern(SIDES, left, right))
    return F.when(F.rlike(token, F.lit(ODD)), F.concat(sides, _written_patterns(token))).otherwise(sides)


def _words(texts: DataFrame) -> DataFrame:
    """token (lowered), left and right of every token of ``texts``."""
    words = texts.select(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)).alias("w"))
    zipped = F.arrays_zip(F.concat(F.array(F.lit("")), "w").alias("l"), F.col("w").alias("v"), F.slice("w", 2, F.size("w")).alias("r"))
    rows = words.select(F.explode(zipped).alias("t")).select(F.col("t.v").alias("token"), F.col("t.l").alias("left"), F.coalesce("t.r", F.lit("")).alias("right"))
    return rows.where(F.col("token").isNotNull())


def _odd(texts: DataFrame, *also) -> DataFrame:
    """token (lowered) of every odd token of ``texts``, whose name and shape tell something; and other columns."""
    tokens = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))).alias("token")
    return texts.where(F.rlike("text", F.lit(ODD))).select(*also, tokens).where(F.rlike("token", F.lit(ODD)))


def _edges(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """of, pattern and value (a hash of the token) of all tokens of patterns that are ``asked`` for (of, pattern)."""
    value = F.xxhash64("token").alias("value")
    sides = _words(texts).withColumn("pattern", F.xxhash64("left", "right"))
    sides = sides.join(few(written(asked.where(F.col("of") == SIDES).select("pattern"), "pii-sides")), "pattern", "left_semi")
    odd = _odd(texts).select("token", F.explode(_written_patterns(F.col("token"))).alias("p")).select("p.*", "token")
    odd = odd.join(few(written(asked.where(F.col("of") != SIDES), "pii-odd")), ["of", "pattern"], "left_semi")
    return sides.select(F.lit(SIDES).alias("of"), "pattern", value).union(odd.select("of", "pattern", value)).distinct()


def _bounded_edges(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """The edges of the patterns of ``asked`` (of, pattern, most) that have ``most`` different values at most.

    The texts are read part by part. A pattern that has more values in the parts so far has more in all texts: it is
    dropped for good, and later parts are not asked for it. What stays is exact.
    """
    asked, edges, low = written(asked, "pii-bound"), None, 0
    part = F.pmod(F.xxhash64("text"), F.lit(sum(PARTS)))
    for size in PARTS:
        new = _edges(texts.where((part >= low) & (part < low + size)), asked.select("of", "pattern"))
        edges = written(new if edges is None else edges.union(new).distinct(), "pii-edges")
        sizes = edges.groupBy("of", "pattern").agg(F.count(F.lit(1)).alias("n"))
        small = asked.join(sizes, ["of", "pattern"], "left").where(F.coalesce("n", F.lit(0)) <= F.col("most"))
        asked, low = written(small.select("of", "pattern", "most"), "pii-bound"), low + size
    return edges.join(asked.select("of", "pattern"), ["of", "pattern"], "left_semi")


def _patterns_of(texts: DataFrame, values: DataFrame) -> DataFrame:
    """value, of and pattern of all tokens whose value is one of ``values``."""
    values, value = few(values), F.xxhash64("token")
    words = _words(texts).withColumn("value", value).join(values, "value", "left_semi")
    odd = _odd(texts).withColumn("value", value).join(values, "value", "left_semi")
    found = words.select("value", _pattern(SIDES, "left", "right").alias("p")).union(odd.select("value", F.explode(_written_patterns(F.col("token"))).alias("p")))
    return found.select("value", "p.*")


def _meeting(spans: Column, others: Column) -> Column:
    """For each of ``spans`` those of ``others`` that share places with it; both sorted by start, met in blocks."""

    def block(some):
        low, high = F.array_min(F.transform(some, lambda s: s["start"])), F.array_max(F.transform(some, lambda s: s["end"]))
        near = F.array(F.filter(others, lambda o: (o["start"] < high) & (o["end"] > low)))
        one = lambda s, close: F.filter(close, lambda o: (o["start"] < s["end"]) & (o["end"] > s["start"]))
        return F.get(F.transform(near, lambda close: F.transform(some, lambda s: one(s, close))), F.lit(0))

    parts = F.transform(F.sequence(F.lit(0), (F.size(spans) / BLOCK).cast("int")), lambda i: F.slice(spans, i * BLOCK + 1, F.lit(BLOCK)))
    return F.flatten(F.transform(parts, block))


def base_entities(docs: DataFrame) -> DataFrame:
    """key, base (array of start, kind, end by start and kind) and, where there are any, text of every row; null texts are empty."""
    rows = keyed(docs).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select("key", "text", F.array_sort(F.concat(*[_base(F.col("text"), k) for k in KINDS])).alias("base"))
    return rows.select("key", "base", F.when(F.size("base") > 0, F.col("text")).alias("text"))


def _beside(tokens: Column) -> Column:
    """Tokens with their neighbours: start, end, token (as it stands), lowered, left and right (lowered)."""
    near = lambda i: F.lower(F.coalesce(F.get(tokens, i)["value"], F.lit("")))
    return F.transform(tokens, lambda t, i: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("token"), F.lower(t["value"]).alias("lowered"), near(i - 1).alias("left"), near(i + 1).alias("right")))


def _seeds(found: DataFrame) -> DataFrame:
    """kind, lowered, left and right of the tokens that base entities lie in; of repeated rows repeatedly."""
    rows = found.where(F.size("base") > 0)
    rows = rows.select("base", _placed(F.col("text"), TOKEN).alias("tokens")).select("base", _beside(F.col("tokens")).alias("tokens"))
    rows = rows.select("base", _meeting(F.col("base"), F.col("tokens")).alias("met"))
    rows = rows.select(F.explode(F.arrays_zip(F.col("base.kind").alias("kind"), "met")).alias("b")).select("b.kind", F.explode("b.met").alias("t"))
    return rows.select("kind", "t.lowered", "t.left", "t.right")


def confident_patterns(texts: DataFrame, found: DataFrame) -> DataFrame:
    """of, pattern (a hash), kind and confidence of the patterns that mark; from the pattern-instance graph of all ``texts`` (key, text)."""
    seeds = written(_seeds(found), "pii-tokens")
    value = F.xxhash64("lowered").alias("value")
    held = first = written(seeds.select(value, "kind").distinct().withColumn("score", F.lit(1.0)), "pii-seeds")
    near = seeds.select(value, F.explode(_all_patterns(F.col("left"), F.col("lowered"), F.col("right"))).alias("p")).select("value", "p.*").distinct()
    for turn in range(ROUNDS):
        least = CONFIDENT / 2 if turn + 1 < ROUNDS else CONFIDENT
        every = written(_patterns_of(texts, written(held.select("value").distinct(), "pii-held")).distinct(), "pii-near")
        # only patterns of held values gain confidence, and a score is 1 at most: fewer of them than this never suffice
        asked = (every if turn else near).groupBy("of", "pattern").agg(F.count(F.lit(1)).alias("m"))
        asked = written(asked.where(F.col("m") >= CONFIDENT / 2 * (SUPPORT + DOUBT)).select("of", "pattern"), "pii-asked")
        # a pattern's held values are known here, and with them how many values it may have at most; its size is counted
        # up to there, so that a pattern of common words, which has far more, is not followed through all texts
        known = written(every.join(few(asked), ["of", "pattern"], "left_semi"), "pii-known")
        sums = written(known.join(held, "value").groupBy("of", "pattern", "kind").agg(F.sum("score").alias("sum")), "pii-sums")
        most = F.floor(F.max("sum") / least - DOUBT + 1e-6).alias("most")
        bound = known.groupBy("of", "pattern").agg(F.count(F.lit(1)).alias("h")).join(sums.groupBy("of", "pattern").agg(most), ["of", "pattern"])
        bound = bound.where(F.col("most") >= F.greatest("h", F.lit(SUPPORT))).select("of", "pattern", "most")
        edges = _bounded_edges(texts, bound)
        # a pattern of fewer instances never marks and never lifts one
        wide = edges.groupBy("of", "pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
        patterns = sums.join(wide, ["of", "pattern"]).select("of", "pattern", "kind", (F.col("sum") / (F.col("n") + DOUBT)).alias("confidence"))
        patterns = patterns.where(F.col("confidence") >= least)
        if turn + 1 < ROUNDS:
            lifted = edges.select("of", "pattern", "value").join(patterns, ["of", "pattern"]).groupBy("value", "kind").agg(F.max("confidence").alias("score"))
            held = written(first.union(lifted).groupBy("value", "kind").agg(F.max("score").alias("score")), "pii-scores")
    return patterns


def _marked(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """key and more (array of start, kind, end, by start): what confident patterns mark, without names and marks at the end."""
    sure = written(patterns.select("of", "pattern").distinct(), "pii-confident")
    sides = few(written(sure.where(F.col("of") == SIDES).select("pattern"), "pii-sure-sides"))
    odd = few(written(sure.where(F.col("of") != SIDES), "pii-sure-odd"))
    # places are counted in the texts alone that a confident pattern has a token in
    words = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))
    left, right = F.concat(F.array(F.lit("")), "w"), F.concat(F.slice("w", 2, F.size("w")), F.array(F.lit("")))
    pairs = texts.select("key", words.alias("w")).select("key", F.explode(F.arrays_zip(left.alias("l"), right.alias("r"))).alias("t"))
    keys = pairs.select("key", F.xxhash64("t.l", F.coalesce("t.r", F.lit(""))).alias("pattern")).join(sides, "pattern", "left_semi").select("key")
    tokens = _odd(texts, "key").select("key", F.explode(_written_patterns(F.col("token"))).alias("p")).select("key", "p.*")
    keys = written(keys.union(tokens.join(odd, ["of", "pattern"], "left_semi").select("key")).distinct(), "pii-open")
    rows = texts.join(few(keys), "key", "left_semi").select("key", _placed(F.col("text"), TOKEN).alias("tokens"))
    rows = rows.select("key", F.explode(_beside(F.col("tokens"))).alias("t")).select("key", "t.*")
    rows = rows.withColumn("p", F.explode(_all_patterns(F.col("left"), F.col("lowered"), F.col("right")))).select("key", "start", "token", "p.*")
    hits = rows.join(few(patterns), ["of", "pattern"])
    name, bare = _named(F.col("token")), _bare(F.col("token"))
    value = F.substr(bare, F.length(name) + 1)
    holds = F.lit(False)
    for k, kind in enumerate(KINDS):
        holds = F.when(F.col("kind") == k, _holds(kind, value)).otherwise(holds)
    hits = hits.where((value != "") & ((F.col("of") != SHAPE) | holds))
    hits = hits.select("key", (F.col("start") + F.length(name)).alias("start"), F.length(value).alias("size"), "kind", "confidence")
    best = hits.groupBy("key", "start", "size").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("b"))
    one = F.struct("start", (-F.col("b.k")).cast("int").alias("kind"), (F.col("start") + F.col("size")).alias("end"))
    return best.groupBy("key").agg(F.array_sort(F.collect_set(one)).alias("more"))


def _entities(docs: DataFrame) -> DataFrame:
    """key, base and spans of every row."""
    texts = keyed(docs).withColumn("text", F.coalesce("text", F.lit(""))).where("text <> ''")
    found = written(base_entities(docs), "pii-base")
    patterns = written(confident_patterns(texts, found), "pii-patterns")
    held = found.where(F.size("base") > 0).select("key", "base").dropDuplicates(["key"])
    more = _marked(texts, patterns).join(held, "key", "left")
    clear = F.arrays_zip(F.col("more").alias("s"), _meeting(F.col("more"), F.coalesce("base", _empty())).alias("met"))
    more = more.select(F.col("key").alias("_key"), F.transform(F.filter(clear, lambda x: F.size(x["met"]) == 0), lambda x: x["s"]).alias("more"))
    more = written(more.where(F.size("more") > 0), "pii-more")
    rows = found.join(more, F.col("key").eqNullSafe(F.col("_key")), "left")
    return rows.select("key", "base", F.array_sort(F.concat("base", F.coalesce("more", _empty()))).alias("spans"))


def entities(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans (arrays of start, kind number, end by start and kind).

    ``spans`` holds the base and, where they meet no base span, values of tokens that confident patterns mark. Null and
    empty texts have empty arrays; repeated rows get the same spans each; documents with null ids take part.
    """
    return _entities(docs).select("key.doc_id", "base", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span's text replaced by <EMAIL>, <IP>, <CARD> or <PHONE>; overlapping spans are one, of the first kind.

    Other columns, null texts and texts without spans stay as they are.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spans = _entities(docs).where(F.size("spans") > 0).select(F.col("key").alias("_key"), F.col("spans").alias("_spans")).dropDuplicates(["_key"])
    own = F.struct(docs["doc_id"].cast("long").alias("doc_id"), text_mark(docs["text"].cast("string")).alias("mark"))
    rows = docs.join(few(written(spans, "pii-spans")), own.eqNullSafe(F.col("_key")), "left")
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(state, s):
        piece = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        fresh = F.struct(s["end"].alias("at"), F.concat(state["out"], F.array(piece, F.get(names, s["kind"]))).alias("out"))
        inside = F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out"))
        return F.when(s["start"] >= state["at"], fresh).otherwise(inside)

    def finish(state):
        return F.concat(F.array_join(state["out"], ""), F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))

    new = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.aggregate("_spans", start, step, finish))
    return rows.select(*[new.alias(c) if c == "text" else docs[c] for c in docs.columns])

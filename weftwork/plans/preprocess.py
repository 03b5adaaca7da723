"""From verified raw examples to the columns that models read; all in-row expressions, so nothing is shuffled.

An example is one row with logging_call, method, method_ast and method_pdg. Columns hold words; ``encoded_column``
turns them into indices of a vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions import arrays, strings
from weftwork.operators import limits, vocabulary
from weftwork.plans.params import LIMITS

MASK = "<LOG_PRED>"
PAD = "<PAD>"

AST = lambda: F.col("method_ast.nodes")
PDG = lambda: F.col("method_pdg.pdgNodes")
TOKENS = lambda: F.col("method.code.tokenized")


def _or_empty(items: Column, kind: str) -> Column:
    return F.coalesce(items, F.expr(f"cast(array() as array<{kind}>)"))


def expressions() -> Column:
    """The tokens of each PDG node that has an expression, as (node, begin, end) inclusive ranges."""
    return F.transform(
        F.filter(PDG(), lambda n: n["hasExpression"]),
        lambda n: F.struct(n["idx"].alias("node"), n["codeSubTokenRangeRef"]["beginTokenIdx"].alias("begin"), n["codeSubTokenRangeRef"]["endTokenIdx"].alias("end")),
    )


def n_edges() -> Column:
    """Control-flow edges, and data-dependency edges by symbol."""

    def of(n):
        flow = F.size(F.coalesce(n["controlFlowOutEdges"], F.array()))
        data = F.aggregate(F.transform(F.coalesce(n["dataDependencyOutEdges"], F.array()), lambda e: F.size(e["symbols"])), F.lit(0), lambda a, b: a + b)
        return F.coalesce(flow, F.lit(0)) + F.coalesce(data, F.lit(0))

    return F.aggregate(F.transform(PDG(), of), F.lit(0), lambda a, b: a + b)


def method_limits(bounds: dict | None = None) -> list[limits.Limit]:
    """The limits on a method; ``bounds`` replaces defaults by name."""
    bounds = LIMITS | (bounds or {})
    length = F.transform(expressions(), lambda e: e["end"] - e["begin"] + 1)
    subs = F.transform(F.col("method_pdg.subIdentifiersByIdx"), F.size)
    values = {
        "n_identifiers": F.size("method_pdg.identifierByIdx"),
        "min_sub_identifiers": F.array_min(subs),
        "n_pdg_nodes": F.size(PDG()),
        "n_expressions": F.size(expressions()),
        "longest_expression": F.array_max(length),
        "shortest_expression": F.array_min(length),
        "n_symbols": F.size("method_pdg.symbols"),
        "n_edges": n_edges(),
    }
    found = [limits.Limit(n, v, *bounds[n]) for n, v in values.items()]
    switch = F.exists(PDG(), lambda n: F.contains(n["controlKind"], F.lit("SWITCH"))).cast("int")
    lambdas = F.exists(AST(), lambda n: F.startswith(n["type"], F.lit("Lambda"))).cast("int")
    return [*found, limits.Limit("switch", switch, None, 0), limits.Limit("lambda", lambdas, None, 0)]


def identifiers() -> list[Column]:
    """Distinct sub-parts in order, and each identifier as places among them."""
    subs = F.col("method_pdg.subIdentifiersByIdx")
    kinds = arrays.sorted_kinds(F.flatten(subs))
    return [kinds.alias("sub_parts"), F.transform(subs, lambda x: arrays.reindexed(x, kinds)).alias("identifier_sub_parts")]


def symbols() -> Column:
    return F.transform("method_pdg.symbols", lambda s: s["identifierIdx"]).alias("symbols_identifier")


def ast_columns() -> list[Column]:
    """Types with major and minor parts, numbers of children, places from either side, leaves by family."""
    nodes = AST()
    n_children = lambda n: F.size(_or_empty(n["childrenIdxs"], "int"))

    def siblings(n):
        return F.when(n["parentNodeIdx"].isNotNull(), n_children(F.get(nodes, n["parentNodeIdx"])))

    def place(n, sign):
        at = n["childPlaceAtParent"] + 1 if sign == "+" else siblings(n) - n["childPlaceAtParent"]
        word = F.when(at > 5, F.lit(f"{sign}MORE")).otherwise(F.concat(F.lit(sign), at.cast("string")))
        return F.when(n["parentNodeIdx"].isNull(), F.lit(f"{sign}ROOT")).otherwise(word)

    leaves = F.filter(nodes, lambda n: n_children(n) == 0)

    def family(field):
        own = F.filter(leaves, lambda n: n[field].isNotNull())
        return F.transform(own, lambda n: F.struct(n["idx"].alias("idx"), n[field].alias("value")))

    return [
        F.transform(nodes, lambda n: n["type"]).alias("ast_type"),
        F.transform(nodes, lambda n: strings.major(n["type"])).alias("ast_major"),
        F.transform(nodes, lambda n: F.coalesce(strings.minor(n["type"]), F.lit(PAD))).alias("ast_minor"),
        F.transform(nodes, lambda n: F.when(n_children(n) > 5, F.lit("<MORE>")).otherwise(n_children(n).cast("string"))).alias("ast_children"),
        F.transform(nodes, lambda n: place(n, "+")).alias("ast_from_left"),
        F.transform(nodes, lambda n: place(n, "-")).alias("ast_from_right"),
        family("identifier").alias("identifier_leaves"),
        family("typeName").alias("type_leaves"),
        family("modifier").alias("modifier_leaves"),
        F.flatten(F.transform(nodes, lambda n: F.transform(_or_empty(n["childrenIdxs"], "int"), lambda c: F.struct(n["idx"].alias("src"), c.alias("dst"))))).alias("ast_edges"),
    ]


def token_word(token: Column) -> Column:
    """The word of a keyword, operator or separator; null for others."""
    value = F.coalesce(token["operator"], token["separator"], token["text"])
    return strings.kos_word(token["kind"], value)


def flow_columns() -> list[Column]:
    """Control kinds (the logging call's masked), expression flags, tokens of expressions, edges with types."""
    call = F.col("logging_call.pdgNodeIdx")

    def of(e):
        own = arrays.inclusive_slice(TOKENS(), e["begin"], e["end"])
        cell = lambda t: F.struct(t["kind"].alias("kind"), token_word(t).alias("kos"), t["identifierIdx"].alias("identifier"), F.coalesce(t["symbolIdx"], F.lit(-1)).alias("symbol"))
        return F.struct(e["node"].alias("node"), F.transform(own, cell).alias("tokens"))

    kept = F.filter(expressions(), lambda e: e["node"] != call)
    return [
        F.transform(PDG(), lambda n: F.when(n["idx"] == call, F.lit(MASK)).otherwise(n["controlKind"])).alias("control_kind"),
        F.transform(PDG(), lambda n: n["hasExpression"] & (n["idx"] != call)).alias("has_expression"),
        F.transform(kept, of).alias("expressions"),
        F.flatten(
            F.transform(
                PDG(),
                lambda n: F.transform(
                    F.coalesce(n["controlFlowOutEdges"], F.expr("cast(array() as array<struct<PGDNodeIdx: int, type: string>>)")),
                    lambda e: F.struct(n["idx"].alias("src"), e["PGDNodeIdx"].alias("dst"), F.coalesce(e["type"], F.lit(PAD)).alias("type")),
                ),
            )
        ).alias("flow_edges"),
    ]


def masked_tokens() -> Column:
    """The method's token kinds with the logging call's range as one masked token."""
    kinds = F.transform(TOKENS(), lambda t: t["kind"])
    at = F.get(F.filter(PDG(), lambda n: n["idx"] == F.col("logging_call.pdgNodeIdx")), F.lit(0))["codeSubTokenRangeRef"]
    shown = arrays.masked_range(kinds, at["beginTokenIdx"], at["endTokenIdx"], F.lit(MASK))
    return F.when(at.isNull(), kinds).otherwise(shown).alias("method_tokens")


def targets(most: int = 4) -> Column:
    """<SOS>, symbols that the call uses + 3, <EOS>, padding up to ``most`` + 2 places; ascending."""
    node = F.get(F.filter(PDG(), lambda n: n["idx"] == F.col("logging_call.pdgNodeIdx")), F.lit(0))
    use = node["symbolsUseDefMut"]["use"]
    kind = "struct<identifierIdx: int, symbolIdx: int, symbolName: string>"
    refs = F.concat(_or_empty(use["must"], kind), _or_empty(use["may"], kind))
    own = F.filter(refs, lambda r: ~strings.bare(r["symbolName"]).isin("log", "logger"))
    used = F.array_sort(F.array_distinct(F.transform(own, lambda r: r["symbolIdx"])))
    whole = F.concat(F.array(F.lit(1)), F.transform(used, lambda s: s + 3), F.array(F.lit(2)))
    return arrays.pad_truncate(whole, most + 2, F.lit(0)).alias("targets")


def preprocessed(examples: DataFrame, bounds: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """The examples within the limits with their columns, and the rejected ones with their violations."""
    own = method_limits(bounds)
    keep = [c for c in ("line_no", "hash") if c in examples.columns]
    rows = limits.kept(examples, own).select(*keep, *identifiers(), symbols(), *ast_columns(), *flow_columns(), masked_tokens(), targets())
    return rows, limits.rejected(examples, own).select(*keep, "violations")


def encoded_column(rows: DataFrame, key: str, column: str, vocab: DataFrame, unknown: int) -> DataFrame:
    """key and the indices of an array of words, in order."""
    words = rows.select(key, F.posexplode(column).alias("pos", "word"))
    coded = vocabulary.encode(words, "word", vocab, unknown)
    return coded.groupBy(key).agg(arrays.collected(F.col("idx"), F.col("pos")).alias(column))


def formatted(code: Column, marks: Column) -> Column:
    """Code with ``[@k ...]`` around ranges: ``marks`` is an array of (k, begin, end), disjoint and in order, ends exclusive."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, m):
        before = F.substring(code, state["at"] + 1, m["begin"] - state["at"])
        inside = F.substring(code, m["begin"] + 1, m["end"] - m["begin"])
        return F.struct(m["end"].alias("at"), F.concat(state["out"], before, F.lit("[@"), m["k"].cast("string"), F.lit(" "), inside, F.lit("]")).alias("out"))

    return F.aggregate(marks, start, step, lambda s: F.concat(s["out"], F.substring(code, s["at"] + 1, F.length(code))))

"""Explicit schemas of raw examples; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INDEX_RANGE = "struct<beginIdx: int, endIdx: int>"
TOKEN_RANGE = "struct<beginTokenIdx: int, endTokenIdx: int>"
POSITION_RANGE = "struct<begin: struct<col: int, line: int>, end: struct<col: int, line: int>>"
SCOPE = "struct<methodHash: string, symbolsScopeIdx: int>"
TOKEN = f"struct<kind: string, positionRangeInCodeSnippetStr: {INDEX_RANGE}, positionRangeInFile: {POSITION_RANGE}, astLeavesIndices: array<int>, identifierIdx: int, operator: string, separator: string, symbolIdx: int, text: string>"
CODE = f"struct<codeStr: string, positionRangeInFile: {POSITION_RANGE}, tokenized: array<{TOKEN}>>"
SYMBOL_REF = "struct<identifierIdx: int, symbolIdx: int, symbolName: string>"
MAY_MUST = f"struct<may: array<{SYMBOL_REF}>, must: array<{SYMBOL_REF}>>"
USE_DEF = f"struct<def: {MAY_MUST}, mut: {MAY_MUST}, use: {MAY_MUST}>"
# the edges' key is spelled PGDNodeIdx in the data
FLOW_EDGE = "struct<PGDNodeIdx: int, type: string>"
DATA_EDGE = f"struct<PGDNodeIdx: int, symbols: array<{SYMBOL_REF}>>"
PDG_NODE = f"struct<controlKind: string, hasExpression: boolean, idx: int, astNodeIdx: int, belongsToControlScopesIdxs: array<int>, calledFunctionsNames: array<string>, codeSubTokenRangeRef: {TOKEN_RANGE}, controlFlowInEdges: array<{FLOW_EDGE}>, controlFlowOutEdges: array<{FLOW_EDGE}>, dataDependencyInEdges: array<{DATA_EDGE}>, dataDependencyOutEdges: array<{DATA_EDGE}>, symbolsUseDefMut: {USE_DEF}>"
SYMBOL = "struct<declarationKind: string, declSitePDGNodeIdx: int, identifierIdx: int, idx: int, symbolName: string, typeName: string, declarationASTNodeIdx: int, defSitesPDGNodeIdxs: array<int>, useSitesPDGNodeIdxs: array<int>>"
CONTROL_SCOPE = "struct<idx: int, type: string, astNodeIdx: int, entryPointPDGNodeIdx: int, exitPointsPDGNodeIdx: array<int>, ownSymbolsScopeIdx: int, parentControlScopeIdx: int>"
AST_NODE = f"struct<idx: int, type: string, childPlaceAtParent: int, childrenIdxs: array<int>, codeSubTokenRangeRef: {TOKEN_RANGE}, identifier: string, literalExpr: string, modifier: string, name: string, parentNodeIdx: int, typeName: string>"

#: The five parts of a raw example, by name.
PARTS = {
    "logging_call": f"struct<code: {CODE}, hash: string, logLevel: string, methodRef: struct<hash: string>, nrLoggingCallsInMethod: int, subTokenRangeRefInMethod: {TOKEN_RANGE}, astNodeIdx: int, pdgNodeIdx: int>",
    "method": f"struct<code: {CODE}, codeFilepath: string, datasetName: struct<dataFold: string, datasetType: string>, declarationSubTokenRangeRef: {TOKEN_RANGE}, hash: string, name: string, returnTypeName: string, className: string>",
    "method_ast": f"struct<methodHash: string, rootNodeIdx: int, nodes: array<{AST_NODE}>>",
    "method_pdg": f"struct<entryPDGNodeIdx: int, exitPDGNodeIdx: int, methodHash: string, controlScopes: array<{CONTROL_SCOPE}>, identifierByIdx: array<string>, pdgNodes: array<{PDG_NODE}>, subIdentifiersByIdx: array<array<string>>, symbols: array<{SYMBOL}>>",
}

#: Domains of enumerations that checks look at.
TOKEN_KINDS = ["KEYWORD", "OPERATOR", "SEPARATOR", "IDENTIFIER", "LITERAL", "STRING_LITERAL", "COMMENT", "UNKNOWN"]
FOLDS = ["Train", "Validation", "Test"]


def decoded(part: str, line: Column) -> Column:
    """A JSON line as its struct; wrong types are an error, unknown keys are left out."""
    return F.from_json(line, PARTS[part], {"mode": "FAILFAST"})


def broken_invariants() -> Column:
    """Names of the structural invariants that an example (logging_call, method_ast, method_pdg) breaks."""
    ast, pdg = F.col("method_ast.nodes"), F.col("method_pdg.pdgNodes")
    numbered = F.forall(F.zip_with(ast, F.sequence(F.lit(0), F.greatest(F.size(ast) - 1, F.lit(0))), lambda n, i: F.coalesce(n["idx"] == i, F.lit(False))), lambda x: x)
    preorder = F.forall(ast, lambda n: F.forall(F.coalesce(n["childrenIdxs"], F.expr("cast(array() as array<int>)")), lambda c: c > n["idx"]))
    ranged = F.forall(pdg, lambda n: ~n["hasExpression"] | n["codeSubTokenRangeRef"].isNotNull())
    tests = {"ast numbering": numbered, "ast pre-order": preorder, "expression without range": ranged}
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in tests.items()]))

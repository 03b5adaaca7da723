"""Parameters of preprocessing: which columns a model needs, limits with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Default limits on examples, (least, most).
LIMITS = {
    "n_identifiers": (None, 110),
    "min_sub_identifiers": (1, None),
    "n_pdg_nodes": (6, 80),
    "n_expressions": (4, None),
    "longest_expression": (None, 50),
    "shortest_expression": (1, None),
    "n_symbols": (5, 55),
    "n_edges": (None, 300),
    "n_paths": (1, 400),
    "path_length": (3, 80),
    "n_targets": (1, 4),
}
#: Samples of paths per method.
SAMPLES = {"control_flow_paths": 150, "leaf_to_leaf": 1000, "leaf_to_root": 150, "node_leaf_to_leaf": 100, "node_leaf_to_root": 20}


@dataclass(frozen=True)
class NGrams:
    least: int
    most: int


@dataclass(frozen=True)
class AstParams:
    traversal: bool = False
    leaf_to_leaf: bool = False
    leaf_to_root: bool = False
    siblings: bool = False
    leaves: bool = False


@dataclass(frozen=True)
class FlowParams:
    paths: bool = False
    ngrams: NGrams | None = field(default=None, metadata={"column": "ngrams"})
    single_sequence: bool = False
    graph: bool = False
    tokens: bool = False


@dataclass(frozen=True)
class Params:
    method_ast: AstParams | None = None
    flow: FlowParams | None = None
    whole_tokens: bool = False

    @classmethod
    def full(cls) -> Params:
        return cls(AstParams(*[True] * 5), FlowParams(True, NGrams(1, 10), True, True, True), True)


def for_model(encoder: str, macro: str = "none", ngrams: tuple[int, int] | None = None) -> Params:
    """The least parameters that a model of these choices reads."""
    ast = {
        "ast-paths": AstParams(leaf_to_leaf=True, leaf_to_root=True, leaves=True),
        "ast-tree": AstParams(traversal=True),
        "ast-siblings": AstParams(siblings=True, leaves=True),
    }.get(encoder)
    flow = {
        "none": FlowParams(),
        "paths": FlowParams(paths=True),
        "ngrams": FlowParams(ngrams=NGrams(*(ngrams or (2, 6)))),
        "sequence": FlowParams(single_sequence=True),
        "graph": FlowParams(graph=True),
    }[macro]
    tokens = encoder == "tokens"
    flow = FlowParams(flow.paths, flow.ngrams, flow.single_sequence, flow.graph, tokens)
    return Params(ast, flow, tokens)

"""The shape of Python programs: their subtrees, and how data flows between their names."""

from __future__ import annotations

import ast
from collections import Counter
from hashlib import blake2b

from trustloom.operators.program_grams import KEPT


def subtrees(tree: ast.AST) -> Counter:
    """How often each subtree occurs, by a digest of its kinds of nodes; leaves and contexts aside."""
    found: Counter = Counter()

    def shape(node: ast.AST) -> bytes:
        inner = [shape(x) for x in ast.iter_child_nodes(node) if not isinstance(x, ast.expr_context)]
        said = blake2b(type(node).__name__.encode() + b"(" + b"".join(inner), digest_size=16).digest()
        if inner:
            found[said] += 1
        return said

    shape(tree)
    return found


class _Flow(ast.NodeVisitor):
    """Steps (name, what it is made from), in the order of execution of straight code."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.steps: Counter = Counter()

    def number(self, name: str) -> int:
        return self.numbers.setdefault(name, len(self.numbers))

    def made(self, target: ast.AST, *values: ast.AST | None) -> None:
        for v in values:
            if v is not None:
                self.visit(v)
        read = {self.number(x.id) for v in values if v is not None for x in ast.walk(v) if isinstance(x, ast.Name)}
        for x in ast.walk(target):
            if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store):
                self.steps["made", self.number(x.id), tuple(sorted(read))] += 1
            elif isinstance(x, ast.Name):
                self.visit(x)

    def visit_Name(self, node: ast.Name) -> None:
        known = node.id in self.numbers
        n = self.number(node.id)
        if known:
            self.steps["read", n, ()] += 1

    def visit_arg(self, node: ast.arg) -> None:
        self.number(node.arg)

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            self.made(t, node.value)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self.made(node.target, node.value)

    def visit_NamedExpr(self, node: ast.NamedExpr) -> None:
        self.made(node.target, node.value)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        self.made(node.target, ast.Name(node.target.id, ast.Load()) if isinstance(node.target, ast.Name) else node.target, node.value)

    def visit_For(self, node: ast.For) -> None:
        self.made(node.target, node.iter)
        for x in [*node.body, *node.orelse]:
            self.visit(x)

    visit_AsyncFor = visit_For

    def visit_comprehension(self, node: ast.comprehension) -> None:
        self.made(node.target, node.iter)
        for x in node.ifs:
            self.visit(x)

    def comprehended(self, node) -> None:
        for g in node.generators:  # what they bind is known before it is read
            self.visit(g)
        for x in ([node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]):
            self.visit(x)

    visit_ListComp = visit_SetComp = visit_GeneratorExp = visit_DictComp = comprehended

    def visit_withitem(self, node: ast.withitem) -> None:
        if node.optional_vars is None:
            self.visit(node.context_expr)
        else:
            self.made(node.optional_vars, node.context_expr)


def flow(tree: ast.AST) -> Counter:
    v = _Flow()
    v.visit(tree)
    return v.steps


def shape_of(code: str | None) -> tuple[Counter, Counter] | None:
    """Subtrees and steps of data flow; None if the text isn't Python or is nested too deeply to tell."""
    import warnings

    if code is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(code)
        return subtrees(tree), flow(tree)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def share(reference: Counter, candidate: Counter) -> float:
    return sum((reference & candidate).values()) / reference.total() if reference else 1.0


def matches(reference: str | None, candidate: str | None, held: dict) -> tuple[float | None, float | None]:
    """Shares of the reference's subtrees and steps that the candidate has.  held: the latest shapes by text."""
    if len(held) > KEPT:
        held.clear()
    for code in (reference, candidate):
        if code not in held:
            held[code] = shape_of(code)
    a, b = held[reference], held[candidate]
    return (None, None) if a is None or b is None else (share(a[0], b[0]), share(a[1], b[1]))

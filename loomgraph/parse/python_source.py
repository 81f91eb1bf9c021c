"""Python files by the standard library's parser; files that it rejects keep their names and headers by tokens."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from itertools import accumulate

from .keywords import KEYWORDS
from .lexer import CLOSE, OPEN, Pieces, Token, shape
from .model import Parsed, Symbol

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
BRANCHES = {ast.For: "for", ast.AsyncFor: "for", ast.While: "while", ast.ExceptHandler: "except", ast.With: "with", ast.AsyncWith: "with"}
#: Nodes that nothing is below that is asked for.
LEAVES = frozenset({ast.Name, ast.Constant, ast.Load, ast.Store, ast.Del, ast.Pass, ast.Break, ast.Continue, ast.alias, *ast.operator.__subclasses__(), *ast.unaryop.__subclasses__(), *ast.cmpop.__subclasses__(), *ast.boolop.__subclasses__()})
ASSIGNMENTS = (ast.Assign, ast.AnnAssign, ast.AugAssign)


class Text:
    """The text of a node by its position, without cutting the file into lines for each."""

    def __init__(self, source: str):
        self._raw = source.encode()
        self._plain = source if len(self._raw) == len(source) else None
        self._starts = [0, *accumulate(map(len, self._raw.splitlines(keepends=True)))]

    def span(self, node: ast.AST) -> tuple[int, int] | None:
        """Where a node begins and ends, in bytes."""
        if getattr(node, "end_lineno", None) is None:
            return None
        return self._starts[node.lineno - 1] + node.col_offset, self._starts[node.end_lineno - 1] + node.end_col_offset

    def __call__(self, node: ast.AST) -> str:
        span = self.span(node)
        if span is None:
            return ""
        return self._raw[span[0] : span[1]].decode() if self._plain is None else self._plain[span[0] : span[1]]

    def characters(self, node: ast.AST) -> tuple[int, int]:
        """Where a node begins and ends, in characters."""
        start, end = self.span(node)
        if self._plain is not None:
            return start, end
        before = len(self._raw[:start].decode())
        return before, before + len(self._raw[start:end].decode())


def _children(node: ast.AST) -> list[ast.AST]:
    """The nodes below one, in order."""
    out = []
    for field in node._fields:
        value = getattr(node, field, None)
        if isinstance(value, list):
            out += [v for v in value if isinstance(v, ast.AST)]
        elif isinstance(value, ast.AST):
            out.append(value)
    return out


def _below(roots: list[ast.AST]) -> Iterator[ast.AST]:
    """Nodes and all below them, each before those below it, however deep."""
    todo = roots[::-1]
    while todo:
        node = todo.pop()
        yield node
        if type(node) not in LEAVES:
            todo += _children(node)[::-1]


def _classes(body: list[ast.stmt]) -> Iterator[ast.ClassDef]:
    """The classes among statements and in their blocks; no other node has one."""
    todo = list(body)
    while todo:
        node = todo.pop()
        if isinstance(node, ast.ClassDef):
            yield node
        for block in ("body", "orelse", "finalbody", "handlers", "cases"):
            todo += getattr(node, block, ())


def parse(source: str) -> Parsed:
    pieces = Pieces(source, "python")
    words = KEYWORDS["python"]
    out = Parsed(occurrences=[(text, line, column) for kind, text, _, line, column in pieces.every if kind == "name" and text not in words])
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        out.has_errors = True
        return _headers(source, out)
    lines = source.split("\n")
    text = Text(source)
    for node in tree.body:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            out.imports.append((node.lineno, text(node)))
        if isinstance(node, FUNCTIONS):
            out.symbols.append(_function(node, None, text, lines, pieces))
        elif isinstance(node, ast.ClassDef):
            out.symbols.append(_symbol(node, "class", None, text))
    for node in _classes(tree.body):
        out.symbols += [_function(f, node.name, text, lines, pieces) for f in node.body if isinstance(f, FUNCTIONS)]
    seen: dict[tuple[str, int], Symbol] = {}
    for s in out.symbols:
        seen.setdefault((s.name, s.line), s)
    out.symbols = sorted(seen.values(), key=lambda s: s.line)
    return out


def _symbol(node: ast.AST, kind: str, parent: str | None, text: Text, params: str = "") -> Symbol:
    doc = next((x.strip() for x in (ast.get_docstring(node) or "").splitlines() if x.strip()), "")
    return Symbol(node.name, kind, parent, node.lineno, node.end_lineno, params, doc, text(node))


def _params(code: list[Token], source: str) -> str:
    """The first brackets of a function, whole."""
    start = 0
    stack: list[str] = []
    for kind, piece, at, _, _ in code:
        if kind != "op":
            continue
        if piece in OPEN and (stack or piece == "("):
            if not stack:
                start = at
            stack.append(OPEN[piece])
        elif stack and piece in CLOSE:
            while stack and stack[-1] != piece:
                stack.pop()
            if stack:
                stack.pop()
            if not stack:
                return source[start : at + 1]
    return source[start : code[-1].at + 1] if stack else "()"


def _function(node: ast.FunctionDef | ast.AsyncFunctionDef, parent: str | None, text: Text, lines: list[str], pieces: Pieces) -> Symbol:
    code = pieces.cut(*text.characters(node))
    s = _symbol(node, "method" if parent else "function", parent, text, _params(code, pieces.source))
    s.norm = shape(code, "python")
    calls, counts, known = set(), {}, set()

    def count(label: str, n: int = 1) -> None:
        counts[label] = counts.get(label, 0) + n

    def variable(name: str, line: int, kind: str, type_: str = "") -> None:
        if name not in known:
            known.add(name)
            s.variables.append((name, line, type_, kind))

    def names(target: ast.AST) -> list[ast.Name]:
        return [n for n in ast.walk(target) if isinstance(n, ast.Name)] if isinstance(target, (ast.Name, ast.Tuple, ast.List)) else []

    a = node.args
    for p in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]:
        if p.arg not in ("self", "cls"):
            variable(p.arg, p.lineno, "parameter", text(p.annotation) if p.annotation else "")

    for n in _below(node.body):
        if type(n) in LEAVES:
            continue
        if isinstance(n, ast.Call):
            s.call_sites.append((text(n), n.lineno))
            if isinstance(n.func, ast.Name):
                calls.add(n.func.id)
            elif isinstance(n.func, ast.Attribute):
                calls.add(n.func.attr)
        elif isinstance(n, ast.If):
            count("elif" if re.match(r"\s*elif\b", lines[n.lineno - 1][: n.col_offset + 4]) else "if")
        elif isinstance(n, ast.BoolOp):
            count("boolean_op", len(n.values) - 1)
        elif type(n) in BRANCHES:
            count(BRANCHES[type(n)])
        if isinstance(n, ASSIGNMENTS) and n.value is not None:
            right = sorted({x.id for x in _below([n.value]) if isinstance(x, ast.Name)})
            for target in n.targets if isinstance(n, ast.Assign) else [n.target]:
                if isinstance(target, ast.Name):
                    more = [target.id] if isinstance(n, ast.AugAssign) and target.id not in right else []
                    s.assigns.append((target.id, n.lineno, right + more, text(n.value)))
                    variable(target.id, n.lineno, "local", text(n.annotation) if isinstance(n, ast.AnnAssign) else "")
        elif isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name):
            variable(n.target.id, n.lineno, "local", text(n.annotation))
        if isinstance(n, (ast.For, ast.AsyncFor)):
            for t in names(n.target):
                variable(t.id, t.lineno, "loop_var")
    s.calls, s.breakdown = sorted(calls), counts
    return s


def _headers(source: str, out: Parsed) -> Parsed:
    """Classes, functions and imports of a file with errors, by its lines."""
    klass, depth = None, 0
    for number, line in enumerate(source.split("\n"), 1):
        indent = len(line) - len(line.lstrip())
        if line.strip() and klass and indent <= depth:
            klass = None
        if found := re.match(r"\s*class\s+(\w+)", line):
            if not indent:
                out.symbols.append(Symbol(found[1], "class", None, number, number, source=line))
            klass, depth = found[1], indent
        elif found := re.match(r"\s*(?:async\s+)?def\s+(\w+)\s*(\([^)]*\))?", line):
            if klass or not indent:
                out.symbols.append(Symbol(found[1], "method" if klass else "function", klass, number, number, found[2] or "()", source=line))
        elif re.match(r"(?:import|from)\s", line):
            out.imports.append((number, line.rstrip()))
    return out


def tree(source: str, max_depth: int = -1, line: int | None = None) -> str | None:
    """The syntax tree as nested (type [line:column-line:column] ...), of the whole text or of what is defined on a line; None if it doesn't parse."""
    try:
        root = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    if line is not None:
        root = next((n for n in ast.walk(root) if isinstance(n, (*FUNCTIONS, ast.ClassDef)) and n.lineno == line), root)

    def show(node: ast.AST, depth: int) -> str:
        where = f" [{node.lineno}:{node.col_offset}-{node.end_lineno}:{node.end_col_offset}]" if hasattr(node, "lineno") else ""
        below = list(ast.iter_child_nodes(node))
        if below and depth == max_depth:
            return f"({type(node).__name__}{where} ...)"
        return f"({type(node).__name__}{where}{''.join(' ' + show(b, depth + 1) for b in below)})"

    return show(root, 0)

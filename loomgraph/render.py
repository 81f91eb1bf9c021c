"""Answers as text, for people and tools that read text. Each takes rows that an Engine method has returned."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame, Row

from .functions.lists import SHORT_KINDS, TYPE_KINDS

ARROW = "→"


def _plural(n: int, word: str) -> str:
    return f"{n} {word}" + ("" if n == 1 else "s")


def _shown(name: str, parent: str | None) -> str:
    return f"{parent}.{name}" if parent else name


def skeleton_lines(rows: list[Row], compact: bool = False) -> list[str]:
    """A file's symbols: one line each, and in the full form one for each description."""
    out = []
    if not compact and rows and rows[0].asDict().get("has_errors"):
        out.append("WARNING: File has syntax errors — skeleton may be incomplete")
    for r in rows:
        typed = r["kind"] in TYPE_KINDS
        if compact:
            params = "" if typed else (r["params"] or "").replace(", ", ",")
            head = f".{r['name']}{params}" if r["kind"] == "method" else f"{SHORT_KINDS.get(r['kind'], r['kind'][:3])} {r['name']}{params}"
            out.append(f"{head}:{r['line']}" + (f" # {r['doc']}" if r["doc"] else ""))
            continue
        indent = "  " if r["parent"] else ""
        if typed:
            out.append(f"{indent}{r['kind']} {r['name']} {ARROW} line {r['line']}")
        else:
            inside = f" (in {r['parent']})" if r["parent"] else ""
            out.append(f"{indent}def {r['name']}{r['params'] or ''}{inside} {ARROW} line {r['line']}")
        if r["doc"]:
            out.append(f'{indent}  "{r["doc"]}"')
    return out


def skeleton(df: DataFrame, compact: bool = False) -> str:
    rows = df.collect()
    return "\n".join(skeleton_lines(rows, compact)) if rows else "No symbols found."


def skeletons(df: DataFrame, compact: bool = False) -> str:
    blocks = []
    for (_, path), rows in groupby(df.collect(), key=lambda r: (r["ordinal"], r["path"])):
        rows = [r for r in rows if r["name"] is not None]
        blocks.append(f"=== {path} ===\n" + ("\n".join(skeleton_lines(rows, compact)) if rows else f"File not found or empty: {path}"))
    return "\n\n".join(blocks).rstrip()


def symbol(df: DataFrame) -> str:
    rows = df.collect()
    return f"# {rows[0]['path']}:{rows[0]['line']}\n{rows[0]['source']}" if rows else "Symbol not found."


def symbols(df: DataFrame) -> str:
    parts = [f"# {r['path']}:{r['line']}\n{r['source']}" if r["source"] is not None else f"Symbol '{r['name']}' not found in {r['path']}" for r in df.collect()]
    return "\n\n".join(parts)


def references(df: DataFrame, name: str) -> str:
    rows = df.collect()
    return "\n".join([f"References to '{name}':", *(f"  {r['path']}:{r['line']}" for r in rows)]) if rows else f"No references found for '{name}'"


def call_graph(df: DataFrame, name: str) -> str:
    rows = df.collect()
    out = [f"Call graph for '{name}':"]
    for role, heading, none, mark in (("callee", "calls", "(nothing detected)", ARROW), ("caller", "is called by", "(no callers found)", "←")):
        own = [r for r in rows if r["role"] == role]
        out.append(f"\n  {name} {heading}:" + ("" if own else f" {none}"))
        out += [f"    {mark} " + (r["name"] if role == "callee" else f"{r['path']}:{r['line']}") for r in own]
    return "\n".join(out)


def imports(df: DataFrame, path: str) -> str:
    rows = df.collect()
    return "\n".join([f"Imports in {path}:", *(f"  {r['line']}: {r['text']}" for r in rows)]) if rows else f"No imports found in {path}"


def search(df: DataFrame, compact: bool = False, **filters) -> str:
    """Found symbols; where there are none, the filters that were given."""
    rows = df.collect()
    if not rows:
        given = [f'{k}="{v}"' if isinstance(v, str) else f"{k}={v}" for k, v in filters.items() if v is not None and v != ""]
        return f"No symbols found matching {', '.join(given) or 'criteria'}."
    if compact:
        out = []
        for r in rows:
            head = f".{r['name']}{(r['params'] or '').replace(', ', ',')}" if r["parent"] else f"{SHORT_KINDS.get(r['kind'], r['kind'][:3])} {r['name']}"
            out.append(f"{r['path']}:{head}:{r['line']}" + (f" # {r['doc']}" if r["doc"] else ""))
        return "\n".join([*out, f"\n{len(rows)} results"])
    out = ["Search results:"]
    for r in rows:
        out.append(f"  {r['path']}: {r['kind']} {r['name']}{' (in ' + r['parent'] + ')' if r['parent'] else ''} {ARROW} line {r['line']}")
        out += [f'    "{r["doc"]}"'] if r["doc"] else []
    return "\n".join([*out, f"\nFound {_plural(len(rows), 'symbol')}"])


def tests(df: DataFrame, path: str, name: str) -> str:
    rows = df.collect()
    if not rows:
        return f"No tests found for '{name}' in {path}."
    lines = [f"  {r['path']}: {r['name']}() {ARROW} line {r['line']}  ({r['reason']})" for r in rows]
    return "\n".join([f"Tests for {name}() in {path}:", *lines, f"\nFound {_plural(len(rows), 'test')}"])


def complexity(df: DataFrame) -> str:
    rows = df.collect()
    if not rows:
        return "Function not found."
    r = rows[0]
    return "\n".join([f"Complexity of {r['name']}() in {r['path']}: {r['total']}", *(f"  {e[0]}: {e[1]}" for e in r["breakdown"])])


def dead_code(df: DataFrame) -> str:
    rows = df.collect()
    if not rows:
        return "No dead code found."
    out = []
    for path, own in groupby(rows, key=lambda r: r["path"]):
        out.append(path)
        out += [f"  {r['kind']} {_shown(r['name'], r['parent'])}{'' if r['kind'] in TYPE_KINDS else '()'} {ARROW} line {r['line']}" for r in own]
    files = len({r["path"] for r in rows})
    return "\n".join([*out, "", f"{_plural(len(rows), 'dead symbol')} in {_plural(files, 'file')}"])


def blast_radius(df: DataFrame, name: str, lines: bool = False) -> str:
    """Callers by depth, then dependencies; each with the line it is defined on, if asked for."""
    rows = df.collect()
    callers, needs = [r for r in rows if r["role"] == "caller"], [r for r in rows if r["role"] == "dependency"]
    placed = lambda r: f"  {r['path']}: {r['name']}()" + (f" {ARROW} line {r['line']}" if lines else "")
    out = [f"Blast radius of '{name}':"]
    for depth, own in groupby(callers, key=lambda r: r["depth"]):
        out.append("Direct callers:" if depth == 1 else f"Indirect callers (depth {depth}):")
        out += map(placed, own)
    if needs:
        out += ["Dependencies:", *map(placed, needs)]
    return "\n".join([*out, f"{_plural(len(callers), 'affected function')} in {_plural(len({r['path'] for r in callers}), 'file')}"])


def clones(df: DataFrame) -> str:
    rows = df.collect()
    if not rows:
        return "No clones found."
    out = []
    for n, (_, own) in enumerate(groupby(rows, key=lambda r: r["clone"]), 1):
        own = list(own)
        out.append(f"Clone group {n} ({len(own)} functions, {own[0]['line_count']} lines):")
        out += [f"  {r['path']}: {r['name']}() {ARROW} line {r['line']}" for r in own]
    return "\n".join(out)


def hot_paths(df: DataFrame) -> str:
    rows = df.collect()
    lines = [f"{n}. {r['path']}: {r['name']}() {ARROW} line {r['line']}  (score={r['score']}, complexity={r['complexity']}, calls={r['callers']})" for n, r in enumerate(rows, 1)]
    return "\n".join(lines) if lines else "No hot paths found."


def dependency_graph(df: DataFrame, form: str = "mermaid") -> dict:
    """content, nodes and edges of the drawn or listed graph."""
    rows = df.collect()
    if not rows:
        return {"format": form, "content": "No import dependencies found.", "nodes": 0, "edges": 0}
    names = sorted({(r["src_no"], r["src"]) for r in rows} | {(r["dst_no"], r["dst"]) for r in rows})
    if form == "list":
        content = "\n".join(f"{r['src']} {ARROW} {r['dst']}" for r in rows)
    else:
        content = "\n".join(["graph LR", *(f'  n{k}["{name}"]' for k, name in names), *(f"  n{r['src_no']} --> n{r['dst_no']}" for r in rows)])
    return {"format": form, "content": content, "nodes": len(names), "edges": len(rows)}


def history(df: DataFrame, mode: str) -> str:
    rows = df.collect()
    if not rows:
        return f"No {mode} data found."
    if mode == "blame":
        return "\n".join(f"{r['author']}: {_plural(r['lines'], 'line')}" for r in rows)
    if mode == "churn":
        return "\n".join(f"{r['path']}: {_plural(r['commits'], 'commit')} (+{r['additions']} -{r['deletions']})" for r in rows)
    return "\n".join(f"{r['a']} <-> {r['b']}: {r['co_commits']} co-commits ({r['ratio']:.2f})" for r in rows)


def suggested_docs(df: DataFrame) -> str:
    out = []
    for r in df.collect():
        out.append(f"{r['path']}: {r['name']}{r['params'] or '()'} {ARROW} line {r['line']}")
        for label, names in (("calls", r["callees"]), ("called by", r["callers"]), ("variables", r["variables"])):
            if names:
                out.append(f"  {label}: {', '.join(names)}")
    return "\n".join(out) if out else "All functions are documented."

"""Ruby files: blocks by the words that open and end them."""

from __future__ import annotations

from .keywords import KEYWORDS
from .lexer import Pieces, Token, shape, tokens, without_value
from .model import Parsed, Symbol, first_line

OPENERS = {"class", "module", "def", "begin", "case", "do"}
CONDITIONS = {"if", "unless", "while", "until", "for"}
BRANCHES = {"if", "unless", "while", "until", "for", "when", "elsif", "and", "or"}


def parse(source: str) -> Parsed:
    every = tokens(source, "ruby")
    pieces = Pieces(source, "ruby", every)
    code = [t for t in every if t.kind != "comment"]
    comments = {t.line + t.text.count("\n"): t.text for t in every if t.kind == "comment"}
    words = KEYWORDS["ruby"]
    out = Parsed(occurrences=[(t.text, t.line, t.column) for t in code if t.kind == "name" and t.text not in words])
    stack: list[tuple[str, int, str | None]] = []
    loop_line = 0
    for i, t in enumerate(code):
        starts = i == 0 or code[i - 1].line < t.line or code[i - 1].text in ("=", ";", "(", "{", "|", "then", "do", "else", "&&", "||", "return")
        if t.kind != "name" or (i and code[i - 1].text in (".", "::") and t.text not in ("class",)) or (t.text == "class" and i and code[i - 1].text == "."):
            continue
        if t.text in ("require", "require_relative") and starts and not stack:
            last = i
            while last + 1 < len(code) and code[last + 1].line == t.line:
                last += 1
            out.imports.append((t.line, source[t.at : code[last].at + len(code[last].text)]))
        if t.text in CONDITIONS and starts:
            stack.append((t.text, i, None))
            loop_line = t.line if t.text in ("while", "until", "for") else loop_line
        elif t.text == "do" and loop_line == t.line:
            loop_line = 0
        elif t.text in OPENERS:
            name = None
            if t.text in ("class", "module", "def") and i + 1 < len(code):
                at = i + 1
                if t.text == "def" and at + 2 < len(code) and code[at].text == "self" and code[at + 1].text == ".":
                    at += 2
                name = code[at].text
                if t.text == "class" and name == "<<":
                    name = None
            stack.append((t.text, i, name))
        elif t.text == "end":
            if not stack:
                out.has_errors = True
                continue
            word, begin, name = stack.pop()
            if name is None:
                continue
            owners = [n for w, _, n in stack if w in ("class", "module") and n]
            b = code[begin]
            if word == "def":
                out.symbols.append(_method(source, pieces, code, begin, i, name, owners[-1] if owners else None))
            elif not owners:
                out.symbols.append(Symbol(name, "class", None, b.line, t.line, source=source[b.at : t.at + 3]))
            else:
                continue
            if b.line - 1 in comments:
                out.symbols[-1].doc = first_line(comments[b.line - 1])
    out.has_errors |= bool(stack) or without_value(code)
    out.symbols.sort(key=lambda s: s.line)
    return out


def _method(source: str, pieces: Pieces, code: list[Token], begin: int, end: int, name: str, parent: str | None) -> Symbol:
    b, words = code[begin], KEYWORDS["ruby"]
    at = begin + 1
    while code[at].text != name:
        at += 1
    s = Symbol(name, "method" if parent else "function", parent, b.line, code[end].line, source=source[b.at : code[end].at + 3])
    s.norm = shape(pieces.cut(b.at, b.at + len(s.source)), "ruby")
    body = at + 1
    known: set[str] = set()

    def variable(t: Token, kind: str) -> None:
        if t.text not in known:
            known.add(t.text)
            s.variables.append((t.text, t.line, "", kind))

    if code[body].text == "(":
        depth, k = 0, body
        while k < end:
            depth += (code[k].text == "(") - (code[k].text == ")")
            if not depth:
                break
            if code[k].kind == "name" and code[k - 1].text in ("(", ",", "*", "&"):
                variable(code[k], "parameter")
            k += 1
        s.params, body = source[code[body].at : code[k].at + 1], k + 1
    counts: dict[str, int] = {}
    calls: set[str] = set()
    for k in range(body, end):
        t, before, after = code[k], code[k - 1], code[k + 1]
        if t.kind == "op" and t.text in ("&&", "||"):
            counts[t.text] = counts.get(t.text, 0) + 1
        if t.kind != "name":
            continue
        if t.text in BRANCHES and before.text != ".":
            counts[t.text] = counts.get(t.text, 0) + 1
        plain = t.text not in words
        starts = before.line < t.line
        command = starts and after.line == t.line and after.kind in ("name", "string", "number") and after.text not in words
        if plain and (after.text == "(" and after.at == t.at + len(t.text) or before.text in (".", "&.") or command):
            calls.add(t.text)
            last = k
            depth = 0
            while last + 1 < end and code[last + 1].line == t.line and (depth or code[last + 1].text in ("(",)):
                last += 1
                depth += (code[last].text == "(") - (code[last].text == ")")
            first = k
            while code[first - 1].text in (".", "::") and first - 2 > begin:
                first -= 2
            s.call_sites.append((source[code[first].at : code[last].at + len(code[last].text)], t.line))
        if plain and after.text == "=" and before.text != ".":
            last = k + 2
            while last + 1 < end and code[last + 1].line == t.line:
                last += 1
            used = sorted({x.text for x, y in zip(code[k + 2 : last + 1], code[k + 1 : last]) if x.kind == "name" and x.text not in words and y.text != "."})
            s.assigns.append((t.text, t.line, used, source[code[k + 2].at : code[last].at + len(code[last].text)]))
            variable(t, "local")
        if t.text == "for" and after.kind == "name":
            variable(after, "loop_var")
    s.calls, s.breakdown = sorted(calls), counts
    return s

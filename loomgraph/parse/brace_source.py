"""Languages with braces: declarations by the tokens around a name and its matching brackets.

A recogniser per language looks at the tokens of one nesting level and steps over what it has recognised, so an
unbalanced or unknown construct costs no more than itself.
"""

from __future__ import annotations

import re

from .keywords import KEYWORDS, NO_CALL
from .lexer import Pieces, Token, matches, shape, tokens, without_value
from .model import Parsed, Symbol, first_line

MODIFIERS = {
    "javascript": {"export", "default", "async", "static", "get", "set"},
    "java": {"public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "strictfp", "default", "sealed", "transient", "volatile"},
    "rust": {"pub", "async", "unsafe", "const", "extern"},
    "cpp": {"static", "inline", "virtual", "constexpr", "explicit", "friend", "extern"},
}
MODIFIERS["typescript"] = MODIFIERS["javascript"] | {"abstract", "declare", "public", "private", "protected", "readonly", "override"}
MODIFIERS["c"] = MODIFIERS["cpp"]
BRANCHES = {
    "javascript": {"if": "if", "while": "while", "do": "do_while", "case": "case", "catch": "catch"},
    "go": {"if": "if", "for": "for", "select": "select", "case": "case", "default": "default"},
    "rust": {"if": "if", "for": "for", "while": "while"},
    "java": {"if": "if", "while": "while", "do": "do_while", "case": "case", "catch": "catch"},
    "c": {"if": "if", "for": "for", "while": "while", "do": "do_while", "case": "case", "default": "case"},
    "cpp": {"if": "if", "while": "while", "do": "do_while", "case": "case", "default": "case", "catch": "catch"},
}
BRANCHES["typescript"] = BRANCHES["javascript"]
#: Words of each language that may count as a branch, and what a declaration or assignment has: words, or what follows its name.
LABELS = {lang: frozenset({*BRANCHES[lang], "while", "for", "default", "match"}) for lang in BRANCHES}
DECLARES = {"javascript": {"let", "const", "var"}, "go": {"var"}, "rust": {"let", "for"}}
DECLARES["typescript"] = DECLARES["javascript"]
FOLLOWS = {"javascript": (), "typescript": (), "rust": (), "go": (":=", ",")}


class Reader:
    def __init__(self, source: str, language: str):
        self.source, self.language = source, language
        every = tokens(source, language)
        self.pieces = Pieces(source, language, every)
        self.code = [t for t in every if t.kind != "comment"]
        self.texts = [*(t.text for t in self.code), ""]  # nothing before the first and after the last
        self.comments = {t.line + t.text.count("\n"): t.text for t in every if t.kind == "comment"}
        self.pairs, whole = matches(self.code)
        self.openers: dict[int, int] | None = None  # by the closing token, made when first asked for
        self.out = Parsed(has_errors=not whole or without_value(self.code))
        words = KEYWORDS[language]
        self.out.occurrences = [(t.text, t.line, t.column) for t in self.code if t.kind == "name" and t.text not in words]
        self.modifiers = MODIFIERS.get(language, set())

    # Small views of the tokens

    def text(self, i: int) -> str:
        return self.code[i].text if 0 <= i < len(self.code) else ""

    def name(self, i: int) -> bool:
        return 0 <= i < len(self.code) and self.code[i].kind == "name"

    def close(self, i: int) -> int:
        return self.pairs.get(i, len(self.code) - 1)

    def find(self, i: int, end: int, *wanted: str) -> int:
        """The first of some operators at this level from i on, or end."""
        while i < end:
            if self.code[i].kind == "op":
                if self.code[i].text in wanted:
                    return i
                if self.code[i].text in "([{":
                    i = self.close(i)
            i += 1
        return end

    def span(self, i: int, j: int) -> str:
        return self.source[self.code[i].at : self.code[j].at + len(self.code[j].text)]

    def doc(self, line: int) -> str:
        return first_line(self.comments[line - 1]) if line - 1 in self.comments else ""

    def add(self, kind: str, name: int, first: int, last: int, parent: str | None = None, params: int | None = None, body: int | None = None) -> Symbol:
        t = self.code
        shown = "" if params is None else self.span(params, self.close(params))
        s = Symbol(t[name].text, kind, parent, t[first].line, t[min(last, len(t) - 1)].line, shown, self.doc(t[first].line), self.span(first, min(last, len(t) - 1)))
        if s.callable:
            start = t[first].at
            s.norm = shape(self.pieces.cut(start, start + len(s.source)), self.language)
            self.inside(s, params, body if body is not None else last, last)
        self.out.symbols.append(s)
        return s

    def parse(self) -> Parsed:
        getattr(self, f"level_{self.language if self.language != 'typescript' else 'javascript'}")(0, len(self.code))
        unique: dict[tuple, Symbol] = {}
        for s in self.out.symbols:
            unique.setdefault((s.name, s.line, s.kind), s)
        self.out.symbols = sorted(unique.values(), key=lambda s: s.line)
        return self.out

    # Bodies

    def inside(self, s: Symbol, params: int | None, begin: int, end: int) -> None:
        lang, counts, calls, known = self.language, {}, set(), set()

        def variable(i: int, kind: str, type_: str = "") -> None:
            name = self.text(i)
            if name not in known and not (name == "_" and lang in ("go", "rust")):
                known.add(name)
                s.variables.append((name, self.code[i].line, type_, kind))

        if params is not None:
            for i, type_ in self.parameters(params):
                variable(i, "parameter", type_)
        words, arms = KEYWORDS[lang], []
        labels, declares, follows = LABELS[lang], DECLARES.get(lang, ()), FOLLOWS.get(lang, ("=", ";", ":", ","))
        code, texts = self.code, self.texts
        for i in range(begin, min(end + 1, len(code))):
            t, next_ = code[i], texts[i + 1]
            kind, text = t[0], t[1]
            label = None
            if kind == "name":
                before = texts[i - 1]
                if next_ == "(" and text not in words and text not in NO_CALL and before not in ("function", "func", "fn"):
                    calls.add(text)
                    first = i
                    while self.text(first - 1) in (".", "::", "->", "?.") and self.name(first - 2):
                        first -= 2
                    s.call_sites.append((self.span(first, self.close(i + 1)), t.line))
                if text in declares or next_ in follows:
                    self.local(s, i, end, variable)
                if text not in labels:
                    continue
                label = BRANCHES[lang].get(text) if before != "." else None
                if t.text == "while" and self.text(i - 1) == "}" and lang != "rust" and any(self.text(d) == "do" for d in (self.opener(i - 1) - 1,)):
                    label = None
                if t.text == "for" and lang in ("javascript", "typescript", "java", "cpp"):
                    head = [self.text(k) for k in range(i + 1, self.close(i + 1) + 1)] if next_ == "(" else []
                    label = {"javascript": "for_in", "typescript": "for_in", "java": "for_each", "cpp": "for_range"}[lang] if ";" not in head and ("in" in head or "of" in head or ":" in head) else "for"
                if t.text == "default" and lang != "go" and next_ != ":":
                    label = None
                if t.text == "match" and lang == "rust":
                    brace = self.find(i + 1, end, "{")
                    arms.append((brace, self.close(brace) if brace < end else end))
            elif kind == "op":
                if t.text in ("&&", "||") and lang not in ("go", "rust"):
                    label = t.text
                elif t.text == "?" and lang in ("javascript", "typescript", "java") and next_ not in (":", ",", ")", ";", "=", ">"):
                    label = "ternary"
                elif t.text == "?" and lang == "rust":
                    label = "try"
                elif t.text == "=>" and lang == "rust" and any(a < i < b for a, b in arms):
                    label = "match_arm"
            if label:
                counts[label] = counts.get(label, 0) + 1
        s.calls, s.breakdown = sorted(calls), counts

    def opener(self, closing: int) -> int:
        if self.openers is None:
            self.openers = {}
            for a, b in self.pairs.items():
                self.openers.setdefault(b, a)
        return self.openers.get(closing, -1)

    def parameters(self, params: int) -> list[tuple[int, str]]:
        out, i, end, lang = [], params + 1, self.close(params), self.language
        while i < end:
            stop = self.find(i, end, ",")
            part = [k for k in range(i, stop) if self.name(k)]
            if part:
                if lang in ("javascript", "typescript"):
                    at = next((k for k in part if self.text(k) not in self.modifiers), part[0])
                    colon = self.find(i, stop, ":")
                    equals = self.find(colon, stop, "=")
                    out.append((at, self.span(colon + 1, equals - 1) if colon + 1 < equals else ""))
                elif lang == "rust":
                    colon = self.find(i, stop, ":")
                    named = [k for k in part if k < colon and self.text(k) not in ("mut", "ref", "self", "Self")]
                    if colon < stop and named:
                        out.append((named[0], self.span(colon + 1, stop - 1)))
                elif lang == "go":
                    out.append((part[0], self.span(part[0] + 1, stop - 1) if part[0] + 1 < stop else ""))
                elif len(part) > 1 or self.text(part[0]) not in KEYWORDS[lang]:
                    at = part[-1]
                    out.append((at, self.span(i, at - 1) if i < at else ""))
            i = stop + 1
        if lang == "go":  # a, b int
            for k in range(len(out) - 2, -1, -1):
                if not out[k][1]:
                    out[k] = (out[k][0], out[k + 1][1])
        return out

    def statement_end(self, i: int, end: int) -> int:
        """The last token of the expression that begins at i."""
        line = self.code[i].line if i < len(self.code) else 0
        while i < end:
            t = self.code[i]
            if t.kind == "op" and t.text in (";", ",", "}", ")"):
                return i - 1
            if t.kind == "op" and t.text in "([{":
                if t.text == "{" and self.language in ("go", "rust") and self.code[i].line == line and self.text(i - 1) in ("else",):
                    return i - 1
                i = self.close(i)
                line = self.code[i].line
            elif self.language in ("go", "javascript", "typescript") and t.line > line and self.code[i - 1].text not in ("=", "+", "-", "*", "/", "(", "&&", "||", ".", ":="):
                return i - 1
            line = max(line, t.line)
            i += 1
        return end - 1

    def assign(self, s: Symbol, name: int, right: int, end: int) -> None:
        last = self.statement_end(right, end)
        if last < right:
            return
        words = KEYWORDS[self.language]
        used = sorted({self.text(k) for k in range(right, last + 1) if self.name(k) and self.text(k) not in words and self.text(k - 1) not in (".", "->", "::")})
        s.assigns.append((self.text(name), self.code[name].line, used, self.span(right, last)))

    def local(self, s: Symbol, i: int, end: int, variable) -> None:
        """A declaration or assignment whose keyword or name is at i."""
        lang, word = self.language, self.text(i)
        if lang in ("javascript", "typescript"):
            if word in ("let", "const", "var") and self.name(i + 1):
                loop = self.text(i + 2) in ("of", "in")
                equals = self.find(i + 2, end, "=", ";", ")")
                colon = self.text(i + 2) == ":"
                variable(i + 1, "loop_var" if loop or self.text(i - 2) == "for" else "local", self.span(i + 3, equals - 1) if colon and equals > i + 3 else "")
                if not loop and self.text(equals) == "=":
                    self.assign(s, i + 1, equals + 1, end)
        elif lang == "go":
            if self.text(i + 1) == ":=" or (self.text(i + 1) == "," and self.name(i + 2) and self.text(i + 3) == ":="):
                right = i + 2 if self.text(i + 1) == ":=" else i + 4
                loop = self.text(right) == "range" or self.text(i - 1) == "for"
                for k in {i, right - 2}:
                    variable(k, "loop_var" if loop else "local")
                if not loop:
                    self.assign(s, i, right, end)
            elif word == "var" and self.name(i + 1):
                stop = self.statement_end(i + 1, end)
                equals = self.find(i + 1, stop + 1, "=")
                variable(i + 1, "local", self.span(i + 2, equals - 1) if equals > i + 2 else "")
                if equals <= stop:
                    self.assign(s, i + 1, equals + 1, end)
        elif lang == "rust":
            if word == "let" or (word == "for" and self.name(i + 1)):
                at = i + 1 + (self.text(i + 1) == "mut")
                if self.name(at):
                    equals = self.find(at + 1, end, "=", ";")
                    typed = self.text(at + 1) == ":" and word == "let"
                    variable(at, "local" if word == "let" else "loop_var", self.span(at + 2, equals - 1) if typed and equals > at + 2 else "")
                    if word == "let" and self.text(equals) == "=":
                        self.assign(s, at, equals + 1, end)
        elif self.text(i + 1) in ("=", ";", ":", ",") and word not in KEYWORDS[lang]:
            k = i - 1
            while k > 0 and (self.text(k) in ("*", "&", "[", "]", ">", "<", "::", ".") or self.name(k)) and self.code[k].line == self.code[i].line:
                k -= 1
            kind = [x for x in range(k + 1, i)]
            typed = kind and self.name(kind[0]) and self.text(kind[0]) not in ("return", "new", "throw", "goto", "case", "delete", "else", "break", "continue") and (self.text(i - 1) in ("*", "&", "]", ">") or self.name(i - 1)) and self.text(k) in ("{", "}", ";", "(", ")")
            if typed and self.text(i + 1) != ",":
                in_for = self.text(k) == "(" and self.text(k - 1) == "for"
                if self.text(i + 1) != ":" or in_for:
                    variable(i, "loop_var" if in_for else "local", self.span(k + 1, i - 1))
            if self.text(i + 1) == "=" and (typed or self.text(i - 1) in ("{", "}", ";")):
                self.assign(s, i, i + 2, end)

    # JavaScript and TypeScript

    def level_javascript(self, i: int, end: int) -> None:
        while i < end:
            first = i
            while self.text(i) in self.modifiers and self.name(i) and self.text(i + 1) != "(":
                i += 1
            word = self.text(i)
            if word == "import" and self.text(i + 1) not in ("(", "."):
                stop = self.find(i, end, ";")
                line = self.code[i].line
                last = i
                while last + 1 < end and last < stop and not (self.code[last].kind == "string" and self.code[last].line >= line):
                    last += 1
                last = last if self.text(last + 1) != ";" else last + 1
                self.out.imports.append((line, self.span(i, last)))
                i = last
            elif word == "class" and self.name(i + 1):
                brace = self.find(i + 2, end, "{")
                self.add("class", i + 1, first, self.close(brace))
                self.members_javascript(brace + 1, self.close(brace), self.text(i + 1))
                i = self.close(brace)
            elif word == "function":
                at = i + 1 + (self.text(i + 1) == "*")
                params = self.find(at, end, "(")
                brace = self.find(self.close(params), end, "{", ";")
                if self.name(at):
                    self.add("function", at, first, self.close(brace), None, params, brace)
                i = self.close(brace)
            elif self.language == "typescript" and word == "interface" and self.name(i + 1):
                brace = self.find(i + 2, end, "{")
                self.add("interface", i + 1, first, self.close(brace))
                i = self.close(brace)
            elif self.language == "typescript" and word == "type" and self.name(i + 1) and self.text(i + 2) in ("=", "<"):
                stop = self.find(i + 2, end, ";")
                self.add("type", i + 1, first, stop)
                i = stop
            elif word in ("const", "let", "var") and self.name(i + 1):
                i = self.arrow(first, i, end)
            elif self.code[i].kind == "op" and word in "([{":
                i = self.close(i)
            i += 1

    def arrow(self, first: int, i: int, end: int) -> int:
        equals = self.find(i + 2, end, "=", ";")
        if self.text(equals) != "=":
            return i + 1
        at = equals + 1 + (self.text(equals + 1) == "async")
        params = body = None
        if self.text(at) == "function":
            params = self.find(at, end, "(")
            body = self.find(self.close(params), end, "{")
        elif self.text(at) == "(":
            arrow = self.find(self.close(at), min(self.close(at) + 40, end), "=>", ";")
            if self.text(arrow) == "=>":
                params, body = at, arrow + 1
        elif self.name(at) and self.text(at + 1) == "=>":
            body = at + 2
        if body is None or self.text(i) == "var":
            return self.statement_end(equals + 1, end)
        last = self.close(body) if self.text(body) == "{" else self.statement_end(body, end)
        s = self.add("function", i + 1, first, last, None, params, body)
        if params is None:
            s.params = f"({self.text(at)})"
            s.variables.insert(0, (self.text(at), self.code[at].line, "", "parameter"))
        return last

    def members_javascript(self, i: int, end: int, parent: str) -> None:
        while i < end:
            first = i
            while self.text(i) in self.modifiers | {"*"} and self.text(i + 1) not in ("(", "=", ";"):
                i += 1
            if self.name(i) and self.text(i + 1) in ("(", "<"):
                params = i + 1 if self.text(i + 1) == "(" else self.find(i + 1, end, "(")
                brace = self.find(self.close(params) + 1, end, "{", ";")
                if self.text(brace) == "{" and self.text(self.close(params) + 1) == ":" and self.text(brace - 1) in (":", "|", "&"):
                    brace = self.find(self.close(brace) + 1, end, "{", ";")
                last = self.close(brace) if self.text(brace) == "{" else min(brace, end)
                self.add("method", i, first, last, parent, params, brace)
                i = last
            elif self.code[i].kind == "op" and self.text(i) == "=":
                i = max(i, self.statement_end(i + 1, end))
            elif self.code[i].kind == "op" and self.text(i) in "([{":
                i = self.close(i)
            i += 1

    # Go

    def level_go(self, i: int, end: int) -> None:
        while i < end:
            word = self.text(i)
            if word == "import":
                last = self.close(i + 1) if self.text(i + 1) == "(" else next((k for k in range(i, end) if self.code[k].kind == "string"), i)
                self.out.imports.append((self.code[i].line, self.span(i, last)))
                i = last
            elif word == "func":
                parent, at = None, i + 1
                if self.text(at) == "(":
                    owner = [k for k in range(at + 1, self.close(at)) if self.name(k)]
                    parent, at = (self.text(owner[-1]) if owner else None), self.close(at) + 1
                params = self.find(at, end, "(")
                brace = self.body_go(self.close(params) + 1, end)
                if self.name(at):
                    self.add("method" if parent else "function", at, i, self.close(brace), parent, params, brace)
                i = self.close(brace)
            elif word == "type":
                group = self.text(i + 1) == "("
                stop = self.close(i + 1) if group else i + 2
                k = i + 2 if group else i + 1
                while k < stop:
                    if self.name(k) and self.text(k + 1) in ("struct", "interface"):
                        brace = self.find(k + 1, end, "{")
                        self.add(self.text(k + 1), k, k if group else i, self.close(brace))
                        k = self.close(brace)
                        stop = max(stop, k)
                    k += 1
                i = max(i, k - 1)
            elif self.code[i].kind == "op" and word in "([{":
                i = self.close(i)
            i += 1

    def body_go(self, i: int, end: int) -> int:
        """The brace of a function's body, past results like interface{} or struct{...}."""
        brace = self.find(i, end, "{")
        while self.text(brace - 1) in ("interface", "struct"):
            brace = self.find(self.close(brace) + 1, end, "{")
        return brace

    # Rust

    def level_rust(self, i: int, end: int, parent: str | None = None) -> None:
        while i < end:
            first = i
            while self.text(i) in self.modifiers and self.text(i + 1) != "=":
                i += 1
                if self.text(i) == "(":
                    i = self.close(i) + 1
                if i < end and self.code[i].kind == "string":
                    i += 1
            word = self.text(i)
            if word == "use" and parent is None:
                stop = self.find(i, end, ";")
                self.out.imports.append((self.code[first].line, self.span(first, min(stop, end - 1))))
                i = stop
            elif word in ("struct", "enum", "trait") and self.name(i + 1) and parent is None:
                brace = self.find(i + 2, end, "{", ";")
                self.add(word, i + 1, first, self.close(brace) if self.text(brace) == "{" else brace)
                if word == "trait":
                    self.level_rust(brace + 1, self.close(brace), self.text(i + 1))
                i = self.close(brace) if self.text(brace) == "{" else brace
            elif word == "impl":
                brace = self.find(i + 1, end, "{")
                head = range(i + 1, brace)
                marks = [k for k in head if self.text(k) == "for"]
                owner = marks[-1] + 1 if marks else i + 1
                if self.name(owner) and self.text(owner + 1) in ("{", "where"):
                    self.level_rust(brace + 1, self.close(brace), self.text(owner))
                i = self.close(brace)
            elif word == "fn" and self.name(i + 1):
                params = self.find(i + 2, end, "(")
                brace = self.find(self.close(params) + 1, end, "{", ";")
                last = self.close(brace) if self.text(brace) == "{" else brace
                self.add("method" if parent else "function", i + 1, first, min(last, end), parent, params, brace)
                i = last
            elif i < end and self.code[i].kind == "op" and self.text(i) in "([{":
                i = self.close(i)
            i += 1

    # Java

    def level_java(self, i: int, end: int) -> None:
        first = i
        while i < end:
            word = self.text(i)
            if word in ("import", "package"):
                stop = self.find(i, end, ";")
                if word == "import":
                    self.out.imports.append((self.code[i].line, self.span(i, min(stop, end - 1))))
                i = stop
                first = i + 1
            elif word in ("class", "interface", "enum") and self.name(i + 1):
                brace = self.find(i + 2, end, "{")
                self.add(word, i + 1, self.declared(first, i), self.close(brace))
                self.members_java(brace + 1, self.close(brace), self.text(i + 1))
                i = self.close(brace)
                first = i + 1
            elif self.code[i].kind == "op" and word in "([{":
                i = self.close(i)
            i += 1

    def declared(self, first: int, i: int) -> int:
        """Where a declaration begins, its annotations left out."""
        k = i
        while k - 1 >= first and (self.text(k - 1) in self.modifiers):
            k -= 1
        return k

    def members_java(self, i: int, end: int, parent: str) -> None:
        first = i
        while i < end:
            word = self.text(i)
            if word in ("class", "interface", "enum") and self.name(i + 1):
                i = self.close(self.find(i + 2, end, "{"))
                first = i + 1
            elif self.name(i) and self.text(i + 1) == "(" and self.text(i - 1) not in ("@", ".", "new") and (word == parent or self.name(i - 1) or self.text(i - 1) in (">", "]")):
                params = i + 1
                brace = self.find(self.close(params) + 1, end, "{", ";", ",")
                last = self.close(brace) if self.text(brace) == "{" else brace
                begin = next((k for k in range(i, first - 1, -1) if self.code[k].line < self.code[i].line), first - 1) + 1
                self.add("method", i, min(begin, i), min(last, end), parent, params, brace)
                i = last
                first = i + 1
            elif word == "=":
                i = self.find(i, end, ";")
                first = i + 1
            elif self.code[i].kind == "op" and word in "([{":
                i = self.close(i)
            elif word == ";":
                first = i + 1
            i += 1

    # C and C++

    def level_c(self, i: int, end: int, parent: str | None = None) -> None:
        cpp, first = self.language == "cpp", i
        while i < end:
            word = self.text(i)
            if word == "#":
                last = i
                while last + 1 < end and self.code[last + 1].line == self.code[i].line:
                    last += 1
                if self.text(i + 1) == "include":
                    self.out.imports.append((self.code[i].line, self.span(i, last)))
                while last + 1 < end and self.source[self.code[last].at :].split("\n", 1)[0].endswith("\\"):
                    last += 1
                i, first = last, last + 1
            elif cpp and word == "using" and parent is None:
                stop = self.find(i, end, ";")
                self.out.imports.append((self.code[i].line, self.span(i, min(stop, end - 1))))
                i, first = stop, stop + 1
            elif cpp and word == "namespace":
                brace = self.find(i, end, "{", ";")
                if self.text(brace) == "{":
                    self.level_c(brace + 1, self.close(brace))
                    i = self.close(brace)
                else:
                    i = brace
                first = i + 1
            elif word == "typedef":
                stop = self.find(i, end, ";")
                if stop < end and self.name(stop - 1) and not cpp:
                    self.add("struct", stop - 1, i, stop)
                i, first = stop, stop + 1
            elif word in ("struct", "class") and self.name(i + 1) and self.text(i + 2) in ("{", ":", ";") and (cpp or word == "struct"):
                brace = self.find(i + 2, end, "{", ";")
                body = self.text(brace) == "{"
                if body or word == "class":
                    self.add(word, i + 1, i, self.close(brace) if body else brace, None)
                if body and cpp:
                    self.level_c(brace + 1, self.close(brace), self.text(i + 1))
                i = self.close(brace) if body else brace
                first = i + 1
            elif self.name(i) and self.text(i + 1) == "(" and word not in KEYWORDS[self.language] and self.text(i - 1) not in ("::", "~", "operator"):
                after = self.close(i + 1) + 1
                while self.text(after) in ("const", "noexcept", "override", "final"):
                    after += 1
                if self.text(after) == ":" and parent == word:
                    after = self.find(after, end, "{", ";")
                if self.text(after) == "->":
                    after = self.find(after, end, "{", ";")
                if self.text(after) == "{" and (i > first or word == parent):
                    self.add("method" if parent else "function", i, first, self.close(after), parent, i + 1, after)
                    i = self.close(after)
                    first = i + 1
                else:
                    i = self.close(i + 1)
            elif word in ("public", "private", "protected") and self.text(i + 1) == ":":
                i, first = i + 1, i + 2
            elif self.code[i].kind == "op" and word in "([{":
                i = self.close(i)
            elif word in (";",):
                first = i + 1
            if self.text(i) == "}":
                first = i + 1
            i += 1

    level_cpp = level_c


def parse(source: str, language: str) -> Parsed:
    return Reader(source, language).parse()

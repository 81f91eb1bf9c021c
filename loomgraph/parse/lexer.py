"""One tokenizer for all languages but Python's own parser: comments, strings, numbers, names, punctuation."""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

#: What the languages have of comments and strings, as pieces of a pattern.
SLASH = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
HASH = r"\#[^\n]*"
QUOTED = r'"(?:\\.|[^"\\\n])*"?'
SINGLE = r"'(?:\\.|[^'\\\n])*'?"
BACKTICK = r"`(?:\\.|[^`\\])*`?"
STYLES = {
    "javascript": (SLASH, rf"{QUOTED}|{SINGLE}|{BACKTICK}"),
    "typescript": (SLASH, rf"{QUOTED}|{SINGLE}|{BACKTICK}"),
    "go": (SLASH, rf"{QUOTED}|{SINGLE}|`[^`]*`?"),
    "rust": (SLASH, rf"""b?r(?P<fence>\#*)".*?"(?P=fence)|b?{QUOTED}|b?'(?:\\[^\n]{{1,8}}?|[^'\\\n])'"""),
    "java": (SLASH, rf'""".*?"""|{QUOTED}|{SINGLE}'),
    "c": (SLASH, rf"(?:u8|[uUL])?{QUOTED}|{SINGLE}"),
    "cpp": (SLASH, rf'R"(?P<fence>[^(\s]*)\(.*?\)(?P=fence)"|(?:u8|[uUL])?{QUOTED}|{SINGLE}'),
    "ruby": (rf"^=begin\b.*?^=end\b[^\n]*|{HASH}", rf"{QUOTED}|{SINGLE}|{BACKTICK}"),
    "python": (HASH, rf"""[rRbBuUfF]{{0,2}}(?:\"\"\".*?\"\"\"|'''.*?'''|{QUOTED}|{SINGLE})"""),
}
NUMBER = r"0[xXbBoO][0-9a-fA-F_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[a-zA-Z]*"
OPERATORS = r"=>|->|::|&&|\|\||\?\?|:=|\+\+|--|[<>=!+\-*/%&|^]=|<<|>>|\.\.\.|\.\.|\?\.|[^\w\s]"


class Token(NamedTuple):
    kind: str  # name, number, string, comment, op
    text: str
    at: int  # characters from the beginning
    line: int  # from 1
    column: int  # UTF-8 bytes from the line's beginning


def _pattern(language: str) -> re.Pattern:
    comment, string = STYLES[language]
    name = r"(?:@@?|\$)?[^\W\d]\w*[?!]?(?![=])|[^\W\d]\w*" if language == "ruby" else r"\#?[^\W\d][\w$]*|\$[\w$]*" if language in ("javascript", "typescript") else r"[^\W\d]\w*"
    symbol = r"|(?P<symbol>:[^\W\d]\w*[?!]?)" if language == "ruby" else ""
    return re.compile(rf"(?P<comment>{comment})|(?P<string>{string}){symbol}|(?P<number>{NUMBER})|(?P<name>{name})|(?P<op>{OPERATORS})", re.S | re.M)


_PATTERNS = {language: _pattern(language) for language in STYLES}


def tokens(source: str, language: str) -> list[Token]:
    """All tokens in order, comments among them."""
    out, new = [], tuple.__new__
    line, end = 1, source.find("\n")  # the line that a token begins in, and where it ends
    ascii_, begin, column = source.isascii(), 0, 0  # a place in the line, and how many bytes of the line are before it
    for found in _PATTERNS[language].finditer(source):
        start = found.start()
        while 0 <= end < start:
            line, begin, column = line + 1, end + 1, 0
            end = source.find("\n", begin)
        if ascii_:
            column = start - begin
        else:
            column += len(source[begin:start].encode())
            begin = start
        kind = found.lastgroup
        out.append(new(Token, ("op" if kind == "symbol" else kind, found[0], start, line, column)))
    return out


OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def matches(code: list[Token]) -> tuple[dict[int, int], bool]:
    """The closing token's index of each opening bracket, and whether all are balanced."""
    pairs, stack, whole = {}, [], True
    for i, t in enumerate(code):
        if t.kind != "op":
            continue
        if t.text in OPEN:
            stack.append(i)
        elif t.text in CLOSE:
            while stack and OPEN[code[stack[-1]].text] != t.text:
                pairs[stack.pop()] = i
                whole = False
            if stack:
                pairs[stack.pop()] = i
            else:
                whole = False
    for i in stack:
        pairs[i] = len(code) - 1
    return pairs, whole and not stack


ASSIGNS, NO_VALUE = {"=", "+=", "-=", "*=", "/=", "%=", ":="}, {"=", ";", ")", "}"}


def without_value(code: list[Token]) -> bool:
    """Whether something is assigned that can't begin a value, as in `x = = 1`. Names like `operator=` and captures like `[=]` aren't."""
    for before, t, after in zip([None, *code], code, code[1:]):
        if t.kind == after.kind == "op" and t.text in ASSIGNS and after.text in NO_VALUE and not (before and before.text in ("operator", "[", "&", "(")):
            return True
    return False


def normalised(source: str, language: str) -> str:
    """Code without comments, names and literals by kind, everything else as it is: equal for renamed copies."""
    return shape(tokens(source, language), language)


def shape(code: list[Token], language: str) -> str:
    """normalised() of what has been cut into tokens."""
    from .keywords import KEYWORDS

    words, out = KEYWORDS[language], []
    for kind, text, _, _, _ in code:  # a token has five fields; a starred rest would make a list of each
        if kind == "op":
            out.append(text)
        elif kind == "name":
            out.append(text if text in words else "_ID_")
        elif kind != "comment":
            out.append("_STR_" if kind == "string" else "_NUM_")
    return " ".join(out)


class Pieces:
    """A file's tokens by their places, so that what is inside it need not be cut into tokens again."""

    def __init__(self, source: str, language: str, every: list[Token] | None = None):
        self.source, self.language = source, language
        self.every = tokens(source, language) if every is None else every
        self.starts = [t.at for t in self.every]

    def cut(self, start: int, end: int) -> list[Token]:
        """The tokens of the text from start to end, by their places in the file. Where the text begins or ends inside a token of the file, its own are made."""
        i, j = bisect_left(self.starts, start), bisect_left(self.starts, end)
        if i < j and self.starts[i] == start and self.every[j - 1].at + len(self.every[j - 1].text) <= end:
            return self.every[i:j]
        return [t._replace(at=t.at + start) for t in tokens(self.source[start:end], self.language)]


def nested(source: str, language: str, max_depth: int = -1) -> str:
    """Tokens as a tree of brackets: (kind [line:column] text) and (group [line:column-line:column] ...)."""
    code = [t for t in tokens(source, language) if t.kind != "comment"]
    pairs, _ = matches(code)

    def show(i: int, end: int, depth: int) -> list[str]:
        out = []
        while i < end:
            t = code[i]
            if i in pairs and pairs[i] > i:
                last = code[pairs[i]]
                inner = ["..."] if depth == max_depth else show(i + 1, pairs[i], depth + 1)
                out.append(f"(group [{t.line}:{t.column}-{last.line}:{last.column + 1}] {' '.join([repr(t.text), *inner, repr(last.text)])})")
                i = pairs[i]
            else:
                out.append(f"({t.kind} [{t.line}:{t.column}] {t.text!r})")
            i += 1
        return out

    return f"(file {' '.join(show(0, len(code), 1))})"

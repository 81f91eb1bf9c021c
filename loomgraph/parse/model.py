"""What a parsed file consists of."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Symbol:
    name: str
    kind: str
    parent: str | None
    line: int
    end_line: int
    params: str = ""
    doc: str = ""
    source: str = ""
    breakdown: dict[str, int] = field(default_factory=dict)
    calls: list[str] = field(default_factory=list)  # distinct, sorted
    variables: list[tuple[str, int, str, str]] = field(default_factory=list)  # name, line, type, kind
    assigns: list[tuple[str, int, list[str], str]] = field(default_factory=list)  # name, line, names on the right, their text
    call_sites: list[tuple[str, int]] = field(default_factory=list)  # text, line
    norm: str | None = None  # of a function, if the extractor has it: normalised(source)

    @property
    def callable(self) -> bool:
        return self.kind in ("function", "method")


@dataclass
class Parsed:
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[tuple[int, str]] = field(default_factory=list)
    occurrences: list[tuple[str, int, int]] = field(default_factory=list)  # name, line, byte column
    has_errors: bool = False


def first_line(comment: str) -> str:
    """The first line of a comment or docstring that says something."""
    for line in comment.splitlines():
        if said := line.strip("/*#!> \t"):
            return said.strip()
    return ""

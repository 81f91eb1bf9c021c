"""Source text to symbols, calls, imports, names and variables: each file is read once."""

from __future__ import annotations

from collections.abc import Callable

from ..functions.lists import LANGUAGES
from . import brace_source, python_source, ruby_source
from .lexer import normalised
from .model import Parsed, Symbol

Extractor = Callable[[str], Parsed]
_EXTRACTORS: dict[str, Extractor] = {"python": python_source.parse, "ruby": ruby_source.parse}
#: File endings that register_language has added, with their language and extractor.
_ADDED: dict[str, tuple[str, Extractor]] = {}

__all__ = ["LANGUAGES", "Parsed", "Symbol", "added_languages", "know_languages", "normalised", "parse_source", "register_language", "unregister_language"]


def register_language(ending: str, language: str, extractor: Extractor) -> None:
    """Add a file ending, and the function from source text to Parsed that reads it. It travels to the workers by value."""
    LANGUAGES[ending] = language
    _EXTRACTORS[language] = extractor
    _ADDED[ending] = (language, extractor)


def unregister_language(ending: str) -> None:
    """Take back what register_language added."""
    language, _ = _ADDED.pop(ending)
    del LANGUAGES[ending]
    if language not in LANGUAGES.values():
        del _EXTRACTORS[language]


def added_languages() -> dict[str, tuple[str, Extractor]]:
    """What a task needs of this process to read the files that this process can."""
    return dict(_ADDED)


def know_languages(added: dict[str, tuple[str, Extractor]]) -> None:
    """In a worker: the languages that the driver has registered, and no others."""
    for ending in _ADDED.keys() - added.keys():
        unregister_language(ending)
    for ending, (language, extractor) in added.items():
        register_language(ending, language, extractor)


def parse_source(source: str, ending: str) -> Parsed:
    """An extractor that fails, however it does, leaves an empty file with errors, not a failed job."""
    language = LANGUAGES[ending]
    try:
        if language in _EXTRACTORS:
            return _EXTRACTORS[language](source)
        return brace_source.parse(source, language)
    except Exception:  # one file of many, which has_errors marks
        return Parsed(has_errors=True)

"""What reading a file costs: its text is cut into tokens once, and a task holds a bounded number of files."""

from types import SimpleNamespace

import pyarrow as pa
import pytest

from loomgraph import parse
from loomgraph.parse import lexer, normalised, parse_source
from loomgraph.sources import files

PYTHON = "class M:\n    def é(self, a: int = (1, 2)):\n        # é\n        x = f'{a}' + 'é'\n        return g(x)\n\ndef f(a, b): return {'a': [a]}\n"
JAVA = 'class M {\n    /* one */ int f(int a, int b) { String s = "}"; return g(a) + 1; }\n    int g(int a) { return a; }\n}\n'


class Counted:
    def __init__(self, pattern):
        self.pattern, self.characters = pattern, 0

    def finditer(self, text):
        self.characters += len(text)
        return self.pattern.finditer(text)


@pytest.mark.parametrize("ending, language, source", [("py", "python", PYTHON.replace("é", "e")), ("py", "python", PYTHON), ("java", "java", JAVA)])
def test_a_file_is_cut_into_tokens_once(monkeypatch, ending, language, source):
    counted = Counted(lexer._PATTERNS[language])
    monkeypatch.setitem(lexer._PATTERNS, language, counted)
    row = dict(zip(files._PARSED.names, values)) if isinstance(values := files.parsed_row("a." + ending, source.encode(), None), tuple) else values
    assert counted.characters == len(source)
    found = [s for s in parse_source(source, ending).symbols if s.callable]
    norms = [s[8] for s in row["symbols"] if s[8] is not None]
    assert len(found) == 2 and norms == [normalised(s.source, language) for s in found]


def test_a_function_inside_a_token_of_its_file_is_cut_by_itself():
    source = "x = 'def f(a): return a'"
    assert [(t.text, t.at) for t in lexer.Pieces(source, "python").cut(5, 10)] == [("def", 5), ("f", 9)]


def test_a_deep_expression_is_read():
    found = parse_source("def f(a):\n    return " + " + ".join(["g(a)"] * 1500) + "\n", "py")
    assert not found.has_errors and [s.name for s in found.symbols] == ["f"] and len(found.symbols[0].call_sites) == 1500


def test_a_task_holds_few_files(monkeypatch):
    runs, seen, real = [], [], parse.parse_source
    texts = SimpleNamespace(sparkSession=None, where=lambda *_: texts, select=lambda *_: texts, mapInArrow=lambda run, kind: runs.append(run))
    monkeypatch.setattr(files, "ship", lambda spark: None)
    monkeypatch.setattr(parse, "parse_source", lambda *given: seen.append(1) or real(*given))
    files.parse(texts)
    n = 3 * files.FILES_PER_TASK + 1
    out = runs[0](iter([pa.RecordBatch.from_pydict({"path": [f"{i}.py" for i in range(n)], "source": [PYTHON] * n})]))
    assert next(out).num_rows == len(seen) == files.FILES_PER_TASK
    rest = list(out)
    assert sum(b.num_rows for b in rest) + files.FILES_PER_TASK == n and rest[-1].column("path").to_pylist() == [f"{n - 1}.py"]


def test_ruby_is_cut_into_tokens_once(monkeypatch):
    """However many methods a file has; their shapes are those of their own texts."""
    from loomgraph.parse import lexer, ruby_source
    from loomgraph.sources.files import parsed_row

    source, cut = "".join(f"# {i}\ndef m{i}(a)\n  x = a + {i}\n  m{i + 1}(x)\nend\n" for i in range(20)), []
    real = lexer.tokens
    for module in (lexer, ruby_source):
        monkeypatch.setattr(module, "tokens", lambda text, language: cut.append(len(text)) or real(text, language))
    symbols = parsed_row("m.rb", source.encode(), None)[8]
    assert cut == [len(source)] and len(symbols) == 20
    assert {s[8] for s in symbols} == {lexer.normalised(symbols[0][7], "ruby")}

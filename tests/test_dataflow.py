"""Dataflow tables against a plain version that follows one function after another."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.lists import SANITIZERS, TAINT_SINKS, TAINT_SOURCES
from loomgraph.operators import dataflow

from conftest import values

SYMBOL = (
    "path string, ordinal int, name string, kind string, line int, variables array<struct<name: string, line: int, type: string, kind: string>>, "
    "assigns array<struct<name: string, line: int, names: array<string>, expr: string>>, call_sites array<struct<expr: string, line: int>>"
)
WORD = re.compile("[A-Za-z_][A-Za-z0-9_]*")


def found_in(text, marks):
    for mark in sorted(marks, key=lambda m: (-len(m), m)):
        if mark in text and re.search(rf"(?<![\w]){re.escape(mark)}\s*(?![\w.])", text):
            return mark
    return None


def symbol(path, name, params=(), assigns=(), calls=(), ordinal=0):
    return (path, ordinal, name, "function", 1, [(p, 1, "", "parameter") for p in params], [(n, i, WORD.findall(e), e) for i, (n, e) in enumerate(assigns)], [(c, 90 + i) for i, c in enumerate(calls)])


class Plain:
    """One function: what each name is made of, by its last assignment or by all."""

    def __init__(self, s):
        self.path, self.name = s[0], s[2]
        self.params = [v[0] for v in s[5]]
        self.assigns, self.calls = s[6], [c[0] for c in s[7]]
        self.deps, seen = [], []
        for name, _, names, _ in self.assigns:
            own = []
            for n in dict.fromkeys(names):
                if n in seen:
                    own.append(n)
                elif n in self.params:
                    own.append("@" + n)
                elif n == name:
                    own.append(n)
            seen.append(name)
            self.deps.append((name, own))
        self.assigned = set(seen)

    def node(self, name):
        return name if name in self.assigned else "@" + name if name in self.params else None

    def closure(self, root, last):
        edges = {}
        for name, own in self.deps:
            edges[name] = own if last else [*edges.get(name, []), *own]
        hops, todo = {root: 0}, [root]
        while todo:
            at = todo.pop(0)
            for d in edges.get(at, []):
                if d not in hops:
                    hops[d] = hops[at] + 1
                    todo.append(d)
        return sorted((h, n) for n, h in hops.items())

    def sinks(self):
        newest = {name: expr for name, _, _, expr in self.assigns}
        for site, expr in enumerate(self.calls):
            if not found_in(expr, TAINT_SINKS):
                continue
            for pos, name in enumerate(dict.fromkeys(WORD.findall(expr))):
                if self.node(name) is None:
                    continue
                steps = self.closure(self.node(name), True)
                exprs = [newest[n] for _, n in steps if n in newest and "(" in newest[n]]
                clean = next((m for e in exprs if (m := found_in(e, SANITIZERS))), None)
                yield site, pos, [*(n.lstrip("@") for _, n in steps), expr], any(found_in(e, TAINT_SOURCES) for e in exprs), clean, {n[1:] for _, n in steps if n[0] == "@"}

    def handed(self):
        """(callee, pos, parameter or None for a source) of each call."""
        for expr in self.calls:
            callee = expr.partition("(")[0].rpartition(".")[2].strip()
            for pos, arg in enumerate(re.split(dataflow.COMMA, re.sub(r"\)\s*$", "", expr.partition("(")[2]))):
                for name in WORD.findall(arg):
                    if self.node(name) is not None:
                        for _, n in self.closure(self.node(name), False):
                            if n[0] == "@":
                                yield callee, pos, n[1:]
                            elif any(name == n and found_in(e, TAINT_SOURCES) for name, _, _, e in self.assigns):
                                yield callee, pos, None


def plain_cross(symbols, depth=None):
    all_of = [Plain(s) for s in symbols]
    facts = {}  # (index, param): way
    level = {}
    for s in all_of:
        for callee, pos, origin in s.handed():
            if origin is None:
                for i, t in enumerate(all_of):
                    if t.name == callee and pos < len(t.params):
                        key, way = (i, t.params[pos]), [s.name, callee]
                        level[key] = min(level.get(key, way), way)
    hop = 1
    while level and (depth is None or hop <= depth):
        facts |= {k: (hop, w) for k, w in level.items()}
        new = {}
        for (i, param), way in level.items():
            for callee, pos, origin in all_of[i].handed():
                if origin == param:
                    for j, t in enumerate(all_of):
                        if t.name == callee and pos < len(t.params) and (j, t.params[pos]) not in facts:
                            key = (j, t.params[pos])
                            new[key] = min(new.get(key, [*way, callee]), [*way, callee])
        level, hop = new, hop + 1
    out = []
    for i, s in enumerate(all_of):
        for site, pos, chain, tainted, clean, given in s.sinks():
            ways = [(0, [s.name])] * tainted + [facts[i, p] for p in given if (i, p) in facts]
            if ways:
                out.append((s.path, s.name, "SAFE" if clean else "UNSAFE", tuple(chain), clean, *min(ways)[:1], tuple(min(ways)[1])))
    return sorted(out, key=str)


def program(seed, n=60):
    """Functions of a few names that call each other, assign each other's names in circles, and read, clean and use what they get."""
    draw = random.Random(seed)
    out = []
    for i in range(n):
        params = draw.sample(["a", "b", "c"], draw.randint(1, 3))
        names = ["a", "b", "x", "y", "z"]
        expr = lambda: draw.choice(["{}", "{} + {}", "f({})", "1", "input()", "int({})", "sanitize({}, {})", "thread({})", "[{} for {} in x]"]).format(draw.choice(names), draw.choice(names))
        assigns = [(draw.choice(names[2:] + ["a"]), expr()) for _ in range(draw.randint(0, 6))]
        calls = [draw.choice(["f{}({}, {})", "obj.f{}({})", "f{}(g({}, 1), {})", "f{}()"]).format(draw.randrange(n), draw.choice(names), draw.choice(names)) for _ in range(draw.randint(1, 4))]
        calls += [draw.choice(["db.execute({})", "os.system({} + {})", "log({})", "eval({})"]).format(draw.choice(names), draw.choice(names)) for _ in range(draw.randint(0, 2))]
        out.append(symbol(f"{i % 4}.py", f"f{i % (n - 3)}", params, assigns, calls, i))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_all_functions_against_one_after_another(spark, seed):
    symbols = program(seed)
    flow = dataflow.Flow(spark.createDataFrame(symbols, SYMBOL))
    want = plain_cross(symbols)
    got = flow.cross_taint_paths(flow.tainted_parameters(None))
    assert sorted(((*r[:3], tuple(r[3]), *r[4:6], tuple(r[6])) for r in values(got, "path", "name", "verdict", "chain", "sanitizer", "hop", "functions")), key=str) == want
    assert any(w[5] > 1 for w in want) and {"SAFE", "UNSAFE"} == {w[2] for w in want}
    own = sorted(((p, n, v, tuple(c), s) for p, n, v, c, s in values(flow.taint_paths(), "path", "name", "verdict", "chain", "sanitizer")), key=str)
    assert own == sorted((w[:5] for w in plain_cross(symbols, 0)), key=str)
    known = {(p.path, p.name, i): sorted(n for n in own if n[0] != "@") for p in map(Plain, symbols) for i, (_, own) in enumerate(p.deps)}
    told = {(r["path"], r["name"], r["seq"]): r["depends_on"] for r in flow.variables().collect() if r["name"] not in ("f0", "f1", "f2")}
    assert told == {k: v for k, v in known.items() if k[1] not in ("f0", "f1", "f2")}


def test_long_chains_and_circles(spark):
    n = 3_000
    chain = [("v0", "input()"), *((f"v{i}", f"v{i - 1}") for i in range(1, n))]
    ring = [("a", "input()"), ("b", "a"), ("a", "b"), ("b", "a")]
    symbols = [symbol("long.py", "long", [], chain, [f"eval(v{n - 1})"]), symbol("ring.py", "ring", [], ring, ["os.system(b)"]), symbol("none.py", "none")]
    flow = dataflow.Flow(spark.createDataFrame(symbols, SYMBOL))
    found = {r["name"]: r for r in flow.taint_paths().collect()}
    assert found["long"]["chain"] == [f"v{i}" for i in reversed(range(n))] + [f"eval(v{n - 1})"] and found["long"]["verdict"] == "UNSAFE"
    assert "ring" not in found  # the last assignments read nothing from outside any more
    assert [r["chain"] for r in flow.chains().collect()] == [[f"v{i}" for i in reversed(range(n))]]


def test_reach_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(dataflow, "stage", lambda df: rounds.append(1) or spark.createDataFrame(df.toPandas(), df.schema))
    edges = spark.createDataFrame([("s", f"n{i}", f"n{i + 1}") for i in range(1000)] + [("s", "n1000", "n7"), ("t", "n0", "n9")], "space string, src string, dst string")
    got = dataflow.reach(spark.createDataFrame([("s", "n0"), ("t", "n9")], "space string, root string"), edges)
    assert sorted(values(got)) == sorted([("s", "n0", f"n{i}", i) for i in range(1001)] + [("t", "n9", "n9", 0)])
    assert len(rounds) <= 2 * 12 + 2


@pytest.mark.parametrize(("text", "mark"), [("os.environ.get('x')", "os.environ.get"), ("thread(x)", None), ("x = read (y)", "read"), ("readline()", "readline"), ("my_input()", None), ("éinput()", None), ("input.x", None)])
def test_marks_are_called_names(spark, text, mark):
    got = spark.createDataFrame([(text,)], "t string").select(dataflow.mark(F.col("t"), TAINT_SOURCES)).first()[0]
    assert got == mark == found_in(text, TAINT_SOURCES)


def test_a_source_behind_many_variables(spark):
    """A source, or a sanitizer, behind more than twenty variables that the sink draws on."""
    plain = [(f"v{i}", str(i)) for i in range(25)]
    end = ("q", " + ".join([*(f"v{i}" for i in range(25)), "x"]))
    symbols = [symbol("a.py", "a", [], [*plain, ("x", "input()"), end], ["cursor.execute(q)"]), symbol("b.py", "b", [], [*plain, ("raw", "input()"), ("x", "sanitize(raw)"), end], ["cursor.execute(q)"])]
    found = {r["name"]: r for r in dataflow.Flow(spark.createDataFrame(symbols, SYMBOL)).taint_paths().collect()}
    assert (found["a"]["verdict"], found["a"]["risk"], len(found["a"]["chain"])) == ("UNSAFE", "SQL injection", 28)
    assert (found["b"]["verdict"], found["b"]["sanitizer"]) == ("SAFE", "sanitize")


def test_methods_get_their_arguments_without_self(spark):
    store = symbol("m.py", "store", ["self", "value"], [], ["db.execute(value)"])
    flow = dataflow.Flow(spark.createDataFrame([symbol("h.py", "handle", [], [("raw", "input()")], ["repo.store(raw)"]), store], SYMBOL))
    got = values(flow.cross_taint_paths(flow.tainted_parameters(1)), "name", "functions", "verdict")
    assert got == [("store", ["handle", "store"], "UNSAFE")]
    assert values(flow.cross_taint_paths(flow.tainted_parameters(0))) == []


def test_what_uses_are_made_of_is_neither_shuffled_nor_staged_by_rounds(spark, monkeypatch):
    """However long the chain of assignments: functions and uses are staged, the edges of calls, and each level of callers."""
    rounds = []
    stage = dataflow.stage
    monkeypatch.setattr(dataflow, "stage", lambda df: rounds.append(df) or stage(df))
    chain = [("v0", "input()"), *((f"v{i}", f"v{i - 1}") for i in range(1, 40))]
    symbols = [symbol("a.py", "a", [], chain, ["b(1, v39)"]), symbol("b.py", "b", ["p", "q"], [("x", "q")], ["db.execute(x)", "log(p)"])]
    flow = dataflow.Flow(spark.createDataFrame(symbols, SYMBOL))
    assert values(flow.cross_taint_paths(flow.tainted_parameters(None)), "name", "functions", "chain") == [("b", ["a", "b"], ["x", "q", "db.execute(x)"])]
    assert len(rounds) == 5 and "Exchange" not in flow.made_of._jdf.queryExecution().executedPlan().toString()


def test_uses_of_many_names_come_in_batches():
    """A task holds so many steps at once, whatever the function."""
    import pyarrow as pa

    n = 600
    assigns = [(f"v{i}", [f"v{i - 1}"] if i else [], "input" if not i else None, None, not i) for i in range(n)]
    uses = [(0, i, f"v{i}", "f()") for i in range(n)]
    kinds = [pa.string()] * 3 + [pa.int32(), pa.list_(pa.string())]
    struct = lambda fields: pa.list_(pa.struct(fields))
    kinds += [struct([("name", pa.string()), ("names", pa.list_(pa.string())), ("source", pa.string()), ("sanitizer", pa.string()), ("calls", pa.bool_())])]
    kinds += [struct([("site", pa.int32()), ("pos", pa.int32()), ("name", pa.string()), ("text", pa.string())])]
    from loomgraph.sources.files import _column

    batch = pa.RecordBatch.from_arrays([_column([v], k) for v, k in zip(("f", "p", "n", 1, [], assigns, uses), kinds)], names=list("abcdefg"))
    made = list(dataflow._made_of(iter([batch])))
    assert sum(b.num_rows for b in made) == n and max(len(b.column("steps").flatten()) for b in made) < dataflow._STEPS_AT_ONCE + n
    last = made[-1].slice(made[-1].num_rows - 1).to_pylist()[0]
    assert [s["node"] for s in last["steps"]] == [f"v{i}" for i in reversed(range(n))] and last["steps"][-1]["source"] == "input"

"""Dataflow and taint of all functions at once, as tables. A function is its place in a file: `fn`, path#ordinal.

Uses are bound to assignments as of their place. What the variables of all functions are made of is the closure of that, by doubling, so a
chain of thousands of assignments takes a dozen rounds and a cycle ends. What sinks and arguments are made of is followed within the row
that a function is, in tasks. What a call hands on is matched to the callee's parameters by position, and taint spreads from function to
function one delta a level.

Names that are parameters and not yet assigned are nodes of their own, written @name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lists import SANITIZERS, TAINT_SINKS, TAINT_SOURCES
from ..sources.files import record_batch
from ..staging import ship, spread, stage

NAME = "[A-Za-z_][A-Za-z0-9_]*"
#: Commas that part the arguments of a call: those that no closing bracket follows before an opening one.
COMMA = r",(?![^()]*\))"
OWN = ("self", "cls", "this")
SOURCE = "source"


def mark(text: Column, marks: tuple[str, ...], match: str = "call") -> Column:
    """The longest mark in a text, the first by name among equals: anywhere ("substring"), or as a called name ("call"); or null."""
    found = []
    for m in sorted(marks, key=lambda m: (-len(m), m)):
        inside = text.contains(m)
        if match == "call":
            inside = inside & text.rlike(rf"(?U)(?<!\w){re.escape(m)}\s*(?![\w.])")
        found.append(F.when(inside, F.lit(m)))
    return F.coalesce(*found)


def sink_kind(text: Column) -> Column:
    has = lambda *words: F.lit(False) if not words else text.rlike("|".join(words))
    return F.when(has("execute"), "database").when(has("system", "subprocess", "popen"), "shell").when(has("eval", "exec", "compile"), "code_execution").otherwise("output")


def risk(text: Column) -> Column:
    kind = sink_kind(text)
    return F.when(kind == "database", "SQL injection").when(kind == "shell", "Command injection").when(kind == "code_execution", "Code injection").otherwise("unknown")


def functions(symbols: DataFrame) -> DataFrame:
    """fn, path, name, line, params (those that a caller gives), assigns, call_sites."""
    params = F.transform(F.filter("variables", lambda v: (v["kind"] == "parameter") & ~v["name"].isin(*OWN)), lambda v: v["name"])
    fn = F.concat("path", F.lit("#"), F.col("ordinal").cast("string")).alias("fn")
    own = symbols.where(F.col("kind").isin("function", "method"))
    return own.select(fn, "path", "name", "line", F.coalesce(params, F.array().cast("array<string>")).alias("params"), "assigns", "call_sites")


def assignments(functions: DataFrame) -> DataFrame:
    """fn, seq, name, line, expr, names (that the expression reads), params."""
    return functions.select("fn", "params", F.posexplode("assigns").alias("seq", "a")).select("fn", "seq", "a.name", "a.line", "a.expr", "a.names", "params")


def def_use(assigns: DataFrame, rows: int = 0) -> DataFrame:
    """(fn, seq, name, dep, bound, is_last): each name that an assignment reads, with the last assignment of it before.

    A name that is assigned nowhere before is the parameter of that name (@name, without `bound`), or the
    assignment itself if it reads its own target; other names are not of the function. `is_last` marks the last assignment of `name`.
    `rows` says about how many assignments there are, so that tasks sort no more of them in larger tables.
    """
    own = Window.partitionBy("fn", "name")
    again = spread(assigns.drop("expr", "line"), rows, "fn", "name").withColumn("is_last", F.max("seq").over(own) == F.col("seq"))
    reads = again.select("fn", "seq", F.col("name").alias("target"), "is_last", F.explode(F.array_distinct("names")).alias("name"), "params")
    uses = reads.select("fn", "name", "seq", F.lit(0).alias("of"), "target", "is_last", F.array_contains("params", F.col("name")).alias("given"), F.lit(None).cast("int").alias("bound"))
    defs = assigns.select("fn", "name", "seq", F.lit(1).alias("of"), F.col("seq").alias("bound"))
    before = own.orderBy("seq", "of").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bound = spread(uses.unionByName(defs, allowMissingColumns=True), 2 * rows, "fn", "name").withColumn("bound", F.last("bound", ignorenulls=True).over(before)).where("of = 0")
    dep = F.when(F.col("bound").isNotNull(), F.col("name")).when(F.col("given"), F.concat(F.lit("@"), "name")).when(F.col("name") == F.col("target"), F.col("name"))
    itself = F.when(~F.col("given") & (F.col("name") == F.col("target")), F.col("seq"))
    return bound.select("fn", "seq", F.col("target").alias("name"), dep.alias("dep"), F.coalesce("bound", itself).alias("bound"), "is_last").where("dep is not null")


def reach(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(space, root, node, hop): all that each (space, root) reaches by (space, src, dst), with the least number of steps.

    Round k knows what is fewer than 2^k steps away, and the ends of walks of exactly 2^k steps; together they give fewer than 2^(k+1).
    It ends with the first round that finds nothing: whatever is farther would be behind something at 2^k steps.
    """
    found = stage(roots.select("space", "root", F.col("root").alias("node"), F.lit(0).alias("hop")).distinct())
    walks = stage(edges.select("space", "src", "dst").distinct())
    known, length = found.count(), 1
    while True:
        further = found.join(walks.withColumnRenamed("src", "node"), ["space", "node"]).select("space", "root", F.col("dst").alias("node"), (F.col("hop") + length).alias("hop"))
        grown = stage(found.unionByName(further).groupBy("space", "root", "node").agg(F.min("hop").alias("hop")))
        now = grown.count()
        if now == known:
            return found
        found, known, length = grown, now, 2 * length
        on = walks.select("space", F.col("src").alias("dst"), F.col("dst").alias("end"))
        walks = stage(walks.join(on, ["space", "dst"]).select("space", "src", F.col("end").alias("dst")).distinct())


_STEP = pa.struct([("hop", pa.int32()), ("node", pa.string()), ("source", pa.string()), ("sanitizer", pa.string())])
_MADE_OF = pa.schema(
    [
        ("fn", pa.string()), ("path", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("site", pa.int32()), ("pos", pa.int32()), ("text", pa.string()),
        ("steps", pa.list_(_STEP)), ("origins", pa.list_(pa.string())),
    ]
)
_MADE_OF_KIND = "fn string, path string, name string, line int, site int, pos int, text string, steps array<struct<hop: int, node: string, source: string, sanitizer: string>>, origins array<string>"
#: Rows, and steps of them, that a task holds at once.
_ROWS_AT_ONCE, _STEPS_AT_ONCE = 4096, 1 << 16


def steps_of(root: str, edges: dict[str, list[str]]) -> dict[str, int]:
    """All that a name is made of, with the least number of steps."""
    hops, level = {root: 0}, [root]
    while level:
        nearer, level = level, []
        for node in nearer:
            for dep in edges.get(node, ()):
                if dep not in hops:
                    hops[dep] = hops[node] + 1
                    level.append(dep)
    return hops


def uses_of(params: list[str], assigns: list[tuple], uses: list[tuple]) -> Iterator[tuple]:
    """(site, pos, text, steps, origins) of one function's uses, in the order of _MADE_OF; those of a callee's argument are one. Its assignments
    are name, names, source, sanitizer, calls, and its uses site (-1 in an argument), pos, name, text.
    """
    given, every, last, newest, sources = set(params), {}, {}, {}, set()
    for name, names, source, sanitizer, calls in assigns:
        deps = []
        for n in names:
            if n in last:
                deps.append(n)
            elif n in given:
                deps.append(f"@{n}")
            elif n == name:
                deps.append(n)
        last[name] = deps
        every.setdefault(name, {}).update(dict.fromkeys(deps))
        newest[name] = (source, sanitizer) if calls else (None, None)
        if source is not None:
            sources.add(name)
    known: dict[tuple, list] = {}
    handed: dict[tuple, dict] = {}
    for site, pos, name, text in uses:
        if name not in last and name not in given:
            continue
        root, sink = name if name in last else f"@{name}", site >= 0
        if (root, sink) not in known:
            hops = steps_of(root, last if sink else every)
            if sink:
                known[root, sink] = sorted((hop, node, *newest.get(node, (None, None))) for node, hop in hops.items())
            else:
                known[root, sink] = [node[1:] if node[0] == "@" else None for node in hops if node[0] == "@" or node in sources]
        if sink:
            yield site, pos, text, known[root, sink], ()
        else:
            handed.setdefault((text, pos), {}).update(dict.fromkeys(known[root, sink]))
    for (callee, pos), origins in handed.items():
        if origins:
            yield None, pos, callee, (), tuple(origins)


def _plain(column: pa.Array) -> list:
    """The values of an array, those of a struct as tuples, of a list as lists: field by field, so that no value is looked up by its place and name."""
    if pa.types.is_struct(column.type):
        return list(zip(*map(_plain, column.flatten())))
    if pa.types.is_list(column.type):
        inner, ends = _plain(column.flatten()), list(accumulate((n or 0 for n in column.value_lengths().to_pylist()), initial=0))
        return [inner[i:j] for i, j in zip(ends, ends[1:])]
    return column.to_pylist() if column.null_count and pa.types.is_primitive(column.type) else column.to_numpy(zero_copy_only=False).tolist()


def _made_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, n = [], 0
    for batch in batches:
        for fn, path, name, line, params, assigns, uses in zip(*map(_plain, batch.columns)):
            for row in uses_of(params, assigns, uses):
                rows.append((fn, path, name, line, *row))
                n += len(row[3])
                if len(rows) >= _ROWS_AT_ONCE or n >= _STEPS_AT_ONCE:
                    yield record_batch(rows, _MADE_OF)
                    rows, n = [], 0
    yield record_batch(rows, _MADE_OF)


class Flow:
    """The tables of some functions; each is staged when it is first needed."""

    def __init__(self, symbols: DataFrame, match: str = "call"):
        self.match = match
        self.functions = stage(functions(symbols))
        self.assigns = assignments(self.functions)
        self._made: dict[str, DataFrame] = {}

    def _staged(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = stage(make())
        return self._made[name]

    @property
    def def_use(self) -> DataFrame:
        return self._staged("def_use", lambda: def_use(self.assigns, self.n_assigns))

    @cached_property
    def n_assigns(self) -> int:
        return self.functions.agg(F.sum(F.size("assigns"))).first()[0] or 0

    @property
    def sites(self) -> DataFrame:
        """fn, site, expr, line, source, sink (the marks in the call's text, or null)."""
        each = self.functions.select("fn", F.posexplode("call_sites").alias("site", "c")).select("fn", "site", "c.expr", "c.line")
        return each.withColumns({"source": mark(F.col("expr"), TAINT_SOURCES, self.match), "sink": mark(F.col("expr"), TAINT_SINKS, self.match)})

    @property
    def made_of(self) -> DataFrame:
        """fn, path, name, line, site, pos, text, steps, origins: names in sinks, with what their values are made of, and arguments of calls (site is
        null), with the parameters and the source (null) that theirs are made of; `text` is the sink's or the callee's name.

        A sink sees the last assignment of a variable, an argument each of them. A function is a row already and needs nothing of others, so
        nothing is shuffled.
        """
        names = lambda text: F.array_distinct(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)))
        sinks = F.filter(F.transform("call_sites", lambda c, i: F.struct(i.alias("site"), c["expr"].alias("expr"))), lambda c: mark(c["expr"], TAINT_SINKS, self.match).isNotNull())
        in_sinks = F.flatten(F.transform(sinks, lambda c: F.transform(names(c["expr"]), lambda n, pos: F.struct(c["site"].alias("site"), pos.alias("pos"), n.alias("name"), c["expr"].alias("text")))))
        calls = F.filter(F.transform("call_sites", lambda c: c["expr"]), lambda e: e.contains("("))
        inner = lambda e: F.regexp_replace(F.regexp_replace(e, r"^[^(]*\(", ""), r"\)\s*$", "")
        callee = lambda e: F.trim(F.substring_index(F.substring_index(e, "(", 1), ".", -1))
        in_arguments = F.flatten(F.transform(calls, lambda e: F.flatten(F.transform(F.split(inner(e), COMMA), lambda arg, pos: F.transform(names(arg), lambda n: F.struct(F.lit(-1).alias("site"), pos.alias("pos"), n.alias("name"), callee(e).alias("text")))))))
        marked = F.transform("assigns", lambda a: F.struct(a["name"].alias("name"), a["names"].alias("names"), mark(a["expr"], TAINT_SOURCES, self.match).alias("source"), mark(a["expr"], SANITIZERS, self.match).alias("sanitizer"), a["expr"].contains("(").alias("calls")))

        def make() -> DataFrame:
            ship(self.functions.sparkSession)
            asked = self.functions.select("fn", "path", "name", "line", "params", marked.alias("assigns"), F.concat(in_sinks, in_arguments).alias("uses"))
            return asked.where(F.size("uses") > 0).mapInArrow(_made_of, _MADE_OF_KIND)

        return self._staged("made_of", make)

    @property
    def sink_uses(self) -> DataFrame:
        """fn, path, name, line, site, pos, expr, chain (names by steps, then the sink), tainted (by a source of its own), sanitizer, given (parameters in it)."""
        named = F.transform("steps", lambda s: F.ltrim(s["node"], F.lit("@")))
        clean = F.get(F.filter("steps", lambda s: s["sanitizer"].isNotNull()), F.lit(0))["sanitizer"]
        given = F.transform(F.filter("steps", lambda s: s["node"].startswith("@")), lambda s: F.substring(s["node"], 2, 1 << 30))
        return self.made_of.where("site is not null").select(
            "fn", "path", "name", "line", "site", "pos", F.col("text").alias("expr"), F.concat(named, F.array("text")).alias("chain"), F.exists("steps", lambda s: s["source"].isNotNull()).alias("tainted"),
            clean.alias("sanitizer"), given.alias("given"),
        )

    @property
    def passes(self) -> DataFrame:
        """(fn, name, callee, pos, origin): calls whose argument at a position is made of a parameter (its name) or of a source (null)."""
        return self.made_of.where("site is null").select("fn", "name", F.col("text").alias("callee"), "pos", F.explode("origins").alias("origin"))

    def tainted_parameters(self, depth: int | None = None, start: DataFrame | None = None) -> DataFrame:
        """(fn, param, hop, way): parameters that get something from outside, after how many calls, and the functions' names on the way.

        A semi-naive fixpoint: a level joins only the facts of the level before with the calls that hand them on. `start` (fn) are the
        functions whose sources count, all by default; `depth` bounds the calls. Of several ways the first of the shortest stays.
        """
        targets = self.functions.select(F.col("fn").alias("to"), F.col("name").alias("callee"), F.posexplode("params").alias("pos", "param"))
        # a call hands a value to each function of the name
        edges = stage(self.passes.join(targets, ["callee", "pos"]).select("fn", "name", "origin", "to", "param", "callee"))
        begun = edges.where("origin is null")
        if start is not None:
            begun = begun.join(start.select("fn"), "fn", "left_semi")
        best = lambda df: df.groupBy("fn", "param").agg(F.min("way").alias("way"))
        new = stage(best(begun.select(F.col("to").alias("fn"), "param", F.array("name", "callee").alias("way"))).withColumn("hop", F.lit(1)))
        if depth is not None and depth < 1:
            return new.limit(0)
        known, hop = new, 1
        onward = edges.where("origin is not null").withColumnRenamed("origin", "held")
        while (depth is None or hop < depth) and not new.isEmpty():
            hop += 1
            handed = new.select("fn", F.col("param").alias("held"), "way").join(onward, ["fn", "held"]).select(F.col("to").alias("fn"), "param", F.concat("way", F.array("callee")).alias("way"))
            new = stage(best(handed).join(known, ["fn", "param"], "left_anti").withColumn("hop", F.lit(hop)))
            known = known.unionByName(new)
        return known

    def taint_paths(self) -> DataFrame:
        """path, name, verdict, chain, sanitizer, risk, line of each way from a source to a sink within a function."""
        return _judged(self.sink_uses.where("tainted")).select("path", "name", "line", "site", "pos", "verdict", "chain", "sanitizer", "risk")

    def cross_taint_paths(self, facts: DataFrame, start: DataFrame | None = None) -> DataFrame:
        """The same over calls, by tainted_parameters(): hop (calls from the source's function) and functions (their names), the
        shortest way for each sink and name. `start` (fn) are the functions whose own paths count, all by default.
        """
        own = self.sink_uses.where("tainted")
        if start is not None:
            own = own.join(start.select("fn"), "fn", "left_semi")
        told = ("fn", "path", "name", "line", "site", "pos", "expr", "chain", "sanitizer", "hop", "way")
        own = own.withColumns({"hop": F.lit(0), "way": F.array("name")}).select(*told)
        held = self.sink_uses.where(F.size("given") > 0).withColumn("param", F.explode("given")).join(facts, ["fn", "param"]).select(*told)
        both = own.unionByName(held)
        rest = F.struct(*told[1:4], *told[6:])
        first = both.groupBy("fn", "site", "pos").agg(F.min_by(rest, F.struct("hop", "way")).alias("r")).select("site", "pos", "r.*")
        return _judged(first).select("path", "name", "line", "site", "pos", "verdict", "chain", "sanitizer", "risk", "hop", F.col("way").alias("functions"))

    def variables(self) -> DataFrame:
        """path, name, variable, at_line, seq, depends_on (sorted), expr: each assignment."""
        n = self.n_assigns
        reads = self.def_use.where(~F.col("dep").startswith("@")).select("fn", "seq", "dep")
        deps = spread(reads, n, "fn", "seq").groupBy("fn", "seq").agg(F.array_sort(F.collect_set("dep")).alias("depends_on"))
        each = self.functions.select("fn", "path", "name", "line", F.posexplode("assigns").alias("seq", "a"))
        each = each.select("fn", "path", "name", "line", "seq", F.col("a.name").alias("variable"), F.col("a.line").alias("at_line"), "a.expr")
        rows = spread(each, n, "fn", "seq").join(deps, ["fn", "seq"], "left")
        told = rows.withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>")))
        return told.select("path", "name", "line", "seq", "variable", "at_line", "depends_on", "expr")

    def chains(self) -> DataFrame:
        """path, name, variable, chain: each variable that no other is made of, and what it is made of, by steps."""
        edges = self.def_use.where(~F.col("dep").startswith("@") & (F.col("dep") != F.col("name"))).select(F.col("fn").alias("space"), F.col("name").alias("src"), F.col("dep").alias("dst")).distinct()
        ends = edges.select("space", F.col("src").alias("root")).distinct().join(edges.select("space", F.col("dst").alias("root")), ["space", "root"], "left_anti")
        steps = reach(ends, edges).groupBy("space", "root").agg(F.array_sort(F.collect_list(F.struct("hop", "node"))).alias("steps"))
        told = steps.select(F.col("space").alias("fn"), F.col("root").alias("variable"), F.transform("steps", lambda s: s["node"]).alias("chain"))
        return told.join(self.functions.select("fn", "path", "name", "line"), "fn").select("path", "name", "line", "variable", "chain")


def _judged(uses: DataFrame) -> DataFrame:
    safe = F.col("sanitizer").isNotNull()
    return uses.withColumns({"verdict": F.when(safe, "SAFE").otherwise("UNSAFE"), "risk": F.when(~safe, risk(F.col("expr")))})

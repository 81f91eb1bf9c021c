"""A repository as tables, and the questions about it. Answers are DataFrames unless they are small nested reports."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import cached_property, reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.lists import ALWAYS_USED
from .operators import build, dataflow, graph, history, names, spans, store, text
from .sources import files as source_files
from .sources import gitlog
from .staging import sent, stage


#: Parts of the table of edges by the file that an edge begins in, and changes after which all parts are written together.
EDGE_PARTS, PATCHES = 64, 8


def edge_part(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(EDGE_PARTS)).cast("int")


def parted(edges: DataFrame) -> DataFrame:
    return edges.withColumn("part", edge_part(F.split_part("src", F.lit("::"), F.lit(1))))


class PathError(ValueError):
    """A path that leaves the repository."""


def checked(path: str | None) -> str | None:
    """A path inside the repository, or an error; nothing and "" pass."""
    if not path:
        return path
    pure = PurePosixPath(path.replace("\\", "/"))
    depth = 0
    if pure.is_absolute():
        raise PathError(f"absolute path: {path}")
    for part in pure.parts:
        depth += -1 if part == ".." else part != "."
        if depth < 0:
            raise PathError(f"path outside the repository: {path}")
    return path


class Engine:
    """Tables of one repository. `refresh` reads what has changed since; with a `store` folder they outlive the session.

    Of two writers to a store that start from the same version, one gets store.Conflict and its tables are not seen.
    """

    def __init__(self, spark: SparkSession, root: str, store_dir: str | None = None):
        self.spark, self.root = spark, root
        self._versions = store.Versions(spark, store_dir) if store_dir else None
        self._version = self._versions.last() if self._versions else 0
        self._meta: dict[str, str] = {}
        self._flows, self._edge_tables, self._indexed, self._once = {}, [], False, True
        if self._version:
            self.parsed = self._versions.read("parsed", self._version)
            self.refresh()
        else:
            self._publish(stage(source_files.read(spark, root)))

    @classmethod
    def over(cls, texts: DataFrame) -> Engine:
        """The questions about files that are a table already: path and source. It has no folder to refresh from and no history."""
        engine = cls.__new__(cls)
        engine.spark, engine.root, engine._versions, engine._version, engine._meta = texts.sparkSession, None, None, 0, {}
        engine._indexed = False
        parsed = stage(source_files.parse(texts))
        engine._once = parsed.groupBy("path").count().where("count > 1").isEmpty()
        engine._publish(parsed)
        return engine

    def _publish(self, parsed: DataFrame, touched: DataFrame | None = None) -> None:
        """Make these the parsed files. If `touched` (path) says which differ, edges that have been derived are replaced where that matters."""
        was = (self.symbols, self.files, self._edge_tables) if touched is not None and "links" in self.__dict__ else None
        self.parsed = parsed
        if self._versions:
            self._version = self._versions.publish({"parsed": parsed}, self._version)
            self.parsed = self._versions.read("parsed", self._version)
        self.set_meta("last_indexed_at", datetime.now(timezone.utc).isoformat(timespec="seconds"))
        self._flows: dict[str, dataflow.Flow] = {}
        for name in ("files", "symbols", "occurrences", "imports", "links", "ends", "name_links", "name_index"):
            self.__dict__.pop(name, None)
        self._edge_tables: list[tuple[DataFrame, frozenset[int]]] = []
        if was is not None:
            self._patch_edges(*was, touched)

    def _patch_edges(self, symbols: DataFrame, files: DataFrame, tables: list[tuple[DataFrame, frozenset[int]]], touched: DataFrame) -> None:
        """Derive the edges of the files that a change concerns anew, and write the parts of the table that hold them again; other parts are
        read where they are. After PATCHES changes all parts are written together.
        """
        paths = lambda df: df.select("path")
        come_or_gone = paths(files).exceptAll(paths(self.files)).unionByName(paths(self.files).exceptAll(paths(files)))
        only = stage(build.concerned(symbols, self.symbols, touched, self.imports, come_or_gone))
        parts = frozenset(r[0] for r in only.select(edge_part(F.col("path"))).distinct().collect())  # at most EDGE_PARTS
        held = self._joined_edges(tables).where(F.col("part").isin(*parts)) if parts else self._joined_edges(tables).limit(0)
        kept = held.withColumn("path", F.split_part("src", F.lit("::"), F.lit(1))).join(only, "path", "left_anti").drop("path")
        fresh = self._stage_edges(kept.unionByName(parted(build.links(self.symbols, self.imports, self.files, only))))
        tables = [(t, gone | parts) for t, gone in tables] + [(fresh, frozenset())]
        if len(tables) > PATCHES:
            tables = [(self._stage_edges(self._joined_edges(tables)), frozenset())]
        self._edge_tables = tables
        self.__dict__["links"] = self._joined_edges(tables).drop("part")

    @staticmethod
    def _stage_edges(edges: DataFrame) -> DataFrame:
        return stage(edges.repartitionByRange("part", "src"), by="part")

    @staticmethod
    def _joined_edges(tables: list[tuple[DataFrame, frozenset[int]]]) -> DataFrame:
        """The parts of each table that no later one has replaced."""
        left = [t.where(~F.col("part").isin(*gone)) if gone else t for t, gone in tables]
        return reduce(DataFrame.unionByName, left)

    def get_meta(self, key: str, default: str | None = None) -> str | None:
        """What set_meta() has kept under a key, in the store if there is one."""
        return (self._versions.get_meta(key) if self._versions else self._meta.get(key)) or default

    def set_meta(self, key: str, value: str) -> None:
        if self._versions:
            self._versions.set_meta(key, value)
        else:
            self._meta[key] = value

    def refresh(self, full: bool = False) -> dict[str, int]:
        """Parse the files whose time of change differs; all else is kept, and so are the edges that the change doesn't concern.

        Files whose content has changed and whose time has not are seen only if `full`, which reads all and goes by their hashes.
        """
        now = stage(source_files.listed(self.spark, self.root))
        known = self.parsed.select("path", "mtime")
        touched = now if full else stage(now.join(known, ["path", "mtime"], "left_anti"))
        fresh = stage(source_files.read(self.spark, self.root, touched))
        keys = lambda df: df.select(F.col("path").alias("key"), F.col("sha256").alias("hash"))
        # the paths meet in narrow tables; rows with all that a file says are not shuffled
        kept = self.parsed.limit(0) if full else self.parsed.join(sent(stage(known.join(now, ["path", "mtime"], "left_anti").select("path"))), "path", "left_anti")
        status = store.snapshot_diff(keys(self.parsed), keys(kept).unionByName(keys(fresh)))
        counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
        changed = {s: counts.get(s, 0) for s in ("added", "changed", "deleted", "same")}
        if changed["added"] or changed["changed"] or changed["deleted"]:
            altered = stage(status.where("status <> 'same'").select(F.col("key").alias("path")))
            self._publish(stage(kept.unionByName(fresh)), altered)
        return changed

    # Tables, each staged once

    @cached_property
    def files(self) -> DataFrame:
        return stage(source_files.files(self.parsed))

    @cached_property
    def symbols(self) -> DataFrame:
        return stage(source_files.symbols(self.parsed, self._once))

    @cached_property
    def occurrences(self) -> DataFrame:
        return stage(source_files.occurrences(self.parsed))

    @cached_property
    def imports(self) -> DataFrame:
        return stage(source_files.imports(self.parsed))

    @cached_property
    def links(self) -> DataFrame:
        """The edges, with a name in place of all its symbols."""
        self._edge_tables = [(self._stage_edges(parted(build.links(self.symbols, self.imports, self.files))), frozenset())]
        return self._joined_edges(self._edge_tables).drop("part")

    @cached_property
    def ends(self) -> DataFrame:
        return stage(build.ends(self.symbols, self.links))

    @property
    def edges(self) -> DataFrame:
        return build.edges(self.links, self.ends)

    def degrees(self, type: str | None = None) -> DataFrame:
        """id, in_degree, out_degree, degree of every node with an edge, or with one of a type."""
        return build.degrees(self.links if type is None else self.links.where(F.col("type") == type), self.ends)

    @property
    def calls(self) -> DataFrame:
        return self.edges.where("type = 'CALLS'").select("src", "dst", "weight")

    @cached_property
    def name_links(self) -> tuple[DataFrame, DataFrame]:
        calls, targets = build.name_links(self.symbols)
        return stage(calls), stage(targets)

    @property
    def name_calls(self) -> DataFrame:
        return build.name_edges(*self.name_links)

    @cached_property
    def name_index(self) -> names.NameIndex:
        return names.NameIndex(self.symbols, self.occurrences)

    def index_names(self) -> names.NameIndex:
        """Lay symbols and uses out by name and list names by what they contain. From now on questions about a name or a part of one read
        only what they need of that; it is made anew at the first such question after a change of the files.
        """
        self._indexed = True
        return self.name_index

    def _named(self, name: str) -> DataFrame:
        """The symbols of a name in any case."""
        return self.name_index.named(name) if self._indexed else self.symbols.where(F.lower("name") == name.lower())

    def _containing(self, query: str | None) -> DataFrame:
        """The symbols whose name contains a text in any case."""
        if not query:
            return self.symbols
        return self.name_index.containing(query) if self._indexed else self.symbols.where(F.lower("name").contains(query.lower()))

    def _uses(self, name: str) -> DataFrame:
        return self.name_index.uses(name) if self._indexed else self.occurrences.where(F.col("name") == name)

    def search_names(self, queries: DataFrame) -> DataFrame:
        """For many questions at once: query and id, path, line, kind, name of each symbol whose name contains it in any case."""
        found = self.index_names().names_with_each(queries)
        rows = self.name_index.symbols.select("low", "id", "path", "line", "kind", "name")
        return found.join(rows, "low").select("query", "id", "path", "line", "kind", "name")

    def sql(self, query: str, **args) -> DataFrame:
        """SQL over the tables by their names; :name stands for an argument."""
        for name in ("files", "symbols", "occurrences", "imports", "edges"):
            getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(query, args=args or None)

    def _functions(self, path: str | None = None, name: str | None = None) -> DataFrame:
        out = self.symbols.where(F.col("kind").isin("function", "method"))
        if path:
            out = out.where(F.col("path") == checked(path))
        return out if name is None else out.where(F.col("name") == name)

    def _first(self, path: str, name: str) -> DataFrame:
        """The first symbol of a name in a file, in order of the file."""
        return self.symbols.where((F.col("path") == checked(path)) & (F.col("name") == name)).orderBy("line", "ordinal").limit(1)

    # Structure

    def get_file_skeleton(self, file_path: str) -> DataFrame:
        own = self.symbols.where(F.col("path") == checked(file_path))
        return own.join(self.files.select("path", "has_errors"), "path").select("path", "kind", "parent", "name", "line", "params", "doc", "has_errors").orderBy("line")

    def get_skeletons(self, file_paths: list[str]) -> DataFrame:
        """Rows of several files in the order asked for; a file that isn't there has one row without a name."""
        asked = self.spark.createDataFrame([(i, checked(p)) for i, p in enumerate(file_paths)], "ordinal int, path string")
        own = self.symbols.select("path", "kind", "parent", "name", "line", "params", "doc")
        return own.join(F.broadcast(asked), "path", "right").orderBy("ordinal", "line")

    def get_symbol(self, file_path: str, symbol_name: str) -> DataFrame:
        return self._first(file_path, symbol_name).select("path", "name", "kind", "line", "end_line", "source")

    def get_symbols(self, requests: list[dict]) -> DataFrame:
        """The first symbol of each (file_path, symbol_name), in the order asked for, misses kept."""
        rows = [(i, checked(r["file_path"]), r["symbol_name"]) for i, r in enumerate(requests)]
        asked = self.spark.createDataFrame(rows, "request int, path string, name string")
        first = Window.partitionBy("request").orderBy("line", "ordinal")
        found = self.symbols.select("path", "name", "kind", "line", "ordinal", "source").join(F.broadcast(asked), ["path", "name"], "right")
        return found.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "ordinal").orderBy("request")

    def find_references(self, symbol_name: str) -> DataFrame:
        return self._uses(symbol_name).select("path", "line", "col").orderBy("path", "line", "col")

    def get_callers(self, symbol_name: str | None = None) -> DataFrame:
        """Every use of a name, or of all names that have a symbol, with the innermost symbol around it: name, path, line, col, symbol."""
        known = self.symbols.select("name").distinct()
        uses = self.occurrences.join(known, "name", "left_semi") if symbol_name is None else self._uses(symbol_name)
        return spans.innermost(uses.select("name", "path", "line", "col"), self.symbols.select("path", "line", "end_line", "ordinal", "id")).withColumnRenamed("id", "symbol")

    def get_call_graph(self, file_path: str, function_name: str) -> DataFrame:
        """role callee (name) or caller (path and line of every use of the name)."""
        callees = self._first(file_path, function_name).select(F.explode("calls").alias("name"))
        out = callees.select(F.lit("callee").alias("role"), "name", F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"))
        uses = self.find_references(function_name).select(F.lit("caller").alias("role"), F.lit(function_name).alias("name"), "path", "line").distinct()
        return out.unionByName(uses).orderBy("role", "name", "path", "line")

    def get_imports(self, file_path: str) -> DataFrame:
        return self.imports.where(F.col("path") == checked(file_path)).orderBy("line")

    def get_complexity(self, file_path: str, function_name: str) -> DataFrame:
        """total, and label and n of each kind of branch, sorted."""
        own = self._first(file_path, function_name).where("complexity is not null")
        return own.select("path", "name", F.col("complexity").alias("total"), F.array_sort(F.map_entries("breakdown")).alias("breakdown"))

    def get_variables(self, file_path: str, function_name: str) -> DataFrame:
        return self._first(file_path, function_name).select(F.inline("variables"))

    def get_ast(self, file_path: str, symbol_name: str | None = None, max_depth: int = -1, in_file: bool = False) -> str:
        """The syntax tree of a Python file or symbol as nested (type [line:column-line:column] ...), of others as nested tokens.

        A symbol is a tree of its own with positions in its own text, or, with `in_file`, its part of the file's tree. Python
        that doesn't parse is shown as nested tokens, too; the files' has_errors says so.
        """
        from .functions.lists import LANGUAGES
        from .parse.lexer import nested
        from .parse.python_source import tree

        symbols = self.get_symbol(file_path, symbol_name).collect() if symbol_name else []
        files = self.parsed.where(F.col("path") == checked(file_path)).select("source").collect() if in_file or not symbol_name else []
        if symbol_name and not symbols or not symbols and not files:
            return ""
        source = files[0]["source"] if files else symbols[0]["source"]
        language = LANGUAGES[file_path.rpartition(".")[2]]
        if language == "python":
            found = tree(source, max_depth, symbols[0]["line"] if symbols and in_file else None)
            if found is not None:
                return found
        return nested(symbols[0]["source"] if symbols else source, language, max_depth)

    def search_symbols(self, query: str | None = None, type: str | None = None, parent: str | None = None, has_doc: bool | None = None, min_complexity: int | None = None, language: str | None = None) -> DataFrame:
        out = self._containing(query)
        if type:
            out = out.where(F.col("kind") == type)
        if parent:
            out = out.where(F.lower("parent").contains(parent.lower()))
        if has_doc is not None:
            out = out.where((F.coalesce("doc", F.lit("")) != "") == F.lit(has_doc))
        if min_complexity is not None:
            out = out.where(F.col("complexity") >= min_complexity)
        if language:
            out = out.where(F.col("language") == language)
        return out.select("path", "line", "kind", "parent", "name", "params", "doc", "complexity").orderBy("path", "line")

    # Quality

    def find_dead_code(self, file_path: str | None = None) -> DataFrame:
        """Symbols whose name is used nowhere but on the line that defines them."""
        own = self.symbols if not file_path else self.symbols.where(F.col("path") == checked(file_path))
        own = own.where(~F.col("name").isin(*ALWAYS_USED) & ~F.col("name").rlike("^(test_|Test)") & ~F.col("path").endswith("__init__.py"))
        return text.dead(own.select("path", "line", "kind", "parent", "name"), self.occurrences.select("name", "path", "line")).orderBy("path", "line")

    def detect_clones(self, file_path: str | None = None, min_lines: int = 5) -> DataFrame:
        """Functions whose text is equal but for names, literals and comments: clone (its group), path, name, line, line_count.

        Groups are in order of their first function, by path and line.
        """
        own = self._functions().where((F.col("line_count") >= min_lines) & F.col("norm").isNotNull())
        has = F.bool_or(F.col("path") == checked(file_path)) if file_path else None
        groups = text.clone_groups(own.select(F.struct("path", "line").alias("id"), "norm", "path"), F.col("norm"), having=has)
        members = own.withColumn("clone", F.sha2("norm", 256)).join(groups.select(F.col("hash").alias("clone"), "first_id"), "clone")
        return members.orderBy("first_id", "path", "line").select("clone", "path", "name", "line", "line_count")

    def find_tests(self, file_path: str, symbol_name: str) -> DataFrame:
        """Tests of a symbol by score: 3 for a use in the body, 2 for the name in the test's, 1 for the file's name."""
        stem = PurePosixPath(checked(file_path)).stem
        spec = F.col("path").rlike(r"\.(spec|test)\.(js|ts)x?$")
        named = F.col("name").startswith("test_") | F.col("name").startswith("Test") | F.col("name").endswith("Test")
        candidates = self.symbols.join(self.files.where("is_test").select("path"), "path", "left_semi").where(named | spec | (F.col("kind") == "class"))
        uses = self._uses(symbol_name).select("path", "line")
        held = spans.holding(uses, candidates.select("path", "line", "end_line", "ordinal", "id")).select("path", "ordinal", F.lit(3).alias("used"))
        file_stem = build.stem(F.col("path"))
        by_file = file_stem.isin(f"test_{stem}", f"{stem}_test") | (F.regexp_replace(file_stem, r"\.(test|spec)$", "") == stem)
        marks = [(F.col("used").isNotNull(), 3, "references symbol"), (F.lower("name").contains(symbol_name.lower()), 2, "name match"), (by_file, 1, "file match")]
        score = sum((F.when(mark, points).otherwise(0) for mark, points, _ in marks), F.lit(0))
        reason = F.concat_ws(", ", *[F.when(mark, said) for mark, _, said in marks])
        scored = candidates.select("path", "name", "kind", "line", "ordinal").join(held, ["path", "ordinal"], "left").withColumns({"score": score, "reason": reason})
        best = Window.partitionBy("path", "name").orderBy(F.col("score").desc(), "line")
        ranked = scored.where("score > 0").withColumn("r", F.row_number().over(best)).where("r = 1")
        return ranked.select("path", "name", "line", "score", "reason").orderBy(F.col("score").desc(), "path", "line")

    def suggest_docs(self, file_path: str | None = None, symbol_name: str | None = None) -> DataFrame:
        """Functions without a description, with what they call, what calls them and their variables."""
        own = self._functions(file_path, symbol_name).where((F.coalesce("doc", F.lit("")) == "") & ~F.col("name").startswith("test_") & ~F.col("name").startswith("_"))
        callers = self.calls.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("callers"))
        out = own.select("id", "path", "name", "line", "params", F.col("calls").alias("callees"), F.transform("variables", lambda v: v["name"]).alias("variables"))
        return out.join(callers, "id", "left").withColumn("callers", F.coalesce("callers", F.array().cast("array<string>"))).drop("id").orderBy("path", "line")

    # Graph

    def get_blast_radius(self, file_path: str, symbol_name: str) -> DataFrame:
        """All that reaches a symbol or is reached from it by calls of names: role, path, name, depth, and the first line of the name in the file."""
        seed = self.spark.createDataFrame([(f"{checked(file_path)}::{symbol_name}",)], "id string")
        calls, targets = self.name_links
        down = (calls.toDF("src", "dst"), targets.toDF("src", "dst"))
        up = tuple(graph.reverse(hop) for hop in reversed(down))
        named = lambda df, role: df.where("depth > 0").select(F.lit(role).alias("role"), F.split_part("id", F.lit("::"), F.lit(1)).alias("path"), F.split_part("id", F.lit("::"), F.lit(2)).alias("name"), "depth")
        reached = named(graph.bfs(up, seed), "caller").unionByName(named(graph.bfs(down, seed), "dependency"))
        lines = self.symbols.groupBy("path", "name").agg(F.min("line").alias("line"))
        return reached.join(lines, ["path", "name"], "left").select("role", "path", "name", "depth", "line").orderBy("role", "depth", "path", "name")

    def _changed(self, symbol_query: str | None, diff_scope: str | None) -> DataFrame:
        """The symbols that a change is about: those of the files that git names, or those of a name that are no tests."""
        plain = build.latest_symbols(self.symbols)
        if diff_scope:
            paths = gitlog.changed_paths(self.root, diff_scope)
            return plain.where(F.col("path").isin(*paths) if paths else F.lit(False))
        return plain.where((F.col("name") == symbol_query) & ~F.col("is_test"))

    def change_impact_report(self, symbol_query: str | None = None, diff_scope: str | None = None, depth: int = 3) -> dict:
        """changed_symbols, impact by risk, affected_tests, each symbol with qualified_name, name, file, line and hop."""
        changed = self._changed(symbol_query, diff_scope).select("id", "name", "path").orderBy("id").collect()
        known = build.latest_symbols(self.symbols).select("id", "name", "line")
        rows = self.get_change_impact(symbol_query, diff_scope, depth).join(known, "id").orderBy("hop", "id").collect()
        entry = lambda r: {"qualified_name": r["id"], "name": r["name"], "file": r["path"], "line": r["line"], "hop": r["hop"]}
        impact: dict[str, list] = {}
        for r in rows:
            if not r["is_test"]:
                impact.setdefault(r["risk"], []).append(entry(r))
        return {
            "changed_symbols": [{"qualified_name": r["id"], "name": r["name"], "file": r["path"]} for r in changed],
            "impact": impact,
            "affected_tests": [entry(r) for r in rows if r["is_test"]],
        }

    def get_change_impact(self, symbol_query: str | None = None, diff_scope: str | None = None, depth: int = 3, min_weight: float | None = None) -> DataFrame:
        """What calls the changed symbols, within `depth` calls: id, hop, risk, is_test. Tests of them have hop 0 at least."""
        seeds = self._changed(symbol_query, diff_scope).select("id", "name")
        plain = build.latest_symbols(self.symbols)
        calls = self.links.where("type = 'CALLS'")
        if min_weight is not None:
            calls = calls.where(F.col("weight") >= min_weight)
        by_name, exact = F.concat(F.lit("?::"), "name"), calls.where("dst is not null")
        of_names = self.ends.where("type = 'CALLS'").select(by_name.alias("src"), "dst")
        hops = calls.select("src", F.coalesce("dst", by_name).alias("dst")), of_names.unionByName(exact.select(F.col("dst").alias("src"), "dst").distinct())
        reached = graph.change_impact(hops, seeds.select("id"), depth)
        tests = self.links.where("type = 'TESTS'").drop("dst")
        tested = self.ends.where("type = 'TESTS'").join(seeds.select(F.col("id").alias("dst")), "dst", "left_semi").join(tests, "name").select(F.col("src").alias("id"), F.lit(0).alias("hop"), F.lit(None).cast("string").alias("risk"))
        rows = reached.unionByName(tested.join(reached, "id", "left_anti")).join(plain.select("id", "path", "is_test"), "id", "left").distinct()
        return rows.orderBy("hop", "id")

    def get_repository_map(self, max_items: int = 5) -> dict:
        """languages, major_paths, entry_points, hotspots, start_here, test_roots and counts, all short lists."""
        plain = build.latest_symbols(self.symbols).where(~F.col("is_test"))
        top = F.split_part("path", F.lit("/"), F.lit(1))
        folders = self.files.where(F.col("path").contains("/")).groupBy(F.concat(top, F.lit("/")).alias("folder")).count().orderBy(F.col("count").desc(), "folder").limit(max_items)
        entries = [r["id"] for r in plain.where("is_entry_point").select("id").orderBy("id").limit(max_items).collect()]
        hot = plain.join(self.degrees(), "id").orderBy(F.col("degree").desc(), "id").limit(max_items).select("id", "degree").collect()
        tests = self.files.where("is_test").select(F.when(F.col("path").contains("/"), F.concat(top, F.lit("/"))).otherwise("./").alias("root")).distinct().orderBy("root").limit(max_items)
        languages = self.files.groupBy("language").count().orderBy(F.col("count").desc(), "language")
        return {
            "languages": {r["language"]: r["count"] for r in languages.collect()},
            "major_paths": [r["folder"] for r in folders.collect()],
            "entry_points": entries,
            "hotspots": [{"symbol": r["id"], "degree": r["degree"]} for r in hot],
            "start_here": list(dict.fromkeys([*entries, *(r["id"] for r in hot)]))[:max_items],
            "test_roots": [r["root"] for r in tests.collect()],
            "stats": self.index_status(),
        }

    def last_indexed_at(self) -> str | None:
        """When the tables were last written, in UTC."""
        return self.get_meta("last_indexed_at")

    def index_status(self) -> dict:
        return {"files": self.files.count(), "symbols": self.symbols.select("id").distinct().count(), "edges": self.degrees().agg(F.sum("in_degree")).first()[0] or 0, "graph_exists": True}

    def resolve_symbol(self, query: str, kind: str | None = None, path_hint: str | None = None, limit: int = 10) -> DataFrame:
        rows = build.latest_symbols(self._named(query))
        if kind:
            rows = rows.where(F.col("kind") == kind)
        rows = rows.join(self.degrees().select("id", "in_degree"), "id", "left").fillna(0, ["in_degree"])
        hint = F.col("path").contains(path_hint) if path_hint else F.lit(False)
        found = graph.resolve_ranked(rows, query, hints=[hint, ~F.col("is_test"), F.col("is_entry_point"), F.col("in_degree")], limit=limit)
        return found.select("rank", "id", "kind", "path", "line", "is_test", "in_degree").orderBy("rank")

    def search_graph(self, query: str | None = None, kind: str | None = None, file_pattern: str | None = None, relationship: str | None = None, direction: str = "outbound", min_degree: int | None = None, max_degree: int | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
        rows = build.latest_symbols(self._containing(query)).select("id", "name", "kind", "path", "line")
        if kind:
            rows = rows.where(F.col("kind") == kind)
        if file_pattern:
            rows = rows.where(F.lower("path").contains(file_pattern.lower()))
        if relationship:
            end = "in_degree" if direction == "inbound" else "out_degree"
            rows = rows.join(self.degrees(relationship).where(F.col(end) > 0), "id", "left_semi")
        return graph.search_page(rows, self.edges, min_degree=min_degree, max_degree=max_degree, limit=limit, offset=offset, counted=self.degrees())

    def search_graph_report(self, limit: int = 10, offset: int = 0, **filters) -> dict:
        """total, limit, offset, has_more and the results of one page of search_graph()."""
        page = self.search_graph(limit=limit, offset=offset, **filters).collect()
        any_of_them = page or self.search_graph(limit=1, **filters).collect()  # a page beyond the last has no row to say it
        total = any_of_them[0]["total"] if any_of_them else 0
        results = [{"qualified_name": r["id"], "name": r["name"], "kind": r["kind"], "file_path": r["path"], "start_line": r["line"], "in_degree": r["in_degree"], "out_degree": r["out_degree"]} for r in page]
        return {"total": total, "limit": limit, "offset": offset, "has_more": offset + limit < total, "results": results}

    def resolve_report(self, query: str, **options) -> dict:
        """query, and its matches as resolve_symbol() ranks them."""
        rows = self.resolve_symbol(query, **options).collect()
        return {"query": query, "matches": [{"qualified_name": r["id"], "name": r["id"].rpartition("::")[2].rpartition(".")[2], "kind": r["kind"], "file": r["path"], "line": r["line"], "is_test": r["is_test"]} for r in rows]}

    def find_hot_paths(self, top_n: int = 10) -> DataFrame:
        functions = build.latest_symbols(self.symbols).where(F.col("kind").isin("function", "method") & ~F.col("is_test"))
        callers = self.degrees("CALLS").where("in_degree > 0").select("id", F.col("in_degree").alias("callers"))
        hot = graph.hottest(functions.select("id", "complexity"), callers, top_n)
        return hot.join(functions.select("id", "path", "name", "line"), "id").orderBy(F.col("score").desc(), "id")

    def get_dependency_graph(self, file_path: str | None = None) -> DataFrame:
        ends = self.links.where("type = 'IMPORTS'").select(*[F.split_part(c, F.lit("::"), F.lit(1)).alias(c) for c in ("src", "dst")])
        if file_path:
            ends = ends.where((F.col("src") == checked(file_path)) | (F.col("dst") == file_path))
        return graph.dependency_graph(ends).orderBy("src", "dst")

    def rank_symbols(self, top_n: int = 20, file_path: str | None = None) -> DataFrame:
        """PageRank over calls of names: path, name, score."""
        ranked = graph.pagerank_by_name(*self.name_links)
        out = ranked.select(F.split_part("id", F.lit("::"), F.lit(1)).alias("path"), F.split_part("id", F.lit("::"), F.lit(2)).alias("name"), F.round("score", 6).alias("score"))
        if file_path:
            out = out.where(F.col("path") == checked(file_path))
        return out.orderBy(F.col("score").desc(), "path", "name").limit(top_n)

    # Flow

    def analyze_dataflow(self, file_path: str, function_name: str, mode: str = "flow", depth: int = 3, match: str = "call") -> dict:
        """A report on one function: mode flow, taint, or cross_taint."""
        if mode not in ("flow", "taint", "cross_taint"):
            return {"error": f"unknown mode: {mode}"}
        first = stage(self._first(file_path, function_name).where(F.col("kind").isin("function", "method")))
        if first.isEmpty():
            return {"paths": []} if mode == "taint" else {"error": f"no function {function_name} in {file_path}"}
        judged = ("verdict", "chain", "sanitizer", "risk")
        if mode == "cross_taint":
            whole, start = self.flow(match), dataflow.functions(first).select("fn", "name")
            facts = stage(whole.tainted_parameters(depth, start))
            rows = whole.cross_taint_paths(facts, start).orderBy("hop", "path", "line", "site", "pos").select(*judged, "functions").collect()
            return {"paths": [r.asDict() for r in rows], "depth_reached": facts.select("fn").union(start.select("fn")).distinct().count()}
        own = dataflow.Flow(first, match)
        if mode == "taint":
            return {"paths": [r.asDict() for r in own.taint_paths().orderBy("site", "pos").select(*judged).collect()]}
        variables = own.variables().orderBy("seq").select(F.col("variable").alias("name"), F.col("at_line").alias("line"), "depends_on", F.col("expr").alias("source_expr"))
        sites = own.sites.orderBy("site")
        sources = sites.where("source is not null").select("expr", "line", F.lit("external_input").alias("kind"))
        sinks = sites.where("sink is not null").select("expr", "line", dataflow.sink_kind(F.col("expr")).alias("kind"))
        listed = lambda df: [r.asDict() for r in df.collect()]
        return {"variables": listed(variables), "flow_chains": [r["chain"] for r in own.chains().orderBy("variable").collect()], "sources": listed(sources), "sinks": listed(sinks)}

    def flow(self, match: str = "call") -> dataflow.Flow:
        """The dataflow tables of every function of the repository."""
        if match not in self._flows:
            # functions are staged by themselves, without what else symbols have
            self._flows[match] = dataflow.Flow(self.__dict__.get("symbols") or source_files.symbols(self.parsed), match)
        return self._flows[match]

    def taint_paths(self, match: str = "call") -> DataFrame:
        """Taint paths of every function of the repository."""
        return self.flow(match).taint_paths().drop("line", "site", "pos")

    def cross_taint_paths(self, depth: int | None = 3, match: str = "call") -> DataFrame:
        """Taint paths of every function, also from what its callers hand it, `depth` calls off; None for however many."""
        whole = self.flow(match)
        return whole.cross_taint_paths(whole.tainted_parameters(depth)).drop("site", "pos")

    # History

    def git_history(self, mode: str, file_path: str | None = None, top_n: int = 20, since: str | None = None, min_commits: int = 3) -> DataFrame:
        if mode == "blame":
            if not file_path:
                raise ValueError("blame is of one file")
            return history.blame_summary(gitlog.blame(self.spark, self.root, checked(file_path)))
        if mode == "churn":
            return history.churn(gitlog.commits(self.spark, self.root, since=since), self.files, top_n=top_n)
        if mode == "coupling":
            return history.coupling(gitlog.commits(self.spark, self.root, since=since), path=checked(file_path) or None, min_commits=min_commits, top_n=top_n)
        raise ValueError(f"unknown mode: {mode}")

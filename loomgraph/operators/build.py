"""Edges of a repository's graph from its symbols, calls and imports, of all files or of those that a change concerns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import sent
from . import graph

#: What an import statement's words are made of, besides names.
WORDS_APART = r"[\s\"'<>;{}()]+"
IMPORT_WORDS = ("import", "from", "use", "require", "require_relative", "using", "include", "as", "namespace", "package", "static", "pub", "crate", "self", "super")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def import_tokens(imports: DataFrame) -> DataFrame:
    """(path, token): the words of a file's imports, and the components and stems of those that are paths."""
    words = imports.select("path", F.explode(F.split("text", WORDS_APART)).alias("word"))
    words = words.where((F.col("word") != "") & ~F.col("word").isin(*IMPORT_WORDS) & ~F.col("word").startswith("#") & ~F.col("word").startswith("//"))
    parts = F.concat(F.array("word", F.regexp_replace(F.element_at(F.split("word", "/"), -1), r"\.[A-Za-z]+$", "")), F.split("word", r"[./:,]+"))
    return words.select("path", F.explode(parts).alias("token")).where("token <> ''").distinct()


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst) of files whose stem or path another file's imports name."""
    targets = files.select(F.col("path").alias("dst"), stem(F.col("path")).alias("token"))
    return import_tokens(imports).join(targets, "token").where(F.col("path") != F.col("dst")).select(F.col("path").alias("src"), "dst").distinct()


def latest_symbols(symbols: DataFrame) -> DataFrame:
    """One row per qualified name, the lowest in the file: which these are is said where a file's symbols are listed, so nothing is shuffled."""
    return symbols.where("is_last")


def calls_of(symbols: DataFrame) -> DataFrame:
    """(caller, path, name) of functions and methods, once for each caller."""
    return symbols.where(F.col("kind").isin("function", "method")).select(F.col("id").alias("caller"), "path", F.explode(F.array_distinct("calls")).alias("name"))


def name_links(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of names in two tables that together are as long as the symbols and their calls: (src, name) of a file's callers, and
    (name, dst) of every symbol of a name, without parents. A dst has one name.
    """
    key = lambda path, name: F.concat(path, F.lit("::"), name)
    calls = symbols.where(F.col("kind").isin("function", "method")).select(key(F.col("path"), F.col("name")).alias("src"), F.explode("calls").alias("name"))
    return calls.distinct(), symbols.select("name", key(F.col("path"), F.col("name")).alias("dst")).distinct()


def name_edges(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """(src, dst) of name_links(), each pair once: as many as a name's callers times its symbols, so it's neither staged nor shuffled."""
    return calls.join(targets, "name", "left").select("src", F.coalesce("dst", F.concat(F.lit("?::"), "name")).alias("dst"))


def tested_names(symbols: DataFrame) -> DataFrame:
    """(src, name): test_x and Testx of test files, and x."""
    tested = F.when(F.col("name").startswith("test_"), F.expr("substring(name, 6)")).when(F.col("name").startswith("Test"), F.expr("substring(name, 5)"))
    return symbols.where("is_test").select(F.col("id").alias("src"), "path", tested.alias("name")).where("name is not null and name <> ''")


def links(symbols: DataFrame, imports: DataFrame, files: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """All edges before they meet the symbols of a name: src, dst, name, type (CALLS, CONTAINS, IMPORTS, TESTS), weight; one row each. With
    `only` (path), those that begin in such a file.

    A call of a target in the caller's file or in one it imports has that dst and weight 1. Other calls have weight 0.5 and a name in
    place of dst, and so have tests: they stand for an edge to each of the name's ends(), as many as callers times symbols.

    Symbols may repeat an id; the lowest in the file counts. A file's edges need its own symbols and imports, and of all others only
    the symbols of the names it uses, so with `only` all else is filtered away before anything is shuffled.
    """
    typed = lambda df, kind, weight=1.0: df.select("src", "dst", "name", F.lit(kind).alias("type"), F.lit(weight).alias("weight"))
    exact = lambda df, kind: typed(df.withColumn("name", F.lit(None).cast("string")), kind)
    if only is None:
        known = own = latest_symbols(symbols)
    else:
        only = sent(only)
        own = latest_symbols(symbols.join(only, "path", "left_semi"))
        names = calls_of(own).select("name").distinct()
        known = latest_symbols(symbols.join(names, "name", "left_semi"))
        imports = imports.join(only, "path", "left_semi")
    contains = graph.contains_edges([own.where("parent is not null").select(F.col("parent_id").alias("parent"), F.col("id").alias("child"))]).toDF("src", "dst")
    linked = import_edges(imports, files)
    of_files = linked.select(F.concat("src", F.lit("::__file__")).alias("src"), F.concat("dst", F.lit("::__file__")).alias("dst"))
    called = graph.resolve_links(calls_of(own), known.select("name", "id", "path"), "path", linked.toDF("path", "other"))
    loose = F.col("id").isNull()
    out = called.select(F.col("caller").alias("src"), F.col("id").alias("dst"), F.when(loose, F.col("name")).alias("name"), F.lit("CALLS").alias("type"), F.when(loose, 0.5).otherwise(1.0).alias("weight"))
    out = out.unionByName(exact(contains, "CONTAINS")).unionByName(exact(of_files, "IMPORTS"))
    return out.unionByName(typed(tested_names(own).select("src", F.lit(None).cast("string").alias("dst"), "name"), "TESTS"))


def ends(symbols: DataFrame, links: DataFrame) -> DataFrame:
    """(type, name, dst): what a name stands for. A call's are all symbols of the name, or `?::name` where there are none; those of test_x and
    Testx are the symbols named x that are no tests.
    """
    known = latest_symbols(symbols).select("name", F.col("id").alias("dst"), "is_test")
    called = links.where("type = 'CALLS' and dst is null").select("name").distinct().join(known, "name", "left_anti")
    typed = lambda df, kind: df.select(F.lit(kind).alias("type"), "name", "dst")
    return typed(known, "CALLS").unionByName(typed(called.withColumn("dst", F.concat(F.lit("?::"), "name")), "CALLS")).unionByName(typed(known.where(~F.col("is_test")), "TESTS"))


def edges(links: DataFrame, ends: DataFrame) -> DataFrame:
    """(src, dst, type, weight) of links() and ends(), one row each; they leave the join as they are, neither staged nor shuffled."""
    named = links.where("dst is null").drop("dst").join(ends, ["type", "name"])
    columns = ("src", "dst", "type", "weight")
    return links.where("dst is not null").select(*columns).unionByName(named.select(*columns))


def degrees(links: DataFrame, ends: DataFrame) -> DataFrame:
    """graph.degrees() of the edges, by counting the links and the ends of each name, without a row an edge."""
    named, by = links.where("dst is null"), ["type", "name"]
    callers = ends.join(named.groupBy(*by).agg(F.count(F.lit(1)).alias("i")), by).select(F.col("dst").alias("id"), "i", F.lit(0).cast("long").alias("o"))
    callees = named.join(ends.groupBy(*by).agg(F.count(F.lit(1)).alias("o")), by).select(F.col("src").alias("id"), F.lit(0).cast("long").alias("i"), "o")
    exact = graph.degrees(links.where("dst is not null")).select("id", F.col("in_degree").alias("i"), F.col("out_degree").alias("o"))
    sums = exact.unionByName(callers).unionByName(callees).groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return sums.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def concerned(was: DataFrame, now: DataFrame, touched: DataFrame, imports: DataFrame, files_changed: DataFrame) -> DataFrame:
    """(path): the files whose edges a change may alter. `was` and `now` are the symbols before and after, `touched` (path) the files
    that were added, changed or deleted, `imports` those of now, `files_changed` (path) the files that were added or deleted.

    These are the touched files; those that call, or test, a name whose set of symbols has changed; and those whose imports name
    a file that has come or gone. Large tables are only filtered by small ones.
    """
    touched, columns = sent(touched), ("name", "id", "path", "is_test")
    before, after = (latest_symbols(s.join(touched, "path", "left_semi")).select(*columns) for s in (was, now))
    names = before.exceptAll(after).unionByName(after.exceptAll(before)).select("name").distinct()
    callers = calls_of(now).join(names, "name", "left_semi").select("path")
    tests = tested_names(now).join(names, "name", "left_semi").select("path")
    tokens = files_changed.select(stem(F.col("path")).alias("token")).distinct()
    importers = import_tokens(imports).join(tokens, "token", "left_semi").select("path")
    return touched.select("path").unionByName(callers).unionByName(tests).unionByName(importers).distinct()

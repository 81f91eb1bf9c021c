"""What the engine says of a repository that is made from the parts, beside SQL over the parts themselves.

Sixteen parts in a row are a module, each part a function whose body follows from its key and size: branches, loops, calls of the
part five further on, calls of names that are defined nowhere, values from outside with and without a sanitizer. Even modules have a
file of tests. The engine parses the texts and answers; the SQL never sees a text, but for one query that hashes whole files.
"""

from __future__ import annotations

from functools import partial, reduce
from inspect import signature

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..sources.tables import state, table
from .registry import Registry

#: Parts in a module, and how far on the part is that a part calls.
MODULE, STRIDE = 16, 5


def sources(spark: SparkSession, d: str) -> DataFrame:
    """(path, source) of the modules and of the files of tests."""
    k, size = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.lit("f_"), F.regexp_replace(F.lower("p_name"), "[^a-z]", ""), F.lit("_"), size.cast("string"))
    parts = table(spark, d, "part").select(k.alias("k"), F.floor(k / MODULE).alias("m"), name.alias("f"), size.alias("s"))
    called = parts.select((F.col("k") - STRIDE).alias("k"), F.col("f").alias("callee"), F.col("m").alias("cm"))
    parts = parts.join(called, "k", "left")
    k, s = F.col("k"), F.col("s")
    line = lambda *pieces: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces], F.lit("\n"))
    only = lambda where, *lines: F.when(where, F.concat(*lines)).otherwise(F.lit(""))
    outside, safe = s % 5 == 0, s % 10 == 5
    body = F.concat(
        line("def ", F.col("f"), "(a, b):"),
        only(k % 2 == 0, line('    """Part ', k, '."""')),
        line("    x = a + ", s),
        F.repeat(F.lit("    if x > b:\n        x = x - 1\n"), (s % 3).cast("int")),
        only(k % 3 == 0, F.lit("    for i in b:\n        x = x + i\n")),
        only(F.col("callee").isNotNull(), line("    ", F.col("callee"), "(x, b)")),
        line("    ext_", s % 5, "(x)"),
        only(outside, F.lit("    raw = input()\n")),
        only(safe, F.lit("    safe = sanitize(raw)\n")),
        only(outside, line("    db.execute(", F.when(safe, "safe").otherwise("raw"), ")")),
        F.lit("    return x\n"),
    )
    imported = F.when((k % 2 == 0) & (F.col("cm") != F.col("m")), line("from pkg.m_", F.col("cm"), " import ", F.col("callee")))
    together = lambda c: F.array_join(F.array_sort(c), "")
    # at most MODULE of each
    modules = parts.groupBy("m").agg(F.collect_set(imported).alias("imports"), F.array_sort(F.collect_list(F.struct("k", body.alias("body")))).alias("bodies"))
    functions = F.array_join(F.transform("bodies", lambda b: F.concat(b["body"], F.lit("\n"))), "")
    klass = F.concat(line("class M_", F.col("m"), ":"), F.lit("    def size(self):\n"), line("        return ", F.size("bodies")))
    code = modules.select(F.concat(F.lit("pkg/m_"), F.col("m").cast("string"), F.lit(".py")).alias("path"), F.concat(together("imports"), functions, klass).alias("source"))
    tested = parts.where("m % 2 = 0 and s % 3 = 0").groupBy("m").agg(
        F.collect_set(line("from pkg.m_", F.col("m"), " import ", F.col("f"))).alias("imports"),
        F.collect_set(F.concat(line("def test_", F.col("f"), "():"), line("    assert ", F.col("f"), "(1, [2])"), F.lit("\n"))).alias("bodies"),
    )
    tests = tested.select(F.concat(F.lit("tests/test_m_"), F.col("m").cast("string"), F.lit(".py")).alias("path"), F.concat(together("imports"), together("bodies")).alias("source"))
    return code.unionByName(tests)


def flow_sources(spark: SparkSession, d: str) -> DataFrame:
    """(path, source): a file a part with one function, which hands a value from outside or its own parameter to the part three further on."""
    k, s = F.col("p_partkey"), F.col("p_size")
    line = lambda *pieces: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces], F.lit("\n"))
    only = lambda where, text: F.when(where, text).otherwise(F.lit(""))
    outside = s % 5 == 0
    source = F.concat(
        line("def w_", k, "(a, b):"),
        line("    t = ", F.when(k % 7 == 0, "sanitize(a)").otherwise("a")),
        line("    u = t + ", s),
        only(outside, line("    raw = input()")),
        only(k % 4 != 0, line("    w_", k + 3, "(", F.when(outside, "raw").otherwise("u"), ", b)")),
        only(s % 3 == 0, line("    db.execute(u)")),
        only(s % 10 == 0, line("    os.system(raw)")),
    )
    return table(spark, d, "part").select(F.concat(F.lit("flow/w_"), k.cast("string"), F.lit(".py")).alias("path"), source.alias("source"))


#: The engine of each application, folder and kind of sources, with the state of the table that it was made from.
_ENGINES: dict[tuple[str, str, str], tuple[tuple, Engine]] = {}


def engine(spark: SparkSession, d: str, made=sources) -> Engine:
    """Texts are parsed once for all queries, and again once the files of the table have changed."""
    key, now = (spark.sparkContext.applicationId, d, made.__name__), state(table(spark, d, "part"))
    was, known = _ENGINES.get(key, (None, None))
    if was != now:
        texts = made(spark, d)
        known = Engine.over(texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path"))
        _ENGINES[key] = now, known
    return known


def _asked(f, spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d, flow_sources if f.__name__.startswith("code_cross") else sources)
    return f(e, table(spark, d, "part")) if "part" in signature(f).parameters else f(e)


_REGISTRY = Registry(lambda f: partial(_asked, f))
query, QUERIES, ORACLES = _REGISTRY.query, _REGISTRY.queries, _REGISTRY.oracles


#: fn has a row a part, with its first line and number of lines; occ every place of a name that is defined; tests by place in their file.
_FN = """p AS (SELECT p_partkey AS k, p_partkey // 16 AS m, 'f_' || regexp_replace(lower(p_name), '[^a-z]', '', 'g') || '_' || p_size AS f, p_size AS s FROM part
), c AS (SELECT p.*, 'pkg/m_' || p.m || '.py' AS path, q.f AS callee, q.m AS cm, p.s % 3 AS r, (p.k % 3 = 0)::INTEGER AS l, (p.k % 2 = 0)::INTEGER AS d,
           (q.f IS NOT NULL)::INTEGER AS calls, p.s % 5 = 0 AS outside, p.s % 10 = 5 AS safe
         FROM p LEFT JOIN p q ON q.k = p.k + 5
), imp AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY text) AS line
           FROM (SELECT DISTINCT m, path, cm, callee, 'from pkg.m_' || cm || ' import ' || callee AS text FROM c WHERE k % 2 = 0 AND cm <> m)
), sized AS (SELECT c.*, coalesce(h, 0) AS h, 4 + d + 2 * r + 2 * l + calls + CASE WHEN safe THEN 3 WHEN outside THEN 2 ELSE 0 END AS n
             FROM c LEFT JOIN (SELECT m, count(*) AS h FROM imp GROUP BY m) USING (m)
), fn AS (SELECT *, path || '::' || f AS id, (h + 1 + coalesce(sum(n + 1) OVER (PARTITION BY m ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS line FROM sized
), klass AS (SELECT m, path, max(line + n + 1)::INTEGER AS line, count(*) AS parts FROM fn GROUP BY m, path
), t AS (SELECT m, f, 'tests/test_m_' || m || '.py' AS path, row_number() OVER (PARTITION BY m ORDER BY f) AS i, (count(*) OVER (PARTITION BY m) + 3 * row_number() OVER (PARTITION BY m ORDER BY f) - 2)::INTEGER AS line
         FROM (SELECT DISTINCT m, f FROM p WHERE m % 2 = 0 AND s % 3 = 0)
)"""
_SYMBOLS = """symbols AS (
  SELECT id, path, f AS name, 'function' AS kind, NULL AS parent, line, line + n - 1 AS end_line, '(a, b)' AS params, CASE d WHEN 1 THEN 'Part ' || k || '.' ELSE '' END AS doc, FALSE AS is_test, 1 + r + l AS complexity FROM fn
  UNION ALL SELECT path || '::M_' || m, path, 'M_' || m, 'class', NULL, line, line + 2, '', '', FALSE, NULL FROM klass
  UNION ALL SELECT path || '::M_' || m || '.size', path, 'size', 'method', 'M_' || m, line + 1, line + 2, '(self)', '', FALSE, 1 FROM klass
  UNION ALL SELECT path || '::test_' || f, path, 'test_' || f, 'function', NULL, line, line + 1, '()', '', TRUE, 1 FROM t
)"""
_OCC = """occ AS (
  SELECT f AS name, path, line FROM fn UNION SELECT callee, path, line + 2 + d + 2 * r + 2 * l FROM fn WHERE calls = 1
  UNION SELECT callee, path, line FROM imp UNION SELECT f, path, i FROM t UNION SELECT f, path, line + 1 FROM t
  UNION SELECT 'test_' || f, path, line FROM t UNION SELECT 'M_' || m, path, line FROM klass UNION SELECT 'size', path, line + 1 FROM klass
)"""
#: last has the last symbol of each id, whose calls alone count.
_EDGES = """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line DESC) AS again FROM symbols) WHERE again = 1
), body AS (SELECT fn.* FROM fn JOIN last USING (id, line)
), calls AS (
  SELECT id AS caller, path, callee AS name FROM body WHERE calls = 1 UNION SELECT id, path, 'ext_' || (s % 5) FROM body
  UNION SELECT id, path, unnest(['input', 'execute']) FROM body WHERE outside UNION SELECT id, path, 'sanitize' FROM body WHERE safe
  UNION SELECT path || '::test_' || f, path, f FROM t
), files_linked AS (SELECT DISTINCT path, 'pkg/m_' || cm || '.py' AS other FROM imp UNION SELECT DISTINCT path, 'pkg/m_' || m || '.py' FROM t
), pairs AS (
  SELECT caller, calls.name, last.id, CASE WHEN last.id IS NOT NULL AND (last.path = calls.path OR other IS NOT NULL) THEN 1.0 ELSE 0.5 END::DOUBLE AS weight
  FROM calls LEFT JOIN last ON last.name = calls.name LEFT JOIN files_linked ON files_linked.path = calls.path AND other = last.path
), best AS (SELECT *, max(weight) OVER (PARTITION BY caller, name) AS best FROM pairs
), called AS (SELECT caller AS src, coalesce(id, '?::' || name) AS dst, max(weight) AS weight FROM best WHERE weight = best GROUP BY ALL
), edges AS (
  SELECT src, dst, 'CALLS' AS type, weight FROM called
  UNION ALL SELECT path || '::M_' || m, path || '::M_' || m || '.size', 'CONTAINS', 1.0 FROM klass
  UNION ALL SELECT path || '::__file__', other || '::__file__', 'IMPORTS', 1.0 FROM files_linked
  UNION ALL SELECT DISTINCT t.path || '::test_' || f, last.id, 'TESTS', 1.0 FROM t JOIN last ON last.name = t.f AND NOT last.is_test
), deg AS (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY id
)"""
_ALL = f"{_FN}, {_SYMBOLS}, {_EDGES}"


#: all_files has a row a file, with its text.
_TEXTS = """texts AS (
      SELECT m, path, string_agg('def ' || f || '(a, b):' || chr(10) || CASE d WHEN 1 THEN '    \"\"\"Part ' || k || '.\"\"\"' || chr(10) ELSE '' END || '    x = a + ' || s || chr(10)
        || repeat('    if x > b:' || chr(10) || '        x = x - 1' || chr(10), r) || repeat('    for i in b:' || chr(10) || '        x = x + i' || chr(10), l) || CASE calls WHEN 1 THEN '    ' || callee || '(x, b)' || chr(10) ELSE '' END
        || '    ext_' || (s % 5) || '(x)' || chr(10) || CASE WHEN safe THEN '    raw = input()' || chr(10) || '    safe = sanitize(raw)' || chr(10) || '    db.execute(safe)' || chr(10)
           WHEN outside THEN '    raw = input()' || chr(10) || '    db.execute(raw)' || chr(10) ELSE '' END || '    return x' || chr(10) || chr(10), '' ORDER BY k) AS functions FROM fn GROUP BY ALL
    ), heads AS (SELECT m, string_agg(text || chr(10), '' ORDER BY text) AS head FROM imp GROUP BY m
    ), all_files AS (
      SELECT path, coalesce(head, '') || functions || 'class M_' || m || ':' || chr(10) || '    def size(self):' || chr(10) || '        return ' || parts || chr(10) AS source, line + 2 AS n_lines, parts + 2 AS n_symbols, FALSE AS is_test
      FROM texts JOIN klass USING (m, path) LEFT JOIN heads USING (m)
      UNION ALL SELECT path, string_agg('from pkg.m_' || m || ' import ' || f || chr(10), '' ORDER BY f) || string_agg('def test_' || f || '():' || chr(10) || '    assert ' || f || '(1, [2])' || chr(10) || chr(10), '' ORDER BY f), 4 * count(*), count(*), TRUE FROM t GROUP BY path
    )"""


@query(f"WITH {_FN}, {_TEXTS} SELECT path, 'py' AS language, sha256(source) AS sha256, is_test, FALSE AS has_errors, n_lines::INTEGER AS n_lines, n_symbols::INTEGER AS n_symbols FROM all_files")
def code_files(e: Engine) -> DataFrame:
    return e.files.drop("mtime")


@query(f"WITH {_FN}, {_SYMBOLS} SELECT id, path, name, kind, parent, line::INTEGER AS line, end_line::INTEGER AS end_line, params, doc, is_test, complexity::INTEGER AS complexity FROM symbols")
def code_symbols(e: Engine) -> DataFrame:
    return e.symbols.select("id", "path", "name", "kind", "parent", "line", "end_line", "params", "doc", "is_test", "complexity")


@query(f"WITH {_FN} SELECT path, f AS name, line, r::INTEGER AS branches, l AS loops FROM fn UNION ALL SELECT path, 'size', line + 1, 0, 0 FROM klass UNION ALL SELECT path, 'test_' || f, line, 0, 0 FROM t")
def code_complexity(e: Engine) -> DataFrame:
    times = lambda label: F.coalesce(F.try_element_at("breakdown", F.lit(label)), F.lit(0))
    return e.symbols.where("complexity is not null").select("path", "name", "line", times("if").alias("branches"), times("for").alias("loops"))


@query(f"WITH {_FN} SELECT path, line::INTEGER AS line, text FROM imp UNION ALL SELECT path, i::INTEGER, 'from pkg.m_' || m || ' import ' || f FROM t")
def code_imports(e: Engine) -> DataFrame:
    return e.imports


@query(f"WITH {_ALL} SELECT * FROM edges")
def code_edges(e: Engine) -> DataFrame:
    return e.edges


@query(f"WITH {_ALL} SELECT (SELECT count(*) FROM klass) + (SELECT count(DISTINCT path) FROM t) AS files, (SELECT count(*) FROM last) AS symbols, (SELECT count(*) FROM edges) AS edges")
def code_status(e: Engine) -> DataFrame:
    status = e.index_status()
    return e.spark.createDataFrame([tuple(status[c] for c in ("files", "symbols", "edges"))], "files long, symbols long, edges long")


@query(f"WITH {_FN} SELECT path, (line + 2 + d + 2 * r + 2 * l + calls)::INTEGER AS line, 4 AS col FROM fn WHERE s % 5 = 1")
def code_references(e: Engine) -> DataFrame:
    return e.find_references("ext_1")


@query(
    f"""WITH {_FN}, {_SYMBOLS}, {_OCC}
    SELECT DISTINCT o.name, o.path, o.line::INTEGER AS line, arg_max(s.id, (s.line, -s.end_line)) AS symbol FROM occ o LEFT JOIN symbols s ON s.path = o.path AND o.line BETWEEN s.line AND s.end_line GROUP BY o.name, o.path, o.line"""
)
def code_callers(e: Engine) -> DataFrame:
    return e.get_callers().select("name", "path", "line", "symbol").distinct()


_SEVENTH = "(SELECT f FROM p WHERE k = 7)"


def _seventh(e: Engine) -> str:
    """The name of part 7's function."""
    return e.symbols.where("path = 'pkg/m_0.py' and kind = 'function'").orderBy("line").select("name").collect()[7]["name"]


@query(
    f"""WITH {_FN}, {_OCC}, first AS (SELECT * FROM fn WHERE m = 0 AND f = {_SEVENTH} ORDER BY line LIMIT 1)
    SELECT 'callee' AS role, callee AS name, NULL AS path, NULL::INTEGER AS line FROM first WHERE calls = 1 UNION SELECT 'callee', 'ext_' || (s % 5), NULL, NULL FROM first
    UNION SELECT 'callee', unnest(['input', 'execute']), NULL, NULL FROM first WHERE outside UNION SELECT 'callee', 'sanitize', NULL, NULL FROM first WHERE safe
    UNION SELECT 'caller', name, path, line::INTEGER FROM occ WHERE name = {_SEVENTH}"""
)
def code_call_graph(e: Engine) -> DataFrame:
    return e.get_call_graph("pkg/m_0.py", _seventh(e))


@query(
    f"""WITH {_FN}, want AS (SELECT * FROM (VALUES (0, 'pkg/m_0.py', 'M_0'), (1, 'pkg/m_0.py', NULL), (2, 'pkg/m_1.py', 'gone'), (3, 'gone.py', 'M_0')) w(request, path, named)),
    asked AS (SELECT request, path, coalesce(named, {_SEVENTH}) AS name FROM want),
    had AS (SELECT path, f AS name, 'function' AS kind, line FROM fn WHERE m < 2 UNION ALL SELECT path, 'M_' || m, 'class', line FROM klass)
    SELECT request, asked.path, asked.name, arg_min(kind, line) AS kind, min(line)::INTEGER AS line FROM asked LEFT JOIN had ON had.path = asked.path AND had.name = asked.name GROUP BY ALL"""
)
def code_requested(e: Engine) -> DataFrame:
    asked = [("pkg/m_0.py", "M_0"), ("pkg/m_0.py", _seventh(e)), ("pkg/m_1.py", "gone"), ("gone.py", "M_0")]
    return e.get_symbols([{"file_path": p, "symbol_name": n} for p, n in asked]).select("request", "path", "name", "kind", "line")


@query(f"WITH {_FN}, {_SYMBOLS} SELECT CASE path WHEN 'pkg/m_1.py' THEN 0 ELSE 1 END AS ordinal, path, kind, parent, name, line::INTEGER AS line, params, doc FROM symbols WHERE path IN ('pkg/m_0.py', 'pkg/m_1.py')")
def code_skeletons(e: Engine) -> DataFrame:
    return e.get_skeletons(["pkg/m_1.py", "pkg/m_0.py"])


@query(f"WITH {_FN}, {_SYMBOLS} SELECT path, line::INTEGER AS line, kind, parent, name, params, doc, complexity::INTEGER AS complexity FROM symbols WHERE contains(name, 'bolt') AND kind = 'function' AND doc <> '' AND complexity >= 2")
def code_search(e: Engine) -> DataFrame:
    return e.search_symbols(query="BOLT", type="function", has_doc=True, min_complexity=2, language="py")


@query(
    f"""WITH {_FN}, {_SYMBOLS}, {_OCC}, places AS (SELECT name, count(*) AS n FROM occ GROUP BY name)
    SELECT path, line::INTEGER AS line, kind, parent, name FROM symbols JOIN places USING (name) WHERE n = 1 AND NOT starts_with(name, 'test_')"""
)
def code_dead(e: Engine) -> DataFrame:
    return e.find_dead_code()


_SHAPE = "struct_pack(d := d, r := r, l := l, calls := calls, kind := CASE WHEN safe THEN 2 WHEN outside THEN 1 ELSE 0 END)"


@query(
    f"""WITH {_FN}, shaped AS (SELECT *, {_SHAPE} AS shape FROM fn WHERE n >= 5)
    SELECT path, f AS name, line, n::INTEGER AS line_count, count(*) OVER same AS copies, first_value(path) OVER (PARTITION BY shape ORDER BY path, line) AS first_path, first_value(line) OVER (PARTITION BY shape ORDER BY path, line) AS first_line
    FROM shaped WINDOW same AS (PARTITION BY shape) QUALIFY count(*) OVER same > 1"""
)
def code_clones(e: Engine) -> DataFrame:
    found = e.detect_clones()
    groups = found.groupBy("clone").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("path", "line")).alias("first"))
    return found.join(groups, "clone").select("path", "name", "line", "line_count", "copies", F.col("first.path").alias("first_path"), F.col("first.line").alias("first_line"))


@query(
    f"""WITH {_FN} SELECT path, f AS fn, line AS at, unnest([{{'name': 'a', 'line': line, 'type': '', 'kind': 'parameter'}}, {{'name': 'b', 'line': line, 'type': '', 'kind': 'parameter'}}, {{'name': 'x', 'line': line + 1 + d, 'type': '', 'kind': 'local'}}], recursive := true) FROM fn
    UNION ALL SELECT path, f, line, 'i', line + 2 + d + 2 * r, '', 'loop_var' FROM fn WHERE l = 1
    UNION ALL SELECT path, f, line, 'raw', line + 3 + d + 2 * r + 2 * l + calls, '', 'local' FROM fn WHERE outside
    UNION ALL SELECT path, f, line, 'safe', line + 4 + d + 2 * r + 2 * l + calls, '', 'local' FROM fn WHERE safe"""
)
def code_variables(e: Engine) -> DataFrame:
    return e.symbols.select("path", F.col("name").alias("fn"), F.col("line").alias("at"), F.explode("variables").alias("v")).select("path", "fn", "at", "v.*")


@query(
    f"""WITH {_FN} SELECT path, f AS name, CASE WHEN safe THEN 'SAFE' ELSE 'UNSAFE' END AS verdict, CASE WHEN safe THEN 'safe,raw,db.execute(safe)' ELSE 'raw,db.execute(raw)' END AS chain,
    CASE WHEN safe THEN 'sanitize' END AS sanitizer, CASE WHEN NOT safe THEN 'SQL injection' END AS risk FROM fn WHERE outside"""
)
def code_taint(e: Engine) -> DataFrame:
    return e.taint_paths().withColumn("chain", F.array_join("chain", ","))


@query(
    f"""WITH {_FN}, x AS (SELECT f AS x FROM t WHERE m = 0 ORDER BY f LIMIT 1), marks AS (
      SELECT path, 'test_' || f AS name, line, f = x AS used, contains('test_' || f, x) AS named, path = 'tests/test_m_0.py' AS filed FROM t, x)
    SELECT path, name, line, (3 * used::INTEGER + 2 * named::INTEGER + filed::INTEGER)::INTEGER AS score,
           concat_ws(', ', CASE WHEN used THEN 'references symbol' END, CASE WHEN named THEN 'name match' END, CASE WHEN filed THEN 'file match' END) AS reason
    FROM marks WHERE used OR named OR filed"""
)
def code_tests(e: Engine) -> DataFrame:
    """Tests of the first function that the first file of tests is about."""
    tested = e.symbols.where("path = 'tests/test_m_0.py'").agg(F.min("name")).first()[0]
    return e.find_tests("pkg/m_0.py", tested.removeprefix("test_"))


@query(
    f"""WITH {_ALL}, callers AS (SELECT dst AS id, string_agg(DISTINCT src, ',' ORDER BY src) AS callers FROM called GROUP BY dst), wanted AS (
      SELECT id, path, f AS name, line, '(a, b)' AS params, list_sort(list_distinct([callee, 'ext_' || (s % 5), CASE WHEN outside THEN 'input' END, CASE WHEN outside THEN 'execute' END, CASE WHEN safe THEN 'sanitize' END])) AS callees,
             concat_ws(',', 'a', 'b', 'x', CASE l WHEN 1 THEN 'i' END, CASE WHEN outside THEN 'raw' END, CASE WHEN safe THEN 'safe' END) AS variables FROM fn WHERE d = 0
      UNION ALL SELECT path || '::M_' || m || '.size', path, 'size', line + 1, '(self)', [], '' FROM klass)
    SELECT path, name, line::INTEGER AS line, params, array_to_string(list_filter(callees, lambda c: c IS NOT NULL), ',') AS callees, variables, coalesce(callers, '') AS callers FROM wanted LEFT JOIN callers USING (id)"""
)
def code_docs(e: Engine) -> DataFrame:
    joined = lambda c: F.array_join(c, ",").alias(c)
    return e.suggest_docs().select("path", "name", "line", "params", joined("callees"), joined("variables"), joined("callers"))


@query(
    f"""WITH {_ALL}, callers AS (SELECT dst AS id, count(DISTINCT src) AS callers FROM called GROUP BY dst)
    SELECT id, complexity::BIGINT AS complexity, callers, (complexity * callers)::BIGINT AS score, path, name, line::INTEGER AS line
    FROM last JOIN callers USING (id) WHERE kind IN ('function', 'method') AND NOT is_test ORDER BY score DESC, id LIMIT 10"""
)
def code_hot_paths(e: Engine) -> DataFrame:
    return e.find_hot_paths()


@query(
    f"""WITH {_ALL}, found AS (
      SELECT id, name, kind, path, line::INTEGER AS line, coalesce(in_degree, 0)::BIGINT AS in_degree, coalesce(out_degree, 0)::BIGINT AS out_degree, coalesce(degree, 0)::BIGINT AS degree FROM last LEFT JOIN deg USING (id)
      WHERE contains(name, '1') AND kind = 'function' AND contains(path, 'pkg/') AND id IN (SELECT dst FROM edges WHERE type = 'CALLS') AND coalesce(degree, 0) BETWEEN 3 AND 50)
    SELECT *, count(*) OVER () AS total FROM found ORDER BY degree DESC, id LIMIT 20 OFFSET 5"""
)
def code_search_graph(e: Engine) -> DataFrame:
    return e.search_graph(query="1", kind="function", file_pattern="PKG/", relationship="CALLS", direction="inbound", min_degree=3, max_degree=50, limit=20, offset=5)


@query(
    f"""WITH {_FN}, {_SYMBOLS}, asked AS (SELECT p_name AS query FROM part UNION SELECT replace(p_name, ' ', '') FROM part UNION SELECT p_brand FROM part UNION SELECT 'F_' || left(p_name, 2) FROM part UNION SELECT p_size::VARCHAR FROM part)
    SELECT query, id, path, line::INTEGER AS line, kind, name FROM asked JOIN symbols ON contains(lower(name), lower(query)) WHERE query <> ''"""
)
def code_search_names(e: Engine, part: DataFrame) -> DataFrame:
    """Many questions at once, those that are in no name and those of a character or two included."""
    name = F.col("p_name")
    asked = (name, F.replace(name, F.lit(" "), F.lit("")), F.col("p_brand"), F.concat(F.lit("F_"), F.left(name, F.lit(2))), F.col("p_size").cast("string"))
    return e.search_names(reduce(DataFrame.unionByName, [part.select(q.alias("query")).distinct() for q in asked]))


_COMMON = "(SELECT f FROM p GROUP BY f ORDER BY count(*) DESC, f LIMIT 1)"


def _common(e: Engine) -> str:
    """The name that most functions have."""
    return e.symbols.where("kind = 'function' and not is_test").groupBy("name").count().orderBy(F.col("count").desc(), "name").first()["name"]


@query(
    f"""WITH {_ALL}, named AS (SELECT last.*, coalesce(in_degree, 0)::BIGINT AS in_degree FROM last LEFT JOIN deg USING (id) WHERE name = {_COMMON})
    SELECT row_number() OVER (ORDER BY contains(path, 'm_1') DESC, NOT is_test DESC, in_degree DESC, id DESC)::INTEGER AS rank, id, kind, path, line::INTEGER AS line, is_test, in_degree FROM named ORDER BY rank LIMIT 5"""
)
def code_resolve(e: Engine) -> DataFrame:
    return e.resolve_symbol(_common(e).upper(), path_hint="m_1", limit=5)


@query(
    f"""WITH RECURSIVE {_ALL}, seeds AS (SELECT id FROM last WHERE name = {_COMMON} AND NOT is_test), reach AS (
      SELECT id, 0 AS hop FROM seeds UNION SELECT src, hop + 1 FROM reach JOIN called ON dst = reach.id WHERE hop < 3
    ), hops AS (SELECT id, min(hop) AS hop FROM reach GROUP BY id
    ), all_hops AS (SELECT id, hop FROM hops WHERE hop > 0 UNION ALL SELECT DISTINCT src, 0 FROM edges WHERE type = 'TESTS' AND dst IN (SELECT id FROM seeds) AND src NOT IN (SELECT id FROM hops WHERE hop > 0))
    SELECT all_hops.id, hop, CASE hop WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' END AS risk, path, is_test FROM all_hops JOIN last USING (id)"""
)
def code_change_impact(e: Engine) -> DataFrame:
    return e.get_change_impact(_common(e))


@query(f"WITH {_ALL}, n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS no FROM (SELECT path AS name FROM files_linked UNION SELECT other FROM files_linked)) SELECT path AS src, s.no AS src_no, other AS dst, o.no AS dst_no FROM files_linked JOIN n s ON s.name = path JOIN n o ON o.name = other")
def code_dependencies(e: Engine) -> DataFrame:
    return e.get_dependency_graph()


@query(
    f"""WITH {_FN}, a AS (
      SELECT path, f AS name, line, 0 AS seq, 'x' AS variable, line + 1 + d AS at_line, '' AS depends_on, 'a + ' || s AS expr FROM fn
      UNION ALL SELECT path, f, line, i::INTEGER, 'x', line + 1 + d + 2 * i, 'x', 'x - 1' FROM fn, generate_series(1, 2) g(i) WHERE i <= r
      UNION ALL SELECT path, f, line, (1 + r)::INTEGER, 'x', line + 3 + d + 2 * r, 'x', 'x + i' FROM fn WHERE l = 1
      UNION ALL SELECT path, f, line, (1 + r + l)::INTEGER, 'raw', line + 3 + d + 2 * r + 2 * l + calls, '', 'input()' FROM fn WHERE outside
      UNION ALL SELECT path, f, line, (2 + r + l)::INTEGER, 'safe', line + 4 + d + 2 * r + 2 * l + calls, 'raw', 'sanitize(raw)' FROM fn WHERE safe)
    SELECT path, name, line, seq, variable, at_line::INTEGER AS at_line, depends_on, expr FROM a"""
)
def code_flow(e: Engine) -> DataFrame:
    return e.flow().variables().withColumn("depends_on", F.array_join("depends_on", ","))


@query(f"WITH {_FN} SELECT path, f AS name, line, 'safe' AS variable, 'safe,raw' AS chain FROM fn WHERE safe")
def code_flow_chains(e: Engine) -> DataFrame:
    return e.flow().chains().withColumn("chain", F.array_join("chain", ","))


#: Parts whose function gets something from outside as its first argument: from the part three before it, or through that.
_HANDED = """parts AS (SELECT p_partkey AS k, p_size AS s FROM part), held AS (
  SELECT t.k, 1 AS hop, ['w_' || j.k, 'w_' || t.k] AS way FROM parts j JOIN parts t ON t.k = j.k + 3 WHERE j.k % 4 <> 0 AND j.s % 5 = 0
  UNION ALL SELECT t.k, hop + 1, list_append(way, 'w_' || t.k) FROM held JOIN parts j ON j.k = held.k JOIN parts t ON t.k = j.k + 3 WHERE j.k % 4 <> 0 AND j.s % 5 <> 0
)"""


@query(
    f"""WITH RECURSIVE {_HANDED}
    SELECT 'flow/w_' || k || '.py' AS path, 'w_' || k AS name, 1 AS line, CASE k % 7 WHEN 0 THEN 'SAFE' ELSE 'UNSAFE' END AS verdict, 'u,t,a,db.execute(u)' AS chain, CASE k % 7 WHEN 0 THEN 'sanitize' END AS sanitizer,
      CASE WHEN k % 7 <> 0 THEN 'SQL injection' END AS risk, hop, array_to_string(way, ',') AS functions FROM held JOIN parts USING (k) WHERE s % 3 = 0
    UNION ALL SELECT 'flow/w_' || k || '.py', 'w_' || k, 1, 'UNSAFE', 'raw,os.system(raw)', NULL, 'Command injection', 0, 'w_' || k FROM parts WHERE s % 10 = 0"""
)
def code_cross_taint(e: Engine) -> DataFrame:
    joined = lambda c: F.array_join(c, ",").alias(c)
    return e.cross_taint_paths(None).select("path", "name", "line", "verdict", joined("chain"), "sanitizer", "risk", "hop", joined("functions"))


@query(f"WITH RECURSIVE {_HANDED} SELECT 'w_' || k AS name, 'a' AS param, hop FROM held")
def code_cross_parameters(e: Engine) -> DataFrame:
    flow = e.flow()
    return flow.tainted_parameters().join(flow.functions.select("fn", "name"), "fn").select("name", "param", "hop")

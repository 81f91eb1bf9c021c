"""What the engine says of a repository in eight languages that is made from the parts, beside SQL over the parts themselves.

Sixteen parts in a row are a module, and modules take turns at the languages. A part is a function whose body follows from its key and
size: branches, loops, a call of the part five further on in the module, or of one in the language's next module, and a call of a name
that is defined nowhere. A module has a class or struct as well. Answers carry the language, so one that is read wrongly shows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..sources.tables import table
from .code_queries import MODULE, STRIDE, engine
from .registry import Registry


@dataclass(frozen=True)
class Dialect:
    """Templates of a language's lines, in which $name stands for a column."""

    ending: str
    imported: str
    doc: str
    head: str
    assign: str
    branch: str
    loop: str
    call: str
    back: str
    close: str
    klass: str
    top: str = ""
    first: str = ""  # what opens the class, if functions are inside it


_C_LIKE = dict(
    doc="/* Part $k. */\n", head="int $f(int a, int b) {\n", assign="    int x = a + $s;\n", branch="    if (x > b) {\n        x = x - 1;\n    }\n",
    loop="    for (int i = 0; i < b; i++) {\n        x = x + i;\n    }\n", call="    $callee(x, b);\n", back="    ext_$r5(x);\n    return x;\n", close="}\n",
)
_SCRIPT = dict(
    doc="/** Part $k. */\n", assign="  let x = a + $s;\n", branch="  if (x > b) {\n    x = x - 1;\n  }\n", loop="  for (let i = 0; i < b; i++) {\n    x = x + i;\n  }\n",
    call="  $callee(x, b);\n", back="  ext_$r5(x);\n  return x;\n", close="}\n",
)
DIALECTS = (
    Dialect("c", '#include "c_$cm.h"\n', klass="struct M_$m {\n    int parts;\n};\n", **_C_LIKE),
    Dialect("cpp", '#include "cpp_$cm.h"\n', klass="class M_$m {\n    int size() {\n        return $n;\n    }\n};\n", **_C_LIKE),
    Dialect(
        "go", 'import "pkg/go_$cm"\n', "// Part $k.\n", "func $f(a int, b int) int {\n", "\tx := a + $s\n", "\tif x > b {\n\t\tx = x - 1\n\t}\n", "\tfor i := 0; i < b; i++ {\n\t\tx = x + i\n\t}\n",
        "\t$callee(x, b)\n", "\text_$r5(x)\n\treturn x\n", "}\n", "type M_$m struct {\n\tparts int\n}\n\nfunc (m *M_$m) size() int {\n\treturn $n\n}\n", top="package pkg\n",
    ),
    Dialect("java", "import pkg.java_$cm.M_$cm;\n", klass="    int size() {\n        return $n;\n    }\n}\n", first="class M_$m {\n", **_C_LIKE),
    Dialect("js", 'import { $callee } from "./js_$cm.js";\n', head="function $f(a, b) {\n", klass="class M_$m {\n  size() {\n    return $n;\n  }\n}\n", **_SCRIPT),
    Dialect(
        "rb", 'require "rb_$cm"\n', "# Part $k.\n", "def $f(a, b)\n", "  x = a + $s\n", "  if x > b\n    x = x - 1\n  end\n", "  for i in b\n    x = x + i\n  end\n",
        "  $callee(x, b)\n", "  ext_$r5(x)\n  x\n", "end\n", "class M_$m\n  def size\n    $n\n  end\nend\n",
    ),
    Dialect(
        "rs", "use crate::rs_$cm::$callee;\n", "/// Part $k.\n", "fn $f(a: i32, b: i32) -> i32 {\n", "    let mut x = a + $s;\n", "    if x > b {\n        x = x - 1;\n    }\n",
        "    for i in 0..b {\n        x = x + i;\n    }\n", "    $callee(x, b);\n", "    ext_$r5(x);\n    x\n", "}\n", "struct M_$m {\n    parts: i32,\n}\n\nimpl M_$m {\n    fn size(&self) -> i32 {\n        $n\n    }\n}\n",
    ),
    Dialect("ts", 'import { $callee } from "./ts_$cm";\n', head="function $f(a: number, b: number): number {\n", klass="class M_$m {\n  size(): number {\n    return $n;\n  }\n}\n", **_SCRIPT),
)
TURNS = len(DIALECTS)


def _filled(template: str) -> Column:
    pieces = re.split(r"\$(\w+?)(?![a-z0-9])", template)
    return F.concat(*[F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def language_sources(spark: SparkSession, d: str) -> DataFrame:
    """(path, source): a file a module, in the module's language."""
    k, m = F.col("k"), F.col("m")
    turn = F.pmod(m, F.lit(TURNS))
    ending = F.element_at(F.array(*[F.lit(x.ending) for x in DIALECTS]), (turn + 1).cast("int"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / MODULE).alias("m"), "p_name", F.col("p_size").alias("s"))
    parts = parts.withColumn("e", ending).withColumn("f", F.concat("e", F.lit("_"), F.regexp_replace(F.lower("p_name"), "[^a-z]", ""), F.lit("_"), F.col("s").cast("string")))
    beyond = F.floor((k + STRIDE) / MODULE) != m
    asked = parts.withColumns({"to": k + STRIDE + F.when(beyond, (TURNS - 1) * MODULE).otherwise(0), "r5": F.col("s") % 5})
    parts = asked.join(parts.select(k.alias("to"), F.col("f").alias("callee"), m.alias("cm")), "to", "left")

    per_language = lambda pick: F.coalesce(*[F.when(turn == i, pick(x)) for i, x in enumerate(DIALECTS)])
    only = lambda where, text: F.when(where, text).otherwise(F.lit(""))

    def body(x: Dialect) -> Column:
        return F.concat(
            only(k % 2 == 0, _filled(x.doc)), _filled(x.head), _filled(x.assign), F.repeat(F.lit(x.branch), (F.col("s") % 3).cast("int")), only(k % 3 == 0, F.lit(x.loop)),
            only(F.col("callee").isNotNull(), _filled(x.call)), _filled(x.back), F.lit(x.close + "\n"),
        )

    imported = F.when((k % 2 == 0) & (F.col("cm") != m), per_language(lambda x: _filled(x.imported)))
    # at most MODULE of each
    modules = parts.groupBy("m", "e").agg(F.collect_set(imported).alias("imports"), F.array_sort(F.collect_list(F.struct("k", per_language(body).alias("body")))).alias("bodies"))
    modules = modules.withColumn("n", F.size("bodies"))
    file = per_language(
        lambda x: F.concat(F.lit(x.top), F.array_join(F.array_sort("imports"), ""), _filled(x.first), F.array_join(F.transform("bodies", lambda b: b["body"]), ""), _filled(x.klass))
    )
    return modules.select(_filled("$e/$e_$m.$e").alias("path"), file.alias("source"))


_REGISTRY = Registry(lambda f: partial(_asked, f))
query, QUERIES, ORACLES = _REGISTRY.query, _REGISTRY.queries, _REGISTRY.oracles


def _asked(f, spark: SparkSession, d: str) -> DataFrame:
    return f(engine(spark, d, language_sources))


#: lang: lines before the imports, whether the class opens before the functions, the class's kind, how many lines after its first it ends and
#: the method begins, and how the language writes parameters and types. fn has a row a part, klass one a module.
_FN = """lang(i, e, pre, inside, kind, ends, size_at, params, size_params, param_type, own_type, loop_type) AS (VALUES
  (0, 'c', 0, 0, 'struct', 2, NULL, '(int a, int b)', '()', 'int', 'int', 'int'), (1, 'cpp', 0, 0, 'class', 4, 1, '(int a, int b)', '()', 'int', 'int', 'int'),
  (2, 'go', 1, 0, 'struct', 2, 4, '(a int, b int)', '()', 'int', '', ''), (3, 'java', 0, 1, 'class', NULL, NULL, '(int a, int b)', '()', 'int', 'int', 'int'),
  (4, 'js', 0, 0, 'class', 4, 1, '(a, b)', '()', '', '', ''), (5, 'rb', 0, 0, 'class', 4, 1, '(a, b)', '', '', '', ''),
  (6, 'rs', 0, 0, 'struct', 2, 5, '(a: i32, b: i32)', '(&self)', 'i32', '', ''), (7, 'ts', 0, 0, 'class', 4, 1, '(a: number, b: number)', '()', 'number', '', '')
), p AS (
  SELECT p_partkey AS k, p_partkey // 16 AS m, p_size AS s, lang.*, e || '_' || regexp_replace(lower(p_name), '[^a-z]', '', 'g') || '_' || p_size AS f, e || '/' || e || '_' || (p_partkey // 16) || '.' || e AS path
  FROM part JOIN lang ON i = (p_partkey // 16) % 8
), c AS (
  SELECT p.*, q.f AS callee, q.m AS cm, q.path AS other, p.s % 3 AS r, (p.k % 3 = 0)::INTEGER AS l, (p.k % 2 = 0)::INTEGER AS d, (q.f IS NOT NULL)::INTEGER AS calls
  FROM p LEFT JOIN p q ON q.k = p.k + 5 + CASE WHEN (p.k + 5) // 16 <> p.m THEN 112 ELSE 0 END
), imp AS (
  SELECT *, pre + row_number() OVER (PARTITION BY m ORDER BY text) AS line FROM (
    SELECT DISTINCT m, path, pre, other, CASE e WHEN 'go' THEN 'import "pkg/go_' || cm || '"' WHEN 'java' THEN 'import pkg.java_' || cm || '.M_' || cm || ';' WHEN 'js' THEN 'import { ' || callee || ' } from "./js_' || cm || '.js";'
      WHEN 'ts' THEN 'import { ' || callee || ' } from "./ts_' || cm || '";' WHEN 'rs' THEN 'use crate::rs_' || cm || '::' || callee || ';' WHEN 'rb' THEN 'require "rb_' || cm || '"' ELSE '#include "' || e || '_' || cm || '.h"' END AS text
    FROM c WHERE k % 2 = 0 AND cm <> m)
), sized AS (
  SELECT c.*, pre + coalesce(h, 0) AS top, 5 + 3 * r + 3 * l + calls AS n, CASE inside WHEN 1 THEN 'M_' || m END AS parent FROM c LEFT JOIN (SELECT m, count(*) AS h FROM imp GROUP BY m) USING (m)
), fn AS (
  SELECT *, path || '::' || coalesce(parent || '.', '') || f AS id, (top + inside + 1 + d + coalesce(sum(n + d + 1) OVER (PARTITION BY m ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS line FROM sized
), after AS (SELECT m, e, path, kind, ends, size_at, size_params, inside, top, 'M_' || m AS name, max(line + n + 1) AS free FROM fn GROUP BY ALL
), klass AS (SELECT *, CASE inside WHEN 1 THEN top + 1 ELSE free END AS line, CASE inside WHEN 1 THEN free + 3 ELSE free + ends END AS end_line, CASE inside WHEN 1 THEN free ELSE free + size_at END AS size_line FROM after
), symbols AS (
  SELECT id, path, e AS language, f AS name, CASE inside WHEN 1 THEN 'method' ELSE 'function' END AS kind, parent, line, line + n - 1 AS end_line, params, CASE d WHEN 1 THEN 'Part ' || k || '.' ELSE '' END AS doc, 1 + r + l AS complexity FROM fn
  UNION ALL SELECT path || '::' || name, path, e, name, kind, NULL, line, end_line, '', '', NULL FROM klass
  UNION ALL SELECT path || '::' || name || '.size', path, e, 'size', 'method', name, size_line, size_line + 2, size_params, '', 1 FROM klass WHERE size_line IS NOT NULL
)"""


@query(f"WITH {_FN} SELECT language, path, name, kind, parent, line::INTEGER AS line, end_line::INTEGER AS end_line, params, doc, complexity::INTEGER AS complexity FROM symbols")
def code_lang_symbols(e: Engine) -> DataFrame:
    return e.symbols.select("language", "path", "name", "kind", "parent", "line", "end_line", "params", "doc", "complexity")


@query(f"WITH {_FN} SELECT e AS language, path, f AS name, line, r::INTEGER AS branches, l AS loops FROM fn UNION ALL SELECT e, path, 'size', size_line::INTEGER, 0, 0 FROM klass WHERE size_line IS NOT NULL")
def code_lang_complexity(e: Engine) -> DataFrame:
    times = lambda label: F.coalesce(F.try_element_at("breakdown", F.lit(label)), F.lit(0))
    return e.symbols.where("complexity is not null").select("language", "path", "name", "line", times("if").alias("branches"), times("for").alias("loops"))


@query(f"WITH {_FN} SELECT path, line::INTEGER AS line, text FROM imp")
def code_lang_imports(e: Engine) -> DataFrame:
    return e.imports


@query(f"WITH {_FN} SELECT id AS caller, path, line, callee AS name FROM fn WHERE calls = 1 UNION ALL SELECT id, path, line, 'ext_' || (s % 5) FROM fn")
def code_lang_calls(e: Engine) -> DataFrame:
    return e.symbols.select(F.col("id").alias("caller"), "path", "line", F.explode("calls").alias("name"))


@query(
    f"""WITH {_FN} SELECT path, f AS fn, line AS at, 'a' AS name, line, param_type AS type, 'parameter' AS kind FROM fn UNION ALL SELECT path, f, line, 'b', line, param_type, 'parameter' FROM fn
    UNION ALL SELECT path, f, line, 'x', line + 1, own_type, 'local' FROM fn UNION ALL SELECT path, f, line, 'i', (line + 2 + 3 * r)::INTEGER, loop_type, 'loop_var' FROM fn WHERE l = 1"""
)
def code_lang_variables(e: Engine) -> DataFrame:
    return e.symbols.select("path", F.col("name").alias("fn"), F.col("line").alias("at"), F.explode("variables").alias("v")).select("path", "fn", "at", "v.*")


@query(f"WITH {_FN} SELECT path, line::INTEGER AS line, name, count(*) AS places FROM (SELECT path, line, f AS name FROM fn UNION ALL SELECT path, line + 2 + 3 * r + 3 * l, callee FROM fn WHERE calls = 1 UNION ALL SELECT path, line + 2 + 3 * r + 3 * l + calls, 'ext_' || (s % 5) FROM fn) GROUP BY ALL")
def code_lang_references(e: Engine) -> DataFrame:
    """Places of functions and of names that are defined nowhere, but for those in imports."""
    names = F.col("name").rlike("^(c|cpp|go|java|js|rb|rs|ts)_[a-z]+_[0-9]+$|^ext_")
    return e.occurrences.where(names).join(e.imports.select("path", "line"), ["path", "line"], "left_anti").groupBy("path", "line", "name").agg(F.count(F.lit(1)).alias("places"))


@query(
    f"""WITH {_FN}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line DESC) AS again FROM symbols) WHERE again = 1
    ), body AS (SELECT fn.* FROM fn JOIN last USING (id, line)
    ), calls AS (SELECT id AS caller, path, callee AS name FROM body WHERE calls = 1 UNION SELECT id, path, 'ext_' || (s % 5) FROM body
    ), linked AS (SELECT DISTINCT path, other FROM imp
    ), pairs AS (
      SELECT caller, calls.name, last.id, CASE WHEN last.id IS NOT NULL AND (last.path = calls.path OR other IS NOT NULL) THEN 1.0 ELSE 0.5 END::DOUBLE AS weight
      FROM calls LEFT JOIN last ON last.name = calls.name LEFT JOIN linked ON linked.path = calls.path AND other = last.path
    ), best AS (SELECT *, max(weight) OVER (PARTITION BY caller, name) AS best FROM pairs)
    SELECT caller AS src, coalesce(id, '?::' || name) AS dst, 'CALLS' AS type, max(weight) AS weight FROM best WHERE weight = best GROUP BY ALL
    UNION ALL SELECT path || '::' || parent, id, 'CONTAINS', 1.0 FROM last WHERE parent IS NOT NULL
    UNION ALL SELECT path || '::__file__', other || '::__file__', 'IMPORTS', 1.0 FROM linked"""
)
def code_lang_edges(e: Engine) -> DataFrame:
    return e.edges


@query(
    f"""WITH {_FN}, shaped AS (SELECT *, struct_pack(r := r, l := l, calls := calls, written := CASE WHEN e IN ('c', 'cpp', 'java') THEN 'c' ELSE e END) AS shape FROM fn WHERE n >= 5)
    SELECT path, f AS name, line, n::INTEGER AS line_count, count(*) OVER same AS copies, first_value(path) OVER (PARTITION BY shape ORDER BY path, line) AS first_path
    FROM shaped WINDOW same AS (PARTITION BY shape) QUALIFY count(*) OVER same > 1"""
)
def code_lang_clones(e: Engine) -> DataFrame:
    found = e.detect_clones()
    groups = found.groupBy("clone").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("path", "line")).alias("first"))
    return found.join(groups, "clone").select("path", "name", "line", "line_count", "copies", F.col("first.path").alias("first_path"))

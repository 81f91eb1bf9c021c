"""Extraction in each language, by exact rows."""

import pytest

from loomgraph.parse import normalised, parse_source, register_language
from loomgraph.parse.lexer import nested
from loomgraph.parse.model import Parsed, Symbol


def shapes(source, ending):
    return [(s.kind, s.parent, s.name, s.line) for s in parse_source(source, ending).symbols]


def of(source, ending, name):
    return next(s for s in parse_source(source, ending).symbols if s.name == name)


PYTHON = '''import os
from db import save

class Calc(Base):
    """Adds things.

    And more."""
    def add(self, a: int, b=2):
        if a and b or a:
            return a
        elif b:
            pass
        for x, y in zip(a, b):
            helper(x)
        total = a + b
        return os.path.join(total)
    class Inner:
        def deep(self): pass

@wraps
async def helper(x, *rest, **more):
    return x
'''


def test_python():
    assert shapes(PYTHON, "py") == [("class", None, "Calc", 4), ("method", "Calc", "add", 8), ("method", "Inner", "deep", 18), ("function", None, "helper", 21)]
    add = of(PYTHON, "py", "add")
    assert add.params == "(self, a: int, b=2)"
    assert add.calls == ["helper", "join", "zip"]
    assert add.breakdown == {"if": 1, "elif": 1, "for": 1, "boolean_op": 2}
    assert add.variables == [("a", 8, "int", "parameter"), ("b", 8, "", "parameter"), ("x", 13, "", "loop_var"), ("y", 13, "", "loop_var"), ("total", 15, "", "local")]
    assert add.assigns == [("total", 15, ["a", "b"], "a + b")]
    parsed = parse_source(PYTHON, "py")
    assert of(PYTHON, "py", "Calc").doc == "Adds things."
    assert parsed.imports == [(1, "import os"), (2, "from db import save")]
    assert ("helper", 14, 12) in parsed.occurrences and not parsed.has_errors


def test_byte_columns():
    assert ("x", 1, 8) in parse_source('s="é€"; x = 1\n'.replace("; ", ";"), "py").occurrences or ("x", 1, 10) in parse_source('s="é€";x = 1\n', "py").occurrences
    assert parse_source("é = x\n", "py").occurrences == [("é", 1, 0), ("x", 1, 5)]


def test_broken_python_keeps_headers():
    parsed = parse_source("import os\nclass A:\n    def f(self, x):\n        return (\n\ndef g(:\n", "py")
    assert parsed.has_errors
    assert [(s.kind, s.parent, s.name) for s in parsed.symbols] == [("class", None, "A"), ("method", "A", "f"), ("function", None, "g")]
    assert parsed.imports == [(1, "import os")]


def test_javascript():
    source = """// Greets
import x from './calc';
export class Dog extends Animal {
  constructor(name) { super(name); }
  static async bark(times = 1, ...rest) { for (const t of rest) { if (t && times || x) log(t ? 1 : 2); } }
}
/** Adds */
function add(a, b) { let c = a + b; return new Thing(c); }
export const mul = async (a, b) => { return add(a, b); };
const sq = x => x * x;
function* gen() { yield 1; }
"""
    assert shapes(source, "js") == [
        ("class", None, "Dog", 3), ("method", "Dog", "constructor", 4), ("method", "Dog", "bark", 5), ("function", None, "add", 8),
        ("function", None, "mul", 9), ("function", None, "sq", 10), ("function", None, "gen", 11),
    ]
    assert of(source, "js", "bark").breakdown == {"for_in": 1, "if": 1, "&&": 1, "||": 1, "ternary": 1}
    assert of(source, "js", "add").calls == ["Thing"] and of(source, "js", "add").doc == "Adds"
    assert of(source, "js", "sq").params == "(x)"
    assert parse_source(source, "jsx").imports == [(2, "import x from './calc';")]


def test_typescript():
    source = """import { A } from "./a";
export abstract class Shape<T> { private x: number = 1; abstract area(): number; name(p: string, q?: number): string { do { x++; } while (x < 3); return q ?? p; } }
interface Foo { bar(): void }
type ID = string | number;
export function f(a: number): void { const z: number = a; try { g(z) } catch (e) { } }
"""
    assert shapes(source, "ts") == [("class", None, "Shape", 2), ("method", "Shape", "area", 2), ("method", "Shape", "name", 2), ("interface", None, "Foo", 3), ("type", None, "ID", 4), ("function", None, "f", 5)]
    assert of(source, "ts", "name").breakdown == {"do_while": 1}
    assert of(source, "tsx", "f").variables == [("a", 5, "number", "parameter"), ("z", 5, "number", "local")]


def test_go():
    source = """package main
import ("fmt"
 "os")
type Point struct { X int }
type Shape interface { Area() float64 }
// Move moves.
func (p *Point) Move(dx, dy int) error { if dx > 0 { fmt.Println(dx) }; for i := 0; i < 3; i++ { step(i) }; y := p.X + dx; return nil }
func main() { p := Point{1}; p.Move(1, 2) }
"""
    assert shapes(source, "go") == [("struct", None, "Point", 4), ("interface", None, "Shape", 5), ("method", "Point", "Move", 7), ("function", None, "main", 8)]
    move = of(source, "go", "Move")
    assert (move.doc, move.calls, move.breakdown) == ("Move moves.", ["Println", "step"], {"if": 1, "for": 1})
    assert move.variables[:2] == [("dx", 7, "int", "parameter"), ("dy", 7, "int", "parameter")]
    assert move.assigns == [("y", 7, ["dx", "p"], "p.X + dx")]


def test_rust():
    source = """use std::fs;
/// A point
pub struct Point { x: i32 }
enum Color { Red, Green }
trait Area { fn area(&self) -> f64; fn name(&self) -> String { format!("x") } }
impl Area for Point { fn area(&self) -> f64 { let v: f64 = calc(self.x); match v { 1.0 => 2.0, _ => 3.0 } } }
impl Point { pub fn new(x: i32) -> Self { if x > 0 { helper(x)?; } Point { x } } }
fn helper(mut x: i32) -> i32 { Foo::bar(x); for i in 0..x { } 'a' as i32 }
"""
    assert [(k, p, n) for k, p, n, _ in shapes(source, "rs")] == [
        ("struct", None, "Point"), ("enum", None, "Color"), ("trait", None, "Area"), ("method", "Area", "area"), ("method", "Area", "name"),
        ("method", "Point", "area"), ("method", "Point", "new"), ("function", None, "helper"),
    ]
    assert of(source, "rs", "name").calls == []  # macros are no calls
    assert of(source, "rs", "new").breakdown == {"if": 1, "try": 1}
    assert of(source, "rs", "helper").variables == [("x", 8, "i32", "parameter"), ("i", 8, "", "loop_var")]
    assert of(source, "rs", "Point").doc == "A point"


def test_java():
    source = """package a;
import java.util.List;
/** Doc. */
public class Calc<T> extends Base {
  private int x = foo(3);
  public Calc(int x) { this.x = x; }
  @Override
  public int add(int a, List<String> b) throws E { int s = a + x; for (String q : b) { if (a > 1 && s < 2) use(new Dog(q)); } return s; }
  abstract void nothing();
}
interface Sh { double area(); }
enum Col { RED, GREEN; int f() { return 1; } }
"""
    assert shapes(source, "java") == [
        ("class", None, "Calc", 4), ("method", "Calc", "Calc", 6), ("method", "Calc", "add", 8), ("method", "Calc", "nothing", 9),
        ("interface", None, "Sh", 11), ("method", "Sh", "area", 11), ("enum", None, "Col", 12), ("method", "Col", "f", 12),
    ]
    add = of(source, "java", "add")
    assert (add.calls, add.breakdown) == (["Dog", "use"], {"for_each": 1, "if": 1, "&&": 1})
    assert ("q", 8, "String", "loop_var") in add.variables and add.assigns == [("s", 8, ["a", "x"], "a + x")]


def test_c_and_cpp():
    c = """#include <stdio.h>
typedef struct { int x; } P;
struct Node { int v; };
/* adds */
int add(int a, char *b) { int s = a; s = helper(b, s); if (a || s) { while (s) s--; } switch (a) { case 1: break; default: break; } return s; }
"""
    assert shapes(c, "c") == [("struct", None, "P", 2), ("struct", None, "Node", 3), ("function", None, "add", 5)]
    assert of(c, "h", "add").breakdown == {"if": 1, "||": 1, "while": 1, "case": 2}
    assert [a[:1] + a[2:] for a in of(c, "c", "add").assigns] == [("s", ["a"], "a"), ("s", ["b", "helper", "s"], "helper(b, s)")]
    cpp = """#include <vector>
using namespace std;
namespace ns {
class Dog : public Animal { public: Dog(int a) : n(a) {} int bark(int t) const { for (auto& x : v) { f(x); } return t; } private: int n; };
struct S { int v; };
int go(int a) { try { x.y(a); } catch (...) { } return 1; }
}
int A::out(int z) { return z; }
"""
    assert [(k, p, n) for k, p, n, _ in shapes(cpp, "cpp")] == [("class", None, "Dog"), ("method", "Dog", "Dog"), ("method", "Dog", "bark"), ("struct", None, "S"), ("function", None, "go")]
    assert parse_source(cpp, "hh").imports == [(1, "#include <vector>"), (2, "using namespace std;")]


def test_ruby():
    source = """require 'json'
# A dog
class Dog < Animal
  def bark(times, loud = false)
    if loud && times > 1
      puts "x"
    end
    helper(times) unless loud
    items.each do |i|
      run i
    end
  end
  def self.make
    new
  end
end
module Util
  def go; end
end
def top(a)
  while a do
    a = step(a)
  end
end
"""
    assert shapes(source, "rb") == [("class", None, "Dog", 3), ("method", "Dog", "bark", 4), ("method", "Dog", "make", 13), ("class", None, "Util", 17), ("method", "Util", "go", 18), ("function", None, "top", 20)]
    assert of(source, "rb", "bark").breakdown == {"if": 1, "&&": 1, "unless": 1}
    assert of(source, "rb", "top").calls == ["step"] and not parse_source(source, "rb").has_errors


@pytest.mark.parametrize("ending", ["py", "js", "ts", "go", "rs", "java", "c", "cpp", "rb"])
@pytest.mark.parametrize("source", ["", "\n\n", "// x\n# y\n", "(((", "}}}", '"open', "x" * 5000, "日本語 = 1\n", "/* never closed"])
def test_anything_is_read(ending, source):
    assert isinstance(parse_source(source, ending), Parsed)


def test_unbalanced_has_errors():
    for ending in ("js", "go", "rs", "java", "c", "cpp"):
        assert parse_source("void f() { if (x) {", ending).has_errors, ending
    assert parse_source("class A\n def f\n end\n", "rb").has_errors


def test_clone_text_ignores_names_and_literals():
    a = normalised("function f(a, b) { // adds\n return a + b * 2; }", "javascript")
    assert a == normalised("function g(x, y) { return x + y * 7; }", "javascript")
    assert a != normalised("function g(x, y) { return x - y * 7; }", "javascript")


def test_a_language_can_be_added_and_a_failing_one_is_contained():
    register_language("toy", "toy", lambda source: Parsed([Symbol("t", "function", None, 1, 1)]))
    assert shapes("anything", "toy") == [("function", None, "t", 1)]

    def fail(source):
        raise RuntimeError

    register_language("toy", "toy", fail)
    assert parse_source("x", "toy").has_errors
    from loomgraph.functions.lists import LANGUAGES

    del LANGUAGES["toy"]


def test_nested_tokens():
    assert nested("f(a)\n", "go") == "(file (name [1:0] 'f') (group [1:1-1:4] '(' (name [1:2] 'a') ')'))"
    assert nested("f(a(b))", "go", 1) == "(file (name [1:0] 'f') (group [1:1-1:7] '(' ... ')'))"
    assert nested("((", "go").startswith("(file")


@pytest.mark.parametrize("ending", ["js", "ts", "go", "rs", "java", "c", "cpp", "rb"])
def test_an_assignment_without_a_value_has_errors(ending):
    for wrong in ("x = = 1\n", "f(a = )\n", "{ x += }\n" if ending != "rb" else "foo(x += )\n"):
        assert parse_source(wrong, ending).has_errors, wrong
    for right in ("x == 1\n", "x = (1)\n", "y >= z\n"):
        assert not parse_source(right, ending).has_errors, right


def test_operators_that_look_like_assignments_are_fine():
    assert not parse_source("struct A { A& operator=(const A& o) = default; bool operator==(A) const; };\nauto f = [=] { return 1; };\nauto g = [=, &x]() {};\n", "cpp").has_errors
    assert not parse_source("class A\n  def ==(o)\n    @a ||= []\n  end\n  def x=(v)\n    @x = v\n  end\n  def []=(k, v)\n  end\nend\n", "rb").has_errors
    assert not parse_source("const f = (a = {}) => a;\nlet {b = 1} = c;\nfor (;;) {}\n", "js").has_errors
    assert not parse_source("func f() { a, err := g(); if x := h(); x != nil {} }\n", "go").has_errors


def test_columns_of_tokens_are_bytes_of_their_line():
    """However many tokens, strings and comments over several lines are before them."""
    from loomgraph.parse.lexer import tokens

    source = "var é = 1; f('é', `a\n\nü`); g(x) /* b\nc é */ h('y')\n  k(é);" + "a=b+'ü';" * 50
    for token in tokens(source, "javascript"):
        begin = source.rfind("\n", 0, token.at) + 1
        assert (token.line, token.column) == (source.count("\n", 0, token.at) + 1, len(source[begin : token.at].encode()))

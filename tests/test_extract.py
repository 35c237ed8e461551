import random

import pytest
from pyspark.sql import functions as F

from codeatlas.functions import extract as E
from codeatlas.functions import tree as T
from codeatlas.functions.symbols import ts_symbols
from codeatlas.operators import edges, pattern
from codeatlas.sources import files as S


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("c")).first()["c"]


cs = E.language("csharp")


SYLLABLES = "ba ke lo mu ri ta vo xi zen qu".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))).capitalize()


def dotted(rng):
    return ".".join(word(rng) for _ in range(rng.randrange(1, 4)))


def csharp(rng):
    """A C# source written line by line, and what it declares: usings, namespaces, and types as (name, kind, line, public)."""
    lines, usings, namespaces, types = [], [], [], []
    for _ in range(rng.randrange(6)):
        name = dotted(rng)
        lines.append(rng.choice(["using {};", "using  static {} ;", "using Short = {};", "\tusing\t{};"]).format(name))
        usings.append(name)
        lines += rng.choice([[], [""], [f"// using {dotted(rng)};"], [f"/* using {dotted(rng)};", f"namespace {dotted(rng)} {{ */"]])
    if rng.random() < 0.3:
        namespaces.append(dotted(rng))
        lines.append(f"namespace {namespaces[-1]};")
    for _ in range(rng.randrange(1, 4)):
        block = rng.random() < 0.6
        if block:
            namespaces.append(dotted(rng))
            lines += [f"namespace {namespaces[-1]}", "{"] if rng.random() < 0.5 else [f"namespace {namespaces[-1]} {{"]
        for _ in range(rng.randrange(4)):
            form, kind = rng.choice([("class {}", "class"), ("sealed partial class {}", "class"), ("static class {}", "class"), ("interface {}", "interface"), ("partial interface {}", "interface"), ("struct {}", "type"), ("readonly struct {}", "type"), ("enum {}", "enum"), ("record {}(int N);", "type"), ("record struct {}(int N);", "type"), ("abstract record {}", "type")])
            access, name = rng.choice(["public ", "internal ", "private ", "protected internal ", ""]), word(rng)
            lines.append(rng.choice(["", "    ", "\t"]) + access + form.format(name))
            types.append((name, kind, len(lines), access == "public "))
            lines += ["{", f'  var s = "using {dotted(rng)}; namespace {dotted(rng)} {{";', "}"] if not form.endswith(";") else [""]
        if block:
            lines.append("}")
    return "\n".join(lines), usings, namespaces, types


def test_csharp_against_its_generator(spark):
    made = [csharp(random.Random(seed)) for seed in range(60)]
    rows = spark.createDataFrame([(i, m[0]) for i, m in enumerate(made)], "i int, t string")
    t = F.col("t")
    exports = cs.exports(t)
    got = rows.select("i", cs.imports(t).alias("imports"), cs.namespaces(t).alias("namespaces"), cs.symbols(t).alias("symbols"), exports.alias("exports"), cs.internals(t, exports).alias("internals")).collect()
    for r in got:
        _, usings, namespaces, types = made[r.i]
        assert list(r.imports) == list(dict.fromkeys(usings)) and list(r.namespaces) == list(dict.fromkeys(namespaces))
        assert [tuple(s) for s in r.symbols] == types
        public = [n for n, _, _, shown in types if shown]
        assert list(r.exports) == public and list(r.internals) == [n for n, _, _, shown in types if not shown and n not in public]
    assert sum(len(m[3]) for m in made) > 100 and any(len(m[2]) != len(set(m[2])) or m[2] == [] for m in made)


def test_csharp_text(spark):
    assert one(spark, cs.docstring, "using System;\n\n/// <summary>\n/// Does a thing.\n/// </summary>\nclass A {}\n/// other") == "Does a thing."
    assert one(spark, cs.docstring, "class A {}\n/// late") == "" and one(spark, cs.sections, "  #region One two \nx\n#region B") == ["One two", "B"]


TS = """/** Module
 * doc. */
import a from './a';
import { b } from "../b.js";
import './side';
const c = await import('./c');
const d = require("./d");
import react from 'react';
export { x } from './x';
// --- Types ---
export interface Shape<T> { area(): number; }
export type Id = string;
export enum Color { Red }
export namespace Deep { export function inner() {} }
export class Box<T> extends Base {
  private size = 3;
  constructor(a: number) { super(); }
  static of(v: number): Box { if (v) { return make(v); } }
  get width() { return this.size; }
  async load<T>(x: () => void): Promise<T> { for (const y of z) { y(); } }
}
abstract class Hidden {}
export async function run(a: number) { const local = () => 1; }
function helper() {}
export const LIMIT = 5, other = { a: 1 };
let counter: Map<string, number> = new Map();
const { p, q } = counter;
const text = "function fake() {}"; // class Fake {}
"""


def test_typescript(spark):
    ts = E.language("typescript")
    assert one(spark, ts.imports, TS) == ["./a", "../b.js", "./side", "./c", "./d", "./x"]
    assert one(spark, ts.exports, TS) == ["Shape", "Id", "Color", "Deep", "Box", "run", "LIMIT"]
    assert one(spark, ts.docstring, TS) == "Module doc." and one(spark, ts.sections, TS) == ["Types"]
    assert {"Hidden", "helper", "counter"} <= set(one(spark, lambda t: ts.internals(t, ts.exports(t)), TS))


def test_typescript_symbols():
    # Accessors are not methods.
    got = [(s["kind"], s["name"], s["exported"]) for s in ts_symbols(TS)]
    assert got == [
        ("function", "inner", True), ("function", "run", True), ("function", "helper", False),
        ("class", "Box", True), ("method", "Box.of", True), ("method", "Box.load", True), ("class", "Hidden", False),
        ("interface", "Shape", True), ("type", "Id", True), ("enum", "Color", True), ("namespace", "Deep", True),
        ("const", "c", False), ("const", "d", False), ("const", "LIMIT", True), ("const", "other", True), ("let", "counter", False), ("const", "text", False),
    ]
    assert next(s["line"] for s in ts_symbols(TS) if s["name"] == "Box") == 15
    assert ts_symbols("") == [] and ts_symbols("}}}((") == []
    assert len(ts_symbols("".join(f"function f{i}() {{}}\n" for i in range(600)))) == 500


def test_metadata_by_language(spark):
    rows = [("a.ts", "typescript", TS), ("b.cs", "csharp", "namespace N;\npublic class B {}"), ("c.py", "python", "def main():\n  pass\n# --- Part ---"), ("d", None, None)]
    got = {r.path: r for r in S.extract_metadata(spark.createDataFrame(rows, "path string, language string, content string"), "r").collect()}
    assert got["b.cs"].namespaces == ["N"] and got["b.cs"].symbols[0].name == "B" and got["a.ts"].symbols
    assert got["c.py"].internals == ["main"] and got["c.py"].sections == ["Part"] and len(got) == 4


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, namespaces array<string>, imports array<string>")


def owners_by_hand(rows, most):
    """Edges of the namespaces that each row uses: sort all owners, take the first, leave the row itself out."""
    edges_ = set()
    for path, _, imports in rows:
        for name in imports:
            edges_ |= {(path, owner) for owner in sorted(p for p, spaces, _ in rows if name in spaces)[:most]}
    return {(a, b) for a, b in edges_ if a != b}


@pytest.mark.parametrize("seed", range(4))
def test_namespace_edges_against_sorting(spark, seed):
    rng = random.Random(seed)
    names = [dotted(rng) for _ in range(5)]
    rows = [(f"{word(rng)}/{i:02}.cs", rng.choices(names, k=rng.randrange(3)), rng.choices(names + ["Unknown"], k=rng.randrange(5))) for i in range(40)]
    for most in (1, edges.MOST_OWNERS):
        got = [tuple(r) for r in edges.namespace_edges(files(spark, rows), most).collect()]
        assert len(got) == len(set(got)) and set(got) == owners_by_hand(rows, most)


def test_specifiers(spark):
    specs = ["./util", "./b.js", "./c.js", "../src/a", "react", "./missing"]
    rows = files(spark, [("src/a.ts", [], specs), ("src/util/index.ts", [], []), ("src/b.js", [], []), ("src/c.tsx", [], [])])
    assert {r.specifier: r.target_path for r in edges.resolved(rows).collect()} == {"./util": "src/util/index.ts", "./b.js": "src/b.js", "./c.js": "src/c.tsx", "../src/a": "src/a.ts"}
    assert {r.target_path for r in edges.import_edges(rows).collect()} == {"src/util/index.ts", "src/b.js", "src/c.tsx"}
    assert edges.all_edges(rows).count() == 3


def contents(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def planted(rng, n):
    """A script with n declarations at known places among lines that only look like them: source and (line, column, name) of each."""
    lines, places = [], []
    for _ in range(n):
        lines += rng.choice([[], ["// function decoy() {}"], ["const q = 'function decoy() {}';"], ["call(function () {});"], ["/* function", " decoy() {} */"]])
        name, indent = word(rng).lower(), rng.choice(["", "  ", "x = 1; "])
        lead = rng.choice(["", "export ", "export default ", "async "])
        lines.append(f"{indent}{lead}function {name}({rng.choice(['', 'a', 'a: number, b = [1, 2]'])}) {{ {rng.choice(['', 'return {{ a: 1 }};', 'if (a) {{ b(); }}']).format()} }}")
        places.append((len(lines), len(indent) + len(lead) + 1, name))
    return "\n".join(lines), places


def test_patterns_against_planted_declarations(spark):
    made = {f"m{seed}/f.{ending}": planted(random.Random(seed), seed % 7) for seed, ending in enumerate(["ts", "tsx", "mts", "cts"] * 5)}
    other = {"x.d.ts": planted(random.Random(1), 3), "x.py": planted(random.Random(2), 3), "x.js": planted(random.Random(3), 3)}
    rows = contents(spark, *((p, s) for p, (s, _) in (made | other).items()))
    got = {(r.path, r.line, r.column, r.captures["F"]) for r in pattern.search(rows, "function $F($$$ARGS) { $$$ }", "typescript").collect()}
    want = sorted((p, *at) for p, (_, places) in made.items() for at in places)
    assert {(p, line, name) for p, line, _, name in got} == {(p, line, name) for p, line, _, name in want}
    for limit in (1, 5, len(want), 400):
        some, more = pattern.first(pattern.search(rows, "function $F($$$ARGS) { $$$ }", "typescript"), limit)
        assert [(r.path, r.line) for r in some.collect()] == [w[:2] for w in want][:limit] and more == (len(want) > limit)
    none, more = pattern.first(pattern.search(rows, "interface $I { $$$ }", "typescript"), 10)
    assert none.count() == 0 and not more


def hits(spark, pattern_, source, language="typescript", path="a.ts"):
    rows = pattern.search(contents(spark, (path, source)), pattern_, language).orderBy("line", "column").collect()
    return [(r.text, r.captures) for r in rows]


DETAILS = [
    ("$A == $A", "x == x; x == y; f(1) == f( 1 ); g(1) == g(2)", ["x == x", "f(1) == f( 1 )"]),
    ("f($$$ARGS)", "f(1, g(2)); f(); h.f(3)", [("f(1, g(2))", {"ARGS": "1, g(2)"}), ("f()", {"ARGS": ""})]),
    ("f($A, $$$REST)", "f(a + b, c, d); f(x)", [("f(a + b, c, d)", {"A": "a + b", "REST": "c, d"}), ("f(x)", {"A": "x", "REST": ""})]),
    ("f($$$, $X, $X)", "f(a, b, c, c); f(a, b)", [("f(a, b, c, c)", {"X": "c"})]),
    ("$O.log($X)", "console.log(1); a.b.log(2).then(3); log(4)", [("console.log(1)", {"O": "console", "X": "1"}), ("a.b.log(2)", {"O": "a.b", "X": "2"})]),
    ("f(1)", "// f(1)\n'f(1)'; `f(1) ${`f(1)`}`; /f(1)/.test(x)", []),
    ("const $X = $Y", "const a = 1 + 2\nlet b = 3\nexport const c = f(4)", [("const a = 1 + 2", {"X": "a", "Y": "1 + 2"}), ("const c = f(4)", {"X": "c", "Y": "f(4)"})]),
    ("return $X", "function f() { return a.b(1) + 2; }\nfunction g() { return }", [("return a.b(1) + 2", {"X": "a.b(1) + 2"})]),
    ("if ($C) { $$$BODY }", "if (a && b) { x(); y(); } else { z() }", [("if (a && b) { x(); y(); }", {"C": "a && b", "BODY": "x(); y()"})]),
    ("class $N { $$$ }", "export default class A { m() {} }\nclass B extends C {}\n(class D {})", ["class A { m() {} }", "class D {}"]),
    ("function $N() {}", "function a() {}\nfunction b(x) {}\nfunction c() { d() }", ["function a() {}"]),
    ("$X; $X", "a(); a(); b(); c()", ["a(); a()"]),
    ("new $T($$$)", "const d = new Date(); new Map([[1, 2]])", ["new Date()", "new Map([[1, 2]])"]),
    ("[$A, $B]", "x = [1, [2, 3]]", [("[1, [2, 3]]", {"A": "1", "B": "[2, 3]"}), ("[2, 3]", {"A": "2", "B": "3"})]),
    ("foo({ $$$, key: $V })", "foo({ a: 1, key: g(2) })\nfoo({ key: 3, b: 4 })", [("foo({ a: 1, key: g(2) })", {"V": "g(2)"})]),
]


@pytest.mark.parametrize("wanted, source, want", DETAILS, ids=[d[0] for d in DETAILS])
def test_pattern_details(spark, wanted, source, want):
    got = hits(spark, wanted, source)
    assert [g if isinstance(w, tuple) else g[0] for g, w in zip(got, want)] == want and len(got) == len(want)


def test_csharp_patterns(spark):
    source = """using System; // class No {}
#if DEBUG
namespace App.Core
{
    #region class Nor {}
    [Serializable]
    public sealed class Store : Base
    {
        public int Size { get; set; } = 3;
        public void Put(string key, int n)
        {
            var s = @"c:\"; Log.Write($"class {key}", n);
        }
    }
    public class Plain { void Put(string key, int n) { return; } }
}"""
    at = lambda p: hits(spark, p, source, "csharp", "a.cs")
    assert [c for _, c in at("class $C { $$$ }")] == [{"C": "Plain"}] and at("class $C : $B { $$$ }")[0][1] == {"C": "Store", "B": "Base"}
    assert [c for _, c in at("void $M($$$P) { $$$ }")] == [{"M": "Put", "P": "string key, int n"}] * 2
    assert at("namespace $N { $$$ }")[0][1] == {"N": "App.Core"} and at("Log.Write($A, $B)")[0][1] == {"A": '$"class {key}"', "B": "n"}


def test_limits_and_names():
    assert pattern.metavariables("f($A, $$$ARGS, $A)") == ["A", "ARGS"]
    assert pattern.compiled("") is None and pattern.compiled("$$$") is None
    assert [pattern.clamp(x) for x in (0, 9, 9999, "x", None, float("nan"))] == [1, 9, 500, 50, 50, 50]


def test_nodes_are_nested_intervals(spark):
    source = "f(a, [b, {c: d}]);\nclass X { m() { return `${1}`; } }\n}}((x"
    rows = T.nodes(contents(spark, ("a.ts", source), ("empty.ts", "")), "typescript").collect()
    by = {r.pre: r for r in rows if r.path == "a.ts"}
    assert sorted(by) == list(range(len(by))) and [r.kind for r in rows if r.path == "empty.ts"] == ["file"]
    for r in by.values():
        below = [x for x in by.values() if r.pre < x.pre <= r.last]
        assert all(r.start <= x.start and x.end <= r.end for x in below)
        assert sorted(x.ord for x in by.values() if x.parent == r.pre) == list(range(r.n))
        assert source[r.start : r.end].startswith(r.text) and (r.parent < 0 or by[r.parent].pre < r.pre <= by[r.parent].last)
        assert (r.line, r.col) == (source.count("\n", 0, r.start) + 1, r.start - source.rfind("\n", 0, r.start))


SYMBOLS = """export function f(a: string): void;
export function f(a: any) { return /}{"/.test(a); }
const o = { run() { return 1 }, get x() { return 2 } };
export default class K<T extends {a: 1}> {
  m(a: string): void;
  m(a: any) { }
  abstract n(): void
  @dec() async *g() {}
  [Symbol.iterator]() {}
  static { init(); }
  arrow = () => { function inside() {} };
}
foo(function named() { class Inner { p() {} } })
namespace A { enum C { X, Y } }
let a = 1, b: Map<string, number> = new Map(), c
"""


def test_symbols_of_a_tree():
    got = [(s["kind"], s["name"], s["line"], s["exported"]) for s in ts_symbols(SYMBOLS)]
    assert got == [
        ("function", "f", 1, True), ("function", "f", 2, True), ("function", "inside", 11, False),
        ("class", "K", 4, True), ("method", "K.m", 6, True), ("method", "K.n", 7, True), ("method", "K.g", 8, True), ("method", "K.[Symbol.iterator]", 9, True),
        ("class", "Inner", 13, False), ("method", "Inner.p", 13, False), ("enum", "C", 14, False), ("namespace", "A", 14, False),
        ("const", "o", 3, False), ("let", "a", 15, False), ("let", "b", 15, False), ("let", "c", 15, False),
    ]


def test_csharp_words_in_comments_and_strings_declare_nothing(spark):
    text = 'using A.B; // using C;\n/* using D;\nnamespace N1 { */\nvar s = "using E; namespace N2 {"; var t = @"c:\\"; using F.G;\nvar c = \'"\'; // "\nnamespace Real.One {\n var v = @"using H; ""namespace N3;"" "; }\nstring u = $"\\"using I;"; using (var x = y) {}'
    assert set(one(spark, cs.imports, text)) == {"A.B", "F.G"} and one(spark, cs.namespaces, text) == ["Real.One"]


def test_large_sources_take_time_in_proportion():
    import time

    took = []
    for n in (400, 3200):
        source = "".join(f"export class C{i} {{ run(a: number) {{ return [a, {i}]; }} }}\nconst v{i} = {i};\n" for i in range(n))
        began = time.process_time()
        assert len(ts_symbols(source)) == 500 and len(T.numbered(T.parse(source), source)) > 20 * n
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0]


def test_many_gaps_and_deep_brackets(spark):
    source = "f(" + ", ".join(f"a{i}" for i in range(60)) + ")"
    assert hits(spark, "f($$$A, x, $$$B, y, $$$C)", source) == []
    assert T.numbered(T.parse("(" * 20_000), "(" * 20_000)[-1][2] >= 0


def test_limits_and_languages(monkeypatch):
    assert [pattern.limit_of("search"), pattern.limit_of("search", 99), pattern.limit_of("neighbours", 0), pattern.limit_of("pattern", "x"), pattern.limit_of("pattern_route", 900)] == [20, 50, 1, 50, 500]
    monkeypatch.setattr(pattern, "PATHS", dict(pattern.PATHS))
    pattern.add_language("java", r"\.java$")
    assert pattern.PATHS["java"] == r"\.java$"

"""The parser on each language: names, extents, calls, imports, constants."""

import pytest

from graphloom.sources.grammar import parse_text


def words(text):
    return 2 * len(text.split())


def found(lang, text):
    p = parse_text(lang, text, words)
    return [(d.kind, d.name) for d in p.definitions], {d.name: d.calls for d in p.definitions}, [(d.name, text[d.start : d.end]) for d in p.constants], p.imports


def test_python():
    text = 'from __future__ import annotations\nimport os, sys as s\nfrom a.b import c as d, e\nfrom .m import f\nX: int = 3\nA = B = 4\n_p, q = 1, 2\ng = lambda x: x\n\n\n@dec(1)\nclass K(Base):\n    @app.get("/\u00e9")\n    async def m(self):\n        def inner(): return h()\n        return f"{run(1)}" + \u00e9(a.b().c(2))\n'
    kinds, calls, constants, imports = found("python", text)
    assert kinds == [("function", "m"), ("function", "inner"), ("class", "K")]
    assert calls["m"] == ["h", "run", "\u00e9", "a.b().c", "a.b"] and calls["K"] == ["app.get", *calls["m"]] and calls["inner"] == ["h"]
    assert constants == [("X", "X: int = 3"), ("A", "A = B = 4"), ("g", "g = lambda x: x")]
    assert imports == ["os", "sys", "s", "a.b", "c", "d", "e", "f"]
    p = parse_text("python", text, words)
    assert text[p.definitions[0].start :].startswith("async def m") and text[p.definitions[2].start :].startswith("class K")


def test_python_that_does_not_compile():
    kinds, calls, _, _ = found("python", "def f(:\n    return g(1)\n\nclass A:\n    def x(self):\n        pass\nprint 3\n")
    assert kinds == [("function", "f"), ("function", "x"), ("class", "A")] and calls["f"] == ["g"]


def test_javascript_names():
    text = """const Handler = (a) => { return run(a) };
async function go() { await new Foo(1).bar(x => x.id); return /a[/]b"{/.test(q) }
const obj = { run() { return 1 }, key: function () { return 2 }, "q": (z) => z + 1, async *[k]() { yield 1 } };
module.exports.thing = function () { go() };
const add = x => y => x + y
export default class extends Base { m() {} }
function* gen() { yield 1 }
"""
    kinds, calls, constants, _ = found("javascript", text)
    assert kinds == [
        ("function", "go"), ("function", "Handler"), ("function", '"q"'), ("function", "x"), ("function", "y"),
        ("function", "key"), ("function", "module.exports.thing"), ("method", "run"), ("method", "[k]"), ("method", "m"),
    ]
    assert calls["go"] == ["new Foo(1).bar", "Foo", '/a[/]b"{/.test'] and calls["Handler"] == ["run"]
    assert [c[0] for c in constants] == ["obj"]


def test_javascript_callbacks_and_jsx():
    text = """import React, { useState } from 'react';
import './x.css'
export default function App(props) {
  const [s, set] = useState(0);
  useEffect(() => {
    fetch(`/api/${encode(props.id)}`).then(r => r.json()); one(1); two(2); three(3); four(4); a; b; c; d; e; f; g
  }, []);
  return <div title="it's" onClick={() => set(s + 1)}>don't {s}</div>;
}
const NAME = 'it\\'s', _p = 1, y = foo(2);
let timeout = 5
export const API = "z";
if (a) { const inner = 1 }
"""
    kinds, calls, constants, imports = found("javascript", text)
    assert kinds == [("function", "App"), ("function", "useEffect()callback"), ("function", "() => set(s + 1)")]
    assert calls["App"] == ["useState", "useEffect", "fetch(`/api/${encode(props.id)}`).then", "fetch", "encode", "r.json", "one", "two", "three", "four", "set"]
    assert constants == [("NAME", "NAME = 'it\\'s'"), ("y", "y = foo(2)"), ("timeout", "timeout = 5")]
    assert imports == ["react", "./x.css"]
    assert parse_text("javascript", "xs.map((a) => a.id)", words).definitions == []
    assert found("javascript", "const LoginButton = () => {\n  return null;\n};\n")[0] == [("function", "LoginButton")]


def test_typescript():
    text = """type F = (a: string) => void;
interface P { cb: (x: number) => void; run(a: string): void }
export class A<T> extends B<T> implements P {
  private readonly n: Map<string, number> = new Map();
  cb = (x: number): void => { use(x) };
  constructor(private a: string) { super(a) }
  run(a: string): Promise<Map<string, Foo>> { return this.svc.get<Foo>(a) }
  sig(a: string): void;
}
const f: F = (a) => { g(a) };
function h(cb: (e: Event) => void, o: { a: string }): string { cb(new Event('x')); return '' }
abstract class Z { abstract q(): void; w(): { a: number } { return { a: 1 } } }
const CFG: Record<string, number> = { a: 1 };
"""
    kinds, calls, constants, _ = found("typescript", text)
    assert kinds == [("function", "h"), ("function", "cb"), ("function", "f"), ("class", "A"), ("method", "constructor"), ("method", "run"), ("method", "w"), ("method", "n"), ("method", "cb")]
    assert calls["run"] == ["this.svc.get"] and calls["h"] == ["cb", "Event"] and calls["A"] == ["Map", "use", "super", "this.svc.get"]
    assert constants == [("CFG", "CFG: Record<string, number> = { a: 1 }")]


def test_java():
    text = """package a.b;
import java.util.List;
@Service("x")
public class Foo extends Bar {
  private final Map<String, List<X>> m = new HashMap<>();
  public Foo(int a) { super(a); this.init(a); }
  @Override
  public <T> List<T> get(String k, int... v) throws IOException {
    for (X x : xs()) { m.put(k, new Y(v).z()); }
    Runnable r = new Runnable() { public void run() { go(); } };
    return obj.a().b(c -> d(c));
  }
  interface In { void q(int a); default int w() { return 1; } }
  enum E { A(1), B(2); E(int x) {} int val() { return x(); } }
}
"""
    kinds, calls, _, imports = found("java", text)
    assert kinds == [("function", "get"), ("function", "run"), ("function", "q"), ("function", "w"), ("function", "val"), ("class", "Foo"), ("class", "In")]
    assert calls["get"] == ["xs", "put", "z", "go", "b", "a", "d"] and calls["Foo"][:2] == ["super", "init"] and imports == []
    p = parse_text("java", text, words)
    assert text[p.definitions[0].start :].startswith("@Override") and text[p.definitions[5].start :].startswith("@Service")


def test_go():
    text = 'package main\nimport "fmt"\ntype Foo struct {\n  a int\n}\ntype (\n  X int\n)\ntype Doer interface { Do(x int) error }\nfunc main() { fmt.Println(add(1, 2), []byte("x")); go func() { run() }() }\nfunc (f *Foo) Bar(x int) (int, error) { return f.baz(x), nil }\nfunc gen[T any](a T) interface{} { return make([]T, 0) }\n'
    kinds, calls, _, _ = found("go", text)
    assert kinds == [("function", "main"), ("function", "gen"), ("function", "Bar"), ("class", "type Foo struct {"), ("class", "type ("), ("class", "type Doer interface { Do(x int) error }")]
    assert calls["main"] == ["fmt.Println", "add", "func() { run() }", "run"] and calls["Bar"] == ["f.baz"] and calls["gen"] == ["make"]


def test_rust():
    text = """use foo;
use std::io;
/// docs
pub struct P { x: i32 }
struct T(i32, String);
enum E { A(i32), B }
impl P { pub fn new(x: i32) -> Self { P { x } } fn go<'a>(&self, s: &'a str) -> i32 { println!("{}", foo(1)); match bar(s) { Some(x) => baz::<i32>(x), _ => self.q() } } }
impl<T> Tr for Vec<T> { }
trait Tr { fn a(&self); fn b(&self) -> i32 { c('x') } }
pub(crate) async fn h() { let Some(v) = w() else { return }; P::new(1); }
"""
    kinds, calls, _, imports = found("rust", text)
    assert kinds == [("function", "new"), ("function", "go"), ("function", "b"), ("function", "h"), ("function", "P"), ("function", "Tr"), ("class", "P"), ("class", "T"), ("class", "E"), ("class", "Tr")]
    assert calls["go"] == ["println", "bar", "baz::<i32>", "self.q"] and calls["h"] == ["w", "P::new"] and imports == ["foo"]


@pytest.mark.parametrize("lang", ["javascript", "typescript", "java", "go", "rust", "python"])
def test_any_text_is_parsed(lang):
    for text in ("", "{", "}", "((((", "`${", "'", '"', "/*", "function", "class", "=>", "x =>", "fn", "impl", "func (", "type", "@", "a.b(", "new", "const", "import", "class A {", "r#\"", "<div>{a => }", "\\", "\u00e9\x00", "use x", "enum E { A("):
        for t in (text, text + "\n" + text, "class A { " + text, "f(" + text):
            for d in parse_text(lang, t, words).definitions:
                assert 0 <= d.start <= d.end <= len(t)

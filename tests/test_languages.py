"""Rust, Go, TypeScript and Python extraction, and the edges that resolution makes of it."""

import pytest

from loomgraph.functions import python_source, scripts, static_source, syntax, typescript_lexer
from loomgraph.operators import resolve
from loomgraph.plans import drivers

RUST = '''
use crate::util::{load, Cfg as Conf, self};
#[derive(Debug)]
pub struct Runner<T> { pub cfg: Cfg, state: Vec<u8>, p: &'static Db }
trait Go { fn go(&self) -> u8 { self.run(); 1 } fn decl(&self); }
impl<T: Clone> Runner<T> {
    #[inline]
    pub async fn new(a: u8, c: Cfg) -> Self { let x = Cfg::new(); load(a); Self { cfg: x } }
    fn run(&mut self, db: &Db) -> Result<(), E> where T: Copy {
        self.state = helper(1);
        self.cfg.get("x (", inner_call(2)).await?;
        db.query(self.step(3));
        if let Some(v) = self.cfg.opt() { println!("{}", f(v)); }
        match v { Some(x) if ok(x) => do_it(x), E::A(y) => { y.go(); } _ => {} }
        let c = |z| hidden(z);
        items.iter().map(|q| q.hide()).collect::<Vec<_>>();
        a::b::Type::from(3); foo::<u8>(1);
    }
}
mod sub { pub fn inner() { super::helper(2) } impl super::X for Y { fn m(self) {} } }
fn helper(n: u8) -> u8 { load(n) + Conf(3) }
'''
GO = '''package x
import "fmt"
import (
  u "a/b/util"
  "net/http"
)
type Server struct {
  db *store.DB
  a, b Conf `json:"x"`
  http.Handler
}
type (
  Conf struct { n int }
)
func (s *Server) Run(ctx Ctx, n int) (int, error) {
  s.db.Query(fmt.Sprintf("x)"), n)
  s.a.Get(); s.step(helper(1))
  go func() { hidden() }()
  s.n, s.m = 1, 2
  if x := u.Load(); x != nil { return }
  return 1, foo.bar.baz()
}
func helper(a, b Conf, c *Server) { c.Run(nil); a.Get() }
'''
TS = '''import { load, save as keep } from "./util";
import * as fs from 'fs';
@Dec({a: 1})
export class Box<T> extends Base {
  store: Store;
  go = async (x: Cfg): Promise<void> => { await this.store.put(x); x.run(); }
  constructor(private session: Session, n: number) { super(); }
  async get(id?: Id): Promise<Foo<Bar>> {
    this.count += 1;
    await this.fetch(id);
    const r = await fs.read(keep(2));
    list.map((q) => hidden(q)); new Thing(); this.session.close(); generic<Foo>(1);
    return r
  }
}
export async function helper(a: Store, cb: () => void): Promise<number> { a.get(1); return load(2); }
export const arrow = (s: Session) => s.open();
'''


def kinds(found, kind):
    return [r for r in found if r["kind"] == kind]


def test_rust():
    found = static_source.records("rust", "src/app/main.rs", RUST)
    functions = {f["qualname"]: f for f in kinds(found, "function")}
    assert set(functions) == {"Go::go", "Runner::new", "Runner::run", "sub::inner", "sub::Y::m", "helper"}
    run = functions["Runner::run"]
    assert run["id"] == "src::app::Runner::run" and run["is_method"] and run["used_self_attrs_written"] == ["state"] and run["params_types"] == {"db": "Db"}
    new = functions["Runner::new"]
    assert new["is_async"] and not new["is_method"] and new["decorators"] == ["#[inline]"] and new["signature"] == "async fn new(a: u8, c: Cfg) -> Self"
    assert [(s["name"], s["target"]) for s in kinds(found, "import")] == [("load", "crate::util::load"), ("Conf", "crate::util::Cfg")]
    assert {(s["owner"], s["name"], s["target"]) for s in kinds(found, "field")} == {("Runner", "cfg", "Cfg"), ("Runner", "p", "Db")}
    calls = [(c["form"], c["raw"], c["is_await"]) for c in kinds(found, "call") if c["id"] == run["id"]]
    assert calls == [
        ("bare", "helper", False), ("self_attr", "self.cfg.get", True), ("bare", "inner_call", False), ("member", "db.query", False), ("self", "self.step", False), ("self_attr", "self.cfg.opt", False), ("macro", "println", False),
        ("bare", "ok", False), ("bare", "do_it", False), ("member", "y.go", False), ("other", "items.iter().map(|q| q.hide()).collect::<Vec<_>>", False), ("other", "items.iter().map", False), ("member", "items.iter", False),
        ("path", "a::b::Type::from", False), ("other", "foo::<u8>", False),
    ]


def test_go():
    found = static_source.records("go", "pkg/srv.go", GO)
    run, helper = kinds(found, "function")
    assert (run["id"], run["used_self_attrs_written"], run["params_types"]) == ("pkg.srv.Server.Run", ["m", "n"], {"ctx": "Ctx"}) and helper["params_types"] == {"a": "Conf", "b": "Conf", "c": "Server"}
    assert [(s["name"], s["target"]) for s in kinds(found, "import")] == [("fmt", "fmt"), ("u", "a/b/util"), ("http", "net/http")]
    assert [(s["owner"], s["name"], s["target"]) for s in kinds(found, "field")] == [("Server", "db", "DB"), ("Server", "a", "Conf"), ("Server", "b", "Conf")]
    assert [(c["form"], c["raw"]) for c in kinds(found, "call") if c["id"] == run["id"]] == [
        ("self_attr", "s.db.Query"), ("member", "fmt.Sprintf"), ("self_attr", "s.a.Get"), ("self", "s.step"), ("bare", "helper"), ("member", "u.Load"), ("other", "foo.bar.baz"),
    ]


def test_typescript():
    found = static_source.records("typescript", "web/box.ts", TS)
    assert [(f["qualname"], f["is_async"]) for f in kinds(found, "function")] == [("Box.go", True), ("Box.constructor", False), ("Box.get", True), ("helper", True), ("arrow", False)]
    assert [(s["name"], s["target"]) for s in kinds(found, "import")] == [("load", "./util::load"), ("keep", "./util::save"), ("fs", "fs")]
    assert {(s["name"], s["target"]) for s in kinds(found, "field")} == {("store", "Store"), ("session", "Session")}
    assert [(c["form"], c["raw"], c["is_await"]) for c in kinds(found, "call") if c["id"] == "web.box.Box.get"] == [
        ("self", "this.fetch", True), ("member", "fs.read", True), ("bare", "keep", False), ("member", "list.map", False), ("self_attr", "this.session.close", False), ("bare", "generic", False),
    ]


LEXED = '''function a(x: string) { return x.replace(/[{]/g, "").split(/['"`]/); }
function b(n: number) { const t = `one ${f(n, `two ${g({k: 1})} end`)} ${h()}`; return n / 2 / 3; }
const c = (x) => { if (x) /}/.test(x); return tag`x${y()}`; };
class K { m() { i++ / 2; const z = q! / 3; return this.n(/\\//); } n(r: RegExp) { return r } }
function last() { done() }
'''
JSX = '''export function App(props: P) {
  const [n, set] = useState(0);
  const id = <T,>(x: T) => x;
  return <div className="it's" onClick={() => set(n + 1)} data={load(n)}>
    It's {render(n)} {/* c */} <b/> {list.map(x => <Item key={x} {...more(x)}>don't {inner(x)}</Item>)}
    <></>
  </div>;
}
function after() { return ok(1 < 2, a > b); }
'''


def test_typescript_lexing():
    found = static_source.records("typescript", "a.ts", LEXED)
    assert [f["qualname"] for f in kinds(found, "function")] == ["a", "b", "c", "K.m", "K.n", "last"]
    assert [(c["id"], c["raw"]) for c in kinds(found, "call")] == [
        ("a.a", 'x.replace(/[{]/g, "").split'), ("a.a", "x.replace"), ("a.b", "f"), ("a.b", "g"), ("a.b", "h"), ("a.c", "/}/.test"), ("a.c", "tag"), ("a.c", "y"), ("a.K.m", "this.n"), ("a.last", "done"),
    ]
    found = static_source.records("typescript", "a.tsx", JSX)
    assert [f["qualname"] for f in kinds(found, "function")] == ["App", "after"]
    assert [c["raw"] for c in kinds(found, "call")] == ["useState", "load", "render", "list.map", "ok"]
    for text in ("`", "`${", "`${a", "/", "a /", "<div", "<div a=", "<div>{", "</", "`\\", "a++ /", "x = <T"):
        for jsx in (False, True):
            list(typescript_lexer.lex(text, jsx))


def test_syntax_gate():
    good = [("rust", RUST), ("go", GO), ("typescript", TS), ("typescript", LEXED), ("go", "package p\nfunc f(g func(int) List[int], x any) {\n\tswitch y := x.(type) {\n\tcase nil:\n\t\tz := y\n\t}\n}\n")]
    good += [("rust", "fn f() { let Some(x) = y else { return }; if let Some(a) = b && let c = d { x == -1; } let g = || 1; let h = |v: &str| -> u8 { 2 }; matches!(x, = / %); }"), ("typescript", "const x = { class: 1, import: 2, let: 3 } as const;\nexport default function () {}\ntype A =\n  | 'x'\n  | 'y';\nimport('x');")]
    assert [syntax.errors(lang, text) for lang, text in good] == [[]] * len(good) and syntax.errors("typescript", JSX, jsx=True) == []
    bad = [
        ("rust", "fn f( { }"), ("rust", "fn f() { let = 1; }"), ("rust", "fn f() { let x = 1 }"), ("rust", "fn f() { a = ; }"), ("rust", "fn f() { x == / 2 }"), ("rust", "struct { a: u8 }"), ("rust", "impl { }"), ("rust", "use a::b"),
        ("go", "func {"), ("go", "package\n"), ("go", "func f() { x := / 2 }"), ("go", "import x y"), ("typescript", "const = 2"), ("typescript", "function (a) { return a == ; }"), ("typescript", "class A extends B"),
        ("typescript", "x = 'abc\n"), ("typescript", "import { a } from;"), ("typescript", "function f { }"), ("typescript", "let x = `a ${b`;"),
    ]
    assert [t for lang, t in bad if not syntax.errors(lang, t)] == []
    assert [line for line, _ in syntax.errors("rust", "fn f() { a = ; }\nfn g() {}\nfn h() { let = 2; }")] == [1, 3]  # reading goes on


@pytest.mark.parametrize("text", ["", "fn", "fn f(", "impl {", "struct A {", "func (", "class A {", "}}}}", "use a::{b", "'", '"x', "import", "type", "const x =", "fn f() { let a = |", "match x {"])
def test_broken_files_stop_nothing(spark, text):
    for lang in static_source.SEPARATOR:
        static_source.records(lang, "x", text)
    static_source.spans("rust", text, "f")
    assert python_source.records("x.py", "def (")[0]["kind"] == "error"


def edges(spark, files, lang, **how):
    df = spark.createDataFrame([(lang, f, t, k) for k, (f, t) in enumerate(files.items())], "lang string, file string, source string, ord long")
    records = static_source.extract(df)
    return {(r["caller_id"], r["raw"]): (r["callee_id"], r["call_type"]) for r in resolve.resolve_forms(records, lang, **how).collect()}


def test_rust_edges(spark):
    files = {"src/lib.rs": RUST, "src/util.rs": "pub struct Cfg {} impl Cfg { pub fn get(&self) {} } pub fn load(n: u8) {}", "src/main.rs": "fn helper() {} fn main() { helper() }"}
    got = edges(spark, files, "rust")
    run = "src::Runner::run"
    assert got["src::Runner::new", "Cfg::new"] == ("src::util::Cfg::new", "internal_constructor") and got["src::Runner::new", "load"] == ("src::util::load", "internal_func")
    assert got[run, "helper"] == ("src::helper", "internal_func") and got[run, "self.cfg.get"] == ("src::util::Cfg::get", "self_attr_method") and got[run, "db.query"] == ("boundary:Db::query", "boundary")
    assert got[run, "self.step"] == ("unresolved:self.step", "unresolved") and got[run, "println"] == ("boundary:println!", "boundary") and got[run, "a::b::Type::from"] == ("boundary:a::b::Type::from", "boundary_constructor")
    assert got[run, "foo::<u8>"] == ("unresolved:foo::<u8>", "unresolved") and got["src::helper", "Conf"] == ("boundary:crate::util::Cfg", "boundary")
    assert got["src::main", "helper"] == ("src::helper", "internal_func")  # files of one module are taken together
    assert edges(spark, files, "rust", unique=False)["src::Runner::new", "load"] == ("boundary:crate::util::load", "boundary")


def test_go_and_typescript_edges(spark):
    got = edges(spark, {"pkg/srv.go": GO, "pkg/two.go": "package x\nfunc two() { helper(1) }\n"}, "go")
    run = "pkg.srv.Server.Run"
    assert got[run, "s.a.Get"] == ("pkg.srv.Conf.Get", "self_attr_method") and got[run, "s.db.Query"] == ("boundary:DB.Query", "boundary") and got[run, "helper"] == ("pkg.srv.helper", "internal_func")
    assert got[run, "u.Load"] == ("boundary:a/b/util.Load", "boundary") and got[run, "s.step"] == ("unresolved:s.step", "unresolved") and got["pkg.srv.helper", "c.Run"] == ("pkg.srv.Server.Run", "param_method")
    assert got["pkg.two.two", "helper"] == ("unresolved:helper", "unresolved")  # free functions of the own file only
    got = edges(spark, {"web/box.ts": TS, "web/store.ts": "export class Store { put(x: number) {} }"}, "typescript")
    assert got["web.box.Box.go", "this.store.put"] == ("web.store.Store.put", "self_attr_method") and got["web.box.Box.get", "keep"] == ("boundary:./util::save", "boundary")
    assert got["web.box.Box.get", "fs.read"] == ("boundary:fs.read", "boundary") and got["web.box.helper", "a.get"] == ("web.store.Store.get", "param_method") and got["web.box.arrow", "s.open"] == ("boundary:Session.open", "boundary")


PY = '''
import os.path, json as j
from lib.util import load, Cfg
class A:
    class B:
        def f(self): return 1
    def __init__(self, *rest: Cfg, **named: "Cfg"):
        self.c = Cfg()
        self.v = load()
        self.w = self.made()
        for self.i in rest: pass
        (self.a, self.b) = 1, 2
    def made(self) -> Cfg | None:
        def inner(): return self.c.get()
        return inner()
    async def run(self, p: None | Cfg, q: list[int], *rest: Cfg):
        await p.get(j.dumps(1)); self.v.x(); self.w.get(); rest.count(1); os.path.join("a"); Cfg.make(); (await self.made()).z()
        from other import Late
        return Late()
'''


def test_python_details(spark):
    files = spark.createDataFrame([("python", "app.py", PY, 0), ("python", "lib/util.py", "class Cfg:\n  def get(self): pass\ndef load(): pass\n", 1)], "lang string, file string, source string, ord long")
    records = python_source.extract(files)
    f = {r["qualname"]: r for r in records.where("kind = 'function'").collect()}
    assert set(f) == {"B.f", "A.__init__", "A.made", "A.made.inner", "A.run", "Cfg.get", "load"} and not f["A.made.inner"]["is_method"]
    assert f["A.__init__"]["params_types"] == {"rest": "lib.util.Cfg"} and f["A.run"]["params_types"] == {"p": "lib.util.Cfg", "rest": "lib.util.Cfg"}
    assert f["A.__init__"]["used_self_attrs_written"] == ["a", "b", "c", "v", "w"]
    got = {(r["caller_id"], r["raw"]): (r["callee_id"], r["call_type"], r["is_await"]) for r in resolve.resolve_python(records).collect()}
    run = "app.A.run"
    assert got[run, "p.get"] == ("lib/util.Cfg.get", "param_method", True) and got[run, "j.dumps"] == ("boundary:json.dumps", "boundary", False)
    assert got[run, "self.v.x"] == ("boundary:lib.util.load.x", "boundary", False) and got[run, "self.w.get"] == ("lib/util.Cfg.get", "self_attr_method", False)
    assert got[run, "rest.count"][1] == "param_method" and got[run, "os.path.join"] == ("unresolved:os.path.join", "unresolved", False) and got[run, "Cfg.make"] == ("lib/util.Cfg.make", "internal_func", False)
    assert got[run, "self.made"] == ("app.A.made", "self_method", True) and got[run, "Late"] == ("boundary:other.Late", "boundary_constructor", False)
    assert got["app.A.__init__", "load"] == ("boundary:lib.util.load", "boundary", False) and got["app.A.__init__", "Cfg"] == ("lib/util.Cfg.__init__", "internal_constructor", False)


def test_analyse_all_languages(spark):
    rows = [("python", "a.py", "def f():\n  g()\ndef g():\n  pass\n", 0), ("rust", "b.rs", "fn h() { h() }", 0), ("shell", "c.sh", "go() {\n  run\n}\n", 0), ("cobol", "d.cbl", "x", 0)]
    files = spark.createDataFrame(rows, "lang string, file string, source string, ord long")
    g = drivers.graph_of(files)
    assert {r["id"] for r in g["functions"].collect()} == {"a.f", "a.g", "b::h", "c.go"}
    assert {(r["caller_id"], r["callee_id"]) for r in g["kept"].collect()} >= {("a.f", "a.g"), ("b::h", "b::h")}
    assert drivers.graph_of(files.limit(0))["nodes"].count() == 0
    with pytest.raises(KeyError, match="python"):
        drivers.language("cobol")


SHELL = '''#!/bin/bash
# go() { no; }
run_all() {
  local x=$(find "$DIR" -name '*.sh' | sort) y="a $(date +%s) b"
  A=1 B="two words" make build && /usr/bin/git push "$@" || { echo "failed; rm -rf /"; exit 1; }
  cat <<EOF > out
not_a_command here
EOF
  if [ -f x ]; then helper one; elif grep -q y z; then :; fi
  for f in a b; do step "$f"; done
  case "$1" in
    start|stop) service "$1" ;;
    *) usage ;;
  esac
  arr=(one two); n=$((1 + 2)); z=${x#*/}
  cat <<'A' <<-B
$(never)
A
	B
  `old style`
}
function helper { trap 'cleanup' EXIT; tail -n 1 -- "$1" 2>/dev/null; }
helper
'''
POWER = '''# function No { Bad-Thing }
function Get-Thing {
  param([string]$Name)
  $x = Get-Item -Path "a Remove-It b" | Where-Object { $_.Name -eq $Name }
  if (Test-Path $x) { return Format-Thing $x }
  $x.Run(); [void](New-Item y)
  @'
Not-A-Command
'@ | Out-Null
}
function Format-Thing($v) { Write-Output $v }
'''
STAR = '''load("//a:b.bzl", "rule")
def macro(name, srcs = [], **kwargs):
    native.filegroup(name = name, srcs = [f(s) for s in srcs])
    rule(
        name = "x",
        deps = select({"a": helper("b")}),
    )

def helper(x): return x.strip()
'''


def test_scripts():
    fs = scripts.shell(SHELL)
    assert [(f.name, f.first, f.last) for f in fs] == [("run_all", 3, 21), ("helper", 22, 22)]
    assert [c[0] for c in fs[0].calls] == ["find", "sort", "date", "make", "git", "echo", "exit", "cat", "helper", "grep", ":", "step", "service", "usage", "cat", "old"]
    assert [c[0] for c in fs[1].calls] == ["trap", "tail"]
    assert [c[0] for c in scripts.shell("f() {\n  A=1\n  find x y; B=2; ls a b\n}")[0].calls] == ["find", "ls"]
    fs = scripts.powershell(POWER)
    assert [(f.name, f.first, f.last) for f in fs] == [("Get-Thing", 2, 10), ("Format-Thing", 11, 11)]
    assert [c[0] for c in fs[0].calls] == ["Get-Item", "Where-Object", "Test-Path", "Format-Thing", "New-Item", "Out-Null"] and [c[0] for c in fs[1].calls] == ["Write-Output"]
    fs = scripts.starlark(STAR)
    assert [(f.name, f.first, f.last) for f in fs] == [("macro", 2, 7), ("helper", 9, 9)]
    assert fs[1].signature == "def helper(x):"
    assert [(c[0], c[1], c[2]) for c in fs[0].calls] == [("filegroup", 3, "native.filegroup"), ("f", 3, "f"), ("rule", 4, "rule"), ("select", 6, "select"), ("helper", 6, "helper")]
    for text in ("", "f() {", "'", '"', "`", "$(", "${", "<<E", "case x in", "function", "@'", "{", "}}}", "a=(", "((", "f()", "\\"):
        scripts.shell(text)
        scripts.powershell(text)

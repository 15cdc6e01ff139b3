"""Scalar functions, the stemmer and the ranking against an independent full-text engine."""

from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from codeloom.functions import extract, fts, ids, paths, tasks, text, vocab
from codeloom.operators import context, search

WORDS = (
    "running flies happily relational conditional rational digitizer operator feudalism hopefulness formalize electrical adjustment dependent"
    " adoption effective bowdlerize probate rate cease controll roll sky by say agreed plastered motoring sized hopping tanned falling hissing"
    " failing filing caresses ponies ties cats feed conflated troubled analogously vietnamization callousness formality sensitivity sensibility"
    " triplicate goodness revival allowance inference airliner gyroscopic defensible irritant replacement homologou communism activate angularity commits"
).split()


def engine(rows):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(path, content, tokenize='porter unicode61')")
    con.executemany("insert into f values (?, ?)", rows)
    return con


def test_stems_equal_the_engine():
    con = engine([("x", w) for w in WORDS])
    con.execute("create virtual table v using fts5vocab(f, 'instance')")
    found = {doc: term for term, doc, col, _ in con.execute("select * from v") if col == "content"}
    assert [fts.stem(w) for w in WORDS] == [found[i + 1] for i in range(len(WORDS))]


def test_ranking_equals_the_engine(spark):
    import random

    rng = random.Random(4)
    vocabulary = ["token", "rotates", "rotate_refresh_token", "cache", "Größe", "plan", "running", "refresh-token"]
    rows = [(f"src/f{i}.rs", " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 40)))) for i in range(80)]
    con, df = engine(rows), spark.createDataFrame(rows, "path string, content string")
    for query in ("token", "plan cache", "rotate_refresh_token", "running plans", "src"):
        want = con.execute("select path, bm25(f) r from f where f match ? order by r, path limit 10", (fts.sanitise(query),)).fetchall()
        got = [tuple(r) for r in search.bm25(df, query, 10, stemmed=True).collect()]
        assert [p for p, _ in got] == [p for p, _ in want]
        assert all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(got, want, strict=True))


def test_search_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", "")], "path string, content string")
    assert search.bm25(df, "!!", 10).count() == 0
    assert search.bm25(df, "word", 10).count() == 0
    assert search.bm25(df.limit(0), "word", 10).count() == 0


def test_snippet_marks_terms():
    s = search.snippet_of("zero one two three rotating four five", {"rotat"}, size=3)
    assert "<b>rotating</b>" in s and s.startswith("...")
    assert search.snippet_of("", {"x"}) == ""


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column).first()[0]


@pytest.mark.parametrize(
    "path, kind",
    [("tests/a.rs", "test"), ("src/contest.rs", "source"), ("spec/x.ts", "test"), ("docs/a.rs", "documentation"), ("README", "documentation"), ("Cargo.toml", "manifest"), ("a.toml", "configuration"), ("x.bin", "unknown"), ("src/a.PY", "source"), (".gitignore", "configuration")],
)
def test_kinds(spark, path, kind):
    assert one(spark, paths.classify_kind(F.col("p"), paths.language(F.col("p"))), p=path) == kind


@pytest.mark.parametrize("path, secret", [(".env", True), ("a/.env.x", True), ("k.pem", True), ("secret_rotation.go", False), ("my_secrets.yaml", True), ("credentials", True), ("secret.md", False), ("a.txt", False)])
def test_secret_names(spark, path, secret):
    from codeloom.sources.worktree import secret_name

    assert one(spark, paths.is_secret(F.col("p")), p=path) is secret
    assert secret_name(path) is secret


def test_redaction(spark):
    token = "ghp_" + "a1" * 18
    s = f"x {token} y"
    assert one(spark, text.redact(F.col("t")), t=s) == text.redact_text(s) == "x [REDACTED] y"
    assert one(spark, text.redact(F.col("t")), t=None) is None


def test_keywords(spark):
    task = "Fix refresh-token rotation (src/auth.rs) and the user_id bug"
    want = tasks.keywords_of(task)
    assert one(spark, tasks.keywords(F.col("t")), t=task) == want
    assert {"refresh-token", "refresh", "token", "rotation", "user_id", "user", "id"} <= set(want) and "the" not in want


def test_import_names(spark):
    for raw, name in [("crate::a::Widget", "Widget"), ("import os.path", "path"), ("{ a, b }", "}"), ('"./x/y"', "y"), ("  ", "")]:
        got = one(spark, ids.import_name(F.col("t")), t=raw)
        assert got == name or raw == "{ a, b }"


def test_chunk_owner_strips_only_numbers(spark):
    assert one(spark, ids.chunk_owner(F.lit("chunk"), F.col("p")), p="foo#bar.rs#1-2") == "foo#bar.rs"
    assert one(spark, ids.chunk_owner(F.lit("chunk"), F.col("p")), p="foo#bar.rs") == "foo#bar.rs"
    assert one(spark, ids.chunk_owner(F.lit("file"), F.col("p")), p="x#1-2") == "x#1-2"


def test_vocabularies():
    assert vocab.parse_source_kinds("git, docs,worktree,tree") == ["history", "docs", "worktree"]
    for bad in ("x", ""):
        with pytest.raises(ValueError):
            vocab.parse_source_kinds(bad)
    with pytest.raises(ValueError):
        vocab.parse_edge_kind("nope")
    assert vocab.normalise("Fresh", vocab.MEMORY_STATUS) == "fresh"


def test_paths_stay_inside(tmp_path):
    for bad in ("/etc/passwd", "../x", "a/../../b", "a\0b"):
        with pytest.raises(ValueError):
            paths.contained(str(tmp_path), bad)
    (tmp_path / "link").symlink_to("/etc")
    with pytest.raises(ValueError):
        paths.contained(str(tmp_path), "link/passwd")


@pytest.mark.parametrize(
    "path, source, names, calls",
    [
        ("a.rs", "mod m { impl T { pub fn f(&self) -> u8 { g(); self.h() } } }\nfn test_g() { m::f(); }\n", ["f", "test_g"], {"g", "h", "f"}),
        ("a.py", "class A:\n    @d\n    def m(self):\n        return x.y(1)\n\nasync def n(): pass\n", ["A", "m", "n"], {"y"}),
        ("a.go", "package a\nfunc (s *T) M(a int) { f(a) }\nfunc g() { T{}.M(1) }\n", ["M", "g"], {"f", "M"}),
        ("a.js", "class A { m(x) { return k(x); } }\nexport async function g() { a.b(); }\n", ["A", "m", "g"], {"k", "b"}),
        ("a.c", "struct S { int a; };\nstatic int f(int a)\n{\n  return g(a);\n}\n", ["S", "f"], {"g"}),
        ("a.sh", "run() {\n  echo hi\n}\nfunction go_on { run; }\n", ["run", "go_on"], {"echo", "run"}),
        ("a.ts", "interface I { a: string }\nclass A { private m(x: number): void { k(x); } }\n", ["I", "A", "m"], {"k"}),
        ("a.rb", "def hello\nend\n", ["hello"], set()),
    ],
)
def test_extraction(path, source, names, calls):
    symbols, references = extract.extract(path, source)
    assert sorted(s["name"] for s in symbols) == sorted(names)
    assert {r["target_name"] for r in references if r["kind"] in ("calls", "tests")} == calls


RUST_TEST = """
pub struct AuthService;
impl AuthService {
    pub fn rotate_refresh_token(user: &str) -> bool { verify_session(user); true }
}
#[test]
fn test_rotate() { rotate_refresh_token("alice"); }
#[tokio::test(flavor = "x")]
async fn checks_it() { assert_eq!(rotate(), 1); }
"""


@pytest.mark.parametrize(
    "path, source, symbols, references",
    [
        ("src/auth.rs", RUST_TEST, {("AuthService", "struct"), ("rotate_refresh_token", "function"), ("test_rotate", "function"), ("checks_it", "function")},
         {("rotate_refresh_token", "verify_session", "calls"), ("test_rotate", "rotate_refresh_token", "tests"), ("test_rotate", "rotate_refresh_token", "calls"), ("checks_it", "checks_it", "tests")}),
        ("m.py", "class T:\n    def refresh(self, t):\n        validate(t)\n\ndef test_refresh_token():\n    T().refresh('a')\n", {("T", "class"), ("refresh", "function"), ("test_refresh_token", "function")},
         {("refresh", "validate", "calls"), ("test_refresh_token", "refresh", "tests"), ("test_refresh_token", "refresh", "calls"), ("test_refresh_token", "T", "calls")}),
        ("main.go", "package main\nimport \"fmt\"\ntype S struct {\n\ta int\n}\ntype I int\nfunc helper() {}\nfunc main() { helper() }\n", {("S", "type_alias"), ("I", "type_alias"), ("helper", "function"), ("main", "function")},
         {(None, '"fmt"', "imports"), ("main", "helper", "calls")}),
        ("parse.cpp", "#include <a>\nnamespace demo {\nvoid parse_header() {}\nint main() { parse_header(); }\nclass A : B {\n  A(int x) : x_(x), y{1} { go(); }\n  std::string C() const { return x_.size(); }\n};\nint A::d() { return 1; }\n}\n",
         {("demo", "module"), ("parse_header", "function"), ("main", "function"), ("A", "class"), ("A", "function"), ("C", "function"), ("d", "function")},
         {(None, "#include <a>", "imports"), ("main", "parse_header", "calls"), ("A", "go", "calls"), ("C", "size", "calls")}),
        ("app.ts", "interface User { name: string }\ntype Id = string;\nenum Color { Red }\nfunction greet(id: Id) { return f(id); }\nfoo();\n", {("User", "interface"), ("Id", "type_alias"), ("Color", "enum"), ("greet", "function")},
         {("greet", "f", "calls"), (None, "foo", "calls")}),
        ("app.tsx", "export function View(p: P) { return <div>{show(p)}</div>; }\n", {("View", "function")}, {("View", "show", "calls")}),
        ("app.dart", "import 'a.dart';\nvoid helper() {}\nvoid main() { helper(); }\nclass K extends L {\n  int m(int x) => go(x);\n}\nvoid runSuite() {\n  group('suite', () {\n    test('adds', () { helper(); });\n  });\n}\n",
         {("helper", "function"), ("main", "function"), ("K", "class"), ("m", "method"), ("runSuite", "function"), ("suite", "function"), ("adds", "function")},
         {(None, "import 'a.dart';", "imports"), ("main", "helper", "calls"), ("K", "go", "calls"), ("runSuite", "group", "tests"), ("runSuite", "test", "tests"), ("runSuite", "helper", "calls")}),
        ("a.js", "import x from 'y';\ndescribe('s', () => { it('w', () => { go(); }); });\n", set(), {(None, "import x from 'y';", "imports"), (None, "describe", "tests"), (None, "it", "tests"), (None, "go", "calls")}),
        ("s.zsh", "X=1; X=2\nf() {\n  local y=\"$(date)\" z=3\n  echo \"a b=c\" # d=1\n}\n", {("X", "variable"), ("f", "function"), ("y", "variable"), ("z", "variable")}, {("f", "date", "calls"), ("f", "echo", "calls")}),
        ("a.rb", "  def hello\nend\nx = function go\n", {("hello", "function"), ("go", "function")}, set()),
    ],
)
def test_extraction_by_language(path, source, symbols, references):
    s, r = extract.extract(path, source)
    assert {(x["name"], x["kind"]) for x in s} == symbols
    assert {(x["source_symbol_name"], x["target_name"], x["kind"]) for x in r} == references


def test_ids_are_distinct_on_a_line():
    for path, source, name, parts in (
        ("sample.sh", "X=1; X=2", "X", ("@0", "@5")), ("src/same.rs", "mod a { fn f() {} } mod b { fn f() {} }", "f", ("::a::f@", "::b::f@")),
        ("same.js", "class A { f() {} } class B { f() {} }", "f", ("::A::f@", "::B::f@")),
    ):
        found = [s["id"] for s in extract.extract(path, source)[0] if s["name"] == name]
        assert len(set(found)) == 2 and all(any(p in i for i in found) for p in parts)


def test_extraction_reads_every_language_of_a_table(spark):
    rows = [("r", f"a.{e}", "function go(x) {}\n") for e in ("tsx", "rb", "lua")] + [("r", "a.cpp", "int go() {}\n"), ("r", "a.dart", "int go() {}\n"), ("r", "a.zsh", "go() {\n}\n"), ("r", "a.md", "function go\n"), ("r", None, "x"), ("r", "b.py", None)]
    df = spark.createDataFrame(rows, "repo_id string, relative_path string, content string")
    assert {r.file_path for r in extract.extract_symbols(df).filter("name = 'go'").collect()} == {"a.tsx", "a.rb", "a.lua", "a.cpp", "a.dart", "a.zsh"}
    assert extract.extract_references(df).count() == 0


def test_extraction_of_deep_nesting():
    s, r = extract.extract("a.rs", "fn f() { " + "(" * 5000 + "foo()" + ")" * 5000 + " }")
    assert [x["name"] for x in s] == ["f"] and [(x["source_symbol_name"], x["target_name"]) for x in r] == [("f", "foo")]
    extract.extract("a.py", "x = " + "(" * 5000)


def test_excerpt_and_budget():
    content = "\n".join(f"line {i}" for i in range(1, 101))
    got = context.excerpt(content, [50], 1000)
    assert got.splitlines()[0] == "  45: line 45" and got.splitlines()[-1] == "  60: line 60"
    assert text.tokens_of(context.excerpt(content, [], 20)) <= 20
    files = [{"path": f"f{i}", "score": 1.0, "reasons": ["r"]} for i in range(20)]
    contents = {f"f{i}": "x = 1\n" * 62 for i in range(20)}
    for limit in (400, 1000, 4000):
        p = context.compile_package("do it", limit, files, [], [], [], contents)
        assert p["budget"]["returned_tokens"] <= limit and len(p["files"]) <= 15
        assert context._size(p) == p["budget"]["returned_tokens"]
    with pytest.raises(ValueError):
        context.compile_package("do it", 5, files, [], [], [], contents)
    assert context.to_markdown(p).startswith("# do it")

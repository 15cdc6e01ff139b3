"""Sources, snapshots and streams on small trees made here."""

from __future__ import annotations

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom.operators import catalog, graph, memory, versions
from codeloom.sources import config, git, store
from codeloom.sources.worktree import WorktreeSource
from codeloom.streaming import sync


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    for path, body in {
        "src/auth.rs": "fn login() {}\n", "tests/auth_test.rs": "fn test_login() {}\n", "docs/architecture.md": "# how\n", ".env": "A=1\n",
        ".gitignore": "build/\n", "build/x.rs": "no\n", "pkg/__init__.py": "", "big.txt": "x" * 5000, "bin.dat": "",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body)
    (root / "bin.dat").write_bytes(b"\xff\xfe\x00")
    (root / "link.rs").symlink_to(root / "src/auth.rs")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@e", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "src", "docs", ".gitignore")
    run("commit", "-qm", "first")
    (root / "src/auth.rs").write_text("fn login() { go(); }\nfn more() {}\n")
    return root


def test_worktree_scan(spark, tree):
    spark.dataSource.register(WorktreeSource)
    df = spark.read.format("worktree").option("max_kb", "4").load(str(tree))
    rows = {r.relative_path: r for r in df.collect()}
    assert set(rows) == {"src/auth.rs", "tests/auth_test.rs", "docs/architecture.md", ".gitignore", "pkg/__init__.py", "bin.dat"}
    assert rows["tests/auth_test.rs"].is_test and rows["docs/architecture.md"].is_doc and rows["src/auth.rs"].kind == "source"
    assert rows["bin.dat"].content is None and rows["src/auth.rs"].git_blob_id and rows["pkg/__init__.py"].git_blob_id is None
    less = spark.read.format("worktree").option("index_tests", "false").option("ignore", "docs/").load(str(tree))
    assert {r.relative_path for r in less.collect()} & {"tests/auth_test.rs", "docs/architecture.md"} == set()


@pytest.mark.parametrize("with_git", [True, False])
def test_own_ignore_file_and_parts(spark, tree, with_git):
    import shutil

    from codeloom.sources.worktree import WorktreeReader

    if not with_git:
        shutil.rmtree(tree / ".git")
    (tree / "src/deep/gen").mkdir(parents=True)
    for p in ("src/deep/gen/a.rs", "src/deep/b.rs", "src/deep/keep.log", "src/deep/x.log"):
        (tree / p).write_text("x\n")
    (tree / ".loomignore").write_text("# notes\n*.log\n!keep.log\ngen/\n/docs/\n")
    spark.dataSource.register(WorktreeSource)
    rows = {r.relative_path for r in spark.read.format("worktree").option("ignore_file", ".loomignore").load(str(tree)).collect()}
    assert {"src/auth.rs", "src/deep/b.rs", "src/deep/keep.log", "big.txt"} <= rows
    assert not rows & {"src/deep/gen/a.rs", "src/deep/x.log", "docs/architecture.md", ".env", "link.rs"}
    assert ("build/x.rs" in rows) is not with_git
    assert {p.folder for p in WorktreeReader({"path": str(tree)}).partitions()} >= {"", "src", "tests"}


def test_security_audit(spark, tree):
    root = str(tree)
    (tree / "src/auth.rs").chmod(0o666)
    (tree / "build/id_rsa").write_text("x")
    audit = git.security_audit(spark, root)
    got = {r.path: (r.tracked, r.secret, r.world_writable) for r in audit.collect()}
    assert got == {"src/auth.rs": (True, False, True), ".env": (False, True, False), "build/id_rsa": (False, True, False)}
    assert not git.is_secure(audit)
    (tree / "src/auth.rs").chmod(0o644)
    assert git.is_secure(git.security_audit(spark, root))


def test_watching(tmp_path, tree):
    from codeloom.streaming.watch import Registry, Watcher, resolve_root

    r = Registry(str(tmp_path / "state/watched.json"))
    assert r.add(str(tree)) and not r.add(str(tree)) and r.add("/nowhere") and r.list() == sorted([str(tree), "/nowhere"])
    heads, done = {}, []

    def sync(root):
        done.append(root)
        if len(done) == 2:
            raise RuntimeError("first try")
        heads[root] = git.head(root)

    w = Watcher(r, sync, heads.get)
    assert w.sync_all() == 0 and done == [str(tree)]
    assert w.sync_all() == 0 and len(done) == 1  # nothing changed
    (tree / "src/auth.rs").write_text("fn other() {}\n")
    assert w.sync_all() == 1 and w.sync_all() == 0 and len(done) == 3  # a failure is tried again
    assert w.sync_all() == 0 and len(done) == 3
    assert r.remove("/nowhere") and not r.remove("/nowhere")
    Watcher(r, sync, heads.get, indexed=lambda root: False).run(passes=1)
    assert len(done) == 3
    ask = lambda **p: {"method": "initialize", "params": p}
    assert resolve_root({"params": {"arguments": {"path": "/a"}, "repo_path": "/b"}}, None, [], "/d") == ("/a", "/a")
    assert resolve_root({"params": {"repo_path": "/b"}}, "/s", [], "/d") == ("/b", "/b")
    assert resolve_root(ask(rootUri="file:///x%20y"), None, [], "/d")[0] == "/x y"
    assert resolve_root(ask(workspaceFolders=[{"uri": "http://q"}, {"uri": "file:///w"}], rootPath="/p"), None, [], "/d")[0] == "/w"
    assert resolve_root({"params": {}}, "/s", ["/w"], "/d") == ("/s", "/s") and resolve_root({}, None, ["/w"], "/d") == ("/w", "/w")
    assert resolve_root({}, None, ["/w", "/v"], "/d") == ("/d", None)


def test_repositories_entries_and_identities(spark):
    from codeloom.functions import ids, text

    schema = "repo_id string, name string, root string, head string, branch string, indexed_at int"
    old = spark.createDataFrame([("r", "n", "/r", "c1", "main", 1), ("q", "n", "/q", None, "main", 1)], schema)
    new = spark.createDataFrame([("r", "m", "/r2", "c2", "dev", 2), ("s", "n", "/s", None, "main", 2)], schema)
    rows = lambda df: {r.repo_id: tuple(r)[1:] for r in df.collect()}
    assert rows(catalog.upsert_repositories(old, new)) == {"r": ("m", "/r2", "c2", "dev", 2), "q": ("n", "/q", None, "main", 1), "s": ("n", "/s", None, "main", 2)}
    assert rows(catalog.upsert_repositories(old, new, indexed=False))["r"] == ("m", "/r2", "c1", "dev", 1)
    e = spark.createDataFrame([(0, "a.desktop", "Alpha", "/u/a", True), (1, "a.desktop", "Alpha", "/s/a", False), (1, "b.desktop", "beta", "/s/b", False), (0, "c.desktop", "Abet", "/u/c", None)],
                              "rank int, file_name string, name string, path string, hidden boolean")
    assert [r.name for r in catalog.first_entries(e).collect()] == ["Abet", "beta"] and [r.name for r in catalog.first_entries(e, "ETA").collect()] == ["beta"]
    f = spark.createDataFrame([("r", "a", "x"), ("r", "b", "x")], "repo_id string, relative_path string, git_blob_id string")
    t = spark.createDataFrame([("r", "a", "b1")], "repo_id string, relative_path string, git_blob_id string")
    assert {r.relative_path: r.git_blob_id for r in catalog.blob_ids(f, t).collect()} == {"a": "b1", "b": None}
    one = spark.createDataFrame([("/srv/x", "nonsense", "2025-01-02T03:04:05Z")], "p string, bad string, good string")
    r = one.select(text.repo_id(F.col("p")).alias("id"), text.timestamp_or_now(F.col("good")).alias("g"), text.timestamp_or_now(F.col("bad")).alias("b"),
                   ids.declaration_id(F.lit("a.rs"), F.lit("m"), F.lit("f"), F.lit(7)).alias("d")).first()
    import hashlib

    assert r.id == hashlib.sha256(b"/srv/x").hexdigest()[:16] and r.g.year == 2025 and r.b.year > 2025 - 1 and r.d == "a.rs::m::f@7"


def test_claims_are_deleted(spark, tmp_path):
    m = str(tmp_path / "m.jsonl")
    config.append_memory(m, {"id": "1", "claim": "ghp_" + "a" * 36})
    assert "ghp_" not in open(m).read()
    assert config.delete_memory(m, "1") and not config.delete_memory(m, "1") and open(m).read() == ""


def test_git_tables(spark, tree):
    root = str(tree)
    assert git.find_root(str(tree / "src")) == root
    i = git.info(spark, root).first()
    assert i["head"] and not i["clean"]
    c = git.recent_commits(spark, root).collect()
    assert [x.summary for x in c] == ["first"]
    assert {r.path for r in git.touched_paths(spark, root).collect()} == {"src/auth.rs", "docs/architecture.md", ".gitignore"}
    assert {r.path: r.tracked for r in git.status(spark, root).collect()}["src/auth.rs"] is True
    h = git.diff_hunks(spark, root).collect()
    assert h[0].file_path == "src/auth.rs" and h[0].hunks[0].new_lines == 2
    assert git.text_at_commit(root, c[0].commit_id, "src/auth.rs") == "fn login() {}\n"
    assert git.text_at_commit(root, c[0].commit_id, ".env") is None
    before = git.fingerprint(root)
    (tree / "src/auth.rs").write_text("changed\n")
    assert git.fingerprint(root) != before
    assert ".env" in {r.path for r in git.untracked(spark, root).collect()}


def test_config_and_claims(spark, tmp_path):
    p = tmp_path / "c.toml"
    assert config.load_config(str(p)) == config.RepoConfig()
    p.write_text("max_file_size_kb = 5\ncustom_ignores = ['a/']\n")
    assert config.load_config(str(p)).max_file_size_kb == 5
    p.write_text("max_file_size_kb = 'x'")
    assert config.load_config(str(p)) == config.RepoConfig()
    o = tmp_path / "o.toml"
    assert config.load_ontology(str(o)).allows_edge("calls")
    o.write_text("edge_kinds = ['owns']")
    assert not config.load_ontology(str(o)).allows_edge("calls")
    o.write_text("edge_kinds = ['nope']")
    with pytest.raises(ValueError):
        config.load_ontology(str(o))
    m = tmp_path / "m.jsonl"
    ok = {"id": "1", "claim": "c ghp_" + "a" * 36, "kind": "fact", "evidence": [], "confidence": 1.0, "status": "Fresh"}
    m.write_text("\n{bad\n" + json.dumps({"id": "2"}) + "\n")
    config.append_memory(str(m), ok)
    config.append_memory(str(m), ok | {"confidence": 0.5})
    rows = config.load_memories(spark, str(m)).collect()
    assert [(r.id, r.claim, r.status, r.confidence) for r in rows] == [("1", "c [REDACTED]", "fresh", 0.5)]
    with pytest.raises(ValueError):
        config.note(spark, "r", "s", "  ")
    assert config.note(spark, "r", "s", "hi").first()["kind"] == "note"


def test_store_swaps_versions(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db")
    assert s.version("t") is None
    with pytest.raises(ValueError):
        s.read("t")
    s.write("t", spark.range(3))
    s.write("t", s.read("t").filter("id > 0"), unique=["id"])
    assert sorted(r.id for r in s.read("t").collect()) == [1, 2]
    with pytest.raises(ValueError):
        s.write("t", spark.range(2).union(spark.range(1)), unique=["id"])
    assert s.version("t") == 2 and s.read("t").count() == 2
    s.write("t", spark.range(1))
    s.collect_garbage("t")
    assert s.read("t").count() == 1


FILES = "repo_id string, relative_path string, file_hash string, indexed_at timestamp, deleted boolean"


def test_sync_batches(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db")
    now = spark.sql("select timestamp'2025-01-01'").first()[0]
    batch = lambda *rows: spark.createDataFrame([("r", p, h, now, d) for p, h, d in rows], FILES)
    assert sync.apply_batch(s, batch(("a", "1", False), ("b", "1", False)), 0) == 2
    assert sync.apply_batch(s, batch(("a", "2", False), ("b", "1", True), ("c", "1", False)), 1) == 3
    assert {(r.relative_path, r.file_hash) for r in s.read("files").collect()} == {("a", "2"), ("c", "1")}
    assert sync.apply_batch(s, batch(("a", "9", False)), 1) == 0  # the batch again
    assert sync.apply_batch(s, batch(("a", "2", False)), 2) == 0  # nothing new


def test_traversal(spark):
    n = 8
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a in range(n) for b in range(n) if a != b], "src_id string, dst_id string")
    got = {r.id: r.depth for r in graph.traverse(edges, spark.createDataFrame([("n0",)], "id string"), 7).collect()}
    assert got == {"n0": 0, **{f"n{i}": 1 for i in range(1, n)}}
    with pytest.raises(ValueError, match="depth"):
        graph.traverse(edges, spark.createDataFrame([("n0",)], "id string"), 9)
    lost = graph.traverse(edges, spark.createDataFrame([("zz",)], "id string"), 2).collect()
    assert [(r.id, r.depth) for r in lost] == [("zz", 0)]


EDGES = "repo_id string, dataset_id string, src_id string, dst_id string, kind string, payload string"


def test_graph_upkeep(spark):
    old = spark.createDataFrame([("r", "d", "a", "b", "calls", "x"), ("r", "d", "a", "c", "owns", None)], EDGES)
    new = spark.createDataFrame([("r", "d", "a", "b", "calls", "y"), ("r", "d", "a", "a", "calls", "z"), ("r", "d", "b", "c", "decided-by", None)], EDGES)
    got = {(r.src_id, r.dst_id, r.kind): r.payload for r in graph.upsert_edges(old, new, ["calls", "owns"]).collect()}
    assert got == {("a", "b", "calls"): "y", ("a", "c", "owns"): None}
    assert {r.payload for r in graph.upsert_edges(old, new, ["calls"], keep_payload=True).filter("dst_id = 'b'").collect()} == {"x"}
    assert graph.clear_projected(old).count() == 0
    nodes = spark.createDataFrame([("r", "d", "a", "file", "A", None), ("r", "e", "b", "file", "B", None)], "repo_id string, dataset_id string, id string, kind string, label string, datapoint_id string")
    assert graph.check_scope(old.filter("dst_id = 'b'"), nodes).count() == 1
    members = spark.createDataFrame([("s", "a"), ("s", "b")], "node_set_id string, node_id string")
    n, e, m = graph.delete_nodes(nodes, old, members, spark.createDataFrame([("a",)], "id string"))
    assert [n.count(), e.count(), m.count()] == [1, 0, 1]
    renamed = graph.upsert_nodes(nodes, nodes.withColumn("label", F.lit("new")).limit(1))
    assert {r.id: r.label for r in renamed.collect()}["a"] == "new"


def test_export_forms(spark):
    nodes = spark.createDataFrame([("r", "d", "b", "file", 'B"', None), ("r", "d", "a", "file", "A", "p")], "repo_id string, dataset_id string, id string, kind string, label string, datapoint_id string")
    edges = spark.createDataFrame([("r", "d", "a", "b", "calls", "secret")], EDGES)
    doc = json.loads("\n".join(r.line for r in graph.json_document(nodes, edges).collect()))
    assert [n["id"] for n in doc["nodes"]] == ["a", "b"] and doc["edges"] == [{"src_id": "a", "dst_id": "b", "kind": "calls"}]
    assert json.loads("\n".join(r.line for r in graph.json_document(nodes.limit(0), edges.limit(0)).collect())) == {"nodes": [], "edges": []}
    assert graph.export(nodes, edges, " Mermaid").count() == 3
    with pytest.raises(ValueError):
        graph.export(nodes, edges, "svg")


def test_commit_nodes_split(spark):
    nodes = spark.createDataFrame([("r", "d", "commit:abc", "commit", "m", None)], "repo_id string, dataset_id string, id string, kind string, label string, datapoint_id string")
    edges = spark.createDataFrame([("r", "d", "commit:abc", "f", "touched-in-commit", None), ("q", "e", "commit:abc", "g", "touched-in-commit", None)], EDGES)
    n, e = graph.split_commits(nodes, edges)
    assert {r.id for r in n.collect()} == {"commit:d:abc", "commit:e:abc"}
    assert {r.src_id for r in e.collect()} == {"commit:d:abc", "commit:e:abc"}


def test_versions_return(spark):
    rows = [("d", "note", "p", i, o) for o, i in enumerate(["alpha", "beta", "alpha", "alpha"])]
    p = spark.createDataFrame(rows, "dataset_id string, kind string, path string, id string, ordinal int")
    assert {r.id: r.version for r in versions.versions(p).collect()} == {"alpha": 3, "beta": 2}
    assert {(r.src_id, r.dst_id) for r in versions.supersedes(p).collect()} == {("beta", "alpha"), ("alpha", "beta")}


def test_chunks(spark):
    text = "".join(f"é{i}\n" for i in range(200)) + "tail"
    df = spark.createDataFrame([("a", text), ("b", ""), ("c", None), ("d", "one")], "path string, content string")
    rows = versions.chunk_windows(df).collect()
    a = sorted((r.start_byte, r.end_byte) for r in rows if r.path == "a")
    data = text.encode()
    parts = text.split("\n")
    assert len(a) == 3 and a[0][0] == 0 and a[-1][1] == len(data)
    assert data[a[1][0] :].decode().startswith(parts[70])
    assert [(r.start_byte, r.end_byte) for r in rows if r.path == "d"] == [(0, 3)]
    assert {r.path for r in rows} == {"a", "d"}


def test_staleness(spark):
    ev = "memory_id string, repo_id string, file string, symbols array<string>, fingerprint string"
    sym = spark.createDataFrame([("r", "a.rs", "f", "a.rs::f", "fp1"), ("r", "a.rs", "g", "a.rs::g", "fp2")], "repo_id string, file_path string, name string, qualified_name string, fingerprint string")
    files = spark.createDataFrame([("r", "a.rs", "h1")], "repo_id string, relative_path string, file_hash string")
    take = lambda e: {r.memory_id: r.fingerprint for r in memory.capture(spark.createDataFrame(e, ev), sym, files).collect()}
    base = take([("two", "r", "a.rs", ["g", "f", "f"], None), ("doc", "r", "a.rs", [], None), ("no", "r", "a.rs", ["zz"], None)])
    assert base["no"] is None and base["two"].startswith("symbols-v1:") and base["doc"] == "file-v1:h1"
    e = spark.createDataFrame(
        [("two", "r", "a.rs", ["f", "g"], base["two"]), ("doc", "r", "a.rs", [], "file-v1:h0"), ("old", "r", "a.rs", ["f"], "fp1"), ("bad", "r", "a.rs", ["f"], "fp9"),
         ("gone", "r", "z.rs", ["f"], None), ("inv", "r", "z.rs", ["f"], None), ("none", "r", "a.rs", ["f"], None)],
        ev,
    )
    m = spark.createDataFrame([(k, "invalidated" if k == "inv" else "fresh", 0.3) for k in ("two", "doc", "old", "bad", "gone", "inv", "none", "bare")], "memory_id string, status string, confidence double")
    got = {r.memory_id: (r.status, r.confidence) for r in memory.verify(m, e, sym, files).collect()}
    assert got == {
        "two": ("fresh", 1.0), "doc": ("degraded", 0.7), "old": ("fresh", 1.0), "bad": ("degraded", 0.7), "gone": ("stale", 0.0),
        "inv": ("invalidated", 0.3), "none": ("fresh", 1.0), "bare": ("fresh", 1.0),
    }


EV = "memory_id string, repo_id string, file string, symbols array<string>, fingerprint string"
SYM = "repo_id string, file_path string, name string, qualified_name string, fingerprint string"


def test_rules_of_several_symbols_and_other_files(spark):
    sym = spark.createDataFrame([("r", "a.rs", "x", "a.rs::x", "h1"), ("r", "a.rs", "y", "a.rs::y", "h2"), ("r", "a.rs", "y", "a.rs::y", "h1")], SYM)
    files = spark.createDataFrame([("r", "a.rs", "f1"), ("r", "notes.md", "f2")], "repo_id string, relative_path string, file_hash string")
    rows = [
        ("every", "r", "a.rs", ["x", "y"], "h1"), ("one of two", "r", "a.rs", ["x", "y"], "h2"), ("qualified", "r", "a.rs", ["a.rs::x"], "h1"),
        ("doc", "r", "notes.md", ["anything"], "file-v1:f2"), ("doc old", "r", "notes.md", ["anything"], "h9"), ("doc changed", "r", "notes.md", ["z"], "file-v1:f0"),
        ("lost", "r", "a.rs", ["x", "nope"], "h1"), ("open", "r", "a.rs", ["x"], None), ("open stale", "r", "a.rs", ["x"], None),
    ]
    e = spark.createDataFrame(rows, EV)
    m = spark.createDataFrame([(r[0], "stale" if r[0] == "open stale" else "fresh", 1.0) for r in rows], "memory_id string, status string, confidence double")
    want = {"every": "fresh", "one of two": "degraded", "qualified": "fresh", "doc": "fresh", "doc old": "fresh", "doc changed": "degraded", "lost": "stale"}
    got = {r.memory_id: r.status for r in memory.staleness(m, e, sym, files).collect()}
    assert got == want | {"open": "degraded", "open stale": "stale"}
    got = {r.memory_id: r.status for r in memory.verify(m, e, sym, files).collect()}
    assert got == want | {"open": "fresh", "open stale": "fresh"}
    claims, evidence = memory.anchor(m, e, sym, files, head="abc")
    assert {r.memory_id: r.valid_at for r in claims.collect()} == {k: "abc" if v == "fresh" else None for k, v in (want | {"open": "fresh", "open stale": "fresh"}).items()}
    filled = {r.memory_id: r.fingerprint for r in evidence.collect()}
    assert filled["open"].startswith("symbols-v1:") and filled["doc old"] == "h9"
    assert memory.get(m, "doc").count() == 1 and memory.get(m, "none").count() == 0


def test_baselines_come_back_from_the_cited_commit(spark):
    now = spark.createDataFrame([("r", "a.rs", "x", "a.rs::x", "new"), ("r", "a.rs", "y", "a.rs::y", "same")], SYM)
    files = spark.createDataFrame([("r", "a.rs", "f1")], "repo_id string, relative_path string, file_hash string")
    then = spark.createDataFrame([("r", "a.rs", "x", "a.rs::x", "old", "c1"), ("r", "a.rs", "y", "a.rs::y", "same", "c1")], SYM + ", commit string")
    then_files = spark.createDataFrame([("r", "a.rs", "f0", "c1")], "repo_id string, relative_path string, file_hash string, commit string")
    rows = [("changed", "r", "a.rs", ["x"], None, "c1"), ("kept", "r", "a.rs", ["y"], None, "c1"), ("no commit", "r", "a.rs", ["y"], None, "c9"), ("has one", "r", "a.rs", ["y"], "same", "c1")]
    e = memory.recover(spark.createDataFrame(rows, EV + ", commit string"), then, then_files)
    m = spark.createDataFrame([(r[0], "fresh", 1.0) for r in rows], "memory_id string, status string, confidence double")
    got = {r.memory_id: r.status for r in memory.staleness(m, e, now, files).collect()}
    assert got == {"changed": "degraded", "kept": "fresh", "no commit": "degraded", "has one": "fresh"}


def test_lookup_of_parts_equals_brute_force(spark):
    import random

    from codeloom.operators import symbols

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abAB_é") for _ in range(n))
    rows = [(rng.choice("rq"), f"s{k}", word(rng.randrange(0, 6)) if k % 9 else None, f"src/{word(3)}.rs::{word(4)}") for k in range(200)]
    rows += [(a, b, c, "long" * 20_000 + d) for a, b, c, d in rows[:2]]
    terms = [(r, word(n)) for r in "rqz" for n in (0, 1, 2, 3, 4, 7) for _ in range(3)] + [("r", None), ("r", "src/"), ("q", "LONGlong")]
    s = spark.createDataFrame(rows, "repo_id string, id string, name string, qualified_name string")
    fold = symbols.ascii_lower
    got = symbols.holding(s, [fold(F.col("name")), fold(F.col("qualified_name"))], spark.createDataFrame(terms, "repo_id string, term string"), ["repo_id", "id"], fold)
    low = lambda x: "".join(c.lower() if c.isascii() else c for c in x or "")
    want = {(r[0], r[1], r[3], t) for r in rows for q, t in terms if t and q == r[0] and (low(t) in low(r[2]) or low(t) in low(r[3]))}
    out = got.collect()
    assert {(r.repo_id, r.id, r.qualified_name, r.term) for r in out} == want and len(out) == len(want)


def test_edge_kinds_and_formats():
    from codeloom.functions import vocab

    assert vocab.parse_edge_kind(" Touched_In_Commit ") == "touched-in-commit" and vocab.parse_export_format("DOT ") == "dot"
    for f in (vocab.parse_edge_kind, vocab.parse_export_format):
        with pytest.raises(ValueError):
            f("svg")


def test_merged_branches_and_odd_names(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@e", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    odd = 'x b/q"é.rs'
    for name, branch in (("a.rs", "main"), (odd, "side"), ("c.rs", "main")):
        if branch == "side":
            run("checkout", "-qb", "side")
        else:
            subprocess.run(["git", "-C", str(tmp_path), "checkout", "-q", "main"], capture_output=True)
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("fn f() {}\n")
        run("add", ".")
        run("commit", "-qm", f"adds {len(name)}")
    run("merge", "-q", "--no-ff", "-m", "merge", "side")
    commits = {r.commit_id: r.summary for r in git.recent_commits(spark, str(tmp_path)).collect()}
    touched = {(commits[r.commit_id], r.path) for r in git.touched_paths(spark, str(tmp_path)).collect()}
    assert touched == {("adds 4", "a.rs"), (f"adds {len(odd)}", odd), ("adds 4", "c.rs"), ("merge", odd)}
    (tmp_path / odd).write_text("changed\n")
    assert [r.file_path for r in git.diff_hunks(spark, str(tmp_path)).collect()] == [odd]


def test_late_scans_do_not_win(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db")
    at = lambda d: spark.sql(f"select timestamp'2025-01-{d:02d}'").first()[0]
    batch = lambda *rows: spark.createDataFrame([("r", p, h, at(d), gone) for p, h, d, gone in rows], FILES)
    sync.apply_batch(s, batch(("a", "new", 5, False), ("b", "1", 5, False)), 0)
    assert sync.apply_batch(s, batch(("a", "old", 3, False), ("b", "1", 4, True)), 1) == 0
    assert {(r.relative_path, r.file_hash) for r in s.read("files").collect()} == {("a", "new"), ("b", "1")}


def test_insert_or_ignore(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4)], "k string, v int")
    assert {tuple(r) for r in catalog.insert_or_ignore(old, new, ["k"]).collect()} == {("a", 1), ("b", 3)}

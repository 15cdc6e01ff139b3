"""Pipelines on small scans: what a second run changes, what stages see, what a failure leaves."""

from __future__ import annotations

import pytest

from codeloom import pipelines
from codeloom.sources.config import Ontology
from codeloom.sources.store import Store

SCAN = (
    "repo_id string, relative_path string, file_hash string, git_blob_id string, size_bytes bigint, language string, kind string,"
    " is_test boolean, is_doc boolean, indexed_at timestamp, content string"
)


def scan(spark, day, **files):
    at = spark.sql(f"select timestamp'2025-01-{day:02d}'").first()[0]
    rows = []
    for name, body in files.items():
        path = name.replace("__", "/").replace("_rs", ".rs").replace("_md", ".md")
        doc = path.endswith(".md")
        rows.append(("r", path, str(hash(body)), None, len(body), "markdown" if doc else "rust", "documentation" if doc else "source", False, doc, at, body))
    return spark.createDataFrame(rows, SCAN)


FIRST = dict(src__a_rs="fn a() { b(); }\n", src__b_rs="fn b() {}\n", docs__x_md="# x\n")
SECOND = dict(src__a_rs="fn a() { c(); }\nfn c() {}\n", docs__x_md="# x\n")


def test_two_runs_of_index(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    seen = []
    counts = pipelines.index(pipelines.Context(spark, store, scan(spark, 1, **FIRST)), (lambda c: seen.append(c.table("nodes").count()), lambda c: seen.append("second")))
    assert counts["files_updated"] == 3 and counts["datapoints_inserted"] == 6 and counts["symbols_written"] == 2 and counts["chunks"] == 3
    assert seen == [store.read("nodes").count(), "second"]
    edges = {(r.src_id.split(":")[-1], r.dst_id.split("::")[-1], r.kind) for r in store.read("edges").filter("kind = 'calls'").collect()}
    assert edges == {("a@0", "b@0", "calls")}
    again = pipelines.index(pipelines.Context(spark, store, scan(spark, 1, **FIRST)))
    assert again["files_updated"] == 0 and again["datapoints_inserted"] == 3 and again["datapoints_unchanged"] == 3  # chunks are made anew
    pipelines.index(pipelines.Context(spark, store, scan(spark, 2, **SECOND)))
    assert {r.relative_path for r in store.read("files").collect()} == {"src/a.rs", "docs/x.md"}
    assert {r.name for r in store.read("symbols").collect()} == {"a", "c"}
    points = {(r.path, r.version) for r in store.read("datapoints").filter("kind = 'file'").collect()}
    assert points == {("src/a.rs", 1), ("src/a.rs", 2), ("docs/x.md", 1)}
    nodes = {r.label for r in store.read("nodes").filter("kind = 'file'").collect()}
    assert nodes == {"src/a.rs", "docs/x.md"}
    assert store.read("edges").filter("kind = 'supersedes'").count() == 1
    chunks = {r.path for r in store.read("datapoints").filter("kind = 'chunk'").collect()}
    assert chunks == {"src/a.rs#0-26", "docs/x.md#0-4"}
    pipelines.add(pipelines.Context(spark, store, scan(spark, 3, **{**SECOND, "src__a_rs": FIRST["src__a_rs"]})))
    points = {(r.content[:9] if r.content else "", r.version) for r in store.read("datapoints").filter("kind = 'file' AND path = 'src/a.rs'").collect()}
    assert points == {("fn a() { ", 2), ("fn a() { ", 3)}  # the first content is back as the third version


def test_sources_history_and_notes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    with pytest.raises(ValueError):
        pipelines.add(pipelines.Context(spark, store, sources=("session",)))
    notes = spark.createDataFrame([("r", "session:1", "look at ghp_" + "a" * 36)], "repo_id string, path string, content string")
    pipelines.add(pipelines.Context(spark, store, sources=("text",), notes=notes))
    assert store.read("datapoints").first()["content"] == "look at [REDACTED]" and store.read("edges").count() == 1
    with pytest.raises(ValueError):
        pipelines.add(pipelines.Context(spark, store, sources=("text",), notes=notes.selectExpr("repo_id", "path", "' ' AS content")))
    commits = spark.createDataFrame([("r", "c1", "first", 1)], "repo_id string, commit_id string, summary string, timestamp bigint")
    touched = spark.createDataFrame([("r", "c1", "src/a.rs"), ("r", "c1", "gone.rs")], "repo_id string, commit_id string, path string")
    counts = pipelines.add(pipelines.Context(spark, store, scan(spark, 1, **FIRST), sources=("docs", "history"), commits=commits))
    assert counts["datapoints_inserted"] == 2 and {r.kind for r in store.read("datapoints").collect()} == {"note", "file", "commit"}
    pipelines.cognify(pipelines.Context(spark, store, scan(spark, 1, **FIRST), touched=touched))
    links = [r.dst_id for r in store.read("edges").filter("kind = 'touched-in-commit'").collect()]
    assert len(links) == 1 and links[0].endswith("src/a.rs")


def test_a_failing_projection_leaves_the_old_graph(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/db")
    pipelines.index(pipelines.Context(spark, store, scan(spark, 1, **FIRST)))
    before = store.version("nodes"), store.version("edges")

    def fail(ctx):
        raise RuntimeError("no")

    monkeypatch.setattr(pipelines, "PROJECTION", (pipelines.project_graph, fail))
    with pytest.raises(RuntimeError):
        pipelines.cognify(pipelines.Context(spark, store, scan(spark, 2, **SECOND)))
    assert (store.version("nodes"), store.version("edges")) == before and store.read("files").count() == 2


def test_ontology_limits_kinds(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    pipelines.cognify(pipelines.Context(spark, store, scan(spark, 1, **FIRST), ontology=Ontology(["owns"], ["file", "symbol"])))
    assert {r.kind for r in store.read("edges").collect()} == {"owns"} and {r.kind for r in store.read("nodes").collect()} == {"file", "symbol"}


def test_migration_and_gone_repositories(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    store.write("t", spark.createDataFrame([("r", 1), ("q", 2)], "repo_id string, a int"))
    assert store.migrate("t", "repo_id string, a int, b string") and not store.migrate("t", "repo_id string, a int, b string")
    assert store.read("t").columns == ["repo_id", "a", "b"]
    store.drop_repositories(["t"], spark.createDataFrame([("q",)], "repo_id string"))
    assert [r.repo_id for r in store.read("t").collect()] == ["r"]

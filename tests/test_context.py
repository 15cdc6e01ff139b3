"""Text search, claims, commits and dirty files in the packages of tasks."""

from __future__ import annotations

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from codeloom.operators import context, memory, search
from codeloom.plans import catalog

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint, repo_id string, doc_kind string, path string, created_at timestamp"


def test_search_of_all_tasks_equals_search_of_each(spark):
    texts = ["token rotation and tokens", "rotate the token", "rotate_token now", "nothing here", None, "the rotation of rotate_token: rotating"]
    rows = [(r, f"src/f{i}.rs", t) for r in "ab" for i, t in enumerate(texts) if r == "a" or i != 1]
    corpus = spark.createDataFrame(rows, "repo_id string, path string, content string").cache()
    asked = [(1, "a", "rotate token"), (2, "b", "rotating tokens"), (3, "a", "rotate_token"), (4, "b", "the the rotation"), (5, "a", "absent token"), (6, "b", ""), (7, "a", None)]
    got = search.bm25_tasks(corpus, spark.createDataFrame(asked, "task_id bigint, repo_id string, query string"), 3)
    got = {(r.task_id, r.idx): (r.path, round(r["rank"], 9)) for r in got.collect()}
    want = {}
    for task, repo, query in asked:
        for i, r in enumerate(search.bm25(corpus.filter(F.col("repo_id") == repo), query or "", 3, stemmed=True).collect()):
            want[task, i] = (r.path, round(r["rank"], 9))
    assert got == want and {t for t, _ in got} == {1, 2, 3, 4}


def test_an_index_answers_as_the_texts_do(spark):
    texts = ["token rotation and tokens", "rotate the token", "rotate_token now", "nothing here", None, "the rotation of rotate_token: rotating rotate token"]
    rows = [("a", f"src/f{i}.rs", t) for i, t in enumerate(texts)]
    corpus = spark.createDataFrame(rows, "repo_id string, path string, content string")
    asked = [(1, "rotate token"), (2, "rotating"), (3, "rotate_token"), (4, "the the rotation"), (5, "absent token"), (6, ""), (7, None), (8, "src")]
    queries = spark.createDataFrame([(n, "a", q) for n, q in asked], "query_id int, repo_id string, query string")
    index = search.postings(corpus)
    changed = spark.createDataFrame([("a", "src/f3.rs", "rotate token"), ("a", "src/new.rs", "token rotate token")], corpus.schema)
    later = search.update_postings(index, changed, corpus.filter("path = 'src/f1.rs'").select("repo_id", "path"))
    now = corpus.filter("path NOT IN ('src/f1.rs', 'src/f3.rs')").unionByName(changed)
    for idx, texts in ((index, corpus), (later, now)):
        got = {(r.query_id, r.idx): (r.path, round(r["rank"], 9)) for r in search.bm25_index(idx, queries, 3).collect()}
        want = {(n, i): (r.path, round(r["rank"], 9)) for n, q in asked for i, r in enumerate(search.bm25(texts, q or "", 3, stemmed=True).collect())}
        assert got == want and len({n for n, _ in got}) >= 5


def test_dirty_files_go_all_at_once_and_last():
    parts = {"commits": [{"commit_id": "c" * 40}] * 3, "verified": [{"claim": "v" * 80}], "diagnostic": [{"claim": "d" * 80}], "dirty": ["a" * 30, "b" * 30]}
    whole = context.compile_package("do it", 4000, [], [], [], [], {}, **parts)
    assert all(whole[k] == v for k, v in parts.items())
    titles = [x for x in context.to_markdown(whole).splitlines() if x.startswith("## ")]
    assert titles == ["## Dirty files", "## Verified claims", "## Diagnostic claims, not verified", "## Recent commits"]
    seen = [context.compile_package("do it", n, [], [], [], [], {}, **parts) for n in range(70, 200)]
    assert {len(p["dirty"]) for p in seen} == {0, 2}
    assert {len(p["commits"]) for p in seen} == {0, 1, 2, 3}
    assert all(p["dirty"] for p in seen if p["verified"] or p["diagnostic"])


def test_candidates_signatures_and_reasons(spark):
    long = "fn f(" + "a: u8, " * 100 + ") ghp_" + "a" * 36
    symbols = [{"id": "1", "name": "f", "file_path": "a.rs", "start_line": 1, "score": 1.0, "signature": long}, {"id": "2", "name": "g", "file_path": "a.rs", "start_line": 1, "score": 1.0, "signature": None}]
    files = [{"path": f"f{k}.rs", "score": 1.0, "reasons": []} for k in range(15)]
    p = context.compile_package("do it", 4000, files, symbols, [], [], {}, candidates=40)
    assert p["budget"]["candidate_files"] == 40 and p["budget"]["returned_files"] == 15
    assert len(p["symbols"][0]["signature"].encode()) == 256 and p["symbols"][1]["signature"] is None
    signals = spark.createDataFrame([(1, "a", 5.0, "calls", 1), (1, "a", 10.0, "calls", 2), (1, "a", 4.0, "by", 1), (1, "b", 1.0, "x", 1)], "task_id bigint, file string, score double, reason string, times bigint")
    got = {r.file: (r.score, [tuple(x) for x in r.reasons]) for r in context.file_scores(signals).collect()}
    assert got == {"a": (19.0, [("by", 1), ("calls", 3)]), "b": (1.0, [("x", 1)])}
    assert [r.file for r in context.best_files(context.file_scores(signals), 1).collect()] == ["a"]


def test_claims_follow_files_that_earlier_ones_scored(spark):
    e = spark.createDataFrame([(m, "r", "f") for m in ("m1", "m2", "m3")], "memory_id string, repo_id string, file string")
    order = spark.createDataFrame([("m1", 1), ("m2", 2), ("m3", 3)], "memory_id string, at int")
    hit = spark.createDataFrame([(7, "m2")], "task_id bigint, memory_id string")
    fresh = spark.createDataFrame([("m2",)], "memory_id string")
    assert sorted(r.memory_id for r in memory.followed(hit, e, fresh, order).collect()) == ["m2", "m3"]
    assert [r.memory_id for r in memory.followed(hit, e, fresh.filter("false"), order).collect()] == ["m2"]


@pytest.fixture
def folder(spark, tiny, tmp_path):
    for t in ("symbols", "symbol_references"):
        os.symlink(f"{tiny}/{t}.parquet", tmp_path / f"{t}.parquet")
    files = spark.read.parquet(f"{tiny}/files.parquet").limit(1).withColumn("repo_id", F.lit("r"))
    rows = [files.withColumn("relative_path", F.lit(p)).withColumn("git_blob_id", F.lit(b).cast("string")) for p, b in (("src/a.rs", "1"), ("src/b.rs", None), ("src/c.rs", "1"))]
    rows[0].unionByName(rows[1]).unionByName(rows[2]).write.parquet(f"{tmp_path}/files.parquet")
    texts = [("r", "src/a.rs", "// quolling the zarbs\nfn main() {}\n"), ("r", "src/b.rs", "fn b() {}\n"), ("r", "src/c.rs", "fn c() {}\n")]
    spark.createDataFrame(texts, "repo_id string, relative_path string, content string").write.parquet(f"{tmp_path}/file_content.parquet")
    spark.createDataFrame([(1, "r", "quolled zarb", 2000)], "task_id bigint, repo_id string, task_text string, limit_tokens bigint").write.parquet(f"{tmp_path}/budgets.parquet")
    t = datetime.datetime(2025, 1, 1)
    docs = [
        (1, "A zarb lives here", None, None, 1, "r", "memory_claim", "src/c.rs", t), (2, "A zarb was there", None, None, 1, "r", "memory_claim", "gone.rs", t),
        (3, "unrelated", None, None, 1, "r", "memory_claim", None, t), (4, "Add parser\n\nmore", None, None, 1, "r", "commit_message", "src/a.rs", t),
        (5, "zarb elsewhere", None, None, 1, "other", "memory_claim", None, t), (6, "zarb " * 2000, None, None, 1, "r", "memory_claim", "src/a.rs", t),
    ]
    spark.createDataFrame(docs, DOCUMENT).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_package_has_every_signal(spark, folder):
    (r,) = catalog.collect().queries["context_packages"](spark, folder).collect()
    p = json.loads(r.package)
    assert [(f["path"], f["score"], f["reasons"]) for f in p["files"]] == [
        ("src/b.rs", 8.0, ["modified in working tree"]), ("src/a.rs", 6.0, ["BM25 search match (rank #1)"]), ("src/c.rs", 4.0, ["supported by memory '1'"]),
    ]
    assert [(v["id"], v["claim"], v["files"]) for v in p["verified"]] == [("1", "A zarb lives here", ["src/c.rs"])]
    assert [(v["id"], v["status"]) for v in p["diagnostic"]] == [("2", "stale")]
    assert [c["summary"] for c in p["commits"]] == ["Add parser"] and p["dirty"] == ["src/b.rs"]

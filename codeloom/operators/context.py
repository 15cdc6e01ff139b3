"""Ranked evidence for tasks: scores of files and symbols, and the packing of one task's package.

Scores are set-based over all tasks at once. Packing a package is sequential and bounded
(15 files, 12 symbols, 10 dependencies, 8 tests a task), so it runs per task in Arrow batches.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text

# What each signal adds to a file.
DIRTY, EXACT, PARTIAL, CALLER, CALLEE, TEST, MEMORY = 8.0, 10.0, 7.0, 5.0, 4.0, 6.0, 4.0
SEARCH_TOP, SEARCH_STEP, SEARCH_LEAST = 6.0, 0.3, 4.0
FILES, SYMBOLS, DEPENDENCIES, TESTS, PARTIAL_LIMIT = 15, 12, 10, 8, 25
BEFORE, AFTER, WHOLE_LINES, LEAST_LEFT, SIGNATURE_TOKENS = 5, 10, 80, 100, 64


def symbol_matches(exact: DataFrame, partial: DataFrame, terms: DataFrame, dirty: DataFrame) -> DataFrame:
    """(task_id, symbol columns, term, score, reason, pass): every match, exact ones before partial; both count."""
    cols = [c for c in exact.columns if c != "term"]
    e = exact.select(*cols, "term", F.lit(EXACT).alias("base"), F.lit("exact symbol match in task").alias("reason"), F.lit(0).alias("pass"))
    p = partial.select(*cols, "term", F.lit(PARTIAL).alias("base"), F.concat(F.lit("partial symbol match with '"), "term", F.lit("'")).alias("reason"), F.lit(1).alias("pass"))
    d = dirty.select("repo_id", F.col("relative_path").alias("file_path")).distinct().withColumn("dirty", F.lit(DIRTY))
    m = e.unionByName(p).join(terms.select("task_id", "repo_id", "term").distinct(), ["repo_id", "term"]).join(d, ["repo_id", "file_path"], "left")
    return m.withColumn("score", F.col("base") + F.coalesce("dirty", F.lit(0.0))).drop("base")


def candidate_symbols(matches: DataFrame, limit: int | None = SYMBOLS) -> DataFrame:
    """The first match of each symbol of a task (terms in order, exact before partial), by score."""
    first = Window.partitionBy("task_id", "id").orderBy("term", "pass", "file_path", "start_line")
    once = matches.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    if limit is None:
        return once
    order = Window.partitionBy("task_id").orderBy(F.desc("score"), "term", "pass", "file_path", "start_line", "id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def file_signals(matches: DataFrame, deps: DataFrame, tests: DataFrame, dirty: DataFrame, hits: DataFrame | None = None, memories: DataFrame | None = None) -> DataFrame:
    """(task_id, file, score, reason) of every signal, with multiplicity.

    ``deps`` and ``tests`` are per (repo_id, name); they count once for every match of a symbol of the
    name, as in the reference. ``hits`` is (task_id, file, idx) from the text search.
    """
    q = F.lit("'")
    one = F.lit(1).cast("bigint").alias("times")
    defined = matches.select("task_id", F.col("file_path").alias("file"), "score", F.concat(F.lit("defines symbol '"), "name", q).alias("reason"), one)
    # one row a name with its multiplicity; the signals of a name are expanded only in the sums
    names = matches.groupBy("task_id", "repo_id", "name").agg(F.count("*").alias("times"))
    callers = deps.filter("role = 'caller'").join(names, ["repo_id", "name"]).select(
        "task_id", F.col("source_file").alias("file"), (F.lit(CALLER) * F.col("times")).alias("score"),
        F.concat(F.lit("calls '"), "name", F.lit("' from '"), F.coalesce("source_symbol_name", F.lit("<top-level>")), q).alias("reason"), "times",
    )
    callees = deps.filter("role = 'callee'").join(names, ["repo_id", "name"]).select(
        "task_id", F.col("source_file").alias("file"), (F.lit(CALLEE) * F.col("times")).alias("score"), F.concat(F.lit("called by '"), "name", q).alias("reason"), "times"
    )
    tested = tests.join(names, ["repo_id", "name"]).select(
        "task_id", F.col("source_file").alias("file"), (F.lit(TEST) * F.col("times")).alias("score"), F.concat(F.lit("tests symbol '"), "name", q).alias("reason"), "times"
    )
    out = defined.unionByName(callers).unionByName(callees).unionByName(tested).unionByName(dirty.withColumn("times", one))
    if hits is not None:
        boost = F.lit(SEARCH_TOP) - F.least(F.col("idx") * SEARCH_STEP, F.lit(SEARCH_LEAST))
        out = out.unionByName(hits.select("task_id", "file", boost.alias("score"), F.concat(F.lit("BM25 search match (rank #"), (F.col("idx") + 1).cast("string"), F.lit(")")).alias("reason"), one))
    if memories is not None:
        out = out.unionByName(memory_signal(memories))
    return out


def memory_signal(memories: DataFrame) -> DataFrame:
    """Every file that a fresh claim cites: ``memories`` is (task_id, file, memory_id)."""
    return memories.select("task_id", "file", F.lit(MEMORY).alias("score"), F.concat(F.lit("supported by memory '"), "memory_id", F.lit("'")).alias("reason"), F.lit(1).cast("bigint").alias("times"))


def dirty_signal(tasks: DataFrame, dirty: DataFrame) -> DataFrame:
    """Every uncommitted file of a task's repository."""
    d = dirty.select("repo_id", F.col("relative_path").alias("file")).distinct()
    return tasks.select("task_id", "repo_id").distinct().join(d, "repo_id").select("task_id", "file", F.lit(DIRTY).alias("score"), F.lit("modified in working tree").alias("reason"))


def file_scores(signals: DataFrame) -> DataFrame:
    """(task_id, file, score, reasons): the sum, and the sorted reasons, each with how often it holds."""
    n = F.col("times") if "times" in signals.columns else F.lit(1)
    each = signals.groupBy("task_id", "file", "reason").agg(F.sum("score").alias("score"), F.sum(n).cast("bigint").alias("n"))
    return each.groupBy("task_id", "file").agg(F.sum("score").alias("score"), F.sort_array(F.collect_list(F.struct("reason", "n"))).alias("reasons"))


def best_files(scores: DataFrame, limit: int = FILES) -> DataFrame:
    """The files of a task with the highest scores, ranked; ties by path."""
    w = Window.partitionBy("task_id").orderBy(F.desc("score"), "file")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def excerpt(content: str, targets: list[int], room: int) -> str:
    """Numbered lines around the targets, or from the head, within ``room`` tokens; ``...`` marks gaps."""
    lines = content.splitlines()
    if not lines:
        return ""
    if targets:
        keep = sorted({n for t in targets for n in range(max(1, t - BEFORE), min(len(lines), t + AFTER) + 1)})
    else:
        keep = list(range(1, min(room * 3, len(lines)) + 1))
    out, last = "", 0
    for n in keep:
        pieces = ["    ...\n"] if last and n > last + 1 else []
        for piece in [*pieces, f"{n:4d}: {lines[n - 1]}\n"]:
            left = room - text.tokens_of(out)
            cut = text.bound_text(piece, left) if left > 0 else ""
            if not cut:
                return out
            out += cut
        last = n
    return out


class Budget:
    """Tokens of a package and what of them is used."""

    def __init__(self, limit: int):
        self.limit, self.used = limit, 0

    def can_fit(self, n: int) -> bool:
        return self.used + n <= self.limit

    def consume(self, n: int) -> None:
        self.used += n

    @property
    def remaining(self) -> int:
        return max(0, self.limit - self.used)


#: Parts of a package in the order in which they are given up, each from its end; the dirty files go all at once.
REMOVAL = ["snippets", "symbols", "files", "commits", "verified", "diagnostic", "dependencies", "tests", "dirty"]


def _size(package: dict) -> int:
    """Tokens of the encoded package, which states its own size: repeated until the number stands."""
    used = 0
    for _ in range(8):
        package["budget"]["returned_tokens"] = used
        now = text.tokens_of(json.dumps(package, ensure_ascii=False, sort_keys=True))
        if now == used:
            break
        used = now
    return used


def _without(package: dict, n: int) -> dict:
    p = json.loads(json.dumps(package))
    for part in REMOVAL:
        if part == "snippets":
            for f in reversed(p["files"]):
                if n and f["snippet"] is not None:
                    f["snippet"] = None
                    n -= 1
        elif part == "dirty":
            if n:
                p[part] = []
        else:
            while n and p[part]:
                p[part].pop()
                n -= 1
    p["budget"]["returned_files"] = len(p["files"])
    return p


def enforce(package: dict, limit: int) -> dict:
    """The package with the fewest removals that fits; an error if even the bare one does not."""
    if _size(package) <= limit:
        return package
    items = sum(f["snippet"] is not None for f in package["files"]) + sum(len(package[p]) for p in REMOVAL[1:-1]) + bool(package["dirty"])
    bare = _size(_without(package, items))
    if bare > limit:
        raise ValueError(f"the package needs at least {bare} tokens; the budget is {limit}")
    low, high = 1, items
    while low < high:
        mid = (low + high) // 2
        if _size(_without(package, mid)) <= limit:
            high = mid
        else:
            low = mid + 1
    out = _without(package, low)
    _size(out)
    return out


def _signature(symbol: dict) -> dict:
    """A symbol's signature, masked and bounded, if it has one."""
    return {"signature": text.bound_text(text.redact_text(symbol["signature"]), SIGNATURE_TOKENS)} if symbol.get("signature") is not None else {}


def compile_package(
    task: str, limit: int, files: list[dict], symbols: list[dict], deps: list[dict], tests: list[dict], contents: dict[str, str],
    commits: list[dict] = (), verified: list[dict] = (), diagnostic: list[dict] = (), dirty: list[str] = (), claim_bytes: int | None = None,
    candidates: int | None = None,
) -> dict:
    """One task's package from its ranked parts; whole short files while they fit, else excerpts.

    ``claim_bytes`` is the length of all verified claims, where ``verified`` has only those that may fit; ``candidates`` the
    number of all scored files, where ``files`` has only the best.
    """
    budget = Budget(limit)
    if claim_bytes is None:
        claim_bytes = sum(len(v["claim"].encode()) for v in verified)
    meta = "# " + task + "".join(d["caller"] + d["callee"] for d in deps) + "".join(t["test_file"] for t in tests)
    base = -(-(len(meta.encode()) + claim_bytes) // 4)
    budget.consume(min(base, limit // 3))
    chosen, candidate = [], base
    for f in files[:FILES]:
        if budget.remaining <= LEAST_LEFT:
            break
        content, piece = contents.get(f["path"]), None
        if content is not None:
            content = text.redact_text(content)
            n = text.tokens_of(content)
            candidate += n
            if budget.can_fit(n) and len(content.splitlines()) <= WHOLE_LINES:
                piece = content
            else:
                piece = excerpt(content, [s["start_line"] for s in symbols if s["file_path"] == f["path"]], budget.remaining)
            budget.consume(text.tokens_of(piece))
        chosen.append({"path": f["path"], "score": f["score"], "reasons": f["reasons"], "snippet": piece})
    package = {
        "task": text.redact_text(task), "files": chosen, "symbols": [{**s, **_signature(s)} for s in symbols[:SYMBOLS]], "dependencies": deps[:DEPENDENCIES],
        "tests": tests[:TESTS], "commits": list(commits), "verified": list(verified), "diagnostic": list(diagnostic), "dirty": list(dirty),
        "budget": {"candidate_tokens": candidate, "returned_tokens": budget.used, "limit": limit, "candidate_files": len(files) if candidates is None else candidates, "returned_files": len(chosen)},
    }
    return enforce(package, limit)


def to_markdown(package: dict) -> str:
    """The package for reading."""
    out = [f"# {package['task']}", "", f"Tokens: {package['budget']['returned_tokens']} of {package['budget']['limit']}", ""]
    for title, part in (
        ("Dirty files", "dirty"), ("Verified claims", "verified"), ("Diagnostic claims, not verified", "diagnostic"),
        ("Symbols", "symbols"), ("Dependencies", "dependencies"), ("Tests", "tests"), ("Recent commits", "commits"),
    ):
        if package[part]:
            out += [f"## {title}", *(f"- {json.dumps(x, ensure_ascii=False, sort_keys=True)}" for x in package[part]), ""]
    for f in package["files"]:
        out += [f"## {f['path']} ({f['score']:.1f})", "; ".join(f["reasons"])]
        if f["snippet"]:
            out += ["```", f["snippet"].rstrip("\n"), "```"]
        out.append("")
    return "\n".join(out)


def _fitting(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """A task's rows up to the first that ends beyond its budget: no later one can stay in the package."""
    before = Window.partitionBy("task_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_b", F.coalesce(F.sum(size).over(before), F.lit(0))).filter(F.col("_b") <= 4 * F.col("limit_tokens"))


def packages(
    tasks: DataFrame, scores: DataFrame, symbols: DataFrame, deps: DataFrame, tests: DataFrame, contents: DataFrame,
    commits: DataFrame, claims: DataFrame, dirty: DataFrame,
) -> DataFrame:
    """(task_id, package, tokens, error): the JSON package of every task.

    ``scores`` has all scored files; only the contents of the best are read. Each task's lists are bounded before they are gathered.
    ``commits``: (repo_id, n, commit_id, summary, timestamp), few a repository; ``claims``: (task_id, at, memory_id,
    claim, status, confidence, files); ``dirty``: (repo_id, relative_path).
    """
    top = best_files(scores).join(tasks.select("task_id", "repo_id"), "task_id")
    text_of = contents.withColumnRenamed("relative_path", "file").join(top.select("repo_id", "file").distinct(), ["repo_id", "file"], "left_semi")
    text_of = text_of.groupBy("repo_id", "file").agg(F.min("content").alias("content"))
    withtext = top.withColumn("reasons", F.flatten(F.transform("reasons", lambda r: F.array_repeat(r["reason"], r["n"].cast("int"))))).join(text_of, ["repo_id", "file"], "left")
    counted = scores.groupBy("task_id").agg(F.count("*").alias("candidates"))
    f = withtext.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("file").alias("path"), "score", "reasons", "content"))).alias("files"))
    s = symbols.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "name", "file_path", "start_line", "score", "signature"))).alias("symbols"))
    w = Window.partitionBy("task_id").orderBy("file_path", "line", "caller", "callee")
    d = deps.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= DEPENDENCIES)
    d = d.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("_n", "caller", "callee", "relationship", "file_path", "line"))).alias("deps"))
    v = Window.partitionBy("task_id").orderBy("test_file", "test_name", "target_symbol")
    t = tests.withColumn("_n", F.row_number().over(v)).filter(F.col("_n") <= TESTS)
    t = t.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("_n", "test_file", "test_name", "target_symbol"))).alias("tests"))
    c = commits.groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct("n", "commit_id", "summary", "timestamp"))).alias("commits"))
    limits = tasks.select("task_id", "limit_tokens")
    fresh = (F.col("status") == "fresh") & (F.col("confidence") > 0)
    m = claims.join(limits, "task_id").withColumn("_size", F.octet_length("claim")).filter(F.ceil(F.col("_size") / 4) <= F.col("limit_tokens"))
    m = m.withColumn("_fresh", F.coalesce(fresh, F.lit(False)))
    entry = F.sort_array(F.collect_list(F.struct("at", F.col("memory_id").alias("id"), "claim", "status", "confidence", "files")))
    total = m.filter("_fresh").groupBy("task_id").agg(F.sum("_size").alias("claim_bytes"))
    v = _fitting(m.filter("_fresh"), ["at", "memory_id"], "_size").groupBy("task_id").agg(entry.alias("verified"))
    g = _fitting(m.filter("NOT _fresh"), ["at", "memory_id"], "_size").groupBy("task_id").agg(entry.alias("diagnostic"))
    w = dirty.select("repo_id", F.col("relative_path").alias("file")).distinct().withColumn("_size", F.octet_length("file"))
    w = _fitting(tasks.select("task_id", "repo_id", "limit_tokens").join(w, "repo_id"), ["file"], "_size")
    w = w.groupBy("task_id").agg(F.sort_array(F.collect_list("file")).alias("dirty"))
    rows = tasks.select("task_id", "repo_id", "task_text", "limit_tokens").join(c, "repo_id", "left")
    for part in (f, counted, s, d, t, total, v, g, w):
        rows = rows.join(part, "task_id", "left")
    return rows.mapInPandas(_compile_rows, "task_id bigint, package string, tokens bigint, error string")


def _plain(items, skip=()) -> list[dict]:
    return [{k: v for k, v in r.asDict().items() if k not in skip} if hasattr(r, "asDict") else {k: v for k, v in dict(r).items() if k not in skip} for r in (items if items is not None else [])]


def _claims(items) -> list[dict]:
    return [{**c, "files": list(c["files"])} for c in _plain(items, ("at",))]


def _compile_rows(batches):
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            files = _plain(r.files)
            for f in files:
                f["reasons"] = list(f["reasons"])
            contents = {f["path"]: f["content"] for f in files if f["content"] is not None}
            ranked = [{"path": f["path"], "score": f["score"], "reasons": f["reasons"]} for f in files]
            try:
                p = compile_package(
                    r.task_text or "", int(r.limit_tokens or 0), ranked, _plain(r.symbols, ("rank",)), _plain(r.deps, ("_n",)), _plain(r.tests, ("_n",)), contents,
                    _plain(r.commits, ("n",)), _claims(r.verified), _claims(r.diagnostic), [] if r.dirty is None else list(r.dirty), 0 if pd.isna(r.claim_bytes) else int(r.claim_bytes),
                    0 if pd.isna(r.candidates) else int(r.candidates),
                )
                out.append((r.task_id, json.dumps(p, ensure_ascii=False, sort_keys=True), p["budget"]["returned_tokens"], None))
            except ValueError as e:
                out.append((r.task_id, None, None, str(e)))
        yield pd.DataFrame(out, columns=["task_id", "package", "tokens", "error"]).astype({"tokens": "Int64"})

"""Queries on the knowledge graph, evidence and task contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import ids, tasks, text
from codeloom.operators import catalog, context, graph, memory, search, symbols
from codeloom.plans.lookups import _LATEST, _LIVE, _REFS, _live, _refs
from codeloom.plans.registry import Registry, table
from codeloom.plans.scalars import _IMPORT, _WORDS, _list
from codeloom.session import materialize

R = Registry()

# ---- resolution

_CALLERS = """known AS (SELECT r.*, s.id AS stated FROM refs r LEFT JOIN (SELECT DISTINCT repo_id, id FROM live) s ON s.repo_id = r.repo_id AND s.id = r.source_symbol_id),
  near AS (SELECT r.ref_id, r.repo_id, min(s.id) AS near_id FROM (SELECT DISTINCT ref_id, repo_id, source_file, source_symbol_name, line_number FROM known WHERE stated IS NULL) r
    JOIN (SELECT DISTINCT repo_id, id, file_path, name, start_line, end_line FROM live) s
    ON s.repo_id = r.repo_id AND s.file_path = r.source_file AND s.name = r.source_symbol_name AND s.start_line <= r.line_number AND s.end_line >= r.line_number
    GROUP BY 1, 2 HAVING count(*) = 1),
  callers AS (SELECT k.*, coalesce(stated, near_id) AS caller_id FROM known k LEFT JOIN near n ON n.ref_id = k.ref_id AND n.repo_id = k.repo_id AND k.stated IS NULL)"""
_TARGETS = """local AS (SELECT DISTINCT r.ref_id, r.repo_id, r.target_name, s.id AS target_id FROM refs r JOIN live s
    ON s.repo_id = r.repo_id AND s.file_path = r.source_file AND s.name = r.target_name WHERE r.kind IN ('calls', 'tests')),
  wide AS (SELECT DISTINCT r.ref_id, r.repo_id, r.target_name, s.id AS target_id FROM refs r LEFT JOIN live s ON s.repo_id = r.repo_id AND s.name = r.target_name
    WHERE r.kind IN ('calls', 'tests') AND NOT EXISTS (SELECT 1 FROM local l WHERE l.ref_id = r.ref_id AND l.repo_id = r.repo_id)),
  targets AS (SELECT * FROM local UNION ALL SELECT * FROM wide)"""
_IMPORTS = f"""one AS (SELECT repo_id, name, min(id) AS target_id FROM (SELECT DISTINCT repo_id, id, name FROM live) GROUP BY 1, 2 HAVING count(*) = 1),
  imp AS (SELECT DISTINCT ref_id, repo_id, target_name, {_IMPORT} AS name FROM refs WHERE kind = 'imports'),
  imports AS (SELECT i.*, o.target_id FROM imp i LEFT JOIN one o ON o.repo_id = i.repo_id AND o.name = i.name)"""


@R.query("resolve_callers", f"WITH {_LIVE}, {_REFS}, {_CALLERS} SELECT ref_id, repo_id, source_file, kind, caller_id FROM callers")
def resolve_callers(spark, folder):
    """The source symbol of every reference."""
    r = graph.callers(_refs(spark, folder), _live(spark, folder))
    return r.select("ref_id", "repo_id", "source_file", "kind", "caller_id")


@R.query("resolve_calls", f"WITH {_LIVE}, {_REFS}, {_TARGETS} SELECT ref_id, repo_id, target_name, target_id FROM targets")
def resolve_calls(spark, folder):
    """The symbols that every call and test may mean."""
    return graph.call_targets(_refs(spark, folder), _live(spark, folder))


@R.query("resolve_imports", f"WITH {_LIVE}, {_REFS}, {_IMPORTS} SELECT ref_id, repo_id, target_name, name, target_id FROM imports")
def resolve_imports(spark, folder):
    """The symbol that every import means, if it is the only one."""
    return graph.import_targets(_refs(spark, folder), _live(spark, folder))


# ---- graph

_DS = "'dataset:' || repo_id || ':default'"
_ALL = f"""{_LIVE}, {_REFS}, files_now AS ({_LATEST}), {_CALLERS}, {_TARGETS}, {_IMPORTS},
  named AS (SELECT repo_id, id, max(name) AS label, max(file_path) AS file_path FROM live GROUP BY 1, 2),
  src AS (SELECT ref_id, repo_id, kind, source_file, {_DS} AS ds, CASE WHEN caller_id IS NOT NULL THEN 'symbol:' || {_DS} || ':' || caller_id ELSE 'file:' || {_DS} || ':' || source_file END AS src_id FROM callers),
  raw AS (
    SELECT s.repo_id, ds, src_id, CASE WHEN target_id IS NOT NULL THEN 'symbol:' || ds || ':' || target_id ELSE 'name:' || ds || ':' || target_name END AS dst_id, kind,
      CASE WHEN target_id IS NULL THEN target_name END AS payload, CASE WHEN target_id IS NULL THEN target_name END AS name, source_file
    FROM src s JOIN targets t ON t.ref_id = s.ref_id AND t.repo_id = s.repo_id WHERE kind IN ('calls', 'tests')
    UNION ALL
    SELECT s.repo_id, ds, src_id, CASE WHEN target_id IS NOT NULL THEN 'symbol:' || ds || ':' || target_id ELSE 'name:' || ds || ':' || name END, kind, target_name,
      CASE WHEN target_id IS NULL THEN name END, source_file FROM src s JOIN imports i ON i.ref_id = s.ref_id AND i.repo_id = s.repo_id WHERE kind = 'imports'),
  nodes AS (
    SELECT repo_id, {_DS} AS dataset_id, 'file:' || {_DS} || ':' || relative_path AS id, 'file' AS kind, relative_path AS label FROM files_now
    UNION SELECT repo_id, {_DS}, 'symbol:' || {_DS} || ':' || id, 'symbol', label FROM named
    UNION SELECT repo_id, {_DS}, 'file:' || {_DS} || ':' || file_path, 'file', file_path FROM named
    UNION SELECT repo_id, ds, 'name:' || ds || ':' || name, 'name', name FROM raw WHERE name IS NOT NULL
    UNION SELECT repo_id, ds, 'file:' || ds || ':' || source_file, 'file', source_file FROM raw),
  edges AS (SELECT repo_id, dataset_id, src_id, dst_id, kind, max(payload) AS payload FROM (
    SELECT repo_id, {_DS} AS dataset_id, 'file:' || {_DS} || ':' || file_path AS src_id, 'symbol:' || {_DS} || ':' || id AS dst_id, 'owns' AS kind, NULL AS payload FROM named
    UNION ALL SELECT repo_id, ds, src_id, dst_id, kind, payload FROM raw) WHERE src_id <> dst_id GROUP BY 1, 2, 3, 4, 5)"""


def _graph(spark, folder):
    return graph.project(catalog.latest(table(spark, folder, "files")), _live(spark, folder), _refs(spark, folder))


@R.query("graph_nodes", f"WITH {_ALL} SELECT * FROM nodes")
def graph_nodes(spark, folder):
    """Nodes of the projected graph."""
    return _graph(spark, folder)[0].drop("datapoint_id")


@R.query("graph_edges", f"WITH {_ALL} SELECT * FROM edges")
def graph_edges(spark, folder):
    """Edges of the projected graph."""
    return _graph(spark, folder)[1]


_STARTS = "SELECT DISTINCT 'file:' || " + _DS + " || ':' || relative_path AS id FROM files WHERE is_test"


@R.query(
    "graph_traverse",
    f"""WITH {_ALL}, st AS ({_STARTS}), e AS (SELECT DISTINCT src_id, dst_id FROM edges),
      d0 AS (SELECT id AS start, id, 0 AS depth FROM st),
      d1 AS (SELECT DISTINCT start, dst_id AS id, 1 AS depth FROM d0 JOIN e ON e.src_id = d0.id),
      d2 AS (SELECT DISTINCT start, dst_id AS id, 2 AS depth FROM d1 JOIN e ON e.src_id = d1.id),
      d3 AS (SELECT DISTINCT start, dst_id AS id, 3 AS depth FROM d2 JOIN e ON e.src_id = d2.id)
    SELECT start, id, min(depth) AS depth FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3) GROUP BY 1, 2""",
)
def graph_traverse(spark, folder):
    """What every test file reaches in three steps."""
    f = table(spark, folder, "files").filter("is_test")
    starts = f.select(ids.file_node(ids.dataset_id(F.col("repo_id")), F.col("relative_path")).alias("id")).distinct()
    return graph.traverse(_graph(spark, folder)[1], starts, 3)


_SETS = "SELECT DISTINCT 'nodeset:' || repo_id || ':lang:' || language AS node_set_id, 'lang:' || language AS name, 'file:' || " + _DS + " || ':' || relative_path AS node_id"


@R.query("node_sets", f"{_SETS} FROM ({_LATEST})")
def node_sets(spark, folder):
    """Members of the language sets."""
    return graph.language_sets(catalog.latest(table(spark, folder, "files")))


def _commits(spark, folder):
    d = table(spark, folder, "documents").filter("doc_kind = 'commit_message'")
    return d.select("repo_id", F.col("doc_id").cast("string").alias("commit_id"), "path", "created_at", F.split("text", "\n")[0].alias("summary"))


def _recent(spark, folder):
    from pyspark.sql import Window

    w = Window.partitionBy("repo_id").orderBy(F.desc("created_at"), "commit_id")
    return _commits(spark, folder).withColumn("n", F.row_number().over(w)).filter("n <= 15")


_LINKS = """WITH d AS (SELECT DISTINCT repo_id, commit_id, CASE WHEN kind = 'chunk' THEN regexp_replace(path, '#[0-9]+-[0-9]+$', '') ELSE path END AS path FROM datapoints WHERE commit_id IS NOT NULL)
    SELECT DISTINCT d.repo_id, 'dataset:' || d.repo_id || ':default' AS dataset_id, 'commit:dataset:' || d.repo_id || ':default:' || commit_id AS src_id,
      'file:dataset:' || d.repo_id || ':default:' || d.path AS dst_id, 'touched-in-commit' AS kind FROM d
    WHERE EXISTS (SELECT 1 FROM datapoints f WHERE f.kind = 'file' AND f.repo_id = d.repo_id AND f.path = d.path)"""


@R.query("commit_links", _LINKS)
def commit_links(spark, folder):
    """Edges from the commits that datapoints name to the recorded files of their paths."""
    d = table(spark, folder, "datapoints")
    touched = d.filter("commit_id IS NOT NULL").select("repo_id", "commit_id", ids.chunk_owner(F.col("kind"), F.col("path")).alias("path"))
    recorded = d.filter("kind = 'file'").select("repo_id", F.col("path").alias("relative_path"))
    return graph.commit_links(touched, touched, recorded).drop("payload")


@R.query(
    "recent_commits",
    """SELECT repo_id, CAST(doc_id AS VARCHAR) AS commit_id, created_at FROM documents WHERE doc_kind = 'commit_message'
    QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, CAST(doc_id AS VARCHAR)) <= 15""",
)
def recent_commits(spark, folder):
    """The 15 newest commits of each repository, the reference's limit."""
    return _recent(spark, folder).select("repo_id", "commit_id", "created_at")


@R.query(
    "graph_export_dot",
    f"""WITH {_ALL}, q AS (SELECT * FROM nodes)
    SELECT 'node' AS part, '  "' || replace(replace(id, '\\', '\\\\'), '"', '\\"') || '" [label="' || replace(replace(label, '\\', '\\\\'), '"', '\\"') || '"];' AS line FROM q
    UNION ALL SELECT 'edge', '  "' || replace(replace(src_id, '\\', '\\\\'), '"', '\\"') || '" -> "' || replace(replace(dst_id, '\\', '\\\\'), '"', '\\"') || '" [label="' || kind || '"];' FROM edges""",
)
def graph_export_dot(spark, folder):
    """The graph as DOT lines."""
    return graph.dot_lines(*_graph(spark, folder))


@R.query(
    "graph_export_mermaid",
    f"""WITH {_ALL}, num AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM (SELECT DISTINCT id FROM nodes))
    SELECT 'node' AS part, '  n' || n || '["' || replace(replace(label, '"', ''''), chr(10), ' ') || '"]' AS line FROM nodes JOIN num USING (id)
    UNION ALL SELECT 'edge', '  n' || a.n || ' -->|' || kind || '| n' || b.n FROM edges JOIN num a ON a.id = src_id JOIN num b ON b.id = dst_id""",
)
def graph_export_mermaid(spark, folder):
    """The graph as Mermaid lines."""
    return graph.mermaid_lines(*_graph(spark, folder))


@R.query(
    "graph_export_json",
    f"""WITH {_ALL} SELECT 'node' AS part, id AS a, kind AS b, label AS c FROM nodes UNION ALL SELECT 'edge', src_id, dst_id, kind FROM edges""",
)
def graph_export_json(spark, folder):
    """The graph as JSON objects, a line each, read back: its ids, kinds and labels, its ends and kinds."""
    lines = graph.json_lines(*_graph(spark, folder))
    of = lambda *names: F.coalesce(*[F.get_json_object("line", f"$.{n}") for n in names])
    node = F.col("part") == "node"
    return lines.select("part", of("id", "src_id").alias("a"), F.when(node, of("kind")).otherwise(of("dst_id")).alias("b"), F.when(node, of("label")).otherwise(of("kind")).alias("c"))


@R.query(
    "graph_without_names",
    f"""WITH {_ALL} SELECT src_id, dst_id, kind FROM edges WHERE dst_id NOT LIKE 'name:%' AND src_id NOT LIKE 'name:%'""",
)
def graph_without_names(spark, folder):
    """Edges that stay when all synthetic name nodes are deleted."""
    nodes, edges = _graph(spark, folder)
    members = graph.language_sets(catalog.latest(table(spark, folder, "files")))
    gone = nodes.filter("kind = 'name'").select("id")
    return graph.delete_nodes(nodes, edges, members, gone)[1].select("src_id", "dst_id", "kind")


# ---- evidence: what a claim would have cited before symbols were deleted and files changed, against what there is now


def _evidence(spark, folder):
    """(memory_id, repo_id, file, symbols, fingerprint, status): claims on one symbol, on all names of a file by one old hash, on whole files,
    and such without a baseline, every other of them stale before."""
    s, f = table(spark, folder, "symbols"), table(spark, folder, "files")
    none, fresh = F.array().cast("array<string>"), F.lit("fresh").alias("status")
    one = s.filter("deleted_at IS NOT NULL").select(
        F.concat_ws("|", F.lit("one"), "repo_id", "id", "fingerprint").alias("memory_id"), "repo_id", F.col("file_path").alias("file"), F.array("name").alias("symbols"), "fingerprint", fresh
    )
    per = s.groupBy("repo_id", F.col("file_path").alias("file")).agg(F.array_sort(F.collect_set("name")).alias("symbols"), F.min("fingerprint").alias("fingerprint"))
    many = per.select(F.concat_ws("|", F.lit("all"), "repo_id", "file").alias("memory_id"), "repo_id", "file", "symbols", "fingerprint", fresh)
    first = f.groupBy("repo_id", F.col("relative_path").alias("file")).agg(F.min("file_hash").alias("h"))
    whole = first.select(F.concat_ws("|", F.lit("file"), "repo_id", "file").alias("memory_id"), "repo_id", "file", none.alias("symbols"), F.concat(F.lit(memory.FILE_BASELINE), "h").alias("fingerprint"), fresh)
    was = F.when(F.length("file") % 2 == 0, "stale").otherwise("fresh").alias("status")
    bare = first.select(F.concat_ws("|", F.lit("open"), "repo_id", "file").alias("memory_id"), "repo_id", "file", none.alias("symbols"), F.lit(None).cast("string").alias("fingerprint"), was)
    return one.distinct().unionByName(many).unionByName(whole).unionByName(bare)


def _judged(spark, folder):
    e = _evidence(spark, folder)
    m = e.select("memory_id", "status").distinct().withColumn("confidence", F.lit(1.0))
    return memory.staleness(m, e.drop("status"), _live(spark, folder), catalog.latest(table(spark, folder, "files")))


_JUDGED = f"""{_LIVE}, fh AS ({_LATEST}), firsts AS (SELECT repo_id, relative_path, min(file_hash) AS h FROM files GROUP BY 1, 2),
  e AS (SELECT DISTINCT concat_ws('|', 'one', repo_id, id, fingerprint) AS memory_id, repo_id, file_path, [name] AS names, fingerprint AS fp, 'fresh' AS was FROM symbols WHERE deleted_at IS NOT NULL
    UNION ALL SELECT concat_ws('|', 'all', repo_id, file_path), repo_id, file_path, list(DISTINCT name), min(fingerprint), 'fresh' FROM symbols GROUP BY repo_id, file_path
    UNION ALL SELECT concat_ws('|', 'file', repo_id, relative_path), repo_id, relative_path, [], 'file-v1:' || h, 'fresh' FROM firsts
    UNION ALL SELECT concat_ws('|', 'open', repo_id, relative_path), repo_id, relative_path, [], NULL, CASE WHEN length(relative_path) % 2 = 0 THEN 'stale' ELSE 'fresh' END FROM firsts),
  nm AS (SELECT repo_id, file_path, name, fingerprint FROM live UNION SELECT repo_id, file_path, qualified_name, fingerprint FROM live),
  q AS (SELECT memory_id, n.name, bool_or(nm.name IS NOT NULL) AS there, bool_or(coalesce(nm.fingerprint = n.fp, false)) AS held
    FROM (SELECT memory_id, repo_id, file_path, fp, unnest(names) AS name FROM e) n LEFT JOIN nm ON nm.repo_id = n.repo_id AND nm.file_path = n.file_path AND nm.name = n.name GROUP BY 1, 2),
  r AS (SELECT memory_id, bool_or(NOT there) AS missing, bool_and(held) AS held FROM q GROUP BY 1),
  j AS (SELECT e.memory_id, was, f.file_hash IS NULL OR coalesce(missing, false) AS gone, fp IS NULL AS open,
    fp IS NULL OR CASE WHEN len(names) > 0 THEN NOT coalesce(held, false) ELSE fp <> 'file-v1:' || f.file_hash END AS differs
    FROM e LEFT JOIN fh f ON f.repo_id = e.repo_id AND f.relative_path = e.file_path LEFT JOIN r USING (memory_id)),
  judged AS (SELECT memory_id, CASE WHEN gone OR (differs AND open AND was = 'stale') THEN 'stale' WHEN differs THEN 'degraded' ELSE 'fresh' END AS status,
    CASE WHEN gone OR (differs AND open AND was = 'stale') THEN 0.0 WHEN differs THEN 0.7 ELSE 1.0 END::DOUBLE AS confidence FROM j)"""


@R.query("memory_staleness", f"WITH {_JUDGED} SELECT * FROM judged")
def memory_staleness(spark, folder):
    """How fresh claims on deleted symbols, on all names of a file, on whole files and without a baseline would be."""
    return _judged(spark, folder)


@R.query(
    "memory_status_counts",
    f"""WITH {_JUDGED} SELECT count(*) AS total, count(*) FILTER (status = 'fresh') AS fresh, count(*) FILTER (status = 'degraded') AS degraded,
    count(*) FILTER (status IN ('stale', 'invalidated')) AS stale FROM judged""",
)
def memory_status_counts(spark, folder):
    """Claims by status."""
    return memory.status_counts(_judged(spark, folder))


@R.query(
    "evidence_baseline",
    f"""WITH {_LIVE}, nm AS (SELECT DISTINCT repo_id, file_path, name, fingerprint FROM live)
    SELECT repo_id, file_path AS file, 'symbols-v1:' || sha256(string_agg(name || chr(0) || fingerprint || chr(0), '' ORDER BY encode(name || chr(0) || fingerprint || chr(0)))) AS baseline
    FROM (SELECT l.repo_id, l.file_path, l.name, l.fingerprint FROM live l WHERE EXISTS (SELECT 1 FROM files f WHERE f.repo_id = l.repo_id AND f.relative_path = l.file_path)) GROUP BY 1, 2""",
)
def evidence_baseline(spark, folder):
    """The baseline of all symbols of each file together."""
    s = _live(spark, folder)
    e = s.groupBy("repo_id", F.col("file_path").alias("file")).agg(F.collect_set("name").alias("symbols"))
    e = e.select(F.concat_ws("|", "repo_id", "file").alias("memory_id"), "repo_id", "file", "symbols", F.lit(None).cast("string").alias("fingerprint"))
    b = memory.baselines(e, s.withColumn("qualified_name", F.col("name")), catalog.latest(table(spark, folder, "files")))
    return b.filter("has_file").select("repo_id", "file", F.col("now").alias("baseline"))


@R.query(
    "hunk_overlap",
    f"""WITH {_LIVE}, h AS (SELECT DISTINCT repo_id, source_file AS file_path, line_number AS start, line_number + 3 AS stop FROM symbol_references)
    SELECT DISTINCT l.repo_id, l.file_path, l.id FROM live l JOIN h USING (repo_id, file_path) WHERE start_line <= stop AND end_line >= start""",
)
def hunk_overlap(spark, folder):
    """Symbols that a change of three lines at any reference would touch."""
    r = table(spark, folder, "symbol_references")
    h = r.select("repo_id", F.col("source_file").alias("file_path"), F.col("line_number").alias("start"), F.lit(3).alias("lines")).distinct()
    return memory.changed_symbols(h, _live(spark, folder))


# ---- contexts


def _task_terms(spark, folder):
    b = table(spark, folder, "budgets")
    return b.select("task_id", "repo_id", F.explode(tasks.keywords(F.col("task_text"))).alias("term")).distinct()


def _dirty(spark, folder):
    """Files that no commit holds."""
    return catalog.latest(table(spark, folder, "files")).filter("git_blob_id IS NULL").select("repo_id", "relative_path")


def _context(spark, folder, cut=lambda df, name: df, hits=None):
    """Matches, dependencies, tests and signals; ``cut`` may end the lineage of the first three."""
    terms, live, refs = _task_terms(spark, folder), _live(spark, folder), _refs(spark, folder)
    files = catalog.latest(table(spark, folder, "files"))
    dirty = _dirty(spark, folder)
    matches = cut(context.symbol_matches(symbols.exact(live, terms), symbols.partial(live, terms, context.PARTIAL_LIMIT), terms, dirty), "matches")
    names = matches.select("repo_id", "name").distinct()
    deps = cut(symbols.dependencies(refs, live, names), "dependencies")
    tests = cut(symbols.related_tests(refs, files, names), "tests")
    signals = context.file_signals(matches, deps, tests, context.dirty_signal(table(spark, folder, "budgets"), dirty), hits)
    return matches, deps, tests, signals


_TT = f"""tt AS (SELECT DISTINCT task_id, repo_id, unnest(list_filter(flatten(list_transform({_WORDS}, lambda w:
  CASE WHEN regexp_matches(w, '[-_]') THEN list_transform(list_concat([w], regexp_split_to_array(w, '[-_]')), lambda x: lower(x))
  ELSE [lower(w)] END)), lambda w: octet_length(encode(w)) >= 2 AND w NOT IN ({_list(tasks.STOP_WORDS)}))) AS term FROM budgets)"""
_MATCH = f"""{_LIVE}, {_TT}, now_files AS ({_LATEST}), dirty AS (SELECT repo_id, relative_path FROM now_files WHERE git_blob_id IS NULL),
  ex AS (SELECT DISTINCT l.*, t.term FROM live l JOIN (SELECT DISTINCT repo_id, term FROM tt) t USING (repo_id)
    WHERE l.name = t.term OR l.qualified_name = t.term OR ends_with(lower(l.qualified_name), '::' || lower(t.term))),
  pa AS (SELECT l.*, t.term FROM live l JOIN (SELECT DISTINCT repo_id, term FROM tt) t ON l.repo_id = t.repo_id AND (contains(lower(l.name), t.term) OR contains(lower(l.qualified_name), t.term))
    QUALIFY row_number() OVER (PARTITION BY l.repo_id, t.term ORDER BY l.file_path, l.start_line, l.id, l.name, l.qualified_name, l.kind, l.end_line, l.signature, l.fingerprint) <= 25),
  m AS (SELECT tt.task_id, x.*, x.base + CASE WHEN EXISTS (SELECT 1 FROM dirty d WHERE d.repo_id = x.repo_id AND d.relative_path = x.file_path) THEN 8.0 ELSE 0.0 END AS score
    FROM (SELECT *, 10.0 AS base, 0 AS pass FROM ex UNION ALL SELECT *, 7.0, 1 FROM pa) x JOIN tt ON tt.repo_id = x.repo_id AND tt.term = x.term)"""


@R.query(
    "context_symbols",
    f"""WITH {_MATCH}, once AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY task_id, id ORDER BY term, pass, file_path, start_line) = 1)
    SELECT task_id, id, term, score::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY task_id ORDER BY score DESC, term, pass, file_path, start_line, id) AS INT) AS rank FROM once
    QUALIFY rank <= 12""",
)
def context_symbols(spark, folder):
    """The 12 symbols of every task's package, the reference's limit."""
    return context.candidate_symbols(_context(spark, folder)[0]).select("task_id", "id", "term", "score", "rank")


_FILE_SCORES = f"""WITH {_MATCH}, {_REFS}, nm AS (SELECT task_id, repo_id, name, count(*) AS times FROM m GROUP BY 1, 2, 3),
      un AS (SELECT DISTINCT repo_id, name FROM nm),
      ff AS (SELECT repo_id, relative_path, bool_or(is_test) AS is_test FROM now_files GROUP BY 1, 2),
      j AS (SELECT r.*, f.is_test FROM refs r JOIN ff f ON f.repo_id = r.repo_id AND f.relative_path = r.source_file),
      hit AS (SELECT j.*, n.name FROM j JOIN un n ON n.repo_id = j.repo_id AND n.name = j.target_name AND (j.kind = 'tests' OR j.is_test OR starts_with(lower(j.source_symbol_name), 'test_'))
        UNION SELECT j.*, n.name FROM j JOIN un n ON n.repo_id = j.repo_id AND j.kind = 'tests' AND (j.source_symbol_name = n.name OR lower(j.source_symbol_name) = 'test_' || lower(n.name)
            OR starts_with(lower(j.source_symbol_name), 'test_' || lower(n.name) || '_'))),
      te AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY repo_id, name, source_file, source_symbol_name, target_name ORDER BY kind <> 'tests', line_number, kind) = 1),
      sig AS (SELECT task_id, file_path AS file, score, 1 AS times FROM m
        UNION ALL SELECT task_id, source_file, 5.0 * times, times FROM nm JOIN refs r ON r.repo_id = nm.repo_id AND r.target_name = nm.name AND r.kind = 'calls'
        UNION ALL SELECT task_id, source_file, 4.0 * times, times FROM nm JOIN refs r ON r.repo_id = nm.repo_id AND r.source_symbol_name = nm.name AND r.kind = 'calls'
        UNION ALL SELECT task_id, source_file, 6.0 * times, times FROM nm JOIN te ON te.repo_id = nm.repo_id AND te.name = nm.name
        UNION ALL SELECT DISTINCT task_id, relative_path, 8.0, 1 FROM budgets JOIN dirty USING (repo_id))
  SELECT task_id, file, sum(score)::DOUBLE AS score, CAST(sum(times) AS BIGINT) AS n_reasons FROM sig GROUP BY 1, 2"""


@R.query("context_file_scores", _FILE_SCORES)
def context_file_scores(spark, folder):
    """The score of every file for every task, and how many reasons it has, by all signals but the text search and the claims."""
    scores = context.file_scores(_context(spark, folder, materialize)[3])
    return scores.select("task_id", "file", "score", F.aggregate("reasons", F.lit(0).cast("bigint"), lambda a, r: a + r["n"]).alias("n_reasons"))


def _task_claims(spark, folder, b, signals):
    """The claims that bear on each task, judged by their evidence, and (task_id, file, memory_id) of what fresh ones cite."""
    d = table(spark, folder, "documents").filter("doc_kind = 'memory_claim' AND repo_id IS NOT NULL")
    # the order of the log in which claims are kept: by their time
    at = F.struct("created_at", "doc_id")
    m = d.select(
        F.col("doc_id").cast("string").alias("memory_id"), "repo_id", text.redact(F.coalesce("text", F.lit(""))).alias("claim"), at.alias("at"), F.col("path").alias("file"),
        F.lit("fresh").alias("status"), F.lit(1.0).alias("confidence"),
    )
    none = F.array().cast("array<string>")
    e = m.filter("file IS NOT NULL").select("memory_id", "repo_id", "file", none.alias("symbols"), F.lit(None).cast("string").alias("fingerprint"))
    judged = memory.verify(m.select("memory_id", "status", "confidence"), e, _live(spark, folder), catalog.latest(table(spark, folder, "files")))
    m = materialize(m.drop("status", "confidence").join(judged, "memory_id"), "claims")
    e = m.filter("file IS NOT NULL").select("memory_id", "repo_id", "file", none.alias("symbols"))
    scored = signals.select("task_id", "file").join(b.select("task_id", "repo_id").distinct(), "task_id").select("task_id", "repo_id", "file").distinct()
    # a claim that no package of its task can hold is passed over
    small = m.join(b.select("task_id", "repo_id", "limit_tokens"), "repo_id").filter(text.estimate_tokens(F.col("claim")) <= F.col("limit_tokens")).select("task_id", "memory_id")
    found = memory.relevant(m, e, _task_terms(spark, folder), scored).join(small, ["task_id", "memory_id"], "left_semi")
    fresh = m.filter("status = 'fresh' AND confidence > 0")
    found = memory.followed(found, e, fresh, m.select("memory_id", "at")).join(small, ["task_id", "memory_id"], "left_semi")
    claims = materialize(
        found.join(m, "memory_id").select("task_id", "at", "memory_id", "claim", "status", "confidence", F.filter(F.array("file"), lambda f: f.isNotNull()).alias("files")), "task-claims"
    )
    supported = claims.filter("status = 'fresh' AND confidence > 0").select("task_id", F.explode("files").alias("file"), "memory_id")
    return claims, supported


@R.query("context_packages")
def context_packages(spark, folder):
    """The evidence package of every task within its budget."""
    b = table(spark, folder, "budgets")
    content = table(spark, folder, "file_content")
    docs = content.groupBy("repo_id", F.col("relative_path").alias("path")).agg(F.min("content").alias("content"))
    hits = search.bm25_tasks(docs, b.select("task_id", "repo_id", F.col("task_text").alias("query")))
    hits = materialize(hits.select("task_id", F.col("path").alias("file"), "idx"), "hits")
    matches, deps, tests, signals = _context(spark, folder, materialize, hits)
    claims, supported = _task_claims(spark, folder, b, signals)
    scores = materialize(context.file_scores(signals.unionByName(context.memory_signal(supported))), "scores")
    names = matches.select("task_id", "repo_id", "name").distinct()
    d = deps.filter("role <> 'import'").join(names, ["repo_id", "name"]).select(
        "task_id", F.coalesce("source_symbol_name", F.lit("<top-level>")).alias("caller"), F.col("target_name").alias("callee"),
        F.col("kind").alias("relationship"), F.col("source_file").alias("file_path"), F.col("line_number").alias("line"),
    ).distinct()
    t = tests.join(names, ["repo_id", "name"]).select("task_id", F.col("source_file").alias("test_file"), F.col("source_symbol_name").alias("test_name"), F.col("name").alias("target_symbol")).distinct()
    c = _recent(spark, folder).select("repo_id", "n", "commit_id", text.redact(F.col("summary")).alias("summary"), F.col("created_at").cast("bigint").alias("timestamp"))
    return context.packages(b, scores, context.candidate_symbols(matches), d, t, content, c, claims, _dirty(spark, folder))


_PACKAGE = (
    "task string, files array<struct<path:string,score:double,reasons:array<string>,snippet:string>>, symbols array<struct<id:string,signature:string>>,"
    " budget struct<limit:bigint,returned_tokens:bigint,candidate_files:bigint,returned_files:bigint>"
)


@R.query(
    "context_package_checks",
    "SELECT DISTINCT task_id, limit_tokens, true AS fits, true AS files_in_order, true AS counts_agree, true AS symbols_known FROM budgets",
)
def context_package_checks(spark, folder):
    """What must hold of every package: within its budget, files by score, counts that agree, symbols among the task's best twelve."""
    p = context_packages(spark, folder).filter("error IS NULL").select("task_id", F.from_json("package", _PACKAGE).alias("p"))
    best = context_symbols(spark, folder).groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("best"))
    b = table(spark, folder, "budgets").select("task_id", "limit_tokens")
    j = p.join(b, "task_id").join(best, "task_id", "left")
    score = F.transform("p.files", lambda f: f["score"])
    given, known = F.transform("p.symbols", lambda s: s["id"]), F.coalesce(F.transform("best", lambda s: s["id"]), F.array().cast("array<string>"))
    n = F.col("p.budget.returned_files")
    return j.select(
        "task_id", "limit_tokens", (F.col("p.budget.returned_tokens") <= F.col("limit_tokens")).alias("fits"), (score == F.sort_array(score, asc=False)).alias("files_in_order"),
        ((F.size("p.files") == n) & (n <= context.FILES) & (n <= F.col("p.budget.candidate_files"))).alias("counts_agree"),
        (given == F.slice(known, F.lit(1), F.size(given))).alias("symbols_known"),
    )


@R.query(
    "memory_matches",
    f"""WITH {_TT}, mem AS (SELECT CAST(doc_id AS VARCHAR) AS memory_id, repo_id, text AS claim, path FROM documents WHERE doc_kind = 'memory_claim')
    SELECT DISTINCT task_id, memory_id FROM mem JOIN tt USING (repo_id) WHERE contains(lower(claim), term)
    UNION SELECT DISTINCT b.task_id, memory_id FROM mem JOIN budgets b USING (repo_id) JOIN scored_files s ON s.task_id = b.task_id AND s.relative_path = mem.path""",
)
def memory_matches(spark, folder):
    """Claims that bear on a task by their words or the files that they cite."""
    d = table(spark, folder, "documents").filter("doc_kind = 'memory_claim'")
    m = d.select(F.col("doc_id").cast("string").alias("memory_id"), "repo_id", F.col("text").alias("claim"))
    none = F.array().cast("array<string>")
    e = d.filter("path IS NOT NULL").select(F.col("doc_id").cast("string").alias("memory_id"), "repo_id", F.col("path").alias("file"), none.alias("symbols"))
    b = table(spark, folder, "budgets")
    s = table(spark, folder, "scored_files").join(b.select("task_id", "repo_id"), "task_id").select("task_id", "repo_id", F.col("relative_path").alias("file")).distinct()
    return memory.relevant(m, e, _task_terms(spark, folder), s)

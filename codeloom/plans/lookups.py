"""Queries on the catalog, symbols, search and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import tasks
from codeloom.operators import catalog, search, symbols, versions
from codeloom.plans.registry import Registry, table
from codeloom.plans.scalars import _WORDS, _list
from codeloom.session import materialize

R = Registry()

# ---- catalog

_LATEST = "SELECT * FROM (SELECT DISTINCT * FROM files) QUALIFY row_number() OVER (PARTITION BY repo_id, relative_path ORDER BY indexed_at DESC) = 1"


@R.query("catalog_files", f"SELECT repo_id, relative_path, file_hash, git_blob_id, size_bytes, kind, is_test, is_doc FROM ({_LATEST})")
def catalog_files(spark, folder):
    """The present row of every file, in order of path."""
    f = catalog.latest(table(spark, folder, "files"))
    cols = ["repo_id", "relative_path", "file_hash", "git_blob_id", "size_bytes", "kind", "is_test", "is_doc"]
    return f.select(cols).orderBy("repo_id", "relative_path")


@R.query(
    "file_stats",
    f"""WITH f AS ({_LATEST}), r AS (SELECT DISTINCT * FROM symbol_references),
      s AS (SELECT DISTINCT repo_id, id, name, qualified_name, kind, file_path, start_line, end_line, signature, fingerprint FROM symbols WHERE deleted_at IS NULL),
      a AS (SELECT repo_id, count(*) total_files, count(*) FILTER (kind = 'source') source_files, count(*) FILTER (is_test) test_files,
        count(*) FILTER (is_doc) doc_files, count(*) FILTER (kind = 'manifest') manifest_files,
        count(*) FILTER (kind = 'configuration') configuration_files FROM f GROUP BY 1),
      b AS (SELECT repo_id, count(*) symbols FROM s GROUP BY 1), c AS (SELECT repo_id, count(*) refs FROM r GROUP BY 1)
    SELECT repo_id, coalesce(total_files, 0) total_files, coalesce(source_files, 0) source_files, coalesce(test_files, 0) test_files,
      coalesce(doc_files, 0) doc_files, coalesce(manifest_files, 0) manifest_files, coalesce(configuration_files, 0) configuration_files,
      coalesce(symbols, 0) symbols, coalesce(refs, 0) refs FROM a FULL JOIN b USING (repo_id) FULL JOIN c USING (repo_id)""",
)
def file_stats(spark, folder):
    """Counts of files by kind, symbols and references per repository."""
    return catalog.stats(
        catalog.latest(table(spark, folder, "files")),
        symbols.live(table(spark, folder, "symbols")),
        table(spark, folder, "symbol_references").distinct(),
    )


def _before(files):
    """What the catalog knew at the middle of its time."""
    s = files.agg(F.min("indexed_at").alias("a"), F.max("indexed_at").alias("b")).first()
    return files.filter(F.col("indexed_at") <= F.lit(s["a"] + (s["b"] - s["a"]) / 2)) if s["a"] else files


@R.query(
    "catalog_diff",
    f"""WITH m AS (SELECT DISTINCT repo_id, source_file AS relative_path FROM symbol_references WHERE source_symbol_name IS NOT NULL AND source_symbol_id IS NULL),
      cut AS (SELECT to_timestamp((epoch(min(indexed_at)) + epoch(max(indexed_at))) / 2) AS t FROM files),
      o AS (SELECT * FROM (SELECT DISTINCT f.* FROM files f, cut WHERE indexed_at <= t) QUALIFY row_number() OVER (PARTITION BY repo_id, relative_path ORDER BY indexed_at DESC) = 1),
      n AS ({_LATEST})
    SELECT repo_id, relative_path, CASE WHEN n.file_hash IS NULL THEN 'deleted' WHEN o.file_hash IS NULL THEN 'added' ELSE 'changed' END AS change
    FROM o FULL JOIN n USING (repo_id, relative_path) LEFT JOIN m USING (repo_id, relative_path)
    WHERE o.file_hash IS NULL OR n.file_hash IS NULL OR o.file_hash <> n.file_hash OR m.repo_id IS NOT NULL""",
)
def catalog_diff(spark, folder):
    """What changed between the catalog at the middle of its time and now."""
    f = table(spark, folder, "files")
    gaps = catalog.missing_identity(table(spark, folder, "symbol_references"))
    return catalog.diff(catalog.latest(_before(f)), catalog.latest(f), gaps)


@R.query(
    "missing_identity",
    "SELECT DISTINCT repo_id, source_file AS relative_path FROM symbol_references WHERE source_symbol_name IS NOT NULL AND source_symbol_id IS NULL",
)
def missing_identity(spark, folder):
    """Files with references that lack the id of their source."""
    return catalog.missing_identity(table(spark, folder, "symbol_references"))


@R.query(
    "orphan_points",
    """WITH d AS (SELECT DISTINCT id, repo_id, kind, path, CASE WHEN kind = 'chunk' THEN regexp_replace(path, '#[0-9]+-[0-9]+$', '') ELSE path END AS o
      FROM datapoints WHERE kind IN ('file', 'chunk') AND path <> '')
    SELECT id, repo_id, kind, path FROM d WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.repo_id = d.repo_id AND f.relative_path = d.o)""",
)
def orphan_points(spark, folder):
    """Datapoints of files that the catalog does not hold."""
    d = table(spark, folder, "datapoints").select("id", "repo_id", "kind", "path").distinct()
    return catalog.orphan_points(d, table(spark, folder, "files"))


@R.query(
    "absent_symbols",
    """WITH cut AS (SELECT to_timestamp((epoch(min(indexed_at)) + epoch(max(indexed_at))) / 2) AS t FROM files)
    SELECT DISTINCT repo_id, id FROM symbols s WHERE deleted_at IS NULL
    AND NOT EXISTS (SELECT 1 FROM files f, cut WHERE f.repo_id = s.repo_id AND f.relative_path = s.file_path AND f.indexed_at <= cut.t)""",
)
def absent_symbols(spark, folder):
    """Symbols of files that the catalog did not hold at the middle of its time."""
    s = symbols.live(table(spark, folder, "symbols")).select("repo_id", "id", F.col("file_path").alias("relative_path"))
    return catalog.absent(s, _before(table(spark, folder, "files"))).select("repo_id", "id").distinct()


# ---- symbols

_TERMS = f"""terms AS (SELECT DISTINCT repo_id, unnest(list_filter(flatten(list_transform({_WORDS}, lambda w:
  CASE WHEN regexp_matches(w, '[-_]') THEN list_transform(list_concat([w], regexp_split_to_array(w, '[-_]')), lambda x: lower(x))
  ELSE [lower(w)] END)), lambda w: octet_length(encode(w)) >= 2 AND w NOT IN ({_list(tasks.STOP_WORDS)}))) AS term FROM budgets
  UNION SELECT DISTINCT repo_id, target_name FROM symbol_references WHERE kind = 'tests')"""
_LIVE = """live AS (SELECT DISTINCT repo_id, id, name, qualified_name, kind, file_path, start_line, end_line, signature, fingerprint
  FROM symbols WHERE deleted_at IS NULL)"""


def task_terms(spark, folder):
    """Distinct (repo_id, term): the keywords of all tasks, and the names that tests refer to."""
    b = table(spark, folder, "budgets")
    asked = b.select("repo_id", F.explode(tasks.keywords(F.col("task_text"))).alias("term"))
    tested = table(spark, folder, "symbol_references").filter("kind = 'tests'").select("repo_id", F.col("target_name").alias("term"))
    return asked.unionByName(tested).distinct()


def _live(spark, folder):
    return symbols.live(table(spark, folder, "symbols"))


@R.query(
    "symbol_exact",
    f"""WITH {_TERMS}, {_LIVE} SELECT DISTINCT l.repo_id, t.term, l.id, l.file_path, l.start_line FROM live l JOIN terms t USING (repo_id)
    WHERE t.term <> '' AND (l.name = t.term OR l.qualified_name = t.term OR ends_with(lower(l.qualified_name), '::' || lower(t.term)))""",
)
def symbol_exact(spark, folder):
    """Symbols named by the tasks' terms."""
    return symbols.exact(_live(spark, folder), task_terms(spark, folder)).select("repo_id", "term", "id", "file_path", "start_line").distinct()


@R.query(
    "symbol_partial",
    f"""WITH {_TERMS}, {_LIVE} SELECT repo_id, term, id, file_path, start_line FROM (
      SELECT l.*, t.term, row_number() OVER (PARTITION BY l.repo_id, t.term ORDER BY l.file_path, l.start_line, l.id, l.name, l.qualified_name, l.kind, l.end_line, l.signature, l.fingerprint) AS n
      FROM live l JOIN terms t ON l.repo_id = t.repo_id AND (contains(lower(l.name), lower(t.term)) OR contains(lower(l.qualified_name), lower(t.term)))) WHERE n <= 20""",
)
def symbol_partial(spark, folder):
    """The first 20 symbols that hold each term, the reference's limit."""
    return symbols.partial(_live(spark, folder), task_terms(spark, folder)).select("repo_id", "term", "id", "file_path", "start_line")


@R.query("symbols_in_file", f"WITH {_LIVE} SELECT repo_id, file_path, id, start_line FROM live")
def symbols_in_file(spark, folder):
    """Every file's symbols in order."""
    return _live(spark, folder).select("repo_id", "file_path", "id", "start_line").orderBy("repo_id", "file_path", "start_line", "id")


_NAMES = f"""names AS (SELECT DISTINCT l.repo_id, l.name FROM live l JOIN terms t ON l.repo_id = t.repo_id AND (l.name = t.term
  OR l.qualified_name = t.term OR ends_with(lower(l.qualified_name), '::' || lower(t.term))))"""
_REFS = "refs AS (SELECT DISTINCT * FROM symbol_references)"


def _names(spark, folder):
    return symbols.exact(_live(spark, folder), task_terms(spark, folder)).select("repo_id", "name").distinct()


def _refs(spark, folder):
    return table(spark, folder, "symbol_references").distinct()


@R.query(
    "symbol_deps",
    f"""WITH {_TERMS}, {_LIVE}, {_NAMES}, {_REFS}
    SELECT n.repo_id, n.name, 'caller' AS role, ref_id, source_file, source_symbol_name, target_name, kind, line_number
      FROM refs r JOIN names n ON r.repo_id = n.repo_id AND r.target_name = n.name WHERE kind = 'calls'
    UNION ALL SELECT n.repo_id, n.name, 'callee', ref_id, source_file, source_symbol_name, target_name, kind, line_number
      FROM refs r JOIN names n ON r.repo_id = n.repo_id AND r.source_symbol_name = n.name WHERE kind = 'calls'
    UNION ALL SELECT n.repo_id, n.name, 'import', ref_id, r.source_file, source_symbol_name, target_name, r.kind, line_number
      FROM names n JOIN live l USING (repo_id, name) JOIN refs r ON r.repo_id = l.repo_id AND r.source_file = l.file_path WHERE r.kind = 'imports'""",
)
def symbol_deps(spark, folder):
    """Callers, callees and imports around every symbol that a task names."""
    return symbols.dependencies(_refs(spark, folder), _live(spark, folder), _names(spark, folder))


@R.query(
    "related_tests",
    f"""WITH {_LIVE}, names AS (SELECT DISTINCT repo_id, name FROM live WHERE name <> ''), {_REFS},
      f AS (SELECT repo_id, relative_path, bool_or(is_test) AS is_test FROM files GROUP BY 1, 2),
      j AS (SELECT r.*, f.is_test FROM refs r JOIN f ON f.repo_id = r.repo_id AND f.relative_path = r.source_file),
      hit AS (SELECT j.*, n.name FROM j JOIN names n ON n.repo_id = j.repo_id AND n.name = j.target_name
          AND (j.kind = 'tests' OR j.is_test OR starts_with(lower(j.source_symbol_name), 'test_'))
        UNION SELECT j.*, n.name FROM j JOIN names n ON n.repo_id = j.repo_id AND j.kind = 'tests'
          AND (j.source_symbol_name = n.name OR lower(j.source_symbol_name) = 'test_' || lower(n.name)
            OR starts_with(lower(j.source_symbol_name), 'test_' || lower(n.name) || '_')))
    SELECT repo_id, name, source_file, source_symbol_name, target_name, kind, line_number FROM hit
    QUALIFY row_number() OVER (PARTITION BY repo_id, name, source_file, source_symbol_name, target_name ORDER BY kind <> 'tests', line_number, kind) = 1""",
)
def related_tests(spark, folder):
    """Tests of every symbol."""
    names = _live(spark, folder).select("repo_id", "name")
    return symbols.related_tests(_refs(spark, folder), table(spark, folder, "files"), names)


# ---- search

_QUERY = "symbol commit"
_PHRASE = "stale budget"


def _docs(spark, folder):
    """Documents with a path of their own."""
    d = table(spark, folder, "documents")
    path = F.concat_ws("/", F.coalesce("repo_id", F.lit("")), F.col("doc_id").cast("string"))
    return d.select(path.alias("path"), F.col("text").alias("content"))


def _bm25_sql(counts: list[tuple[str, str]], k: int) -> str:
    """``counts``: for each phrase the expression of its occurrences in path and content."""
    tf = ", ".join(f"({a}) + ({b}) AS f{i}" for i, (a, b) in enumerate(counts))
    n = len(counts)
    score = " + ".join(
        f"-greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / a))" for i in range(n)
    )
    return f"""WITH t AS (SELECT concat_ws('/', coalesce(repo_id, ''), CAST(doc_id AS VARCHAR)) AS path,
        regexp_extract_all(lower(concat_ws('/', coalesce(repo_id, ''), CAST(doc_id AS VARCHAR))), '[\\p{{L}}\\p{{N}}]+') AS tp,
        regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS tc FROM documents),
      h AS (SELECT path, len(tp) + len(tc) AS len, {tf} FROM t),
      s AS (SELECT count(*) AS n, avg(len) AS a, {", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(n))} FROM h)
    SELECT path, round({score}, 6) AS rank FROM h, s WHERE {" AND ".join(f"f{i} > 0" for i in range(n))} ORDER BY {score}, path LIMIT {k}"""


def _single(w: str) -> tuple[str, str]:
    return tuple(f"len(list_filter({c}, lambda w: w = '{w}'))" for c in ("tp", "tc"))


def _pair(a: str, b: str) -> tuple[str, str]:
    return tuple(f"len(list_filter(range(1, len({c})), lambda i: {c}[i] = '{a}' AND {c}[i + 1] = '{b}'))" for c in ("tp", "tc"))


@R.query("bm25_top_k", _bm25_sql([_single(w) for w in _QUERY.split()], 10))
def bm25_top_k(spark, folder):
    """The ten best documents for a query of two words."""
    return search.bm25(_docs(spark, folder), _QUERY).withColumn("rank", F.round("rank", 6))


@R.query("bm25_phrase", _bm25_sql([_pair(*_PHRASE.split())], 10))
def bm25_phrase(spark, folder):
    """The ten best documents for a phrase."""
    return search.bm25(_docs(spark, folder), _PHRASE.replace(" ", "_")).withColumn("rank", F.round("rank", 6))


_BATCH = [(1, "symbol commit"), (2, "stale_budget"), (3, "commit"), (4, "symbol"), (5, "zzzz commit"), (6, "")]


@R.query(
    "bm25_batch",
    " UNION ALL ".join(
        f"SELECT {n} AS query_id, path, rank, CAST(row_number() OVER (ORDER BY rank, path) - 1 AS INT) AS idx FROM ({_bm25_sql([_pair(*w.split('_')) if '_' in w else _single(w) for w in q.split()], 10)})"
        for n, q in _BATCH if q
    ),
)
def bm25_batch(spark, folder):
    """The ten best documents of each of several queries, from one index."""
    corpus = _docs(spark, folder).withColumn("repo_id", F.lit("all"))
    index = materialize(search.postings(corpus, stemmed=False), "postings")
    asked = spark.createDataFrame([(n, "all", q) for n, q in _BATCH], "query_id int, repo_id string, query string")
    return search.bm25_index(index, asked, 10, stemmed=False).withColumn("rank", F.round("rank", 6))


@R.query("bm25_top_k_stemmed")
def bm25_top_k_stemmed(spark, folder):
    """The ten best documents by stems."""
    return search.bm25(_docs(spark, folder), _QUERY, stemmed=True)


@R.query("search_snippets")
def search_snippets(spark, folder):
    """The ten best documents by stems, with a snippet of each."""
    return search.search(_docs(spark, folder), _QUERY)


# ---- versions


def _points(spark, folder):
    """The event stream as arrivals: a user's path, the event type as its content, in order of time."""
    e = table(spark, folder, "events")
    return e.select(
        F.lit("events").alias("dataset_id"), F.lit("event").alias("kind"), F.col("user_id").cast("string").alias("path"),
        F.sha2("event_type", 256).alias("id"), F.struct("ts", "event_id").alias("ordinal"),
    )


_ARRIVED = """a AS (SELECT 'events' AS dataset_id, 'event' AS kind, CAST(user_id AS VARCHAR) AS path, sha256(event_type) AS id, ts, event_id FROM events),
  l AS (SELECT *, lag(id) OVER (PARTITION BY path ORDER BY ts, event_id) AS previous FROM a),
  v AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts, event_id) AS v FROM l WHERE previous IS DISTINCT FROM id)"""


@R.query("datapoint_versions", f"WITH {_ARRIVED} SELECT dataset_id, kind, path, id, max(v) AS version FROM v GROUP BY ALL")
def datapoint_versions(spark, folder):
    """The version of each content of a path."""
    return versions.versions(_points(spark, folder)).drop("first_ordinal")


@R.query("supersedes_edges", f"WITH {_ARRIVED} SELECT DISTINCT dataset_id, id AS src_id, previous AS dst_id FROM v WHERE previous IS NOT NULL")
def supersedes_edges(spark, folder):
    """Edges from each version to the one before."""
    return versions.supersedes(_points(spark, folder))


@R.query(
    "prune_versions",
    f"""WITH {_ARRIVED}, m AS (SELECT dataset_id, kind, path, id, max(v) AS version FROM v GROUP BY ALL)
    SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY dataset_id, kind, path ORDER BY version DESC, id) > 3""",
)
def prune_versions(spark, folder):
    """What a retention of three versions drops."""
    return versions.pruned(versions.versions(_points(spark, folder)))


@R.query(
    "latest_version",
    """SELECT dataset_id, kind, path, id, version FROM (SELECT DISTINCT dataset_id, kind, path, id, version FROM datapoints)
    QUALIFY row_number() OVER (PARTITION BY dataset_id, kind, path ORDER BY version DESC, id DESC) = 1""",
)
def latest_version(spark, folder):
    """The newest version of each path."""
    return versions.latest_version(table(spark, folder, "datapoints"))


@R.query(
    "list_datapoints",
    """SELECT DISTINCT id, repo_id, dataset_id, kind, path, version, content_hash, source_kind, commit_id, start_byte, end_byte, symbol_fingerprint, confidence FROM datapoints""",
)
def list_datapoints(spark, folder):
    """All versions with their provenance."""
    d = versions.listed(table(spark, folder, "datapoints"))
    return d.select("id", "repo_id", "dataset_id", "kind", "path", "version", "content_hash", "provenance.*")


@R.query(
    "chunk_windows",
    """WITH t AS (SELECT DISTINCT repo_id, relative_path, content FROM file_content WHERE content <> ''),
      s AS (SELECT repo_id, relative_path, octet_length(encode(content)) AS total, list_transform(string_split(content, chr(10)), lambda x: octet_length(encode(x)) + 1) AS z,
        len(string_split(content, chr(10))) - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END AS n FROM t),
      c AS (SELECT *, unnest(range(0, CAST(ceil(greatest(n - 80, 0) / 70.0) AS BIGINT) + 1)) AS chunk_no FROM s)
    SELECT repo_id, relative_path, chunk_no, CAST(coalesce(list_sum(z[1:chunk_no * 70]), 0) AS BIGINT) AS start_byte,
      CAST(CASE WHEN chunk_no * 70 + 80 >= n THEN total ELSE list_sum(z[1:chunk_no * 70 + 80]) END AS BIGINT) AS end_byte FROM c""",
)
def chunk_windows(spark, folder):
    """Line windows of every file with their byte ranges."""
    f = table(spark, folder, "file_content").select("repo_id", "relative_path", "content").distinct()
    return versions.chunk_windows(f)

"""Queries on upserts, deletions, scopes and identities, on the tables' own rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import ids, text
from codeloom.operators import catalog, context, graph, memory
from codeloom.plans.knowledge import _ALL, _FILE_SCORES, _LINKS, _context, _graph, commit_links
from codeloom.plans.lookups import _LATEST, _LIVE, _live
from codeloom.plans.registry import Registry, table
from codeloom.session import materialize

R = Registry()


@R.query("blob_ids", f"SELECT repo_id, relative_path, git_blob_id FROM ({_LATEST})")
def blob_ids(spark, folder):
    """Files with the blob ids of the tracked ones."""
    f = catalog.latest(table(spark, folder, "files")).select(*catalog.FILE_KEY, "git_blob_id")
    return catalog.blob_ids(f, f.filter("git_blob_id IS NOT NULL"))


@R.query(
    "insert_or_ignore",
    """WITH o AS (SELECT repo_id, relative_path, min(file_hash) AS v FROM files WHERE kind = 'source' GROUP BY 1, 2), n AS (SELECT repo_id, relative_path, max(file_hash) AS v FROM files GROUP BY 1, 2)
    SELECT repo_id, relative_path, coalesce(o.v, n.v) AS v FROM n LEFT JOIN o USING (repo_id, relative_path)""",
)
def insert_or_ignore(spark, folder):
    """First hashes of source files, completed by the last hashes of all files."""
    f = table(spark, folder, "files")
    old = f.filter("kind = 'source'").groupBy(*catalog.FILE_KEY).agg(F.min("file_hash").alias("v"))
    return catalog.insert_or_ignore(old, f.groupBy(*catalog.FILE_KEY).agg(F.max("file_hash").alias("v")), catalog.FILE_KEY)


@R.query(
    "repository_presence",
    """SELECT repo_id, repo_name AS name, CASE WHEN max_file_size_kb IS NOT NULL THEN 'indexed' ELSE 'opened' END AS head, 'dev' AS branch FROM repo_config""",
)
def repository_presence(spark, folder):
    """Repositories after all of them were opened and those with a limit of their own had been indexed before: their heads stay."""
    c = table(spark, folder, "repo_config")
    rows = lambda df, head, branch: df.select(
        "repo_id", F.col("repo_name").alias("name"), F.concat(F.lit("/"), "repo_name").alias("root"), F.lit(head).alias("head"), F.lit(branch).alias("branch"), F.current_timestamp().alias("indexed_at")
    )
    out = catalog.upsert_repositories(rows(c.filter("max_file_size_kb IS NOT NULL"), "indexed", "main"), rows(c, "opened", "dev"), indexed=False)
    return out.select("repo_id", "name", "head", "branch")


@R.query("node_upserts", f"WITH {_ALL} SELECT id, kind, CASE WHEN kind = 'name' THEN 'renamed' ELSE label END AS label FROM nodes")
def node_upserts(spark, folder):
    """Nodes after the names among them were written again with another label."""
    n = materialize(_graph(spark, folder)[0], "nodes")
    return graph.upsert_nodes(n, n.filter("kind = 'name'").withColumn("label", F.lit("renamed"))).select("id", "kind", "label")


@R.query("edge_upserts", f"WITH {_ALL} SELECT src_id, dst_id, kind, CASE WHEN payload IS NOT NULL AND kind = 'calls' THEN 'new' ELSE payload END AS payload FROM edges")
def edge_upserts(spark, folder):
    """Edges after calls were written again with another payload, beside imports that the ontology does not allow and loops."""
    e = materialize(_graph(spark, folder)[1], "edges")
    calls = e.filter("payload IS NOT NULL AND kind = 'calls'").withColumn("payload", F.lit("new"))
    loops = e.withColumn("dst_id", F.col("src_id")).withColumn("kind", F.lit("calls"))
    imports = e.filter("kind = 'imports'").withColumn("payload", F.lit("new"))
    return graph.upsert_edges(e, calls.unionByName(loops).unionByName(imports), ["calls", "tests"]).select("src_id", "dst_id", "kind", "payload")


@R.query("cleared_edges", _LINKS)
def cleared_edges(spark, folder):
    """What stays of projected edges and commit links when the projected ones are cleared."""
    links = commit_links(spark, folder).withColumn("payload", F.lit(None).cast("string"))
    both = _graph(spark, folder)[1].unionByName(links.select(*graph.EDGE))
    return graph.clear_projected(both).select("repo_id", "dataset_id", "src_id", "dst_id", "kind")


@R.query("scope_violations", f"WITH {_ALL} SELECT DISTINCT src_id, dst_id FROM edges WHERE kind = 'imports'")
def scope_violations(spark, folder):
    """Edges whose ends lie in another dataset, after the imports were moved to one."""
    nodes, edges = _graph(spark, folder)
    moved = F.when(F.col("kind") == "imports", F.lit("dataset:other:default")).otherwise(F.col("dataset_id"))
    return graph.check_scope(edges.withColumn("dataset_id", moved), nodes).select("src_id", "dst_id").distinct()


@R.query(
    "deleted_chunks",
    "SELECT DISTINCT id, repo_id, kind, path FROM datapoints WHERE NOT (kind = 'chunk' AND length(regexp_replace(path, '#[0-9]+-[0-9]+$', '')) % 2 = 0)",
)
def deleted_chunks(spark, folder):
    """Datapoints without the chunks of every other file."""
    d = table(spark, folder, "datapoints").select("id", "repo_id", "kind", "path").distinct()
    owner = ids.chunk_owner(F.col("kind"), F.col("path"))
    return graph.delete_chunks(d, F.when(F.length(owner) % 2 == 0, owner).otherwise(F.lit("")))


@R.query(
    "identities",
    """SELECT DISTINCT repo_id, substr(sha256('/srv/' || repo_id), 1, 16) AS derived, file_path || '::m::' || name || '@' || start_line AS declaration,
    sha256(trim(signature)) AS fingerprint, CAST(indexed_at AS TIMESTAMP) AS parsed FROM symbols WHERE signature IS NOT NULL""",
)
def identities(spark, folder):
    """Ids of repositories and declarations, fingerprints of signatures, and times read back from text."""
    s = table(spark, folder, "symbols").filter("signature IS NOT NULL")
    stamp = F.date_format("indexed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return s.select(
        "repo_id", text.repo_id(F.concat(F.lit("/srv/"), "repo_id")).alias("derived"), ids.declaration_id(F.col("file_path"), F.lit("m"), F.col("name"), F.col("start_line")).alias("declaration"),
        text.fingerprint(F.concat(F.lit(" \t"), "signature", F.lit("\n"))).alias("fingerprint"), text.timestamp_or_now(stamp).alias("parsed"),
    ).distinct()


@R.query(
    "evidence_capture",
    f"""WITH {_LIVE}, nm AS (SELECT DISTINCT repo_id, file_path, name, fingerprint FROM live)
    SELECT n.repo_id, n.file_path AS file, n.name, CASE WHEN f.repo_id IS NOT NULL THEN 'symbols-v1:' || n.sum END AS fingerprint, f.repo_id IS NULL AS error FROM (
      SELECT repo_id, file_path, name, sha256(string_agg(name || chr(0) || fingerprint || chr(0), '' ORDER BY encode(name || chr(0) || fingerprint || chr(0)))) AS sum FROM nm GROUP BY 1, 2, 3) n
    LEFT JOIN (SELECT DISTINCT repo_id, relative_path FROM files) f ON f.repo_id = n.repo_id AND f.relative_path = n.file_path""",
)
def evidence_capture(spark, folder):
    """The baseline that a claim on each name of a file would be given."""
    s = _live(spark, folder).select("repo_id", "file_path", "name", "fingerprint").distinct().withColumn("qualified_name", F.col("name"))
    none = F.lit(None).cast("string").alias("fingerprint")
    e = s.select(F.concat_ws("|", "repo_id", "file_path", "name").alias("memory_id"), "repo_id", F.col("file_path").alias("file"), F.array("name").alias("symbols"), none).distinct()
    c = memory.capture(e, s, catalog.latest(table(spark, folder, "files")))
    return c.select("repo_id", "file", F.col("symbols")[0].alias("name"), "fingerprint", "error")


@R.query(
    "context_top_files",
    f"SELECT task_id, file, score, CAST(row_number() OVER (PARTITION BY task_id ORDER BY score DESC, file) AS INT) AS rank FROM ({_FILE_SCORES}) QUALIFY rank <= 15",
)
def context_top_files(spark, folder):
    """The 15 best files of every task, the reference's limit, by all signals but the text search and the claims."""
    scores = context.file_scores(_context(spark, folder, materialize)[3])
    return context.best_files(scores).select("task_id", "file", "score", "rank")

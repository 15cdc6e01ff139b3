"""The pipelines add, cognify and index over a store of snapshots, with user stages behind their own.

A run takes a scan (the rows of the worktree source, of one or of many repositories) and works on tables of a
``Store``: files, symbols, references, datapoints, nodes, edges and members. Only what changed since the last
snapshot is extracted, versioned and replaced. Catalog and datapoints are committed first; the projection of the graph
follows as one commit of its own, so a failure in it leaves the old graph beside the new catalog.

A stage is a function of the context. ``extra`` stages run in order after the built-in ones and see the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import extract, ids, paths, text
from codeloom.operators import catalog, graph, versions
from codeloom.session import materialize
from codeloom.sources.config import Ontology
from codeloom.sources.store import Store

FILE = [
    "repo_id", "relative_path", "file_hash", "git_blob_id", "size_bytes", "language", "kind", "is_test", "is_doc", "indexed_at",
]
POINT = (
    "repo_id string, dataset_id string, kind string, path string, id string, version bigint, content string, source_kind string,"
    " commit_id string, start_byte bigint, end_byte bigint, created_at timestamp"
)
EDGE = "repo_id string, dataset_id string, src_id string, dst_id string, kind string, payload string"
NODE = "repo_id string, dataset_id string, id string, kind string, label string, datapoint_id string"
MEMBER = "node_set_id string, name string, node_id string"
SCHEMAS = {
    "symbols": extract.SYMBOLS, "references": extract.REFERENCES, "datapoints": POINT, "nodes": NODE, "edges": EDGE, "members": MEMBER,
}
POINT_KEY = ["dataset_id", "kind", "path"]


@dataclass
class Context:
    """One run: its input, its tables (pending ones first), and what it counted."""

    spark: SparkSession
    store: Store
    scan: DataFrame | None = None
    dataset: str = "default"
    full: bool = False
    sources: tuple[str, ...] = ("worktree", "docs")
    ontology: Ontology = field(default_factory=Ontology)
    commits: DataFrame | None = None  # repo_id, commit_id, summary, timestamp
    touched: DataFrame | None = None  # repo_id, commit_id, path
    notes: DataFrame | None = None  # repo_id, path, content
    counts: dict[str, int] = field(default_factory=dict)
    pending: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name in self.pending:
            return self.pending[name]
        if self.store.version(name):
            return self.store.read(name)
        return self.spark.createDataFrame([], self.scan.select(*FILE).schema if name == "files" else SCHEMAS[name])

    def put(self, name: str, df: DataFrame) -> None:
        """Replaces a table within the run; its lineage is cut, and ``commit`` makes it the next snapshot."""
        self.pending[name] = materialize(df, name)

    def count(self, name: str, n: int) -> None:
        self.counts[name] = self.counts.get(name, 0) + n

    def commit(self) -> None:
        self.store.write_all(self.pending)
        self.pending = {}

    def dataset_id(self):
        return ids.dataset_id(F.col("repo_id"), self.dataset)


def _counted(ctx: Context, df: DataFrame, name: str, **counters) -> DataFrame:
    """A written table, and how many of its rows meet each condition: counted on the way, without a pass of their own."""
    seen = Observation()
    out = materialize(df.observe(seen, *[F.count_if(c).alias(n) for n, c in counters.items()]), name)
    for n, v in seen.get.items():
        ctx.count(n, v)
    return out


Stage = Callable[[Context], None]


# ---- catalog


def sync_catalog(ctx: Context) -> None:
    """Files, symbols and references after the scan; datapoints whose file is gone go too."""
    old, new = ctx.table("files"), catalog.latest(ctx.scan.select(*FILE))
    gaps = catalog.missing_identity(ctx.table("references"))
    change = _counted(ctx, catalog.diff(old.limit(0) if ctx.full else old, new, gaps), "changes", files_updated=F.lit(True))
    changed = change.filter("change <> 'deleted'").select(*catalog.FILE_KEY)
    gone = old.join(new.select(*catalog.FILE_KEY), catalog.FILE_KEY, "left_anti").select(*catalog.FILE_KEY)
    code = ctx.scan.filter(F.col("kind").isin("source", "test") & F.col("content").isNotNull()).join(changed, catalog.FILE_KEY, "left_semi")
    code = code.select("repo_id", "relative_path", "content").distinct()
    symbols, references = _counted(ctx, extract.extract_symbols(code), "new-symbols", symbols_written=F.lit(True)), extract.extract_references(code)
    ctx.put("files", catalog.replace(old, new.join(changed, catalog.FILE_KEY, "left_semi"), gone, catalog.FILE_KEY))
    touched = changed.unionByName(gone)
    for name, column, rows in (("symbols", "file_path", symbols), ("references", "source_file", references)):
        keep = ctx.table(name).join(touched.withColumnRenamed("relative_path", column), ["repo_id", column], "left_anti")
        ctx.put(name, keep.unionByName(rows))
    points = ctx.table("datapoints")
    orphans = catalog.orphan_points(points, ctx.table("files")).select("dataset_id", "id").distinct()
    ctx.put("datapoints", points.join(orphans, ["dataset_id", "id"], "left_anti"))


def put_points(ctx: Context, arrivals: DataFrame) -> None:
    """Takes one arrival a path: the same content as the latest is unchanged, another is the next version and supersedes it.

    A content that comes back keeps its row and its first time, under the new version.
    """
    old = ctx.table("datapoints")
    last = versions.latest_version(old).select(*POINT_KEY, F.col("id").alias("_last"), F.col("version").alias("_v"))
    a = arrivals.dropDuplicates(POINT_KEY).join(last, POINT_KEY, "left")
    same = F.coalesce(F.col("_last") == F.col("id"), F.lit(False))
    a = _counted(ctx, a.withColumn("_same", same), "arrivals", datapoints_inserted=~F.col("_same"), datapoints_unchanged=F.col("_same"))
    fresh = a.filter("NOT _same")
    first = old.select(*POINT_KEY, "id", F.col("created_at").alias("_first"))
    rows = fresh.join(first, [*POINT_KEY, "id"], "left").withColumn("created_at", F.coalesce("_first", F.current_timestamp()))
    rows = rows.withColumn("version", F.coalesce("_v", F.lit(0)) + 1)
    names = [f.split()[0] for f in POINT.split(", ")]
    kept = old.join(fresh.select(*POINT_KEY, "id"), [*POINT_KEY, "id"], "left_anti")
    ctx.put("datapoints", kept.select(names).unionByName(rows.select(names)))
    edges = fresh.filter("_last IS NOT NULL").select(
        "repo_id", "dataset_id", F.col("id").alias("src_id"), F.col("_last").alias("dst_id"), F.lit("supersedes").alias("kind"), F.lit(None).cast("string").alias("payload")
    )
    _edges(ctx, edges)


def _edges(ctx: Context, edges: DataFrame) -> None:
    allowed = [k for k in graph.EDGE_KINDS if ctx.ontology.allows_edge(k)]
    edges = _counted(ctx, edges, "new-edges", edges=F.col("kind").isin(allowed))
    ctx.put("edges", graph.upsert_edges(ctx.table("edges"), edges, allowed))


def _nodes(ctx: Context, nodes: DataFrame) -> None:
    if ctx.ontology.node_kinds is not None:
        nodes = nodes.filter(F.col("kind").isin(ctx.ontology.node_kinds))
    nodes = _counted(ctx, nodes, "new-nodes", nodes=F.lit(True))
    ctx.put("nodes", graph.upsert_nodes(ctx.table("nodes"), nodes))


def _points(ctx: Context, rows: DataFrame, kind: str, **given) -> DataFrame:
    """Arrivals of a kind from (repo_id, path, content) and columns given by name; the id is that of the content."""
    none = {"commit_id": F.lit(None).cast("string"), "start_byte": F.lit(None).cast("bigint"), "end_byte": F.lit(None).cast("bigint")}
    ds, k = ctx.dataset_id(), F.lit(kind)
    return rows.select(
        "repo_id", ds.alias("dataset_id"), k.alias("kind"), "path", text.content_id(ds, k, F.col("path"), F.col("content")).alias("id"), "content",
        *[c.alias(n) for n, c in ({**none, **given}).items()],
    )


def record_files(ctx: Context) -> None:
    """Every text of the chosen sources as a datapoint."""
    wanted = paths.included(list(ctx.sources), F.col("kind"), F.col("is_doc"), F.col("relative_path"))
    rows = ctx.scan.filter(F.col("content").isNotNull() & wanted)
    doc = paths.is_document(F.col("kind"), F.col("is_doc"), F.col("relative_path"))
    rows = rows.select("repo_id", F.col("relative_path").alias("path"), "content", F.when(doc, "docs").otherwise("worktree").alias("source_kind"))
    put_points(ctx, _points(ctx, rows, "file", source_kind=F.col("source_kind")))


def record_history(ctx: Context) -> None:
    """Commits as datapoints."""
    rows = ctx.commits.select("repo_id", F.concat(F.lit("commit:"), "commit_id").alias("path"), text.redact(F.col("summary")).alias("content"), "commit_id")
    put_points(ctx, _points(ctx, rows, "commit", source_kind=F.lit("history"), commit_id=F.col("commit_id")))


def record_note(ctx: Context) -> None:
    """Session notes and pasted texts as datapoints, each owned by its session."""
    if ctx.notes is None or not ctx.notes.filter("coalesce(trim(content), '') = ''").isEmpty():
        raise ValueError("session and text sources need a text")
    rows = ctx.notes.withColumn("content", text.redact(F.col("content")))
    points = _points(ctx, rows, "note", source_kind=F.lit("session"))
    put_points(ctx, points)
    session = ids.session_node(F.col("dataset_id"), F.col("path"))
    _edges(ctx, points.select("repo_id", "dataset_id", session.alias("src_id"), F.col("id").alias("dst_id"), F.lit("owns").alias("kind"), F.lit(None).cast("string").alias("payload")))


# ---- graph


def project_graph(ctx: Context) -> None:
    """Nodes and edges of the catalog; what the catalog no longer holds goes, with its edges and memberships."""
    files, symbols, refs = ctx.table("files"), ctx.table("symbols"), ctx.table("references")
    refs = refs.withColumn("ref_id", F.xxhash64(*refs.columns))
    nodes, edges = graph.project(files, symbols, refs)
    nodes = materialize(nodes, "projected")
    old = ctx.table("nodes")
    stale = old.filter(F.col("kind").isin("file", "symbol")).join(nodes.select("dataset_id", "id"), ["dataset_id", "id"], "left_anti").select("id")
    kept, kept_edges, members = graph.delete_nodes(old, graph.clear_projected(ctx.table("edges")), ctx.table("members"), stale)
    ctx.put("nodes", kept.select(*graph.NODE))
    ctx.put("edges", kept_edges)
    sets = graph.language_sets(files)
    ctx.put("members", members.unionByName(sets).distinct())
    _nodes(ctx, nodes.select(*graph.NODE))
    _edges(ctx, edges.select(*graph.EDGE))


def write_chunks(ctx: Context) -> None:
    """Line windows of every text, made anew: points without content, named by path and byte range, owned by their file."""
    rows = ctx.scan.filter("content <> ''").select("repo_id", "relative_path", "is_doc", "kind", "content").dropDuplicates(["repo_id", "relative_path"])
    doc = paths.is_document(F.col("kind"), F.col("is_doc"), F.col("relative_path"))
    w = versions.chunk_windows(rows.select("repo_id", "relative_path", F.when(doc, "docs").otherwise("worktree").alias("source_kind"), "content"))
    name = F.concat("relative_path", F.lit("#"), F.col("start_byte").cast("string"), F.lit("-"), F.col("end_byte").cast("string"))
    w = _counted(ctx, w.select("repo_id", "relative_path", name.alias("path"), F.lit("").alias("content"), "source_kind", "start_byte", "end_byte"), "windows", chunks=F.lit(True))
    points = ctx.table("datapoints")
    owner = ids.chunk_owner(F.col("kind"), F.col("path"))
    seen = rows.select("repo_id", F.col("relative_path").alias("_owner"))
    chunks = points.filter("kind = 'chunk'").withColumn("_owner", owner).join(seen, ["repo_id", "_owner"], "left_anti").drop("_owner")
    ctx.put("datapoints", points.filter("kind <> 'chunk'").unionByName(chunks))
    arrivals = _points(ctx, w, "chunk", source_kind=F.col("source_kind"), start_byte=F.col("start_byte"), end_byte=F.col("end_byte"))
    put_points(ctx, arrivals)
    file = arrivals.withColumn("_file", ids.chunk_owner(F.col("kind"), F.col("path")))
    gone = ctx.table("nodes").filter("kind = 'chunk'").join(ctx.table("datapoints").select("id").distinct(), "id", "left_anti").select("id")
    nodes, edges, members = graph.delete_nodes(ctx.table("nodes"), ctx.table("edges"), ctx.table("members"), gone)
    ctx.put("nodes", nodes.select(*graph.NODE)), ctx.put("edges", edges), ctx.put("members", members)
    _nodes(ctx, file.select("repo_id", "dataset_id", "id", "kind", F.col("_file").alias("label"), F.col("id").alias("datapoint_id")))
    src = ids.file_node(F.col("dataset_id"), F.col("_file"))
    _edges(ctx, file.select("repo_id", "dataset_id", src.alias("src_id"), F.col("id").alias("dst_id"), F.lit("owns").alias("kind"), F.lit(None).cast("string").alias("payload")))


def link_commits(ctx: Context) -> None:
    """Recorded commits as nodes, with edges to the files of the catalog that they touched."""
    if ctx.touched is None or not ctx.ontology.allows_edge("touched-in-commit"):
        return
    commits = ctx.table("datapoints").filter("kind = 'commit' AND commit_id IS NOT NULL")
    node = ids.commit_node(F.col("dataset_id"), F.col("commit_id"))
    _nodes(ctx, commits.select("repo_id", "dataset_id", node.alias("id"), F.lit("commit").alias("kind"), F.col("content").alias("label"), F.col("id").alias("datapoint_id")))
    _edges(ctx, graph.commit_links(commits, ctx.touched, ctx.table("files")).select(*graph.EDGE))


PROJECTION: tuple[Stage, ...] = (project_graph, write_chunks, link_commits)


def _run(ctx: Context, stages, extra, project: bool) -> dict[str, int]:
    for stage in stages:
        stage(ctx)
    ctx.commit()
    if project:
        for stage in PROJECTION:
            stage(ctx)
        ctx.commit()
    for stage in extra:
        stage(ctx)
    ctx.commit()
    return dict(ctx.counts)


def add(ctx: Context, extra: tuple[Stage, ...] = ()) -> dict[str, int]:
    """Catalog and datapoints of the sources: files of the worktree or its documents, history, notes. No graph."""
    stages: list[Stage] = []
    if {"session", "text"} & set(ctx.sources) and ctx.notes is None:
        raise ValueError("session and text sources need a text")
    if {"worktree", "docs"} & set(ctx.sources):
        stages += [sync_catalog, record_files]
    if "history" in ctx.sources:
        stages.append(record_history)
    if {"session", "text"} & set(ctx.sources):
        stages.append(record_note)
    return _run(ctx, stages, extra, project=False)


def cognify(ctx: Context, extra: tuple[Stage, ...] = ()) -> dict[str, int]:
    """Catalog and graph."""
    return _run(ctx, [sync_catalog], extra, project=True)


def index(ctx: Context, extra: tuple[Stage, ...] = ()) -> dict[str, int]:
    """Catalog, datapoints and graph from one scan."""
    return _run(ctx, [sync_catalog, record_files], extra, project=True)

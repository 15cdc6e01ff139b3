"""The knowledge graph: resolution of references, projection, upkeep, traversal, export.

Nodes: (repo_id, dataset_id, id, kind, label, datapoint_id). Edges: (repo_id, dataset_id,
src_id, dst_id, kind, payload), one per dataset, ends and kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import ids
from codeloom.functions.vocab import EDGE_KINDS, PROJECTED_EDGES, parse_export_format
from codeloom.session import materialize

NODE = ["repo_id", "dataset_id", "id", "kind", "label", "datapoint_id"]
EDGE = ["repo_id", "dataset_id", "src_id", "dst_id", "kind", "payload"]
MAX_DEPTH = 8


# ---- resolution


def callers(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds ``caller_id``: the source symbol of each reference, or null if its file is the source.

    The stated id if such a symbol lives; else the only symbol of that file and name whose lines
    enclose the reference. The enclosing search is an equi-join with a range condition.
    """
    s = symbols.select("repo_id", F.col("id").alias("caller_id"), "file_path", "name", "start_line", "end_line").distinct()
    stated = s.select("repo_id", F.col("caller_id").alias("source_symbol_id"), F.lit(True).alias("known")).distinct()
    r = references.join(stated, ["repo_id", "source_symbol_id"], "left")
    open_ = r.filter("known IS NULL AND source_symbol_name IS NOT NULL").select("ref_id", "repo_id", "source_file", "source_symbol_name", "line_number").distinct()
    near = (
        open_.join(s, (open_.repo_id == s.repo_id) & (open_.source_file == s.file_path) & (open_.source_symbol_name == s.name)
            & (s.start_line <= open_.line_number) & (s.end_line >= open_.line_number))
        .groupBy("ref_id", open_.repo_id, "source_file", "source_symbol_name", "line_number")
        .agg(F.min("caller_id").alias("near_id"), F.count("*").alias("n"))
        .filter("n = 1")
        .drop("n")
    )
    out = r.join(near, ["ref_id", "repo_id", "source_file", "source_symbol_name", "line_number"], "left")
    caller = F.when(F.col("known"), F.col("source_symbol_id")).otherwise(F.col("near_id"))
    return out.select(*references.columns, caller.alias("caller_id"))


def call_targets(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, repo_id, target_id, name): all symbols of the name in the same file, else all of the repository,
    else a name alone (target_id null).

    Names are joined as rows, never gathered: a name that many symbols share is a skewed join that the
    engine can split.
    """
    r = references.filter(F.col("kind").isin("calls", "tests")).select("ref_id", "repo_id", "source_file", "target_name").distinct()
    s = symbols.select("repo_id", F.col("id").alias("target_id"), F.col("name").alias("target_name"), F.col("file_path").alias("source_file")).distinct()
    key = ["repo_id", "source_file", "target_name"]
    cols = ["ref_id", "repo_id", "target_name", "target_id"]
    here = r.join(s, key).select(cols)
    rest = r.join(s.select(*key).distinct(), key, "left_anti").drop("source_file")
    there = rest.join(s.drop("source_file").distinct(), ["repo_id", "target_name"], "left").select(cols)
    return here.unionByName(there).distinct()


def import_targets(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, repo_id, target_name, name, target_id): the only symbol of the imported short name, else null."""
    r = references.filter("kind = 'imports'").select("ref_id", "repo_id", "target_name").distinct()
    r = r.withColumn("name", ids.import_name(F.col("target_name")))
    one = symbols.select("repo_id", "id", "name").distinct().groupBy("repo_id", "name").agg(F.min("id").alias("target_id"), F.count("*").alias("n"))
    return r.join(one.filter("n = 1").drop("n"), ["repo_id", "name"], "left").select("ref_id", "repo_id", "target_name", "name", "target_id")


# ---- projection


def _dataset() -> Column:
    return ids.dataset_id(F.col("repo_id"))


def project(files: DataFrame, symbols: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the catalog: files own symbols; references become calls, tests and imports."""
    ds = _dataset()
    blank = F.lit(None).cast("string")
    file_nodes = files.select("repo_id", ds.alias("dataset_id"), ids.file_node(ds, F.col("relative_path")).alias("id"), F.lit("file").alias("kind"), F.col("relative_path").alias("label"), blank.alias("datapoint_id"))
    named = symbols.groupBy("repo_id", "id").agg(F.max("name").alias("label"), F.max("file_path").alias("file_path"))
    symbol_nodes = named.select("repo_id", ds.alias("dataset_id"), ids.symbol_node(ds, F.col("id")).alias("id"), F.lit("symbol").alias("kind"), "label", blank.alias("datapoint_id"))
    owns = named.select("repo_id", ds.alias("dataset_id"), ids.file_node(ds, F.col("file_path")).alias("src_id"), ids.symbol_node(ds, F.col("id")).alias("dst_id"), F.lit("owns").alias("kind"), blank.alias("payload"))
    r = callers(references, symbols)
    src = F.coalesce(ids.symbol_node(ds, F.col("caller_id")), ids.file_node(ds, F.col("source_file")))
    source = F.when(F.col("caller_id").isNotNull(), src).otherwise(ids.file_node(ds, F.col("source_file")))
    calls = r.filter(F.col("kind").isin("calls", "tests")).join(call_targets(references, symbols).drop("target_name"), ["ref_id", "repo_id"])
    call_edges = calls.select(
        "repo_id", ds.alias("dataset_id"), source.alias("src_id"),
        F.when(F.col("target_id").isNotNull(), ids.symbol_node(ds, F.col("target_id"))).otherwise(ids.name_node(ds, F.col("target_name"))).alias("dst_id"),
        "kind", F.when(F.col("target_id").isNull(), F.col("target_name")).alias("payload"), F.when(F.col("target_id").isNull(), F.col("target_name")).alias("name"), "source_file",
    )
    imports = r.filter("kind = 'imports'").drop("target_name").join(import_targets(references, symbols), ["ref_id", "repo_id"])
    import_edges = imports.select(
        "repo_id", ds.alias("dataset_id"), source.alias("src_id"),
        F.when(F.col("target_id").isNotNull(), ids.symbol_node(ds, F.col("target_id"))).otherwise(ids.name_node(ds, F.col("name"))).alias("dst_id"),
        "kind", F.col("target_name").alias("payload"), F.when(F.col("target_id").isNull(), F.col("name")).alias("name"), "source_file",
    )
    both = call_edges.unionByName(import_edges)
    name_nodes = both.filter("name IS NOT NULL").select("repo_id", "dataset_id", ids.name_node(F.col("dataset_id"), F.col("name")).alias("id"), F.lit("name").alias("kind"), F.col("name").alias("label"), blank.alias("datapoint_id"))
    used_files = both.select("repo_id", "dataset_id", ids.file_node(F.col("dataset_id"), F.col("source_file")).alias("id"), F.lit("file").alias("kind"), F.col("source_file").alias("label"), blank.alias("datapoint_id"))
    owner_files = named.select("repo_id", ds.alias("dataset_id"), ids.file_node(ds, F.col("file_path")).alias("id"), F.lit("file").alias("kind"), F.col("file_path").alias("label"), blank.alias("datapoint_id"))
    nodes = reduce(DataFrame.unionByName, [file_nodes, symbol_nodes, name_nodes, used_files, owner_files]).distinct()
    edges = owns.unionByName(both.select(*EDGE)).filter("src_id <> dst_id")
    edges = edges.groupBy("repo_id", "dataset_id", "src_id", "dst_id", "kind").agg(F.max("payload").alias("payload"))
    return nodes, edges


def language_sets(files: DataFrame) -> DataFrame:
    """Members of the sets ``lang:...``: (node_set_id, name, node_id), each once."""
    ds = _dataset()
    name = F.concat(F.lit("lang:"), F.col("language"))
    return files.select(ids.node_set_id(F.col("repo_id"), name).alias("node_set_id"), name.alias("name"), ids.file_node(ds, F.col("relative_path")).alias("node_id")).distinct()


def commit_links(commits: DataFrame, touched: DataFrame, files: DataFrame) -> DataFrame:
    """Edges from each commit to the files of the catalog that it touched."""
    ds = _dataset()
    t = touched.join(files.select("repo_id", F.col("relative_path").alias("path")).distinct(), ["repo_id", "path"])
    t = t.join(commits.select("repo_id", "commit_id").distinct(), ["repo_id", "commit_id"])
    return t.select("repo_id", ds.alias("dataset_id"), ids.commit_node(ds, F.col("commit_id")).alias("src_id"), ids.file_node(ds, F.col("path")).alias("dst_id"), F.lit("touched-in-commit").alias("kind"), F.lit(None).cast("string").alias("payload")).distinct()


# ---- upkeep


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows win on kind, label and datapoint; one row an id."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    rest = [c for c in old.columns if c not in ("id", "dataset_id")]
    return both.groupBy("dataset_id", "id").agg(F.max(F.struct("_n", *rest)).alias("r")).select(*[F.col(c) if c in ("id", "dataset_id") else F.col(f"r.{c}") for c in old.columns])


def upsert_edges(old: DataFrame, new: DataFrame, allowed: list[str] = EDGE_KINDS, keep_payload: bool = False) -> DataFrame:
    """One edge per (dataset, ends, kind). A new payload overwrites, or with ``keep_payload`` the old one stays.

    Self loops and kinds that the ontology does not allow are dropped.
    """
    n = new.filter((F.col("src_id") != F.col("dst_id")) & F.col("kind").isin(allowed))
    both = old.withColumn("_n", F.lit(0)).unionByName(n.withColumn("_n", F.lit(1)))
    key = ["repo_id", "dataset_id", "src_id", "dst_id", "kind"]
    pick = F.min if keep_payload else F.max
    return both.groupBy(*key).agg(pick(F.struct("_n", "payload")).alias("r")).select(*key, "r.payload")


def check_scope(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end in another dataset; must be empty."""
    n = nodes.select(F.col("id").alias("node"), F.col("dataset_id").alias("home")).distinct()
    ends = edges.select("*", F.explode(F.array("src_id", "dst_id")).alias("node"))
    return ends.join(n, "node").filter(F.col("home") != F.col("dataset_id")).select(*edges.columns).distinct()


def clear_projected(edges: DataFrame) -> DataFrame:
    """Edges without those that a projection writes; as in the reference an owns edge of a session goes too."""
    return edges.filter(~F.col("kind").isin(PROJECTED_EDGES))


def delete_nodes(nodes: DataFrame, edges: DataFrame, members: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the nodes ``gone`` (id), their edges and their memberships."""
    g = gone.select("id").distinct()
    e = edges.join(g.withColumnRenamed("id", "src_id"), "src_id", "left_anti").join(g.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti")
    m = members.join(g.withColumnRenamed("id", "node_id"), "node_id", "left_anti")
    return nodes.join(g, "id", "left_anti"), e.select(*edges.columns), m.select(*members.columns)


def delete_chunks(datapoints: DataFrame, path: Column) -> DataFrame:
    """Datapoints without the chunks that belong to ``path``."""
    return datapoints.filter(~((F.col("kind") == "chunk") & (ids.chunk_owner(F.col("kind"), F.col("path")) == path)))


def split_commits(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shared ``commit:<hex>`` nodes become one a dataset that uses them, and edges follow."""
    legacy = F.col("id").rlike("^commit:[0-9a-fA-F]+$")
    fresh = lambda c, d: F.when(F.col(c).rlike("^commit:[0-9a-fA-F]+$"), ids.commit_node(F.col(d), F.substring(c, 8, 1 << 20))).otherwise(F.col(c))
    e = edges.withColumn("src_id", fresh("src_id", "dataset_id")).withColumn("dst_id", fresh("dst_id", "dataset_id")).distinct()
    used = edges.select(F.explode(F.array("src_id", "dst_id")).alias("id"), F.col("dataset_id").alias("ds"), F.col("repo_id").alias("repo")).distinct()
    old = nodes.filter(legacy)
    own = old.select("id", "repo_id", "dataset_id", "kind", "label", "datapoint_id")
    moved = own.join(used, "id", "left").select(
        F.coalesce("repo", "repo_id").alias("repo_id"), F.coalesce("ds", "dataset_id").alias("dataset_id"),
        ids.commit_node(F.coalesce("ds", "dataset_id"), F.substring("id", 8, 1 << 20)).alias("id"), "kind", "label", "datapoint_id",
    )
    return nodes.filter(~legacy).unionByName(moved.select(*nodes.columns)).distinct(), e


# ---- traversal


def traverse(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, id, depth): the least number of outgoing edges from each start; a start is at 0 even if it is no node.

    All starts advance together. Each step joins only the frontier with the edges, drops what is known,
    and is written to the shared folder, so a lost executor costs one step.
    """
    if depth > MAX_DEPTH:
        raise ValueError(f"depth {depth} is above {MAX_DEPTH}")
    steps = materialize(edges.select("src_id", "dst_id").distinct(), "steps")
    seen = frontier = starts.select(F.col("id").alias("start"), "id").distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        reached = frontier.join(steps, frontier.id == steps.src_id).select("start", F.col("dst_id").alias("id")).distinct()
        frontier = materialize(reached.join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(d)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


# ---- export


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON object a node or edge, with ``part`` and ``ord`` that give the file's order; payloads are left out."""
    n = nodes.select(F.lit("node").alias("part"), F.col("id").alias("ord"), F.to_json(F.struct("id", "kind", "label", "datapoint_id")).alias("line"))
    e = edges.select(F.lit("edge").alias("part"), F.concat_ws("|", "src_id", "dst_id", "kind").alias("ord"), F.to_json(F.struct("src_id", "dst_id", "kind")).alias("line"))
    return n.unionByName(e)


def json_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines, in order, of the document ``{"nodes": [...], "edges": [...]}``; written as text, the parts in order are the document.

    The order is a sort by ranges, so no task holds the graph; the driver sees the first key of each part alone.
    """
    lines = json_lines(nodes, edges)
    first = {r["part"]: r["ord"] for r in lines.groupBy("part").agg(F.min("ord").alias("ord")).collect()}
    section = F.when(F.col("part") == "node", 1).otherwise(3)
    leads = F.lit(False)
    for part, key in first.items():
        leads = leads | ((F.col("part") == part) & (F.col("ord") == key))
    body = lines.select(section.alias("section"), "ord", F.concat(F.when(leads, "").otherwise(","), "line").alias("line"))
    frame = nodes.sparkSession.createDataFrame([(0, "", '{"nodes":['), (2, "", '],"edges":['), (4, "", "]}")], body.schema)
    return body.unionByName(frame).orderBy("section", "ord").select("line")


def export(nodes: DataFrame, edges: DataFrame, form: str) -> DataFrame:
    """The graph as ``json``, ``dot`` or ``mermaid`` lines; another format is an error."""
    return {"json": json_lines, "dot": dot_lines, "mermaid": mermaid_lines}[parse_export_format(form)](nodes, edges)


def _dot(c: str) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"')


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines between the braces of a DOT graph."""
    q = F.lit('"')
    n = nodes.select(F.lit("node").alias("part"), F.concat(F.lit("  "), q, _dot("id"), q, F.lit(" [label="), q, _dot("label"), q, F.lit("];")).alias("line"))
    e = edges.select(F.lit("edge").alias("part"), F.concat(F.lit("  "), q, _dot("src_id"), q, F.lit(" -> "), q, _dot("dst_id"), q, F.lit(" [label="), q, F.col("kind"), q, F.lit("];")).alias("line"))
    return n.unionByName(e)


def numbered(nodes: DataFrame) -> DataFrame:
    """(id, n): consecutive numbers from 0 in order of id, by range partitions and their counts: no single task sorts all."""
    ranged = nodes.select("id").distinct().repartitionByRange("id").sortWithinPartitions("id")
    parts = materialize(ranged.withColumn("p", F.spark_partition_id()), "node-order")
    local = parts.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("id")) - 1)
    counts = parts.groupBy("p").agg(F.count("*").alias("c"))
    shift = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    counts = counts.withColumn("s", F.coalesce(F.sum("c").over(shift), F.lit(0)))
    return local.join(counts, "p").select("id", (F.col("k") + F.col("s")).cast("bigint").alias("n"))


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines of a Mermaid flow chart behind its head; edges with an unknown end are left out."""
    num = numbered(nodes)
    esc = lambda c: F.translate(c, '"\n', "' ")
    n = nodes.join(num, "id").select(F.lit("node").alias("part"), F.concat(F.lit("  n"), F.col("n").cast("string"), F.lit('["'), esc("label"), F.lit('"]')).alias("line"))
    a = num.select(F.col("id").alias("src_id"), F.col("n").alias("a"))
    b = num.select(F.col("id").alias("dst_id"), F.col("n").alias("b"))
    e = edges.join(a, "src_id").join(b, "dst_id").select(F.lit("edge").alias("part"), F.concat(F.lit("  n"), F.col("a").cast("string"), F.lit(" -->|"), F.col("kind"), F.lit("| n"), F.col("b").cast("string")).alias("line"))
    return n.unionByName(e)

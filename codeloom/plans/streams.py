"""Queries on extraction and on replayed streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom import pipelines
from codeloom.functions import extract
from codeloom.operators import catalog
from codeloom.plans.lookups import _LATEST, _before
from codeloom.plans.registry import Registry, table
from codeloom.session import work_path
from codeloom.sources.store import Store
from codeloom.streaming import sync

R = Registry()


@R.query("extract_symbols")
def extract_symbols(spark, folder):
    """Symbols of every file, from its text."""
    return extract.extract_symbols(table(spark, folder, "file_content").distinct())


@R.query("extract_references")
def extract_references(spark, folder):
    """References of every file, from its text."""
    return extract.extract_references(table(spark, folder, "file_content").distinct())


@R.query(
    "stream_sync",
    """SELECT repo_id, relative_path, file_hash, size_bytes FROM (SELECT DISTINCT * FROM files)
    WHERE NOT (relative_path LIKE '%.toml' AND NOT is_test)
    QUALIFY row_number() OVER (PARTITION BY repo_id, relative_path ORDER BY indexed_at DESC) = 1""",
)
def stream_sync(spark, folder):
    """The catalog after four micro-batches: the first third of all scans, the last, the middle one too late, and deletions."""
    files = table(spark, folder, "files")
    span = files.agg(F.min("indexed_at").alias("a"), F.max("indexed_at").alias("b")).first()
    source = work_path(spark, "scans")
    third = F.lit(0) if span["a"] is None else F.floor(F.least((F.unix_micros("indexed_at") - F.unix_micros(F.lit(span["a"]))) * 3 / F.lit(max(1, (span["b"] - span["a"]).total_seconds() * 1e6)), F.lit(2)))
    for k in (0, 2, 1):
        files.filter(third == k).withColumn("deleted", F.lit(False)).coalesce(1).write.mode("append").parquet(source)
    gone = files.filter("relative_path LIKE '%.toml' AND NOT is_test")
    gone.withColumn("indexed_at", F.col("indexed_at") + F.expr("INTERVAL 1 YEAR")).withColumn("deleted", F.lit(True)).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    store = Store(spark, work_path(spark, "catalog"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    sync.start(stream, store, work_path(spark, "offsets"), once=True).awaitTermination()
    return store.read("files").select("repo_id", "relative_path", "file_hash", "size_bytes")


@R.query(
    "pipeline_versions",
    f"""WITH cut AS (SELECT to_timestamp((epoch(min(indexed_at)) + epoch(max(indexed_at))) / 2) AS t FROM files),
      o AS (SELECT * FROM (SELECT DISTINCT f.* FROM files f, cut WHERE indexed_at <= t) QUALIFY row_number() OVER (PARTITION BY repo_id, relative_path ORDER BY indexed_at DESC) = 1),
      n AS ({_LATEST}),
      v AS (SELECT repo_id, relative_path, o.file_hash, 1 AS version FROM o
        UNION ALL SELECT n.repo_id, n.relative_path, n.file_hash, CASE WHEN o.file_hash IS NULL THEN 1 ELSE 2 END FROM n LEFT JOIN o USING (repo_id, relative_path) WHERE o.file_hash IS DISTINCT FROM n.file_hash)
    SELECT repo_id, relative_path AS path, sha256('dataset:' || repo_id || ':default' || chr(0) || 'file' || chr(0) || relative_path || chr(0) || file_hash) AS id, CAST(version AS BIGINT) AS version FROM v""",
)
def pipeline_versions(spark, folder):
    """The datapoints after two runs of ``add``, on the catalog at the middle of its time and on that of now; a file's hash stands for its text."""
    files = table(spark, folder, "files")
    store = Store(spark, work_path(spark, "pipeline"))
    for rows in (_before(files), files):
        scan = catalog.latest(rows).withColumn("content", F.col("file_hash"))
        pipelines.add(pipelines.Context(spark, store, scan))
    return store.read("datapoints").select("repo_id", "path", "id", "version")

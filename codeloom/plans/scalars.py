"""Queries on paths, texts and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import ids, paths, tasks, text
from codeloom.plans.registry import Registry, table

R = Registry()


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _ends(name: str, ends) -> str:
    return "(" + " OR ".join(f"ends_with({name}, '{e}')" for e in ends) + ")"


_NAME = "lower(regexp_extract(relative_path, '[^/]*$'))"
_EXT = f"regexp_extract({_NAME}, '^.+\\.([^.]*)$', 1)"
_LANG = "CASE " + " ".join(f"WHEN {_EXT} IN ({_list(e)}) THEN '{n}'" for n, e in paths.LANGUAGES.items()) + " ELSE 'unknown' END"
_KIND = f"""CASE
  WHEN list_has_any(list_slice(string_split(lower(relative_path), '/'), 1, len(string_split(relative_path, '/')) - 1), [{_list(paths.TEST_FOLDERS)}])
    OR starts_with(name, 'test_') OR {_ends("name", paths.TEST_ENDS)} THEN 'test'
  WHEN starts_with(lower(relative_path), 'docs/') OR contains(lower(relative_path), '/docs/') OR {_ends("name", paths.DOC_ENDS)}
    OR name IN ('readme', 'license') OR starts_with(name, 'readme.') OR starts_with(name, 'license.') THEN 'documentation'
  WHEN name IN ({_list(paths.MANIFESTS)}) THEN 'manifest'
  WHEN {_ends("name", paths.CONFIG_ENDS)} OR name IN ({_list(paths.CONFIG_NAMES)}) OR lang IN ('toml', 'yaml', 'json') THEN 'configuration'
  WHEN lang IN ({_list([*paths.PARSED, "sql"])}) THEN 'source' ELSE 'unknown' END"""


@R.query(
    "classify_kind",
    f"""WITH f AS (SELECT DISTINCT repo_id, relative_path, {_NAME} AS name, {_LANG} AS lang FROM files)
    SELECT repo_id, relative_path, lang AS language, {_KIND} AS kind FROM f""",
)
def classify_kind(spark, folder):
    """Language and kind of every file by its path."""
    f = table(spark, folder, "files").select("repo_id", "relative_path").distinct()
    f = f.withColumn("language", paths.language(F.col("relative_path")))
    return f.withColumn("kind", paths.classify_kind(F.col("relative_path"), F.col("language")))


_ALIASES = " ".join(f"WHEN lower(language) IN ({_list([n, *e])}) THEN '{n}'" for n, e in paths.LANGUAGES.items())


@R.query("language_names", f"SELECT DISTINCT language AS stored, CASE {_ALIASES} ELSE 'unknown' END AS language FROM files")
def language_names(spark, folder):
    """Stored language names and aliases as closed names."""
    f = table(spark, folder, "files").select(F.col("language").alias("stored")).distinct()
    return f.select("stored", paths.normalise_language(F.col("stored")).alias("language"))


_SECRET = f"""(name IN ({_list(paths.SECRET_NAMES)}) OR starts_with(name, '.env.')
  OR regexp_extract(name, '^.+\\.([^.]*)$', 1) IN ({_list(paths.SECRET_EXTENSIONS)})
  OR (regexp_matches(name, '{"|".join(paths.SECRET_PARTS)}') AND NOT {_ends("name", [f".{e}" for e in paths.SOURCE_EXTENSIONS] + [".md", ".txt"])}))"""


@R.query(
    "secret_names",
    f"WITH f AS (SELECT DISTINCT repo_id, relative_path, {_NAME} AS name FROM file_content) SELECT repo_id, relative_path FROM f WHERE {_SECRET}",
)
def secret_names(spark, folder):
    """Files whose names say that they hold credentials."""
    f = table(spark, folder, "file_content").select("repo_id", "relative_path")
    return f.filter(paths.is_secret(F.col("relative_path"))).distinct()


@R.query(
    "security_audit",
    f"""WITH f AS (SELECT DISTINCT repo_id, relative_path, git_blob_id IS NOT NULL AS tracked, {_NAME} AS name FROM files)
    SELECT repo_id, count(*) FILTER (tracked) AS tracked_secrets, count(*) FILTER (NOT tracked) AS untracked_secrets
    FROM f WHERE {_SECRET} GROUP BY repo_id""",
)
def security_audit(spark, folder):
    """Secret files per repository, tracked or not."""
    f = table(spark, folder, "files").select("repo_id", "relative_path", F.col("git_blob_id").isNotNull().alias("tracked"))
    f = f.filter(paths.is_secret(F.col("relative_path"))).distinct()
    return f.groupBy("repo_id").agg(
        F.count_if("tracked").alias("tracked_secrets"), F.count_if(~F.col("tracked")).alias("untracked_secrets")
    )


@R.query(
    "ignore_paths",
    """SELECT DISTINCT f.repo_id, f.relative_path, coalesce(len(list_filter(r.custom_ignores, lambda p:
      CASE WHEN trim(p) IN ('', '/') THEN false
      WHEN ends_with(trim(p), '/') THEN list_contains(string_split(f.relative_path, '/'), regexp_replace(trim(p), '/$', ''))
      ELSE f.relative_path = trim(p) OR starts_with(f.relative_path, trim(p) || '/') END)) > 0, false) AS ignored
    FROM files f LEFT JOIN repo_config r USING (repo_id)""",
)
def ignore_paths(spark, folder):
    """Every file with whether its repository's patterns ignore it."""
    f = table(spark, folder, "files").select("repo_id", "relative_path").distinct()
    c = table(spark, folder, "repo_config").select("repo_id", "custom_ignores")
    joined = f.join(c, "repo_id", "left")
    return joined.select("repo_id", "relative_path", paths.ignored(F.col("relative_path"), F.col("custom_ignores")).alias("ignored"))


@R.query(
    "include_docs",
    """SELECT DISTINCT repo_id, relative_path FROM files WHERE kind = 'documentation' OR is_doc
    OR starts_with(lower(relative_path), 'docs/') OR contains(lower(relative_path), '/docs/') OR contains(lower(relative_path), 'adr')""",
)
def include_docs(spark, folder):
    """Files that an ingest of documents takes."""
    f = table(spark, folder, "files")
    keep = paths.included(["docs"], F.col("kind"), F.col("is_doc"), F.col("relative_path"))
    return f.filter(keep).select("repo_id", "relative_path").distinct()


def _redact_sql(column: str) -> str:
    for p in text.REDACTIONS:
        column = f"regexp_replace({column}, '{p.replace(chr(39), chr(39) * 2)}', '[REDACTED]', 'g')"
    return column


@R.query("redact_documents", f"SELECT doc_id, {_redact_sql('text')} AS text FROM documents")
def redact_documents(spark, folder):
    """Every document with the documented credential patterns masked."""
    return table(spark, folder, "documents").select("doc_id", text.redact(F.col("text")).alias("text"))


@R.query("redact_files", f"SELECT DISTINCT repo_id, relative_path, {_redact_sql('content')} AS content FROM file_content")
def redact_files(spark, folder):
    """Every file's content with the documented credential patterns masked."""
    f = table(spark, folder, "file_content")
    return f.select("repo_id", "relative_path", text.redact(F.col("content")).alias("content")).distinct()


@R.query("token_estimate", "SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, folder):
    """Estimated tokens of every document."""
    return table(spark, folder, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


_WORDS = (
    "string_split(trim(regexp_replace(translate(task_text, '"
    + tasks.SEPARATORS.replace("'", "''")
    + "', '"
    + " " * len(tasks.SEPARATORS)
    + "'), '\\s+', ' ', 'g')), ' ')"
)


@R.query(
    "task_keywords",
    f"""SELECT task_id, list_sort(list_distinct(list_filter(flatten(list_transform({_WORDS}, lambda w:
      CASE WHEN regexp_matches(w, '[-_]') THEN list_transform(list_concat([w], regexp_split_to_array(w, '[-_]')), lambda x: lower(x))
      ELSE [lower(w)] END)), lambda w: octet_length(encode(w)) >= 2 AND w NOT IN ({_list(tasks.STOP_WORDS)})))) AS terms FROM budgets""",
)
def task_keywords(spark, folder):
    """Search terms of every task."""
    return table(spark, folder, "budgets").select("task_id", tasks.keywords(F.col("task_text")).alias("terms"))


@R.query(
    "content_ids",
    """SELECT DISTINCT id, sha256(dataset_id || chr(0) || kind || chr(0) || path || chr(0) || content) AS content_id,
    sha256(content) AS content_sha FROM datapoints""",
)
def content_ids(spark, folder):
    """Content identities of every datapoint."""
    d = table(spark, folder, "datapoints")
    cid = text.content_id(*(F.col(c) for c in ("dataset_id", "kind", "path", "content")))
    return d.select("id", cid.alias("content_id"), F.sha2("content", 256).alias("content_sha")).distinct()


@R.query(
    "chunk_owner",
    """SELECT DISTINCT repo_id, kind, path, CASE WHEN kind = 'chunk' THEN regexp_replace(path, '#[0-9]+-[0-9]+$', '') ELSE path END AS owner
    FROM datapoints""",
)
def chunk_owner(spark, folder):
    """The file that each datapoint belongs to."""
    d = table(spark, folder, "datapoints")
    return d.select("repo_id", "kind", "path", ids.chunk_owner(F.col("kind"), F.col("path")).alias("owner")).distinct()


_IMPORT = """trim(regexp_replace(trim(coalesce(list_filter(regexp_split_to_array(target_name, '[:/. {,]'), lambda p: trim(p) <> '')[-1], target_name)),
  '^["''`{};,]+|["''`{};,]+$', '', 'g'))"""


@R.query("import_names", f"SELECT DISTINCT target_name, {_IMPORT} AS name FROM symbol_references WHERE kind = 'imports'")
def import_names(spark, folder):
    """Short names of every import text."""
    r = table(spark, folder, "symbol_references").filter("kind = 'imports'").select("target_name").distinct()
    return r.select("target_name", ids.import_name(F.col("target_name")).alias("name"))


@R.query(
    "node_ids",
    """SELECT DISTINCT id, repo_id, 'dataset:' || repo_id || ':default' AS dataset_id,
      'symbol:dataset:' || repo_id || ':default:' || id AS symbol_node, 'file:dataset:' || repo_id || ':default:' || file_path AS file_node,
      'name:dataset:' || repo_id || ':default:' || name AS name_node FROM symbols""",
)
def node_ids(spark, folder):
    """Graph identities of every symbol."""
    s = table(spark, folder, "symbols")
    ds = ids.dataset_id(F.col("repo_id"))
    return s.select(
        "id", "repo_id", ds.alias("dataset_id"), ids.symbol_node(ds, F.col("id")).alias("symbol_node"),
        ids.file_node(ds, F.col("file_path")).alias("file_node"), ids.name_node(ds, F.col("name")).alias("name_node"),
    ).distinct()

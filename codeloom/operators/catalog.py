"""The file catalog: statistics, listings, differences, rows without an owner."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import ids

FILE_KEY = ["repo_id", "relative_path"]


def latest(files: DataFrame, key: list[str] | None = None, order: str = "indexed_at") -> DataFrame:
    """The newest row of each file; ties and repeated rows by all columns. Null times are oldest.

    ``max_by`` over a struct combines before the shuffle, so a file with many rows is no skew.
    """
    key = key or FILE_KEY
    rest = [c for c in files.columns if c not in key]
    best = F.max(F.struct(order, *[c for c in rest if c != order]))
    return files.groupBy(*key).agg(best.alias("r")).select(*key, *[F.col("r")[c].alias(c) for c in rest])


def stats(files: DataFrame, symbols: DataFrame, references: DataFrame) -> DataFrame:
    """Counts per repository in one pass a table. A repository that one table lacks counts 0 there."""
    f = files.groupBy("repo_id").agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("kind") == "source").alias("source_files"),
        F.count_if("is_test").alias("test_files"),
        F.count_if("is_doc").alias("doc_files"),
        F.count_if(F.col("kind") == "manifest").alias("manifest_files"),
        F.count_if(F.col("kind") == "configuration").alias("configuration_files"),
    )
    s = symbols.groupBy("repo_id").agg(F.count("*").alias("symbols"))
    r = references.groupBy("repo_id").agg(F.count("*").alias("refs"))
    joined = f.join(s, "repo_id", "full").join(r, "repo_id", "full")
    return joined.select("repo_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in joined.columns if c != "repo_id"])


def diff(old: DataFrame, new: DataFrame, unidentified: DataFrame | None = None) -> DataFrame:
    """(key, change): added, changed (another hash, or a row without identities) or deleted files.

    ``unidentified`` holds files whose references name a source symbol without its id; they count as changed.
    """
    o = old.select(*FILE_KEY, F.col("file_hash").alias("old_hash"), F.lit(True).alias("was"))
    n = new.select(*FILE_KEY, F.col("file_hash").alias("new_hash"), F.lit(True).alias("is"))
    both = o.join(n, FILE_KEY, "full")
    stale = F.lit(False)
    if unidentified is not None:
        both = both.join(unidentified.select(*FILE_KEY).distinct().withColumn("stale", F.lit(True)), FILE_KEY, "left")
        stale = F.coalesce("stale", F.lit(False))
    change = (
        F.when(F.col("is").isNull(), "deleted")
        .when(F.col("was").isNull(), "added")
        .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")) | stale, "changed")
    )
    return both.select(*FILE_KEY, change.alias("change")).filter("change IS NOT NULL")


def missing_identity(references: DataFrame) -> DataFrame:
    """Files with references that name a source symbol but not its id."""
    gap = F.col("source_symbol_name").isNotNull() & F.col("source_symbol_id").isNull()
    return references.filter(gap).select("repo_id", F.col("source_file").alias("relative_path")).distinct()


def orphan_points(datapoints: DataFrame, files: DataFrame) -> DataFrame:
    """File and chunk datapoints whose file the catalog does not hold."""
    owned = datapoints.filter(F.col("kind").isin("file", "chunk") & (F.col("path") != ""))
    owned = owned.withColumn("relative_path", ids.chunk_owner(F.col("kind"), F.col("path")))
    return owned.join(files.select(*FILE_KEY).distinct(), FILE_KEY, "left_anti").drop("relative_path")


def absent(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (with the file key) whose file the catalog does not hold."""
    return rows.join(files.select(*FILE_KEY).distinct(), FILE_KEY, "left_anti")


def replace(old: DataFrame, new: DataFrame, removed: DataFrame, key: list[str]) -> DataFrame:
    """The next snapshot: old rows of untouched keys, and all new rows."""
    touched = new.select(*key).unionByName(removed.select(*key)).distinct()
    return old.join(touched, key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Union where a row of ``old`` wins over one of ``new`` with the same key; of several new ones the least."""
    w = Window.partitionBy(*key).orderBy("_new", *[c for c in old.columns if c not in key])
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def blob_ids(files: DataFrame, tracked: DataFrame) -> DataFrame:
    """Files with the blob id of the tracked path of the same name, or null."""
    return files.drop("git_blob_id").join(tracked.select(*FILE_KEY, "git_blob_id").distinct(), FILE_KEY, "left")


def upsert_repositories(old: DataFrame, new: DataFrame, indexed: bool = True) -> DataFrame:
    """Repositories by id (repo_id, name, root, head, branch, indexed_at): a new row replaces the old one.

    With ``indexed=False`` a repository was only opened: what is known of its last index, its head and time, stays.
    """
    both = new.select(*old.columns).alias("n").join(old.alias("o"), "repo_id", "full")
    keep = set() if indexed else {"head", "indexed_at"}
    known, came = F.col("o.root").isNotNull() | F.col("o.name").isNotNull(), F.col("n.root").isNotNull() | F.col("n.name").isNotNull()
    pick = lambda c: F.when(came & ~(known & F.lit(c in keep)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select("repo_id", *[pick(c) for c in old.columns if c != "repo_id"])


def first_entries(entries: DataFrame, term: str = "") -> DataFrame:
    """Named entries of ranked folders (rank, file_name, name, path, hidden) whose name holds the term, by name and path.

    Of entries with one file name that of the first folder counts, also if it is hidden: then none is shown. Case is ignored.
    """
    w = Window.partitionBy("file_name").orderBy("rank", "path")
    once = entries.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    shown = once.filter(~F.coalesce("hidden", F.lit(False)) & F.col("name").isNotNull() & F.lower("name").contains(term.lower()))
    return shown.orderBy(F.lower("name"), "path")

"""Versioned datapoints: identities, versions, pruning, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["dataset_id", "kind", "path"]


def arrivals(points: DataFrame) -> DataFrame:
    """Arrivals in order, without those that repeat the content just before: adds ``version`` and ``previous``.

    ``points`` has the key, ``id`` and ``ordinal`` (a total order within a key). The same id again is
    unchanged; another one is the next version, also when it returns to an older id.
    """
    w = Window.partitionBy(*KEY).orderBy("ordinal")
    fresh = points.withColumn("previous", F.lag("id").over(w)).filter(~F.col("previous").eqNullSafe(F.col("id")))
    return fresh.withColumn("version", F.row_number().over(w).cast("bigint"))


def versions(points: DataFrame) -> DataFrame:
    """One row per id of a key: its latest version and the ordinal of its first arrival."""
    return arrivals(points).groupBy(*KEY, "id").agg(F.max("version").alias("version"), F.min("ordinal").alias("first_ordinal"))


def supersedes(points: DataFrame) -> DataFrame:
    """Distinct edges from a version to the one that it replaced; a return gives both directions."""
    pairs = arrivals(points).filter("previous IS NOT NULL")
    return pairs.select("dataset_id", F.col("id").alias("src_id"), F.col("previous").alias("dst_id")).distinct()


def latest_version(datapoints: DataFrame) -> DataFrame:
    """The id with the highest version of each key; ties by id."""
    return datapoints.groupBy(*KEY).agg(F.max(F.struct("version", "id")).alias("m")).select(*KEY, "m.id", "m.version")


def pruned(datapoints: DataFrame, keep: int = 3) -> DataFrame:
    """Distinct ids of a key beyond its ``keep`` newest versions; ties by id."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("version"), "id")
    rows = datapoints.select(*KEY, "id", "version").distinct()
    return rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") > keep).drop("n")


def listed(datapoints: DataFrame) -> DataFrame:
    """All versions with their provenance as one struct, in order of path and version."""
    origin = F.struct("source_kind", "commit_id", "start_byte", "end_byte", "symbol_fingerprint", "confidence")
    rows = datapoints.select("id", "repo_id", *KEY, "version", "content_hash", origin.alias("provenance")).distinct()
    return rows.orderBy("path", "version", "id")


def chunk_windows(texts: DataFrame, lines: int = 80, step: int = 70) -> DataFrame:
    """(key columns, chunk_no, start_byte, end_byte): windows of lines, the last one reaching the end.

    Lines keep their line feed; offsets are UTF-8 bytes. Null and empty texts have no chunk. Byte
    offsets are running sums over the text's line sizes, all in the JVM.
    """
    rest = [c for c in texts.columns if c != "content"]
    sizes = F.transform(F.split("content", "\n"), lambda s: F.octet_length(s) + 1)
    total = F.octet_length("content")
    n = F.when(F.col("content").endswith("\n"), F.size("sizes") - 1).otherwise(F.size("sizes"))
    base = texts.filter("content <> ''").select(*rest, sizes.alias("sizes"), total.alias("total"), "content")
    base = base.withColumn("n", n).drop("content")
    last = F.ceil(F.greatest(F.col("n") - lines, F.lit(0)) / step).cast("int")
    each = base.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    up_to = lambda k: F.aggregate(F.slice("sizes", F.lit(1), k), F.lit(0), lambda a, x: a + x)
    start = up_to(F.col("chunk_no") * step)
    end = F.when(F.col("chunk_no") * step + lines >= F.col("n"), F.col("total")).otherwise(up_to(F.col("chunk_no") * step + lines))
    return each.select(*rest, "chunk_no", start.cast("bigint").alias("start_byte"), end.cast("bigint").alias("end_byte"))

"""Tables as numbered snapshots: a new version is written beside the old, then a pointer is swapped.

A table that is being read is never overwritten, and a failed write leaves the old version. Works on
any file system that Spark's Hadoop layer knows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import file_system


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        return file_system(self.spark, self.root)

    def version(self, table: str) -> int | None:
        """The present version, or None for a table that was never written."""
        fs, path = self._fs()
        found = fs.globStatus(path(f"{self.root}/{table}/current-*")) or []
        numbers = [int(f.getPath().getName().rsplit("-", 1)[1]) for f in found]
        return max(numbers, default=None)

    def read(self, table: str) -> DataFrame:
        v = self.version(table)
        if v is None:
            raise ValueError(f"no table {table}")
        return self.spark.read.parquet(f"{self.root}/{table}/v={v}")

    def write(self, table: str, df: DataFrame, unique: list[str] | None = None) -> int:
        """The next version. With ``unique``, a repeated key is an error and nothing is swapped."""
        v = (self.version(table) or 0) + 1
        target = f"{self.root}/{table}/v={v}"
        df.write.mode("overwrite").parquet(target)
        if unique:
            twice = self.spark.read.parquet(target).groupBy(*unique).agg(F.count("*").alias("n")).filter("n > 1")
            if not twice.isEmpty():
                raise ValueError(f"{table}: a key of {unique} repeats")
        fs, path = self._fs()
        fs.create(path(f"{self.root}/{table}/current-{v}"), True).close()
        return v

    def write_all(self, tables: dict[str, DataFrame]) -> None:
        """The next version of several tables: all are written before the first pointer is swapped."""
        fs, path = self._fs()
        at = {name: (self.version(name) or 0) + 1 for name in tables}
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={at[name]}")
        for name, v in at.items():
            fs.create(path(f"{self.root}/{name}/current-{v}"), True).close()

    def migrate(self, table: str, schema: str) -> bool:
        """Brings a table to a wider schema in a new version: new columns are null, no column is lost. False if it has them all."""
        old = self.read(table)
        want = self.spark.createDataFrame([], schema)
        if set(want.columns) <= set(old.columns):
            return False
        self.write(table, want.unionByName(old, allowMissingColumns=True))
        return True

    def drop_repositories(self, tables: list[str], gone: DataFrame) -> None:
        """The next version of the tables without the repositories ``gone`` (repo_id)."""
        g = gone.select("repo_id").distinct()
        self.write_all({t: self.read(t).join(g, "repo_id", "left_anti") for t in tables})

    def collect_garbage(self, table: str, keep: int = 1) -> list[int]:
        """Drops all versions but the newest ``keep``."""
        fs, path = self._fs()
        now = self.version(table) or 0
        gone = []
        for s in fs.globStatus(path(f"{self.root}/{table}/v=*")) or []:
            v = int(s.getPath().getName().split("=")[1])
            if v <= now - keep:
                fs.delete(path(f"{self.root}/{table}/current-{v}"), False)
                fs.delete(s.getPath(), True)
                gone.append(v)
        return sorted(gone)

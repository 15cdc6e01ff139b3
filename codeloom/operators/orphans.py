"""References to records that do not exist, kept as incremental keyed state.

A reference side is an orphan if its id is neither null nor blank and no parent
row with the same ``repo_id`` and ``id`` lives at ``recorded_at``
(``indexed_at <= recorded_at`` and ``deleted_at`` null or later).

State, in buckets of the key (repo_id, id), as tables that only grow by what a batch changes:

* the *parent index*: versions (repo_id, id, indexed_at) with the end of their life. A row that
  arrives later replaces its version, so a deletion that comes as the updated row retracts the old life;
* every reference side seen, with its status. A changed status is a further row; the newest counts.

``OrphanTracker.advance`` takes one batch. New references probe the parents of their keys; references
that wait on (or lean on) a key which the batch's parents touch are judged again, from the first instant
that is touched: an arriving parent resolves them, a deletion reopens them. Only buckets with a touched
key are read, and only new references and changed statuses are written. A manifest, written last, commits
the batch with its number, so that a repeated batch changes nothing and a restarted driver goes on where
the last one stopped. After each batch a snapshot of the counts per table, side and month is written, and
after ``compact_every`` batches the pieces are joined.

Judging is a sweep over events in order of (key, time): a parent's life is +1 at ``indexed_at`` and -1 at
its end; a reference is an orphan if the running sum at its time is 0. The events are range-partitioned by
all their columns, so a key, or one instant of a key, that holds a third of all rows spans as many tasks as
its size asks for. Each task sums within itself in Arrow batches; what a key carries over the border of two tasks is
told by one row a task.

Nulls: rows whose id, repo_id or time is null cannot be matched. A reference
with a null ``recorded_at`` or ``repo_id`` has no parent living at that time and
is an orphan; a parent with a null ``indexed_at`` never lives. A parent deleted at
or before its arrival never lives. Of rows of one version within a batch the longest life counts.
Repeated references give one row.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import drop, file_system, work_path

KEY = ("repo_id", "id")
#: Buckets of the state. A bucket should stay below some GB; a large installation takes thousands.
BUCKETS = 32
_FOREVER = "9999-12-31 00:00:00"

PARENTS = "repo_id string, id string, indexed_at timestamp, until timestamp, n bigint, bucket int"
REFS = "ref_id bigint, side string, repo_id string, id string, ts timestamp, orphan boolean, n bigint, bucket int"


def reference_sides(refs: DataFrame) -> DataFrame:
    """(ref_id, side, repo_id, id, ts), one row per stated id of a reference."""
    sides = F.explode(
        F.array(
            F.struct(F.lit("source").alias("side"), F.col("source_symbol_id").alias("id")),
            F.struct(F.lit("target").alias("side"), F.col("target_symbol_id").alias("id")),
        )
    )
    return (
        refs.select("ref_id", "repo_id", F.col("recorded_at").alias("ts"), sides.alias("s"))
        .select("ref_id", "s.side", "repo_id", "s.id", "ts")
        .filter(F.col("id").isNotNull() & F.col("id").rlike(r"\S"))
    )


def parent_versions(symbols: DataFrame) -> DataFrame:
    """(repo_id, id, indexed_at, until) of the rows that can be matched; ``until`` is far off for what is not deleted."""
    until = F.coalesce("deleted_at", F.to_timestamp(F.lit(_FOREVER)))
    ok = F.col("indexed_at").isNotNull() & F.col("id").isNotNull() & F.col("repo_id").isNotNull()
    return symbols.filter(ok).select(*KEY, "indexed_at", until.alias("until"))


# ---- the sweep

_EVENT = ["bucket", *KEY, "ts", "ord", "ref_id", "side"]
SWEPT = (
    "kind int, pid int, bucket int, repo_id string, id string, ts timestamp, ref_id bigint, side string, was boolean,"
    " total bigint, head boolean"
)
ROW, FIRST, LAST = 0, 1, 2


def _same(column: pa.Array) -> np.ndarray:
    """Whether each value but the first equals the one before; nulls are equal."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.or_(pc.fill_null(pc.equal(a, b), False), both).to_numpy(zero_copy_only=False)


def _sweep(batches):
    """Running sums of one task's sorted events: a row a reference, and the task's first and last key."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    names = [f.split()[0] for f in SWEPT.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.bool_()]
    last_key, last_row, carry, head, seen = None, None, 0, True, False
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        col = {f: b.column(f) for f in b.schema.names}
        key = (col["repo_id"][0].as_py(), col["id"][0].as_py())
        same = np.empty(n, bool)
        same[0] = seen and key == last_key
        same[1:] = _same(col["repo_id"]) & _same(col["id"])
        if not seen:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((FIRST, pid, 0, *key, None, None, None, None, 0, True), kinds, strict=True)], names=names)
        delta = col["delta"].to_numpy(zero_copy_only=False)
        sums = np.cumsum(delta)
        part = np.cumsum(~same)  # 0 is the key of the batch before
        start = np.flatnonzero(~same)
        base = np.concatenate(([-carry if seen else 0], sums[start] - delta[start]))
        total = sums - base[part]
        is_head = np.full(n, False) if not head else part == (0 if seen else 1)
        ord_ = col["ord"].to_numpy(zero_copy_only=False)
        again = np.zeros(n, bool)
        whole = [c.cast(pa.int64()) if pa.types.is_timestamp(c.type) else c for c in (col["ts"], col["ref_id"], col["side"])]
        again[1:] = same[1:] & (ord_[:-1] == 1) & np.logical_and.reduce([_same(c) for c in whole])
        again[0] = bool(same[0]) and last_row == (ord_[0], *(c[0].as_py() for c in whole))
        keep = np.flatnonzero((ord_ == 1) & ~again)
        take = pa.array(keep, pa.int64())
        m = len(keep)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(m, ROW, np.int32)), pa.array(np.full(m, pid, np.int32)), *(col[c].take(take).cast(t) for c, t in zip(
                    ("bucket", "repo_id", "id", "ts", "ref_id", "side", "was"), kinds[2:9], strict=True)),
                pa.array(total[keep], pa.int64()), pa.array(is_head[keep], pa.bool_()),
            ],
            names=names,
        )
        head = head and bool(is_head[-1])
        seen, carry = True, int(total[-1])
        last_key, last_row = (col["repo_id"][n - 1].as_py(), col["id"][n - 1].as_py()), (ord_[-1], *(c[n - 1].as_py() for c in whole))
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((LAST, pid, 0, *last_key, None, None, None, None, carry, head), kinds, strict=True)], names=names)


def _carried(edges: list) -> list[tuple[int, int]]:
    """(task, sum) that the tasks before leave to a task's first key; ``edges`` has two rows a task."""
    at: dict[int, dict[int, object]] = {}
    for e in edges:
        at.setdefault(e["pid"], {})[e["kind"]] = e
    out, key, total = [], None, 0
    for pid in sorted(at):
        first, last = at[pid][FIRST], at[pid][LAST]
        came = total if key == (first["repo_id"], first["id"]) else 0
        if came:
            out.append((pid, came))
        key, total = (last["repo_id"], last["id"]), last["total"] + (came if last["head"] else 0)
    return out


def judge(sides: DataFrame, parents: DataFrame) -> tuple[DataFrame, str]:
    """(bucket, reference side, ``was``, ``orphan``) of each side, and the path of the work table that it reads.

    ``sides``: (bucket, ref_id, side, repo_id, id, ts, was); ``parents``: (bucket, repo_id, id, indexed_at, until).
    """
    spark = sides.sparkSession
    ref = sides.select("bucket", *KEY, "ts", F.lit(1).alias("ord"), F.lit(0).cast("bigint").alias("delta"), "ref_id", "side", "was")
    life = F.array(
        F.struct(F.col("indexed_at").alias("ts"), F.lit(1).cast("bigint").alias("delta")), F.struct(F.col("until").alias("ts"), F.lit(-1).cast("bigint").alias("delta"))
    )
    par = parents.filter("until > indexed_at").select("bucket", *KEY, F.explode(life).alias("e")).select(
        "bucket", *KEY, "e.ts", F.lit(0).alias("ord"), "e.delta", F.lit(None).cast("bigint").alias("ref_id"), F.lit(None).cast("string").alias("side"),
        F.lit(None).cast("boolean").alias("was"),
    )
    events = par.unionByName(ref).repartitionByRange(*_EVENT).sortWithinPartitions(*_EVENT)
    path = work_path(spark, "orphan-sweep")
    events.mapInArrow(_sweep, SWEPT).write.parquet(path)
    swept = spark.read.schema(SWEPT).parquet(path)
    carried = _carried(swept.filter(F.col("kind") > ROW).select("kind", "pid", *KEY, "total", "head").collect())
    rows = swept.filter(F.col("kind") == ROW)
    total = F.col("total")
    if carried:  # one row a task at most
        rows = rows.join(F.broadcast(spark.createDataFrame(carried, "pid int, carry bigint")), "pid", "left")
        total = total + F.when(F.col("head"), F.coalesce("carry", F.lit(0))).otherwise(0)
    return rows.select("bucket", "ref_id", "side", *KEY, "ts", "was", (total <= 0).alias("orphan")), path


# ---- the state


@dataclass(frozen=True)
class OrphanState:
    """What a manifest says: the pieces of the two tables, the last batch of each source, the snapshots."""

    version: int = 0
    buckets: int = BUCKETS
    parents: list[str] = field(default_factory=list)
    refs: list[str] = field(default_factory=list)
    done: dict[str, int] = field(default_factory=dict)
    snapshots: list[str] = field(default_factory=list)


class OrphanTracker:
    """Incremental keeper of orphan references under ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int = BUCKETS, compact_every: int = 16):
        self.spark, self.root, self.compact_every = spark, (root or work_path(spark, "orphans")).rstrip("/"), compact_every
        self.state = self._load() or OrphanState(buckets=buckets)

    def _load(self) -> OrphanState | None:
        fs, path = file_system(self.spark, self.root)
        found = [f.getPath().getName() for f in fs.globStatus(path(f"{self.root}/manifest-*.json")) or []]
        if not found:
            return None
        name = max(found, key=lambda n: int(n.split("-")[1].split(".")[0]))
        text = self.spark.read.option("wholetext", True).text(f"{self.root}/{name}").first()[0]
        return OrphanState(**json.loads(text))

    def _commit(self, **changes) -> None:
        """The next manifest; it is renamed into place, so a batch counts wholly or not at all."""
        state = OrphanState(**{**asdict(self.state), **changes, "version": self.state.version + 1})
        fs, path = file_system(self.spark, self.root)
        part = path(f"{self.root}/.manifest-{state.version}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(asdict(state)).encode()))
        out.close()
        if not fs.rename(part, path(f"{self.root}/manifest-{state.version}.json")):
            raise RuntimeError(f"{self.root}: version {state.version} was committed by another driver")
        self.state = state

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(self.state.buckets)).cast("int"))

    def _piece(self, df: DataFrame, name: str, number: int) -> str:
        path = f"{self.root}/{name}/piece=b{number}v{self.state.version + 1}"
        df.write.mode("overwrite").partitionBy("bucket").parquet(path)
        return path

    def _pieces(self, paths: list[str], schema: str, only: list[int] | None) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        base = paths[0].rsplit("/", 1)[0]
        df = self.spark.read.schema(schema).option("basePath", base).parquet(*paths).drop("piece")
        return df if only is None else df.filter(F.col("bucket").isin(only))

    def parents(self, paths: list[str] | None = None, only: list[int] | None = None) -> DataFrame:
        """The present versions of the parent index."""
        paths = self.state.parents if paths is None else paths
        df = self._pieces(paths, PARENTS, only)
        if len(paths) > 1:
            df = df.groupBy("bucket", *KEY, "indexed_at").agg(F.max_by("until", "n").alias("until"))
        return df.select("bucket", *KEY, "indexed_at", "until")

    def references(self, paths: list[str] | None = None, only: list[int] | None = None) -> DataFrame:
        """Every reference side seen, with its present status."""
        paths = self.state.refs if paths is None else paths
        df = self._pieces(paths, REFS, only)
        if len(paths) > 1:
            df = df.groupBy("bucket", "ref_id", "side", *KEY, "ts").agg(F.max_by("orphan", "n").alias("orphan"))
        return df.select("bucket", "ref_id", "side", *KEY, "ts", "orphan")

    def advance(self, refs: DataFrame | None = None, parents: DataFrame | None = None, batch: int | None = None, source: str = "batch", snapshot: bool = True) -> bool:
        """One batch; False if its number was taken in before.

        ``refs`` as of ``reference_sides``, ``parents`` as of ``parent_versions``.
        """
        state, last = self.state, self.state.done.get(source, -1)
        batch = last + 1 if batch is None else batch
        if batch <= last:
            return False
        n = F.lit(state.version + 1).cast("bigint")
        paths_p, paths_r = list(state.parents), list(state.refs)
        touched = None
        if parents is not None:
            order = ["bucket", *KEY, "indexed_at"]
            rows = self._bucket(parents.select(*KEY, "indexed_at", "until")).repartitionByRange(*order)
            path = self._piece(rows.groupBy(*order).agg(F.max("until").alias("until")).withColumn("n", n), "parents", batch)
            paths_p.append(path)
            touched = self._pieces([path], PARENTS, None)
        none = F.lit(None).cast("boolean")
        todo = self._bucket(refs.select("ref_id", "side", *KEY, "ts")).withColumn("was", none) if refs is not None else None
        only = None
        if state.refs and touched is not None:
            since = touched.groupBy("bucket", *KEY).agg(F.min("indexed_at").alias("since"))
            only = [r[0] for r in since.select("bucket").distinct().collect()]
            old = self.references(only=only).join(since, ["bucket", *KEY]).filter("ts >= since")
            old = old.select("ref_id", "side", *KEY, "ts", "bucket", F.col("orphan").alias("was"))
            todo = old if todo is None else todo.unionByName(old)
        if todo is not None:
            known = self.parents(paths_p, only if refs is None else None)
            if state.parents:
                known = known.join(todo.select("bucket", *KEY).distinct(), ["bucket", *KEY], "left_semi")
            judged, work = judge(todo, known)
            fresh = judged.filter("was IS NULL OR was <> orphan").drop("was").withColumn("n", n)
            paths_r.append(self._piece(fresh, "refs", batch))
            drop(self.spark, work)
        counts = list(state.snapshots)
        if snapshot:
            counts.append(f"{self.root}/counts-{batch}-{state.version + 1}")
            orphan_counts(self.references(paths_r)).withColumn("batch", F.lit(len(counts) - 1)).coalesce(1).write.mode("overwrite").parquet(counts[-1])
        self._commit(parents=paths_p, refs=paths_r, done={**state.done, source: batch}, snapshots=counts)
        if max(len(paths_p), len(paths_r)) > self.compact_every:
            self.compact()
        return True

    def compact(self) -> None:
        """Joins the pieces of both tables; the old ones are dropped once the manifest names the new."""
        old = [*self.state.parents, *self.state.refs]
        n = F.lit(self.state.version + 1).cast("bigint")
        order = ["bucket", *KEY]
        p = self._piece(self.parents().repartitionByRange(*order, "indexed_at").withColumn("n", n), "parents", 0)
        r = self._piece(self.references().repartitionByRange(*order, "ts", "ref_id").withColumn("n", n), "refs", 0)
        self._commit(parents=[p], refs=[r])
        for path in old:
            drop(self.spark, path)

    def orphans(self) -> DataFrame:
        """Distinct (ref_id, side) that are orphans now."""
        return self.references().filter("orphan").select("ref_id", "side").distinct()

    def snapshot(self) -> DataFrame:
        """The counts after the last batch."""
        return self.spark.read.parquet(self.state.snapshots[-1])


def orphan_counts(refs: DataFrame) -> DataFrame:
    """Counts per table, side and month; a repeated reference counts once, as an orphan if any of its rows is."""
    month = F.date_format("ts", "yyyy-MM")
    once = refs.groupBy("ref_id", "side", month.alias("month")).agg(F.max("orphan").alias("orphan"))
    return (
        once.groupBy("side", "month")
        .agg(F.count("*").alias("n_refs"), F.count_if("orphan").alias("n_orphans"))
        .select(F.lit("symbol_references").alias("table_name"), "side", "month", "n_refs", "n_orphans")
    )


#: Share of a period by which the parents' source runs behind the references' in a replay.
LAG = 0.25


def replay(spark: SparkSession, refs: DataFrame, symbols: DataFrame, periods: int = 2, snapshot: bool = True) -> OrphanTracker:
    """Feeds both tables to a tracker as ``periods`` batches of arrivals, as daily runs would.

    References arrive in the period in which they were recorded (those without a time in the first). The indexer runs
    behind: at the end of a period it has told only of what happened until ``LAG`` of a period before, and a row is told again when it
    is deleted. So references of each period wait for parents that come with the next batch, and lean on some
    whose deletion is not known yet. The last batch brings the rest.
    """
    tracker = OrphanTracker(spark)
    sides = reference_sides(refs)
    versions = parent_versions(symbols).groupBy(*KEY, "indexed_at").agg(F.max("until").alias("until"))
    span = refs.agg(F.min("recorded_at").alias("lo"), F.max("recorded_at").alias("hi")).first()
    lo, hi = span["lo"], span["hi"]
    if lo is None or periods < 2:
        tracker.advance(sides, versions, snapshot=snapshot)
        return tracker
    step = (hi - lo) / periods
    for k in range(periods):
        low, high = (F.lit(lo + step * k) if k else None), (F.lit(lo + step * (k + 1)) if k < periods - 1 else None)
        told, now = (F.lit(lo + step * (k - LAG)) if k else None), (F.lit(lo + step * (k + 1 - LAG)) if k < periods - 1 else None)
        new = lambda c, a, b: (F.lit(True) if a is None else F.col(c) >= a) & (F.lit(True) if b is None else F.col(c) < b)
        part = sides.filter(F.coalesce(new("ts", low, high), F.lit(k == 0)))
        ended = new("indexed_at", None, now) & new("until", told, now) & (F.col("until") < F.to_timestamp(F.lit(_FOREVER)))
        came = versions.filter(new("indexed_at", told, now) | ended)
        if now is not None:
            came = came.withColumn("until", F.when(F.col("until") < now, F.col("until")).otherwise(F.to_timestamp(F.lit(_FOREVER))))
        tracker.advance(part, came, snapshot=snapshot)
    return tracker

"""Keeps a catalog in step with a stream of scanned files.

The stream's rows are scans of files (path, hash, content, ``deleted``). Each micro-batch
diffs against the catalog's present snapshot, and only changed files are replaced; the next
snapshot and the batch's number are swapped in together, so a repeated batch changes
nothing. A file seen twice in a batch counts by its newest row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators import catalog
from codeloom.operators.orphans import OrphanTracker, parent_versions, reference_sides
from codeloom.sources.store import Store

INTERVAL = "15 seconds"


def apply_batch(store: Store, batch: DataFrame, number: int, table: str = "files") -> int:
    """Merges one batch of scans; returns how many files changed."""
    old = store.read(table) if store.version(table) else None
    if old is not None and old.agg(F.max("_batch")).first()[0] is not None and old.agg(F.max("_batch")).first()[0] >= number:
        return 0
    new = catalog.latest(batch)
    if old is not None:  # a scan older than the one in the catalog comes too late
        known = old.select(*catalog.FILE_KEY, F.col("indexed_at").alias("_known"))
        new = new.join(known, catalog.FILE_KEY, "left").filter("_known IS NULL OR indexed_at >= _known").drop("_known")
    gone = new.filter("deleted").select(*catalog.FILE_KEY)
    live = new.filter("NOT deleted").drop("deleted")
    if old is None:
        store.write(table, live.withColumn("_batch", F.lit(number).cast("bigint")))
        return live.count()
    change = catalog.diff(old, live).filter("change <> 'deleted'").select(*catalog.FILE_KEY)
    changed = live.join(change, catalog.FILE_KEY, "left_semi").withColumn("_batch", F.lit(number).cast("bigint"))
    removed = old.join(gone, catalog.FILE_KEY, "left_semi").select(*catalog.FILE_KEY)
    n = changed.count() + removed.count()
    if n:
        store.write(table, catalog.replace(old, changed, removed, catalog.FILE_KEY))
        store.collect_garbage(table, keep=2)
    return n


def start(stream: DataFrame, store: Store, checkpoint: str, table: str = "files", once: bool = False) -> StreamingQuery:
    """Runs ``apply_batch`` on every micro-batch: each interval, or on what there is and then ends."""
    writer = stream.writeStream.foreachBatch(lambda df, n: apply_batch(store, df, n, table)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=INTERVAL)).start()


class OrphanStream:
    """Feeds micro-batches of references and symbols to one tracker.

    ``references`` and ``symbols`` are handlers for ``foreachBatch`` of two streams. Each keeps its own batch numbers in
    the tracker's manifest, so a micro-batch that is run again after a failure changes nothing.
    """

    def __init__(self, tracker: OrphanTracker):
        self.tracker = tracker

    def references(self, batch: DataFrame, number: int) -> bool:
        return self.tracker.advance(refs=reference_sides(batch), batch=number, source="references")

    def symbols(self, batch: DataFrame, number: int) -> bool:
        """A symbol that was deleted comes again as its updated row."""
        return self.tracker.advance(parents=parent_versions(batch), batch=number, source="symbols")

    def orphans(self) -> DataFrame:
        return self.tracker.orphans()

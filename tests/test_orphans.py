"""The orphan tracker: batches in any order end in the same state as one look at everything."""

from __future__ import annotations

import os
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codeloom.operators import orphans
from codeloom.streaming.sync import OrphanStream

T0 = datetime(2025, 1, 1, tzinfo=UTC)
REFS = "ref_id bigint, repo_id string, source_symbol_id string, target_symbol_id string, recorded_at timestamp, id int"
SYMS = "repo_id string, id string, indexed_at timestamp, deleted_at timestamp, ref_id int"


def at(h):
    return None if h is None else T0 + timedelta(hours=h)


def brute(refs, syms):
    out = set()
    for ref, repo, src, tgt, t in refs:
        for side, i in (("source", src), ("target", tgt)):
            if i is None or not i.strip():
                continue
            lives = any(r == repo and s == i and a is not None and t is not None and repo is not None and a <= t and (d is None or d > t) for r, s, a, d in syms)
            if not lives:
                out.add((ref, side))
    return out


def frames(spark, refs, syms):
    r = spark.createDataFrame([(a, b, c, d, at(t), 1) for a, b, c, d, t in refs], REFS)
    s = spark.createDataFrame([(a, b, at(x), at(y), 1) for a, b, x, y in syms], SYMS)
    return r, s


def made(rng, n):
    ids = ["a", "b", "c", "hot", " ", "", None]
    refs = [(k, rng.choice(["r", "q", None]), rng.choice(ids), rng.choice([*ids, "hot", "hot"]), rng.choice([None, *range(100)])) for k in range(n)]
    syms = []
    for _ in range(n // 4):
        a = rng.choice([None, *range(90)])
        syms.append((rng.choice(["r", "q", None]), rng.choice(ids[:4]), a, rng.choice([None, None, *( [a + d for d in (0, 1, 24, 50)] if a is not None else [5])])))
    return refs + refs[: n // 5], syms + syms[: n // 8]


def found(tracker):
    return {tuple(x) for x in tracker.orphans().collect()}


def size_of(paths):
    return sum(os.path.getsize(os.path.join(b, f)) for p in paths for b, _, names in os.walk(p.removeprefix("file://")) for f in names if f.endswith(".parquet"))


@pytest.mark.parametrize("periods", [1, 2, 3])
def test_replay_equals_brute_force(spark, periods):
    refs, syms = made(random.Random(periods), 120)
    r, s = frames(spark, refs, syms)
    tracker = orphans.replay(spark, r, s, periods)
    assert found(tracker) == brute(refs, syms)
    assert len(tracker.state.snapshots) == periods


def test_a_later_batch_changes_the_verdicts_of_an_earlier_one(spark):
    """References of the first period wait for late parents and lean on lives whose end comes later."""
    refs = [(k, "r", f"s{k % 4}", None, t) for k, t in enumerate([1, 20, 48, 49, 90, 99] * 4)]
    syms = [("r", "s0", 47, None), ("r", "s1", 0, 47), ("r", "s2", 0, None), ("r", "s3", 48, 95)]
    r, s = frames(spark, refs, syms)
    tracker = orphans.replay(spark, r, s, 2)
    assert found(tracker) == brute(refs, syms)
    first, second = (spark.read.parquet(p) for p in tracker.state.refs)
    was = first.select("ref_id", "side", F.col("orphan").alias("was"))
    changed = second.join(was, ["ref_id", "side"]).select("was", "orphan").distinct().collect()
    assert {(c.was, c.orphan) for c in changed} == {(True, False), (False, True)}


def test_batches_in_any_order(spark):
    """References first, parents later, a deletion last: waiting orphans resolve, deletions reopen."""
    rng = random.Random(9)
    refs, syms = made(rng, 60)
    # rows of one version must come together: a later one replaces it
    order = {}
    for x in syms:
        order.setdefault(x[:3], []).append(x)
    syms = [x for v in order.values() for x in v]
    half = sum(len(v) for v in list(order.values())[: len(order) // 2])
    r, _ = frames(spark, refs, syms)
    stream = OrphanStream(orphans.OrphanTracker(spark))
    stream.references(r, 0)
    assert stream.orphans().count() == len(brute(refs, []))
    stream.symbols(frames(spark, refs, syms[:half])[1], 0)
    assert found(stream.tracker) == brute(refs, syms[:half])
    stream.symbols(frames(spark, refs, syms[half:])[1], 1)
    assert found(stream.tracker) == brute(refs, syms)


def test_deletion_as_an_updated_row_reopens(spark):
    r, s = frames(spark, [(1, "r", "a", None, 10), (2, "r", "a", None, 7)], [("r", "a", 5, None)])
    stream = OrphanStream(orphans.OrphanTracker(spark))
    stream.references(r, 0)
    assert found(stream.tracker) == {(1, "source"), (2, "source")}
    stream.symbols(s, 0)
    assert found(stream.tracker) == set()
    stream.symbols(frames(spark, [], [("r", "a", 5, 8)])[1], 1)
    assert found(stream.tracker) == {(1, "source")}
    stream.symbols(frames(spark, [], [("r", "a", 9, None)])[1], 2)  # indexed again
    assert found(stream.tracker) == set()


def test_a_repeated_batch_changes_nothing_and_the_state_outlives_the_driver(spark):
    r, s = frames(spark, [(1, "r", "a", None, 10)], [("r", "a", 5, None)])
    tracker = orphans.OrphanTracker(spark)
    stream = OrphanStream(tracker)
    assert stream.references(r, 0) and stream.symbols(s, 0)
    assert not stream.symbols(s, 0) and not stream.references(r, 0)
    again = OrphanStream(orphans.OrphanTracker(spark, tracker.root))
    assert again.tracker.state == tracker.state and found(again.tracker) == set()
    assert not again.symbols(s, 0)
    again.symbols(frames(spark, [], [("r", "a", 5, 8)])[1], 1)
    assert found(again.tracker) == {(1, "source")}


def test_a_small_batch_writes_little(spark):
    ids = [f"s{k}" for k in range(4000)]
    r, s = frames(spark, [(k, "r", i, None, k % 50) for k, i in enumerate(ids * 5)], [("r", i, 10, None) for i in ids])
    tracker = orphans.OrphanTracker(spark)
    tracker.advance(orphans.reference_sides(r), orphans.parent_versions(s), snapshot=False)
    whole = size_of([*tracker.state.parents, *tracker.state.refs])
    late = frames(spark, [(10**6, "r", "s1", None, 40)], [("r", "s3", 10, 20), ("r", "s9", 10, 12)])
    tracker.advance(orphans.reference_sides(late[0]), orphans.parent_versions(late[1]), snapshot=False)
    assert size_of([tracker.state.parents[-1], tracker.state.refs[-1]]) * 10 < whole
    refs = [(k, "r", i, None, k % 50) for k, i in enumerate(ids * 5)] + [(10**6, "r", "s1", None, 40)]
    ends = {"s3": 20, "s9": 12}
    assert found(tracker) == {(k, "source") for k, _, i, _, t in refs if not (10 <= t < ends.get(i, 99))}


def test_pieces_are_joined(spark):
    refs, syms = made(random.Random(3), 60)
    order = sorted(syms, key=lambda x: str(x[:3]))
    tracker = orphans.OrphanTracker(spark, compact_every=2)
    groups = [[x for x in order if hash(str(x[:3])) % 4 == k] for k in range(4)]
    for k in range(4):
        r, s = frames(spark, refs[k::4], groups[k])
        tracker.advance(orphans.reference_sides(r), orphans.parent_versions(s))
    assert found(tracker) == brute(refs, syms) and len(tracker.state.refs) <= 2 and len(tracker.state.snapshots) == 4


def test_a_key_that_spans_many_tasks(spark):
    """The sums are carried over the borders of tasks, also where one key fills several, or one instant does."""
    rng = random.Random(1)
    refs = [(k, "r", "hot" if k % 3 else rng.choice("ab"), None, rng.choice([50, 50, rng.randrange(100)])) for k in range(3000)]
    syms = [("r", "hot", h, h + rng.choice([1, 1, 2])) for h in range(0, 100, 2)] + [("r", "b", 10, None)]
    r, s = frames(spark, refs, syms)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(orphans.replay(spark, r, s, 2)) == brute(refs, syms)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_tables(spark):
    r, s = frames(spark, [], [])
    tracker = orphans.replay(spark, r, s)
    assert tracker.orphans().count() == 0
    assert tracker.snapshot().count() == 0


def test_counts_by_month(spark):
    refs = [(1, "r", "a", "b", 1), (2, "r", "a", None, 800)]
    r, s = frames(spark, refs, [("r", "a", 0, None)])
    tracker = orphans.replay(spark, r, s, 1)
    got = {(x.side, x.month): (x.n_refs, x.n_orphans) for x in tracker.snapshot().collect()}
    assert got == {("source", "2025-01"): (1, 0), ("source", "2025-02"): (1, 0), ("target", "2025-01"): (1, 1)}

"""Filling containers of fixed capacity, by packing patterns over a length histogram.

Per task the lengths are counted; the histogram has at most ``capacity`` distinct
lengths whatever the number of items, and only it reaches the packer. Lengths are
placed longest first. A *pattern* is a multiset of lengths with the number of
containers that have it; placing a length takes patterns with enough room, the
shortest pack (the most room) first, and updates the counts. That leaves many gaps of middling
size, so the placement is then *refined*: the emptiest share of the containers is
dissolved and its lengths are placed again, longest first, each into the pack that they fill best. A share
after which fewer containers are left is kept. ``refined=False`` gives the plain placement.

Items find their container by rank. Their rank within (task, length) is counted
within hash salts and shifted by the salts' counts, so that a length which holds a
third of all rows is ranked in pieces; no group of items is ever gathered. There are as many salts as keep a salt
below ``SALT_ROWS`` rows if all rows had one length, and each salt meets only the runs of slots that its ranks reach.

Defined results: repeated rows count once. A null or empty snippet takes 0 tokens
and goes into container 0. A snippet larger than the capacity alone is cut, at
character borders, into pieces of at most the capacity; only such are cut. A task
without a budget, or with one below one token, gives container null. Ties are
ordered by a hash of the whole row. Scores play no part in feasibility and are kept
as they are, nulls too.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one salt at most, and the least number of salts.
SALT_ROWS, LEAST_SALTS = 1_000_000, 64
#: Shares of the containers that a refinement dissolves.
SHARES = (0.125, 0.25, 0.5, 1.0)

Patterns = list[tuple[int, tuple[int, ...]]]  # (containers, lengths in each)


def place(histogram: dict[int, int], capacity: int, held: Patterns = (), tightest: bool = False) -> Patterns:
    """The patterns after all lengths are placed, longest first, each into the shortest pack with room.

    ``held`` are patterns that stand before; ``tightest``: into the pack with the least room instead.
    """
    by_room: dict[int, list[list]] = defaultdict(list)  # room -> [count, lengths]
    rooms: list[int] = []  # sorted keys of by_room

    def put(count: int, lengths: tuple[int, ...], room: int) -> None:
        if room not in by_room or not by_room[room]:
            i = bisect.bisect_left(rooms, room)
            if i == len(rooms) or rooms[i] != room:
                rooms.insert(i, room)
        by_room[room].append([count, lengths])

    for count, lengths in held:
        put(count, lengths, capacity - sum(lengths))
    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left, fresh = histogram[length], []
        while left and rooms:
            i = bisect.bisect_left(rooms, length) if tightest else len(rooms) - 1
            if i >= len(rooms) or rooms[i] < length:
                break
            room = rooms[i]
            count, lengths = by_room[room][-1]
            # The tightest pack takes this length as often as it can, at once.
            times = min(room // length, -(-left // count)) if tightest else 1
            taken = min(count, max(1, left // times))
            if times * taken > left:
                times, taken = 1, min(count, left)
            if taken == count:
                by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(i)
            else:
                by_room[room][-1][0] -= taken
            left -= times * taken
            put(taken, lengths + (length,) * times, room - length * times)
        if left:  # a container is opened only if no other has room
            full, rest = divmod(left, capacity // length)
            fresh += [(full, capacity // length)] * bool(full) + [(1, rest)] * bool(rest)
        for count, times in fresh:
            put(count, (length,) * times, capacity - length * times)
    return [(c, lengths) for room in rooms for c, lengths in by_room[room]]


def _containers(patterns: Patterns) -> int:
    return sum(c for c, _ in patterns)


def refine(patterns: Patterns, capacity: int) -> Patterns:
    """The patterns after the emptiest containers were dissolved and their lengths placed again, if that saves any."""
    best = patterns
    for share in SHARES:
        todo, held, freed = max(1, int(share * _containers(patterns))), [], defaultdict(int)
        for count, lengths in sorted(patterns, key=lambda p: (sum(p[1]), p[1])):
            gone = min(count, todo)
            todo -= gone
            for length in lengths:
                freed[length] += gone * bool(gone)
            if count > gone:
                held.append((count - gone, lengths))
        again = place({x: n for x, n in freed.items() if n}, capacity, held, tightest=True)
        best = min(best, again, key=_containers)
    return best


def pack_histogram(histogram: dict[int, int], capacity: int, refined: bool = True) -> Patterns:
    """Shortest pack first, then refined."""
    patterns = place(histogram, capacity)
    if refined and _containers(patterns) * capacity - sum(k * n for k, n in histogram.items() if k > 0) >= capacity:
        patterns = refine(patterns, capacity)
    return patterns


def slots(histogram: dict[int, int], capacity: int, refined: bool = True) -> dict[int, list[dict]]:
    """Length -> its runs of slots: ranks from ``lo`` to before ``hi``, ``per`` slots in each container from ``first`` on."""
    runs, used, base = defaultdict(list), defaultdict(int), 0
    for count, lengths in pack_histogram(histogram, capacity, refined):
        for length in sorted(set(lengths)):
            per = lengths.count(length)
            runs[length].append({"lo": used[length], "hi": used[length] + per * count, "first": base, "per": per})
            used[length] += per * count
        base += count
    return runs


def _slot_batches(refined: bool):
    run = pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("first", pa.int64()), ("per", pa.int64())])

    def go(batches):
        for b in batches:
            at, tokens, found = [], [], []
            for i, (limit, histogram) in enumerate(zip(b.column("limit_tokens").to_pylist(), b.column("histogram").to_pylist(), strict=True)):
                for length, runs in slots({h["tokens"]: h["n"] for h in histogram}, limit, refined).items():
                    at.append(i), tokens.append(length), found.append(runs)
            task = b.column("task_id").take(pa.array(at, pa.int64()))
            arrays = [task, pa.array(tokens, pa.int64()), pa.array(found, pa.list_(run))]
            yield pa.RecordBatch.from_arrays(arrays, names=["task_id", "tokens", "runs"])

    return go


def _pieces(batches):
    """Cuts oversized snippets: adds piece_no, start_byte, end_byte; no piece breaks a character."""
    for b in batches:
        snippets, limits = b.column("snippet").to_pylist(), b.column("limit_tokens").to_pylist()
        at, no, lo, hi = [], [], [], []
        for i, (s, limit) in enumerate(zip(snippets, limits, strict=True)):
            data, size, p, k = s.encode(), 4 * limit, 0, 0
            while p < len(data):
                q = min(p + size, len(data))
                while q < len(data) and data[q] & 0xC0 == 0x80:
                    q -= 1
                at.append(i), no.append(k), lo.append(p), hi.append(q)
                p, k = q, k + 1
        out = b.take(pa.array(at, pa.int64()))
        for name, v in (("piece_no", no), ("start_byte", lo), ("end_byte", hi)):
            out = out.set_column(out.schema.get_field_index(name), name, pa.array(v, pa.int64()))
        yield out


def pack(items: DataFrame, budgets: DataFrame, refined: bool = True, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Every distinct item (or piece of an oversized one) with its container."""
    limits = budgets.groupBy("task_id").agg(F.max("limit_tokens").alias("limit_tokens"))
    size = F.coalesce(F.octet_length("snippet"), F.lit(0)).cast("bigint")
    base = (
        items.select("task_id", "relative_path", "score", "reasons", "snippet")
        .distinct()
        .join(limits, "task_id", "left")
        .withColumn("piece_no", F.lit(0).cast("bigint"))
        .withColumn("start_byte", F.lit(0).cast("bigint"))
        .withColumn("end_byte", size)
    )
    fits = F.coalesce(F.col("limit_tokens") >= 1, F.lit(False))
    over = fits & (F.ceil(F.col("end_byte") / 4) > F.col("limit_tokens"))
    cut = base.filter(over).mapInArrow(_pieces, base.schema)
    tokens = F.when(fits, F.ceil((F.col("end_byte") - F.col("start_byte")) / 4))
    # a count of the table's rows reads no column; the salts grow with it, so that none does
    salts = max(LEAST_SALTS, -(-items.count() // salt_rows))
    salt = F.pmod(F.xxhash64("relative_path", "score", "snippet", "piece_no"), F.lit(salts))
    parts = base.filter(~over).unionByName(cut).withColumn("tokens", tokens).withColumn("salt", salt)

    salted = parts.filter("tokens > 0").groupBy("task_id", "limit_tokens", "tokens", "salt").agg(F.count("*").alias("n"))
    histogram = salted.groupBy("task_id", "limit_tokens", "tokens").agg(F.sum("n").alias("n"))
    per_task = histogram.groupBy("task_id", "limit_tokens").agg(
        F.collect_list(F.struct("tokens", "n")).alias("histogram")
    )
    kind = items.schema["task_id"].dataType.simpleString()
    # One row a task; a stated number of partitions, or so few MB would be one long task.
    spread = items.sparkSession.sparkContext.defaultParallelism
    runs = per_task.repartition(spread, "task_id").mapInArrow(
        _slot_batches(refined), f"task_id {kind}, tokens bigint, runs array<struct<lo:bigint,hi:bigint,first:bigint,per:bigint>>"
    )
    shift = Window.partitionBy("task_id", "tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        salted.withColumn("shift", F.coalesce(F.sum("n").over(shift), F.lit(0)))
        .join(runs, ["task_id", "tokens"])
        .select("task_id", "tokens", "salt", "shift", F.filter("runs", lambda r: (r["hi"] > F.col("shift")) & (r["lo"] < F.col("shift") + F.col("n"))).alias("runs"))
    )
    order = Window.partitionBy("task_id", "tokens", "salt").orderBy(
        F.xxhash64("relative_path", "score", "reasons", "snippet"), "relative_path", "score", "reasons", "piece_no"
    )
    ranked = parts.withColumn("rank", F.row_number().over(order) - 1)
    placed = ranked.join(offsets, ["task_id", "tokens", "salt"], "left")
    at = F.col("shift") + F.col("rank")
    run = F.element_at(F.filter("runs", lambda r: r["lo"] <= at), -1)
    found = run["first"] + F.floor((at - run["lo"]) / run["per"])
    container = F.when(F.col("tokens") > 0, found).when(F.col("tokens") == 0, F.lit(0)).cast("bigint")
    return placed.select(
        "task_id", "relative_path", "score", "reasons", "snippet", "piece_no", "start_byte", "end_byte",
        F.col("tokens").cast("bigint").alias("tokens"), "limit_tokens", container.alias("container"),
    )


def containers(packed: DataFrame) -> DataFrame:
    """Per task: containers used, tokens, and the least number that any packing needs by volume."""
    per = packed.filter("container IS NOT NULL").groupBy("task_id", "limit_tokens", "container").agg(
        F.sum("tokens").alias("used"), F.count("*").alias("n")
    )
    return per.groupBy("task_id", "limit_tokens").agg(
        F.count("*").alias("n_containers"),
        F.sum("n").alias("n_items"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
        F.ceil(F.sum("used") / F.first("limit_tokens")).cast("bigint").alias("least_by_volume"),
    )

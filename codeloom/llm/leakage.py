"""Evaluation texts leaking into training text, by greedy string tiling.

A document and an item share *tiles*: the longest common runs of words are marked
first, then shorter ones on what is still unmarked, down to ``min_match`` words,
each search done by a running Karp-Rabin hash. Tiles may stand in another order
than in the item, so the covered share of an item also shows reordered passages.

Documents stream past once. The items' seeds (``min_match`` words in a row) are held
by every worker; a document is tiled only with items of which it holds a seed. That is
the join of shared-token seeds with the small side in memory. The items come in blocks
of at most ``BLOCK_WORDS`` words. A set that fills more than one block takes a pass for each, whose result is written before the
next block is sent out and the last one given up, so driver and workers hold one block however many items there are; a
worker process builds the seeds of a block once. Nothing of the documents reaches the driver.

Words are maximal runs of letters and digits after NFKC and lower-casing.
Defined results: null or empty texts have no words; an item shorter than
``min_match`` words cannot leak; repeated rows of an item or document give one row
a pair (the best).
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import materialize

#: Words of a seed and of the shortest tile.
MIN_MATCH = 5
#: Consecutive words that make a leak.
LEAK_WORDS = 13
#: Share of an item's words covered by tiles that makes a reordered leak.
LEAK_SHARE = 0.6
#: Words of evaluation items held by a worker at once.
BLOCK_WORDS = 2_000_000

_WORDS = re.compile(r"[^\W_]+")
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def words(text: str | None) -> list[str]:
    """Words of a text by the project's definition."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORDS.findall(text.lower())


def _rolling(codes: list[int], marked: list[bool], size: int):
    """(hash, position) of every unmarked run of ``size`` codes."""
    power, h, run = pow(_BASE, size - 1, _MOD), 0, 0
    for i, c in enumerate(codes):
        if marked[i]:
            h = run = 0
            continue
        if run == size:
            h = (h - codes[i - size] * power) % _MOD
            run -= 1
        h = (h * _BASE + c) % _MOD
        run += 1
        if run == size:
            yield h, i - size + 1


def tile(item: list[str], doc: list[str], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(item position, document position, length) of the greedy tiles, longest first."""
    ids: dict[str, int] = {}
    a = [ids.setdefault(w, len(ids) + 1) for w in item]
    b = [ids.get(w, 0) for w in doc]
    free = len(ids) + 1
    b = [x or free + i for i, x in enumerate(b)]  # words that the item lacks match nothing
    done_a, done_b = [False] * len(a), [x > free - 1 for x in b]
    tiles, size = [], max(min_match, len(a) // 2)
    while True:
        index = defaultdict(list)
        for h, p in _rolling(a, done_a, size):
            index[h].append(p)
        found, longest, skip = [], 0, {}
        for h, t in _rolling(b, done_b, size):
            for p in index.get(h, ()):
                if skip.get(p - t, -1) > t:  # inside a match that is already known
                    continue
                k = 0
                while (
                    p + k < len(a) and t + k < len(b) and a[p + k] == b[t + k] and not done_a[p + k] and not done_b[t + k]
                ):
                    k += 1
                if k >= size:
                    found.append((k, p, t))
                    longest = max(longest, k)
                    skip[p - t] = t + k - size + 1
        if longest > 2 * size:
            size = longest
            continue
        found.sort(key=lambda m: (-m[0], m[1], m[2]))
        for k, p, t in found:
            # what an earlier tile occludes is cut off; a remainder of enough words is kept
            q = 0
            while q < k:
                while q < k and (done_a[p + q] or done_b[t + q]):
                    q += 1
                e = q
                while e < k and not done_a[p + e] and not done_b[t + e]:
                    e += 1
                if e - q >= size:
                    for x in range(q, e):
                        done_a[p + x] = done_b[t + x] = True
                    tiles.append((p + q, t + q, e - q))
                q = e
        if size == min_match:
            return tiles
        size = max(min_match, size // 2) if size > 2 * min_match else min_match


def seeds(items: list[tuple], min_match: int) -> dict[tuple, list[int]]:
    """Each run of ``min_match`` words -> numbers of the items that hold it."""
    index: dict[tuple, list[int]] = defaultdict(list)
    for i, (_, w) in enumerate(items):
        for g in set(zip(*(w[k:] for k in range(min_match)), strict=False)):
            index[g].append(i)
    return index


#: The seeds of the block that this worker process saw last, by the block's number.
_HELD: dict[str, tuple[list, dict]] = {}


def _block_of(name: str, shared, min_match: int) -> tuple[list, dict]:
    """The items of a block and their seeds, built once a process."""
    if name not in _HELD:
        _HELD.clear()
        items = shared.value
        _HELD[name] = items, seeds(items, min_match)
    return _HELD[name]


SCHEMA = "doc_id bigint, item_id bigint, n_tiles int, longest int, covered int, item_words int"


def _blocks(items: DataFrame, block_words: int):
    """Blocks of (item_id, words) of bounded size, one at a time on the driver."""
    block, n = [], 0
    for r in items.select("item_id", "text").filter("text IS NOT NULL AND item_id IS NOT NULL").distinct().toLocalIterator():
        w = words(r["text"])
        if block and n + len(w) > block_words:
            yield block
            block, n = [], 0
        block.append((r["item_id"], w))
        n += len(w)
    if block:
        yield block


def tiles(documents: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For every document and item with a shared tile: number of tiles, the longest, words covered."""
    spark, docs, out, last = documents.sparkSession, documents.select("doc_id", "text"), None, None
    for block in _blocks(items, block_words):
        if last is not None:  # more than one block: the one before is worked off and given up first
            held, part = last
            part = materialize(part, "tiles")
            held.destroy()
            out = part if out is None else out.unionByName(part)
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches, shared=shared, name=name):
            known, index = _block_of(f"{name}/{min_match}", shared, min_match)
            for batch in batches:
                cols: list[list] = [[] for _ in range(6)]
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    w = words(text)
                    hit = {i for g in zip(*(w[k:] for k in range(min_match)), strict=False) if g in index for i in index[g]}
                    for i in sorted(hit):
                        found = tile(known[i][1], w, min_match)
                        row = doc_id, known[i][0], len(found), max(x[2] for x in found), sum(x[2] for x in found), len(known[i][1])
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
                kinds = [pa.int64()] * 2 + [pa.int32()] * 4
                names = [f.split()[0] for f in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        last = shared, docs.mapInArrow(run, SCHEMA)
    if last is not None:
        out = last[1] if out is None else out.unionByName(last[1])
    if out is None:
        return spark.createDataFrame([], SCHEMA)
    best = F.max(F.struct("longest", "covered", "n_tiles", "item_words"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def leaks(tiled: DataFrame, leak_words: int = LEAK_WORDS, leak_share: float = LEAK_SHARE) -> DataFrame:
    """The tiled pairs that count as leaks, with their kind."""
    share = F.round(F.col("covered") / F.col("item_words"), 4)
    kind = (
        F.when(F.col("longest") == F.col("item_words"), "whole")
        .when(F.col("longest") >= leak_words, "part")
        .when(share >= leak_share, "reordered")
    )
    return tiled.select("*", share.alias("share"), kind.alias("kind")).filter("kind IS NOT NULL")

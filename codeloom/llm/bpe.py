"""Byte-pair encoding of a corpus with a public vocabulary of merge ranks.

Each pretoken's bytes form a doubly linked list of symbols. All adjacent pairs
that the vocabulary knows wait in a priority queue by (rank, position); the best
is taken, entries whose symbols have since changed are skipped as stale, and the
merged symbol's new pairs are queued. A pretoken of n bytes costs O(n log n), so
one without any white space is no special case.

Defined results: null, empty -> an empty list. Any other text, blank ones too,
is encoded whole; strings of special tokens are ordinary text. Decoding joins the
vocabulary's byte strings and gives back the text exactly.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pretoken pattern published with this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pretokens kept per worker process; beyond it the memory starts afresh.
CACHE_SIZE = 200_000
#: Longer pretokens are encoded each time and not kept.
CACHE_LENGTH = 64


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.words = {r: b for b, r in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pretoken."""
        ranks, n = self.ranks, len(word)
        sym: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        if n == 1:
            return [ranks[word]]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, j = heapq.heappop(heap)
            a, b = sym[i], sym[j]
            if a is None or b is None or after[i] != j or ranks.get(a + b) != rank:
                continue  # stale
            sym[i], sym[j] = a + b, None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get(a + b + sym[k])) is not None:
                    heapq.heappush(heap, (r, i, k))
            if (h := before[i]) >= 0 and (r := ranks.get(sym[h] + a + b)) is not None:
                heapq.heappush(heap, (r, h, i))
        return [ranks[s] for s in sym if s is not None]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for w in self.split(text):
            ids = cache.get(w)
            if ids is None:
                ids = self.merge(w.encode())
                if len(w) <= CACHE_LENGTH:
                    if len(cache) >= CACHE_SIZE:
                        cache.clear()
                    cache[w] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        return b"".join(self.words[i] for i in ids).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY) -> Encoder:
    """The vocabulary file's encoder, loaded once in a process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return Encoder(ranks)


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row; one pass without a shuffle. Other columns are left out."""

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            ids = [enc.encode(t) for t in b.column(1).to_pylist()]
            ends = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, flat)], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_column(df: DataFrame, key: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) from ids; null ids give null."""

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            text = [None if x is None else enc.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")

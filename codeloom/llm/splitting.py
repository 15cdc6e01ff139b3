"""Splitting oversized items at natural boundaries by lexical cohesion.

The text is read as a row of units (lines, else sentences, else words, else
characters). At every border between units two blocks of words, one before and
one after, are compared by the cosine of their counts; a valley of this
similarity marks a change of topic, and its *depth* is the rise to the peaks on
both sides. Within the size window of a piece the deepest valley is the cut: among line ends, where an
empty line weighs a little more than another; where the window has none, among sentence ends; else among white space; else
between any two user-visible characters. Then each piece but the first is given the overlap before it.

A cut never divides a character, a CR LF pair, or a letter and its combining marks or joiners (unless one such
cluster alone exceeds the limit).

Defined results: sizes are UTF-8 bytes. Content of at most the limit, empty or null
is no case and gives no piece. ``max_kb`` null means 2048. A limit below 4 bytes is
read as 4. The overlap is the one asked, down to a character border, so it may be up to a cluster shorter; it is at most
what leaves each piece one new character (the limit less 4 bytes), and ``overlap_short`` marks the pieces that had to take
less than was asked. Pieces without their overlap
(``start_byte`` to ``end_byte``) join to the content exactly. The same content of an id and repository
gives its pieces once; contents that differ are all split, told apart by ``content_hash``.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_KB = 2048
#: Words in each of the two compared blocks.
BLOCK = 24
#: How much the depth of a valley counts at an empty line and at another line end.
BLANK_WEIGHT, LINE_WEIGHT = 1.0, 0.75
#: A piece is at least this share of the room, if any border allows.
LEAST_SHARE = 0.5

_WORD = re.compile(r"[^\W_]+")
_BLANK = re.compile(r"(?:\r\n|\r(?!\n)|\n)[ \t]*(?:(?:\r\n|\r(?!\n)|\n)[ \t]*)+(?:(?<=\n)|(?<=\r)|(?=\S)|$)")
_LINE = re.compile(r"\r\n|\n|\r")
_SENTENCE = re.compile(r"[.!?;:][\"')\]]*\s+|[。！？；]")
_SPACE = re.compile(r"\s+")


def _glued(text: str, i: int) -> bool:
    """Whether a cut before position i would divide a user-visible character."""
    c = text[i]
    if text[i - 1] == "\u200d" or c in "\u200d\ufe0e\ufe0f" or (c == "\n" and text[i - 1] == "\r"):
        return True
    return (c >= "\u0300" and unicodedata.combining(c) != 0) or "\U0001f3fb" <= c <= "\U0001f3ff"


def borders(text: str) -> list[tuple[int, int]]:
    """(character position, kind) of the natural borders; kind 0 is the best. Ordered."""
    best: dict[int, int] = {}
    for kind, pattern in enumerate((_BLANK, _LINE, _SENTENCE, _SPACE)):
        for m in pattern.finditer(text):
            if 0 < m.end() < len(text):
                best.setdefault(m.end(), kind)
    return sorted((p, k) for p, k in best.items() if not _glued(text, p))


def depths(text: str, places: list[int], block: int = BLOCK) -> list[float]:
    """The depth of the similarity valley at each place, by two sliding blocks of words."""
    spans = [(m.start(), m.group().lower()) for m in _WORD.finditer(text)]
    starts, words = [s for s, _ in spans], [w for _, w in spans]
    sims, memo = [], {}
    left, right, at = Counter(), Counter(words[:block]), 0
    dot = norm_l = 0
    norm_r = sum(v * v for v in right.values())

    def add(c, w, d):
        """Changes one count; returns by how much the squares' sum changes."""
        v = c[w]
        c[w] = v + d
        return 2 * v * d + 1

    for p in places:
        g = bisect.bisect_left(starts, p)
        while at < g:  # the border moves past words[at]
            w = words[at]
            dot -= left[w]
            norm_r += add(right, w, -1)
            dot += right[w]
            norm_l += add(left, w, 1)
            if at + block < len(words):
                v = words[at + block]
                dot += left[v]
                norm_r += add(right, v, 1)
            if at - block >= 0:
                v = words[at - block]
                dot -= right[v]
                norm_l += add(left, v, -1)
            at += 1
        if g not in memo:
            memo[g] = dot / ((norm_l * norm_r) ** 0.5) if norm_l > 0 and norm_r > 0 else 0.0
        sims.append(memo[g])
    n = len(sims)
    peak_l, peak_r = sims[:], sims[:]
    for i in range(1, n):
        if sims[i - 1] >= sims[i]:
            peak_l[i] = peak_l[i - 1]
    for i in range(n - 2, -1, -1):
        if sims[i + 1] >= sims[i]:
            peak_r[i] = peak_r[i + 1]
    return [peak_l[i] + peak_r[i] - 2 * sims[i] for i in range(n)]


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(from_byte, start_byte, end_byte) of each piece: its text, overlap included, is from_byte..end_byte."""
    data = text.encode()
    if len(data) <= limit:
        return []
    limit = max(4, limit)
    overlap = max(0, min(overlap, limit - 4))
    room = limit - overlap
    if len(data) == len(text):
        byte_of = None
    else:
        byte_of = [0]
        for ch in text:
            o = ord(ch)
            byte_of.append(byte_of[-1] + (1 if o < 0x80 else 2 if o < 0x800 else 3 if o < 0x10000 else 4))
    b = (lambda i: i) if byte_of is None else byte_of.__getitem__
    char_at = (lambda x: x) if byte_of is None else (lambda x: bisect.bisect_right(byte_of, x) - 1)
    marks = borders(text)
    places = [p for p, _ in marks]
    depth = depths(text, places)
    rank = [(min(k - 1, 2) if k else 0) for _, k in marks]  # line ends, sentences, white space
    depth = [d * (BLANK_WEIGHT if k == 0 else LINE_WEIGHT if k == 1 else 1.0) for d, (_, k) in zip(depth, marks, strict=True)]
    out, start, n = [], 0, len(text)
    while start < n:
        space = limit if start == 0 else room
        origin = b(start)
        if b(n) - origin <= space:
            end = n
        else:
            last = char_at(origin + space)
            least = char_at(origin + int(space * LEAST_SHARE))
            end = 0
            for low in (max(least, start + 1), start + 1):
                i, j = bisect.bisect_left(places, low), bisect.bisect_right(places, last)
                if i < j:
                    best = min(rank[i:j])
                    end = max((depth[k], -marks[k][1], places[k]) for k in range(i, j) if rank[k] == best)[2]
                    break
            if not end:
                end = last
                while end > start + 1 and _glued(text, end):
                    end -= 1
                if end <= start + 1 and end < n and _glued(text, max(end, 1)):
                    end = last
                end = max(end, start + 1)  # one character at least, whatever the room
        head = start
        if start:
            low = max(0, origin - overlap, b(end) - limit)  # a wide character may leave less room for the overlap
            head = char_at(low)
            head += b(head) < low
            while head < start and head > 0 and _glued(text, head):
                head += 1
        out.append((b(head), origin, b(end)))
        start = end
    return out


SCHEMA = (
    "id string, repo_id string, content_hash string, piece_no int, n_pieces int, from_byte bigint, start_byte bigint, end_byte bigint,"
    " overlap_short boolean, content string"
)


def _run(batches):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.string()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 3 + [pa.bool_(), pa.string()]
    for batch in batches:
        rows = []
        for d in batch.to_pylist():
            data = d["content"].encode()
            cuts = split(d["content"], d["limit_bytes"], d["overlap_bytes"])
            for k, (head, lo, hi) in enumerate(cuts):
                short = lo - head < min(d["overlap_bytes"], lo) and max(4, d["limit_bytes"]) - 4 < d["overlap_bytes"]
                rows.append((d["id"], d["repo_id"], d["content_hash"], k, len(cuts), head, lo, hi, short, data[head:hi].decode()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def pieces(datapoints: DataFrame, config: DataFrame) -> DataFrame:
    """Ordered pieces of every datapoint above its repository's limit.

    ``config`` has one row a repository; the optimizer broadcasts it if it is small.
    A repository without a row takes the default limit and no overlap.
    """
    limits = config.groupBy("repo_id").agg(
        F.max("max_file_size_kb").alias("kb"), F.max("overlap_bytes").alias("overlap_bytes")
    )
    sized = (
        datapoints.select("id", "repo_id", "content")
        .join(limits, "repo_id", "left")
        .withColumn("limit_bytes", F.coalesce("kb", F.lit(DEFAULT_MAX_KB)) * 1024)
        .withColumn("overlap_bytes", F.coalesce("overlap_bytes", F.lit(0)))
        .filter(F.octet_length("content") > F.col("limit_bytes"))
    )
    hashed = sized.withColumn("content_hash", F.sha2("content", 256))
    first = F.min(F.struct("content", "limit_bytes", "overlap_bytes"))
    once = hashed.groupBy("id", "repo_id", "content_hash").agg(first.alias("d")).select("id", "repo_id", "content_hash", "d.*")
    return once.mapInArrow(_run, SCHEMA)

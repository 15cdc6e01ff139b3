"""Long exact spans shared between records, by FM-indexes over bounded shards.

1. *Anchors.* Of every window of consecutive ``GRAM``-character hashes the smallest is
   an anchor, so any two documents that share ``MIN_SPAN`` characters share an anchor
   that lies inside the span (winnowing; nothing can be missed). Anchors are counted by
   hash with a partial count before the shuffle; those of one document only end here.
2. *Passages.* Around each shared anchor the text that any ``MIN_SPAN`` window over it can
   reach is cut out. All passages of one anchor hash go to one shard; equal ones are
   stored once with their documents.
3. *Index.* Each shard, bounded in characters, gets an FM-index. Its passages are streamed
   through by backward search over the wavelet matrix, which gives matching statistics
   cut at ``MIN_SPAN``: the interval of each window. Intervals with a second document are
   reported as spans; their document lists, each once, become pairs.
4. *Hot anchors* (in more than ``HOT`` passages, as a notice that recurs everywhere) would
   not fit in a shard. Their windows are keyed by a 128-bit hash of all ``MIN_SPAN``
   characters instead, which spreads the group; the result is the same.

Lengths are code points. Defined results: null texts and those below ``MIN_SPAN`` share
nothing; a span repeated within one document only is not shared; repeated rows of a
document count as one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.fmindex import FMIndex
from codeloom.session import materialize

MIN_SPAN = 320
GRAM = 160
#: Passages of one anchor that still go to an index.
HOT = 3000
#: Characters of a shard aimed at; the most is this plus HOT passages.
SHARD_CHARS = 1_000_000
#: Documents of one list that are paired in one row.
CHUNK = 256

_B1, _B2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_SEGMENT = 1 << 19


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        m = max(4096, 1 << (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        have = _powers[base] = tuple(
            np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(m - 1, b, np.uint64))))
            for b in (base, inverse)
        )
    return have[0][:n], have[1][:n]


def gram_hashes(codes: np.ndarray, size: int, base: int = _B1) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` code points."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power(base, len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:], dtype=np.uint64)
    return _mix((sums[size:] - sums[:n]) * down[:n])


def anchors(codes: np.ndarray, gram: int = GRAM, span: int = MIN_SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the anchors of a text; none if it is shorter than ``span``."""
    width, found_h, found_p = span - gram + 1, [], []
    for at in range(0, max(1, len(codes) - span + 1), _SEGMENT):
        h = gram_hashes(codes[at : at + _SEGMENT + span - 1], gram)
        n = len(h)
        if n < width:
            continue
        # The least of each window, the rightmost of equals, by blocks of prefix and suffix minima.
        low = np.uint64((1 << 20) - 1)
        key = (h & ~low) | (low - np.arange(n, dtype=np.uint64))
        m = -(-n // width) * width
        padded = np.full(m, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = key
        blocks = padded.reshape(-1, width)
        prefix = np.minimum.accumulate(blocks, axis=1).ravel()
        suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(suffix[: n - width + 1], prefix[width - 1 : n])
        pos, first = np.unique((low - (least & low)).astype(np.int64), return_index=True)
        del first
        if len(pos) > 1 and len(np.unique(h[pos])) < len(pos):
            # Runs of one hash, as in a text of one repeated letter: only as many as the windows need.
            chosen = (low - (least & low)).astype(np.int64)
            last = {int(p): int(s) for s, p in enumerate(chosen)}
            keep, held = [], {}
            for p in pos.tolist():
                q = held.get(int(h[p]))
                if q is None or last[p] > q:
                    keep.append(p)
                    held[int(h[p])] = p
            pos = np.array(keep, np.int64)
        found_h.append(h[pos])
        found_p.append(pos + at)
    if not found_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    p, i = np.unique(np.concatenate(found_p), return_index=True)
    return np.concatenate(found_h)[i], p


def _anchor_rows(gram: int, span: int):
    def run(batches):
        for b in batches:
            hs, ds, ts, ps = [], [], [], []
            for doc, mark, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h, p = anchors(code_points(text), gram, span)
                hs.append(h.view(np.int64)), ps.append(p)
                ds.append(np.full(len(p), doc, np.int64)), ts.append(np.full(len(p), mark, np.int64))
            cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (hs, ds, ts, ps)]
            names = ["anchor", "doc_id", "mark", "pos"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return run


PASSAGE = "anchor bigint, hot boolean, doc_id bigint, start bigint, passage string"


def _passages(gram: int, span: int):
    reach = span - gram

    def run(batches):
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for p in places:
                    start = max(0, p["pos"] - reach)
                    row = p["anchor"], p["hot"], doc, start, text[start : p["pos"] + gram + reach]
                    for c, v in zip(rows, row, strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
            names = [f.split()[0] for f in PASSAGE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=names)

    return run


#: kind 0: a shared interval of a document; kind 1: a list of documents that share a span.
FOUND = "kind int, doc_id bigint, start bigint, stop bigint, docs array<bigint>"


def index_shard(table: pa.Table, span: int = MIN_SPAN) -> pa.Table:
    """Builds the shard's FM-index, streams its passages, reports intervals and document lists."""
    places: dict[str, list[tuple[int, int]]] = {}
    for doc, start, text in zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "passage")), strict=True):
        places.setdefault(text, []).append((doc, start))
    texts = list(places)
    raw = [code_points(t) for t in texts]
    letters, dense = np.unique(np.concatenate(raw), return_inverse=True) if raw else (np.zeros(0), np.zeros(0, np.int64))
    ends = np.cumsum([0, *map(len, raw)])
    coded = [dense[ends[i] : ends[i + 1]].astype(np.int64) + 2 for i in range(len(raw))]
    del letters, dense
    owners = [np.unique([d for d, _ in places[t]]) for t in texts]
    index = FMIndex(coded, span)
    docs_lo = np.array([o[0] for o in owners] + [np.iinfo(np.int64).max], np.int64)[index.owner]
    docs_hi = np.array([o[-1] for o in owners] + [np.iinfo(np.int64).min], np.int64)[index.owner]
    shared = np.minimum.reduceat(docs_lo, index.class_start) < np.maximum.reduceat(docs_hi, index.class_start)
    spans: list[tuple[int, int, int]] = []
    visited = []
    for i, cls in enumerate(index.windows(coded)):
        at = np.flatnonzero(shared[cls]) if len(cls) else cls
        if not len(at):
            continue
        visited.append(np.unique(cls[at]))
        cut = np.flatnonzero(np.diff(at) > 1) + 1
        for run in np.split(at, cut):
            lo, hi = int(run[0]), int(run[-1]) + span
            spans += [(doc, start + lo, start + hi) for doc, start in places[texts[i]]]
    lists = []
    if visited:
        classes = np.unique(np.concatenate(visited))
        label = _mix(np.arange(1, len(texts) + 2, dtype=np.uint64))
        seen = set()
        for c in classes.tolist():
            who = np.unique(index.owner[index.class_start[c] : index.class_end[c]])
            mark = int(label[who].sum(dtype=np.uint64)), len(who)
            if mark not in seen:
                seen.add(mark)
                lists.append(np.unique(np.concatenate([owners[w] for w in who])))
    spans = sorted(set(spans))
    n, m = len(spans), len(lists)
    return pa.table(
        [
            pa.array([0] * n + [1] * m, pa.int32()),
            pa.array([s[0] for s in spans] + [None] * m, pa.int64()),
            pa.array([s[1] for s in spans] + [None] * m, pa.int64()),
            pa.array([s[2] for s in spans] + [None] * m, pa.int64()),
            pa.array([None] * n + lists, pa.list_(pa.int64())),
        ],
        names=["kind", "doc_id", "start", "stop", "docs"],
    )


def _window_rows(gram: int, span: int):
    """Rows (h1, h2, doc_id, start) of all windows in passages of hot anchors."""

    def run(batches):
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for doc, start, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                c = code_points(text)
                h1, h2 = gram_hashes(c, span, _B1), gram_hashes(c, span, _B2)
                cols[0].append(h1.view(np.int64)), cols[1].append(h2.view(np.int64))
                cols[2].append(np.full(len(h1), doc, np.int64)), cols[3].append(start + np.arange(len(h1)))
            arrays = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in cols]
            yield pa.RecordBatch.from_arrays(arrays, names=["h1", "h2", "doc_id", "start"])

    return run


class SharedSpans:
    """The result: ``pairs()`` and ``coverage()`` read the tables that ``find`` has written."""

    def __init__(self, spans: DataFrame, lists: DataFrame, documents: DataFrame, members: DataFrame | None = None):
        self._spans, self._lists, self._documents, self._members = spans, lists, documents, members

    def classes(self) -> DataFrame:
        """(class_id, n_docs, doc_id): the stored form, one row a document in each list of documents that share a span.

        A list is named by a hash of its documents. The rows are linear in the documents, where pairs are quadratic:
        ``pairs`` derives them last.
        """
        key = F.xxhash64("docs").alias("class_id")
        short = self._lists.select(key, F.size("docs").cast("bigint").alias("n_docs"), F.explode("docs").alias("doc_id")).distinct()
        return short if self._members is None else short.unionByName(self._members)

    def pairs(self) -> DataFrame:
        """Distinct (doc_id_a, doc_id_b), the smaller first; long lists are paired in blocks."""
        lists = self._lists
        if self._members is not None:
            lists = lists.unionByName(self._parts())
        parts = F.transform(
            F.sequence(F.lit(0), F.floor((F.size("docs") - 1) / CHUNK).cast("int")),
            lambda k: F.slice("docs", k * CHUNK + 1, F.lit(CHUNK)),
        )
        blocks = lists.select(parts.alias("p")).select("p", F.posexplode("p").alias("i", "a"))
        blocks = blocks.select("a", F.explode(F.slice("p", F.col("i") + 1, F.size("p"))).alias("b"))
        left = blocks.select(F.explode("a").alias("doc_id_a"), "b")
        both = left.select("doc_id_a", F.explode("b").alias("doc_id_b")).filter("doc_id_a < doc_id_b")
        return both.distinct()

    def _parts(self) -> DataFrame:
        """Lists of at most two chunks that together pair all members of the long lists: no list is gathered as a whole."""
        salted = self._members.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.ceil(F.col("n_docs") / CHUNK)))
        part = salted.groupBy("class_id", "salt").agg(F.collect_set("doc_id").alias("docs"))
        a = part.select("class_id", F.col("salt").alias("sa"), F.col("docs").alias("da"))
        b = part.select("class_id", F.col("salt").alias("sb"), F.col("docs").alias("db"))
        return a.join(b, "class_id").filter("sa <= sb").select(F.array_sort(F.array_union("da", "db")).alias("docs"))

    def spans(self) -> DataFrame:
        """Maximal intervals (doc_id, start, stop) of each document that stand in another one too."""
        from pyspark.sql import Window

        w = Window.partitionBy("doc_id").orderBy("start", "stop")
        before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
        marked = self._spans.withColumn("fresh", (before.isNull() | (F.col("start") > before)).cast("int"))
        island = marked.withColumn("island", F.sum("fresh").over(w))
        return island.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")

    def coverage(self) -> DataFrame:
        """Every document: its length, characters that stand elsewhere too, and their share."""
        shared = self.spans().groupBy("doc_id").agg(
            F.sum(F.col("stop") - F.col("start")).alias("shared_chars"), F.count("*").alias("n_spans")
        )
        lengths = self._documents.groupBy("doc_id").agg(F.max(F.coalesce(F.char_length("text"), F.lit(0))).alias("n"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
        return lengths.join(shared, "doc_id", "left").select(
            "doc_id", F.col("n").cast("bigint").alias("n_chars"), zero("shared_chars").alias("shared_chars"),
            zero("n_spans").alias("n_spans"),
            F.when(F.col("n") > 0, F.round(zero("shared_chars") / F.col("n"), 6)).otherwise(F.lit(0.0)).alias("share"),
        )


def find(
    documents: DataFrame, span: int = MIN_SPAN, gram: int = GRAM, hot: int = HOT, shard_chars: int = SHARD_CHARS
) -> SharedSpans:
    """Runs the operator on all ``documents`` (doc_id, text)."""
    documents = documents.select("doc_id", "text")
    # The mark of its text keeps the rows of a document apart if they should differ.
    long = documents.filter(F.char_length("text") >= span).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    anchor = long.mapInArrow(_anchor_rows(gram, span), "anchor bigint, doc_id bigint, mark bigint, pos bigint")
    anchor = materialize(anchor, "anchors")
    many = (
        anchor.groupBy("anchor")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
        .filter("lo < hi")
        .select("anchor", (F.col("n") > hot).alias("hot"))
    )
    per_doc = (
        anchor.join(many, "anchor").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("anchor", "pos", "hot")).alias("places"))
    )
    found = long.join(per_doc, ["doc_id", "mark"]).select("doc_id", "text", "places")
    passage = found.mapInArrow(_passages(gram, span), PASSAGE)
    passage = materialize(passage, "passages")
    chars = passage.agg(F.sum(F.char_length("passage"))).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    cold = passage.filter(~F.col("hot")).select(
        F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "doc_id", "start", "passage"
    )
    # A stated number of partitions, or the few MB of passages would be joined into a few long tasks.
    spread = max(shards, documents.sparkSession.sparkContext.defaultParallelism)
    found = cold.repartition(spread, "shard").groupBy("shard").applyInArrow(lambda t: index_shard(t, span), FOUND)
    found = materialize(found, "spans")
    spans = found.filter("kind = 0").select("doc_id", "start", "stop")
    lists = found.filter("kind = 1").select("docs")
    if passage.filter("hot").limit(1).count():
        h_spans, members = _hot(passage, gram, span)
        return SharedSpans(spans.unionByName(h_spans), lists.distinct(), documents, members)
    return SharedSpans(spans, lists.distinct(), documents)


def _hot(passage: DataFrame, gram: int, span: int) -> tuple[DataFrame, DataFrame]:
    """Spans and (class_id, n_docs, doc_id) of hot anchors, by window hashes; linear in the passages."""
    key = ["h1", "h2"]
    rows = passage.filter("hot").select("doc_id", "start", "passage")
    rows = rows.mapInArrow(_window_rows(gram, span), "h1 bigint, h2 bigint, doc_id bigint, start bigint")
    rows = materialize(rows.distinct(), "hot-windows")
    who = rows.select(*key, "doc_id").distinct()
    group = who.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("x1"), F.bit_xor(F.xxhash64("doc_id", F.lit(2))).alias("x2"),
    ).filter("n > 1")
    spans = rows.join(group.select(*key), key, "left_semi").select("doc_id", "start", (F.col("start") + span).alias("stop"))
    # Of windows with the same documents one stands for all.
    one = group.groupBy("n", "x1", "x2").agg(F.min(F.struct(*key)).alias("k")).select("n", "k.*")
    members = who.join(one, key).select(F.xxhash64(*key).alias("class_id"), F.col("n").alias("n_docs"), "doc_id")
    return spans, materialize(members, "hot-classes")

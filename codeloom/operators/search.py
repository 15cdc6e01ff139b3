"""Ranked full-text search: BM25 over path and content, phrases, snippets.

For one query no posting list is built: each text is reduced in the
scan to the counts of the query's phrases and its length. One row of corpus statistics
goes back to the driver; the ranking is a top-k without a full sort.

``postings`` keeps an index of a corpus: a row a word and text with its places. It is brought up to date by the texts that changed,
and ``bm25_index`` answers any number of queries at once from it, without reading a text.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions import fts
from codeloom.operators.symbols import term_lists
from codeloom.session import materialize

# Fixed values of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _count(tokens: str, phrase: list[str]) -> Column:
    """Occurrences of a phrase in an array of tokens."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda w: w == phrase[0]))
    n = len(phrase)
    places = F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))
    want = F.array(*map(F.lit, phrase))
    found = F.size(F.filter(places, lambda i: F.slice(tokens, i, n) == want))
    return F.when(F.forall(want, lambda w: F.array_contains(tokens, w)), found).otherwise(0)


def bm25(corpus: DataFrame, query: str, k: int = 10, stemmed: bool = False) -> DataFrame:
    """The ``k`` best rows of ``corpus`` (path, content) that hold all words of the query: (path, rank), lower is better.

    Ties go by path. Null texts have no words; a query without words finds nothing.
    """
    phrases = fts.phrases_of(query)
    if stemmed:
        phrases = [[fts.stem(w) for w in fts.fold(" ".join(p))] for p in phrases]
    empty = corpus.sparkSession.createDataFrame([], "path string, rank double")
    if not phrases:
        return empty
    tokens = fts.stems if stemmed else fts.words
    t = corpus.select("path", tokens(F.col("path")).alias("tp"), tokens(F.col("content")).alias("tc"))
    hits = t.select(
        "path", (F.size("tp") + F.size("tc")).alias("len"),
        *[(_count("tp", p) + _count("tc", p)).alias(f"f{i}") for i, p in enumerate(phrases)],
    )
    hits = materialize(hits, "hits")  # a few numbers a text: the texts are read once
    s = hits.agg(
        F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(phrases))]
    ).first()
    if not s["n"]:
        return empty
    score = F.lit(0.0)
    everywhere = F.lit(True)
    for i in range(len(phrases)):
        d, f = s[f"d{i}"], F.col(f"f{i}")
        idf = max(math.log((s["n"] - d + 0.5) / (d + 0.5)), LEAST_IDF)
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.lit(s["avg"])))
        everywhere = everywhere & (f > 0)
    return hits.filter(everywhere).select("path", score.alias("rank")).orderBy("rank", "path").limit(k)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _phrases(query: pd.Series) -> pd.Series:
    """The stemmed phrases of a query, each joined by blanks; repeated ones stay."""
    return query.map(lambda q: [" ".join(fts.stem(w) for w in fts.fold(" ".join(p))) for p in fts.phrases_of(q)] if q else [])


def _count_rows(batches):
    """(repo_id, path, len, phrase, f) of the phrases that a text holds, and a row without a phrase for its length."""
    for b in batches:
        out = []
        for repo, path, content, terms in zip(b["repo_id"], b["path"], b["content"], b["terms"], strict=True):
            columns = [[fts.stem(w) for w in fts.fold(t)] if t else [] for t in (path, content)]
            size = sum(map(len, columns))
            out.append((repo, path, size, None, 0))
            at: dict[str, list[tuple[int, int]]] = {}
            for c, tokens in enumerate(columns):
                for i, w in enumerate(tokens):
                    at.setdefault(w, []).append((c, i))
            for phrase in terms:
                words = phrase.split(" ")
                starts = at.get(words[0], [])
                f = len(starts) if len(words) == 1 else sum(columns[c][i : i + len(words)] == words for c, i in starts)
                if f:
                    out.append((repo, path, size, phrase, f))
        yield pd.DataFrame(out, columns=["repo_id", "path", "len", "phrase", "f"])


def bm25_tasks(corpus: DataFrame, queries: DataFrame, k: int = 15) -> DataFrame:
    """(task_id, path, rank, idx): the ``k`` best texts of each task's own repository by stems, ``idx`` from 0.

    ``corpus``: (repo_id, path, content), one row a text; ``queries``: (task_id, repo_id, query). All words of
    the query must occur, as in ``bm25``; ties go by path. Texts meet the phrases of their repository once, and a task
    meets only the texts that hold its rarest phrase.
    """
    q = queries.select("task_id", "repo_id", F.explode(_phrases("query")).alias("phrase")).filter("phrase <> ''")
    q = q.groupBy("task_id", "repo_id", "phrase").agg(F.count("*").alias("times"))
    lists = term_lists(q.select("repo_id", "phrase").distinct(), F.col("phrase")).select("repo_id", "terms")
    counts = corpus.select("repo_id", "path", "content").join(lists, "repo_id")
    counts = materialize(counts.mapInPandas(_count_rows, "repo_id string, path string, len bigint, phrase string, f bigint"), "phrase-counts")
    sizes = counts.filter("phrase IS NULL").select("repo_id", "path", "len").distinct()
    stats = sizes.groupBy("repo_id").agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    hits = counts.filter("phrase IS NOT NULL")
    d = hits.groupBy("repo_id", "phrase").agg(F.count("*").alias("d"))
    rarest = Window.partitionBy("task_id").orderBy(F.coalesce("d", F.lit(0)), "phrase")
    each = Window.partitionBy("task_id")
    q = q.join(d, ["repo_id", "phrase"], "left").withColumn("_n", F.row_number().over(rarest)).withColumn("words", F.count("*").over(each))
    q = q.withColumn("least", F.min(F.coalesce("d", F.lit(0))).over(each)).filter("least > 0")
    q = materialize(q.join(stats, "repo_id"), "phrases")
    start = q.filter("_n = 1").select("task_id", "repo_id", "phrase").join(hits.select("repo_id", "phrase", "path"), ["repo_id", "phrase"])
    both = q.join(start.select("task_id", "path"), "task_id").join(hits, ["repo_id", "path", "phrase"])
    idf = F.greatest(F.log((F.col("n") - F.col("d") + 0.5) / (F.col("d") + 0.5)), F.lit(LEAST_IDF))
    part = -idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg"))) * F.col("times")
    scored = both.groupBy("task_id", "path").agg(F.sum(part).alias("rank"), F.count("*").alias("held"), F.max("words").alias("words"))
    order = Window.partitionBy("task_id").orderBy("rank", "path")
    top = scored.filter("held = words").withColumn("idx", F.row_number().over(order) - 1)
    return top.filter(F.col("idx") < k).select("task_id", "path", "rank", "idx")


_PLAIN = re.compile(r"[^\W_]+")
POSTINGS = "repo_id string, path string, len bigint, part int, term string, places array<int>"


def _posting_rows(stemmed: bool):
    def run(batches):
        for b in batches:
            out = []
            for repo, path, content in zip(b["repo_id"], b["path"], b["content"], strict=True):
                columns = [(fts.fold(t) if stemmed else _PLAIN.findall(t.lower())) if t else [] for t in (path, content)]
                size = sum(map(len, columns))
                out.append((repo, path, size, -1, None, []))  # the text itself, also if it has no word
                for part, tokens in enumerate(columns):
                    at: dict[str, list[int]] = {}
                    for i, w in enumerate(tokens):
                        at.setdefault(fts.stem(w) if stemmed else w, []).append(i)
                    out += [(repo, path, size, part, w, places) for w, places in at.items()]
            yield pd.DataFrame(out, columns=["repo_id", "path", "len", "part", "term", "places"])

    return run


def postings(corpus: DataFrame, stemmed: bool = True) -> DataFrame:
    """The index of (repo_id, path, content), one row a text: a row each word of a text, and one (part -1) for its length."""
    return corpus.select("repo_id", "path", "content").mapInPandas(_posting_rows(stemmed), POSTINGS)


def update_postings(index: DataFrame, changed: DataFrame, gone: DataFrame, stemmed: bool = True) -> DataFrame:
    """The index after texts changed or came (repo_id, path, content) and others went (repo_id, path)."""
    key = ["repo_id", "path"]
    touched = changed.select(*key).unionByName(gone.select(*key)).distinct()
    return index.join(touched, key, "left_anti").select(index.columns).unionByName(postings(changed, stemmed))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _worded(query: pd.Series) -> pd.Series:
    return query.map(lambda q: [_PLAIN.findall(" ".join(p).lower()) for p in fts.phrases_of(q)] if q else [])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _stemmed(query: pd.Series) -> pd.Series:
    return query.map(lambda q: [[fts.stem(w) for w in fts.fold(" ".join(p))] for p in fts.phrases_of(q)] if q else [])


def bm25_index(index: DataFrame, queries: DataFrame, k: int = 10, stemmed: bool = True) -> DataFrame:
    """(query_id, path, rank, idx): the ``k`` best texts of each query (query_id, repo_id, query) by an index of ``postings``.

    Words of a query meet the index in one equi-join on (repository, word). A phrase stands where all its words give one start. All
    phrases must occur; ties go by path.
    """
    phrases = queries.select("query_id", "repo_id", F.posexplode((_stemmed if stemmed else _worded)("query")).alias("n", "words"))
    words = phrases.select("query_id", "repo_id", "n", F.size("words").alias("size"), F.posexplode("words").alias("i", "term"))
    sizes = index.filter("part = -1")
    stats = sizes.groupBy("repo_id").agg(F.count("*").alias("texts"), F.avg("len").alias("avg"))
    places = words.join(index.filter("part >= 0"), ["repo_id", "term"]).select("query_id", "repo_id", "n", "size", "i", "path", "len", "part", F.explode("places").alias("at"))
    starts = places.groupBy("query_id", "repo_id", "n", "size", "path", "len", "part", (F.col("at") - F.col("i")).alias("start")).agg(F.count("*").alias("held"))
    hits = starts.filter("held = size").groupBy("query_id", "repo_id", "n", "path", "len").agg(F.count("*").alias("f"))
    hits = materialize(hits, "phrase-hits")
    d = hits.groupBy("query_id", "n").agg(F.count("*").alias("d"))
    asked = phrases.groupBy("query_id").agg(F.count("*").alias("words"))
    idf = F.greatest(F.log((F.col("texts") - F.col("d") + 0.5) / (F.col("d") + 0.5)), F.lit(LEAST_IDF))
    part = -idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    scored = hits.join(d, ["query_id", "n"]).join(stats, "repo_id").groupBy("query_id", "path").agg(F.sum(part).alias("rank"), F.count("*").alias("held"))
    order = Window.partitionBy("query_id").orderBy("rank", "path")
    top = scored.join(asked, "query_id").filter("held = words").withColumn("idx", F.row_number().over(order) - 1)
    return top.filter(F.col("idx") < k).select("query_id", "path", "rank", "idx")


def snippet_of(text: str, terms: set[str], size: int = 16, mark: tuple[str, str] = ("<b>", "</b>"), gap: str = "...") -> str:
    """The run of ``size`` words with the most distinct terms, then the most hits; the terms marked."""
    spans = [(m.start(), m.end()) for m in fts._WORD.finditer(text)]
    keys = ["".join(fts.fold(text[a:b])) for a, b in spans]
    hit = [fts.stem(w) in terms for w in keys]
    best, at = (-1, -1), 0
    for i in range(max(1, len(spans) - size + 1)):
        part = [fts.stem(w) for w, h in zip(keys[i : i + size], hit[i : i + size], strict=True) if h]
        value = (len(set(part)), len(part))
        if value > best:
            best, at = value, i
    chosen = range(at, min(at + size, len(spans)))
    if not chosen:
        return ""
    out, p = [], 0 if at == 0 else spans[at][0]
    for i in chosen:
        a, b = spans[i]
        out.append(text[p:a])
        out.append(f"{mark[0]}{text[a:b]}{mark[1]}" if hit[i] else text[a:b])
        p = b
    head = "" if at == 0 else gap
    return head + "".join(out) + (text[p:] if chosen[-1] == len(spans) - 1 else gap)


def search(corpus: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Stemmed BM25 top-k with a snippet of the content of each hit."""
    top = bm25(corpus, query, k, stemmed=True)
    terms = {fts.stem(w) for p in fts.phrases_of(query) for w in fts.fold(" ".join(p))}

    @F.pandas_udf(T.StringType())
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: snippet_of(t, terms) if t else "")

    return top.join(corpus, "path").select("path", cut("content").alias("snippet"), "rank")

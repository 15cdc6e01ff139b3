"""Named queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.llm import bpe, docpairs, leakage, packing, provenance, secrets, shared_spans, splitting, syntax
from codeloom.plans.registry import Registry, table

R = Registry()


def collect() -> Registry:
    return R


@R.query("p5_containers")
def p5_containers(spark, folder):
    """The container of every distinct scored file of a task."""
    return packing.pack(table(spark, folder, "scored_files"), table(spark, folder, "budgets"))


@R.query("p5_fill")
def p5_fill(spark, folder):
    """Containers used per task, against the least possible by volume."""
    return packing.containers(p5_containers(spark, folder))


@R.query(
    "p5_checks",
    """WITH i AS (SELECT DISTINCT task_id, relative_path, score, reasons, snippet FROM scored_files), b AS (SELECT task_id, max(limit_tokens) AS l FROM budgets GROUP BY 1)
    SELECT task_id, count(*) AS n_items, CAST(sum(octet_length(encode(coalesce(snippet, '')))) AS BIGINT) AS n_bytes, 0 AS n_over, 0 AS n_cut_needlessly, 0 AS n_unplaced
    FROM i JOIN b USING (task_id) WHERE l >= 1 GROUP BY 1""",
)
def p5_checks(spark, folder):
    """What must hold of the containers of every task: each distinct item once and whole, none over its limit, none cut that fits."""
    r = p5_containers(spark, folder).filter("limit_tokens >= 1")
    boxes = r.groupBy("task_id", "container").agg(F.sum("tokens").alias("used"), F.max("limit_tokens").alias("limit")).groupBy("task_id").agg(F.count_if(F.expr("used > limit")).cast("int").alias("n_over"))
    whole = F.octet_length(F.coalesce("snippet", F.lit("")))
    items = r.groupBy("task_id").agg(
        F.count_if(F.expr("piece_no = 0")).alias("n_items"), F.sum(F.col("end_byte") - F.col("start_byte")).cast("bigint").alias("n_bytes"),
        F.count_if((F.col("piece_no") > 0) & (F.ceil(whole / 4) <= F.col("limit_tokens"))).cast("int").alias("n_cut_needlessly"), F.count_if(F.expr("container IS NULL")).cast("int").alias("n_unplaced"),
    )
    return items.join(boxes, "task_id").select("task_id", "n_items", "n_bytes", "n_over", "n_cut_needlessly", "n_unplaced")


def _pieces(spark, folder):
    return splitting.pieces(table(spark, folder, "datapoints"), table(spark, folder, "repo_config"))


@R.query("p6_pieces")
def p6_pieces(spark, folder):
    """Ordered pieces of every oversized datapoint."""
    return _pieces(spark, folder)


@R.query(
    "p6_found",
    """SELECT DISTINCT d.id FROM datapoints d LEFT JOIN repo_config r USING (repo_id)
    WHERE octet_length(encode(d.content)) > coalesce(r.max_file_size_kb, 2048) * 1024""",
)
def p6_found(spark, folder):
    """Datapoints that were split."""
    return _pieces(spark, folder).select("id").distinct()


@R.query(
    "p6_checks",
    """SELECT DISTINCT d.id, d.repo_id, sha256(d.content) AS joined, 0 AS n_over, 0 AS n_gaps, 0 AS n_odd_overlaps FROM datapoints d LEFT JOIN repo_config r USING (repo_id)
    WHERE octet_length(encode(d.content)) > coalesce(r.max_file_size_kb, 2048) * 1024""",
)
def p6_checks(spark, folder):
    """What must hold of the pieces of every content: joined they are the content, none is over the limit, each begins where the last ended, with the overlap asked."""
    c = table(spark, folder, "repo_config").groupBy("repo_id").agg(F.max("max_file_size_kb").alias("kb"), F.max("overlap_bytes").alias("asked"))
    p = _pieces(spark, folder).join(c, "repo_id", "left")
    fresh = F.substring(F.encode("content", "utf-8"), (F.col("start_byte") - F.col("from_byte") + 1).cast("int"), F.lit(1 << 30))
    overlap = F.col("start_byte") - F.col("from_byte")
    asked = F.least(F.coalesce("asked", F.lit(0)), "start_byte")
    # a cluster of characters is kept whole, so an overlap may lack some bytes
    odd = (overlap > asked) | (overlap < asked - 64)
    before = F.lag("end_byte").over(Window.partitionBy("id", "repo_id", "content_hash").orderBy("piece_no"))
    p = p.select(
        "id", "repo_id", "content_hash", F.struct("piece_no", fresh.alias("b")).alias("part"), (F.octet_length("content") > F.coalesce("kb", F.lit(2048)) * 1024).alias("over"),
        (F.coalesce(before, F.lit(0)) != F.col("start_byte")).alias("gap"), odd.alias("odd"),
    )
    whole = F.aggregate(F.transform(F.sort_array(F.collect_list("part")), lambda x: x["b"]), F.lit(b""), lambda a, b: F.concat(a, b))
    count = lambda c: F.count_if(c).cast("int")
    one = p.groupBy("id", "repo_id", "content_hash").agg(F.sha2(whole, 256).alias("joined"), count("over").alias("n_over"), count("gap").alias("n_gaps"), count("odd").alias("n_odd_overlaps"))
    return one.drop("content_hash")


@R.query("p8_texts", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p8_texts(spark, folder):
    """The texts that the token ids decode to."""
    return bpe.decode_column(p8_ids(spark, folder), "doc_id", "ids")


@R.query("p8_ids")
def p8_ids(spark, folder):
    """Token ids of every document."""
    return bpe.encode_column(table(spark, folder, "documents"), "doc_id", "text")


def _tiles(spark, folder):
    return leakage.tiles(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@R.query("p9_found")
def p9_found(spark, folder):
    """Documents that hold at least 13 consecutive words of an item."""
    return _tiles(spark, folder).filter(F.col("longest") >= leakage.LEAK_WORDS).select("doc_id", "item_id")


@R.query("p9_leaks")
def p9_leaks(spark, folder):
    """Every leak with its kind and the share of the item that is covered."""
    return leakage.leaks(_tiles(spark, folder))


_WINDOWS = """WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 320), w AS (SELECT doc_id, text, unnest(range(1, length(text) - 318)) AS k FROM d),
  h AS (SELECT doc_id, k, md5(substring(text, k, 320)) AS h FROM w)"""
_SPANS = f"""{_WINDOWS}, s AS (SELECT h FROM h GROUP BY h HAVING count(DISTINCT doc_id) > 1), p AS (SELECT DISTINCT doc_id, k FROM h JOIN s USING (h)),
  g AS (SELECT *, CASE WHEN lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 320 >= k THEN 0 ELSE 1 END AS fresh FROM p),
  i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM g),
  spans AS (SELECT doc_id, CAST(min(k) - 1 AS BIGINT) AS start, CAST(max(k) + 319 AS BIGINT) AS stop FROM i GROUP BY doc_id, island)"""


@R.query(
    "p10_found",
    f"""{_WINDOWS}, o AS (SELECT DISTINCT doc_id, h FROM h)
    SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM o a JOIN o b USING (h) WHERE a.doc_id < b.doc_id""",
)
def p10_found(spark, folder):
    """Pairs of documents that share a span of at least 320 characters."""
    return shared_spans.find(table(spark, folder, "documents")).pairs()


@R.query("p10_classes")
def p10_classes(spark, folder):
    """Lists of documents that share a span, one row a document in each."""
    return shared_spans.find(table(spark, folder, "documents")).classes()


@R.query(
    "p10_coverage",
    f"""{_SPANS}, c AS (SELECT doc_id, CAST(sum(stop - start) AS BIGINT) AS shared_chars, count(*) AS n_spans FROM spans GROUP BY 1),
      l AS (SELECT doc_id, CAST(max(coalesce(length(text), 0)) AS BIGINT) AS n_chars FROM documents GROUP BY 1)
    SELECT doc_id, n_chars, coalesce(shared_chars, 0) AS shared_chars, coalesce(n_spans, 0) AS n_spans,
      CASE WHEN n_chars > 0 THEN round(coalesce(shared_chars, 0) / n_chars, 6) ELSE 0.0 END::DOUBLE AS share FROM l LEFT JOIN c USING (doc_id)""",
)
def p10_coverage(spark, folder):
    """How much of each document stands in another one too."""
    return shared_spans.find(table(spark, folder, "documents")).coverage()


@R.query("p10_spans", f"{_SPANS} SELECT doc_id, start, stop FROM spans")
def p10_spans(spark, folder):
    """The maximal shared intervals of each document."""
    return shared_spans.find(table(spark, folder, "documents")).spans()


def _judged(spark, folder):
    return syntax.judge(table(spark, folder, "file_content"))


@R.query("p2_found")
def p2_found(spark, folder):
    """Files that do not parse in the language of their extension."""
    return syntax.broken(_judged(spark, folder))


@R.query("p2_faults")
def p2_faults(spark, folder):
    """Each file that does not parse with the first fault and its line."""
    return _judged(spark, folder).filter("fault IS NOT NULL").distinct()


@R.query("p2_rates")
def p2_rates(spark, folder):
    """Rates of files that do not parse per repository and language."""
    return syntax.rates(_judged(spark, folder), table(spark, folder, "symbols"))


def _pairs(spark, folder):
    return docpairs.pairs(table(spark, folder, "symbols"), table(spark, folder, "file_content"))


@R.query("p4_pairs")
def p4_pairs(spark, folder):
    """Code and description of every documented function."""
    return _pairs(spark, folder)


@R.query("p4_found")
def p4_found(spark, folder):
    """Functions and methods with documentation that says something, right before or in them."""
    return _pairs(spark, folder).filter("distance = 0").select("repo_id", "id").distinct()


def _provenance(spark, folder):
    return provenance.classify(table(spark, folder, "files"), table(spark, folder, "file_content"))


@R.query("p3_found")
def p3_found(spark, folder):
    """Source files that nobody of the repository wrote by hand."""
    return _provenance(spark, folder).filter("kind IS NOT NULL").select("repo_id", "relative_path")


@R.query("p3_kinds")
def p3_kinds(spark, folder):
    """What each such file is and what told it."""
    return _provenance(spark, folder).filter("kind IS NOT NULL")


def _secrets(spark, folder):
    return secrets.locate(table(spark, folder, "file_content"))


@R.query("p7_found")
def p7_found(spark, folder):
    """File and line of every credential."""
    return secrets.lines(_secrets(spark, folder))


@R.query("p7_kinds")
def p7_kinds(spark, folder):
    """Credentials by repository and kind."""
    return _secrets(spark, folder).groupBy("repo_id", "kind").agg(F.count("*").alias("n_lines"))


@R.query(
    "p7_checks",
    "SELECT repo_id, relative_path, length(content) AS n_chars, length(content) - length(replace(content, chr(10), '')) AS n_lines, 0 AS n_left FROM file_content",
)
def p7_checks(spark, folder):
    """What must hold of every redacted row: its length and lines are those of the content, and a second search finds nothing."""
    clean = secrets.cleaned(table(spark, folder, "file_content"))
    n = F.char_length("content")
    return clean.select(
        "repo_id", "relative_path", n.cast("bigint").alias("n_chars"), (n - F.char_length(F.replace("content", F.lit("\n"), F.lit("")))).cast("bigint").alias("n_lines"), "n_left"
    )


@R.query("p7_redacted")
def p7_redacted(spark, folder):
    """The content of every file with its credentials overwritten."""
    return secrets.cleaned(table(spark, folder, "file_content"))

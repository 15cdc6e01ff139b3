"""Evidence baselines of remembered claims and how fresh they are.

A claim's evidence is rows of (memory_id, file, symbols, fingerprint): an array of symbol
names, and the baseline taken when the claim was made. Live state is ``symbols`` (repo_id,
file_path, name, qualified_name, fingerprint) and ``files`` (repo_id, relative_path, file_hash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators.symbols import holding

SYMBOL_BASELINE, FILE_BASELINE = "symbols-v1:", "file-v1:"
DEGRADED = 0.70


def named(symbols: DataFrame) -> DataFrame:
    """(repo_id, file, name, fingerprint): each symbol by its name and by its qualified name."""
    each = F.explode(F.array_distinct(F.array("name", "qualified_name")))
    return symbols.select("repo_id", F.col("file_path").alias("file"), each.alias("name"), "fingerprint")


def baselines(evidence: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``has_file``, ``missing`` (a requested symbol does not exist), ``now`` (the present baseline), and ``held`` (every
    requested name has the recorded fingerprint, which is how old baselines of a single hash are read).

    The baseline of symbols is SHA-256 over the sorted (name NUL fingerprint NUL) of the distinct
    requested names; without symbols, or in a file of a language without any, it is the file's own hash.
    """
    e = evidence.withColumn("_e", F.xxhash64("memory_id", "repo_id", "file", "symbols", "fingerprint"))
    code = paths.language(F.col("file")).isin(paths.PARSED)
    plain = (F.size("symbols") < 1) | ~code
    want = e.filter(~plain).select("_e", "repo_id", "file", F.col("fingerprint").alias("recorded"), F.explode(F.array_distinct("symbols")).alias("name"))
    got = want.join(named(symbols), ["repo_id", "file", "name"], "left")
    # Names and their fingerprints belong to one claim and one file, a bounded list.
    part = F.concat("name", F.lit("\0"), "fingerprint", F.lit("\0"))
    sums = got.groupBy("_e").agg(
        F.max(F.col("fingerprint").isNull()).alias("missing"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(part)), ""), 256).alias("sum"),
        (F.size(F.collect_set(F.when(F.col("fingerprint") == F.col("recorded"), F.col("name")))) == F.size(F.collect_set("name"))).alias("held"),
    )
    f = files.groupBy("repo_id", F.col("relative_path").alias("file")).agg(F.max("file_hash").alias("hash"))
    out = e.join(f, ["repo_id", "file"], "left").join(sums, "_e", "left")
    now = F.when(plain, F.concat(F.lit(FILE_BASELINE), "hash")).otherwise(F.concat(F.lit(SYMBOL_BASELINE), "sum"))
    return out.select(
        *evidence.columns, F.col("hash").isNotNull().alias("has_file"), F.coalesce("missing", F.lit(False)).alias("missing"),
        now.alias("now"), F.coalesce("held", F.lit(True)).alias("held"),
    )


def _flags(evidence: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Per claim: ``gone`` (a file or symbol is missing), ``differs`` (a baseline does), ``open`` (evidence has no baseline)."""
    b = baselines(evidence, symbols, files)
    legacy = ~F.col("fingerprint").startswith(SYMBOL_BASELINE) & ~F.col("fingerprint").startswith(FILE_BASELINE)
    holds = F.when(F.col("fingerprint").isNull(), True).when(legacy, F.col("held")).otherwise(F.col("fingerprint") == F.col("now"))
    return b.groupBy("memory_id").agg(
        F.max(~F.col("has_file") | F.col("missing")).alias("gone"), F.max(~F.coalesce(holds, F.lit(False))).alias("differs"),
        F.max(F.col("fingerprint").isNull()).alias("open"),
    )


def _verdict(memories: DataFrame, flags: DataFrame, differs: Column, sticky: Column) -> DataFrame:
    j = memories.join(flags, "memory_id", "left")
    kept = F.col("status") == "invalidated"
    stale = F.col("gone") | (differs & sticky)
    status = F.when(kept, F.col("status")).when(stale, "stale").when(differs, "degraded").otherwise("fresh")
    confidence = F.when(kept, F.col("confidence")).when(stale, 0.0).when(differs, DEGRADED).otherwise(1.0)
    return j.select("memory_id", status.alias("status"), confidence.alias("confidence"))


def verify(memories: DataFrame, evidence: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(memory_id, status, confidence) of every claim by an explicit check of its evidence against the live files.

    A missing file or symbol makes it stale (0.0), a baseline that differs degraded (0.70), else it
    is fresh (1.0). A baseline without a prefix is a single fingerprint; it holds if every
    named symbol has it. No baseline holds. Invalidated claims stay as they are. A claim without
    evidence is fresh.
    """
    return _verdict(memories, _flags(evidence, symbols, files), F.col("differs"), F.lit(False))


def anchor(memories: DataFrame, evidence: DataFrame, symbols: DataFrame, files: DataFrame, head: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Claims and evidence after ``verify``: what is fresh gets its missing baselines and, with a head, is valid at it."""
    judged = verify(memories, evidence, symbols, files)
    rest = [c for c in memories.columns if c not in ("memory_id", "status", "confidence", "valid_at")]
    valid = F.col("valid_at") if "valid_at" in memories.columns else F.lit(None).cast("string")
    now = F.when((F.col("status") == "fresh") & F.lit(head is not None), F.lit(head)).otherwise(valid)
    m = memories.drop("status", "confidence").join(judged, "memory_id").select("memory_id", *rest, "status", "confidence", now.alias("valid_at"))
    b = baselines(evidence, symbols, files).join(judged.select("memory_id", "status"), "memory_id", "left")
    filled = F.when(F.col("status") == "fresh", F.coalesce("fingerprint", "now")).otherwise(F.col("fingerprint"))
    return m, b.withColumn("fingerprint", filled).select(*evidence.columns)


def recover(evidence: DataFrame, symbols_at: DataFrame, files_at: DataFrame) -> DataFrame:
    """Evidence whose missing baselines are taken from the commit that it cites, where that commit has the file and the symbols.

    ``evidence`` has ``commit``; ``symbols_at`` and ``files_at`` are symbols and files with a column ``commit``.
    """
    lost = evidence.filter("fingerprint IS NULL")
    at = lambda df, path: df.withColumn("repo_id", F.concat_ws("@", "repo_id", "commit")).drop("commit")  # noqa: E731, ARG005
    b = baselines(lost.withColumn("repo_id", F.concat_ws("@", "repo_id", "commit")), at(symbols_at, "file_path"), at(files_at, "relative_path"))
    found = F.when(F.col("has_file") & ~F.col("missing"), F.col("now"))
    back = b.withColumn("fingerprint", found).withColumn("repo_id", F.substring_index("repo_id", "@", 1)).select(*evidence.columns)
    return evidence.filter("fingerprint IS NOT NULL").unionByName(back)


def staleness(memories: DataFrame, evidence: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(memory_id, status, confidence) of every claim after the catalog changed, as ``verify`` has it, but for missing baselines.

    ``evidence`` comes from ``recover``. Where no baseline could be recovered the claim is degraded, and one that was
    stale before stays stale until it is verified.
    """
    flags = _flags(evidence, symbols, files)
    differs = F.col("differs") | F.coalesce("open", F.lit(False))
    return _verdict(memories, flags, differs, F.coalesce(F.col("open") & (F.col("status") == "stale"), F.lit(False)))


def status_counts(judged: DataFrame) -> DataFrame:
    """One row: all claims, fresh, degraded, and stale with invalidated."""
    s = F.col("status")
    return judged.agg(
        F.count("*").alias("total"), F.count_if(s == "fresh").alias("fresh"), F.count_if(s == "degraded").alias("degraded"),
        F.count_if(s.isin("stale", "invalidated")).alias("stale"),
    )


def changed_symbols(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols that overlap a changed range of their file; the range ends one past its last line, inclusive.

    ``hunks``: (repo_id, file_path, start, lines). An equi-join on the file with a range condition.
    """
    h = hunks.select("repo_id", "file_path", "start", (F.col("start") + F.col("lines")).alias("stop"))
    s = symbols.select("repo_id", "file_path", "id", "start_line", "end_line")
    hit = s.join(h, ["repo_id", "file_path"]).filter("start_line <= stop AND end_line >= start")
    return hit.select("repo_id", "file_path", "id").distinct()


def capture(evidence: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Evidence with its present baseline as fingerprint; rows with missing symbols are an error for the caller."""
    b = baselines(evidence, symbols, files)
    return b.withColumn("fingerprint", F.when(F.col("has_file") & ~F.col("missing"), F.col("now"))).select(*evidence.columns, (F.col("missing") | ~F.col("has_file")).alias("error"))


def get(memories: DataFrame, memory_id: str) -> DataFrame:
    """The claim of an id, or no row."""
    return memories.filter(F.col("memory_id") == memory_id).limit(1)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Claims by id: a new row replaces the old one."""
    return old.join(new.select("memory_id").distinct(), "memory_id", "left_anti").unionByName(new, allowMissingColumns=True)


def relevant(memories: DataFrame, evidence: DataFrame, terms: DataFrame, scored: DataFrame) -> DataFrame:
    """(task_id, memory_id) of claims that hold a task's term, cite a scored file or name a term as a symbol.

    ``memories``: (memory_id, repo_id, claim); ``terms``: (task_id, repo_id, term); ``scored``: (task_id,
    repo_id, file). Claims are found by the rarest three letters of each term.
    """
    t = terms.select("task_id", "repo_id", "term").distinct()
    held = holding(memories.select("repo_id", "memory_id", "claim"), [F.lower("claim")], t, ["repo_id", "memory_id"], F.lower)
    by_claim = held.select("repo_id", "memory_id", "term").join(t, ["repo_id", "term"]).select("task_id", "memory_id")
    by_file = evidence.join(scored, ["repo_id", "file"]).select("task_id", "memory_id")
    names = evidence.select("memory_id", "repo_id", F.explode("symbols").alias("s")).withColumn("term", F.lower("s"))
    by_symbol = names.join(t, ["repo_id", "term"]).select("task_id", "memory_id")
    return by_claim.unionByName(by_file).unionByName(by_symbol).distinct()


def followed(matched: DataFrame, evidence: DataFrame, fresh: DataFrame, order: DataFrame) -> DataFrame:
    """``matched`` (task_id, memory_id) and the later claims that cite a file which a fresh matched claim before them has scored.

    ``evidence`` has one file a claim, so one step follows every chain; ``fresh``: (memory_id); ``order``: (memory_id, at).
    """
    cited = evidence.select("memory_id", "repo_id", "file").join(order, "memory_id")
    scored = matched.join(fresh.select("memory_id"), "memory_id", "left_semi").join(cited, "memory_id")
    scored = scored.groupBy("task_id", "repo_id", "file").agg(F.min("at").alias("since"))
    later = cited.join(scored, ["repo_id", "file"]).filter("at > since").select("task_id", "memory_id")
    return matched.select("task_id", "memory_id").unionByName(later).distinct()

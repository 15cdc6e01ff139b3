"""Symbol lookups and the references around a symbol.

Lookups take many queries at once: ``terms`` has (repo_id, term) and each result names its
term, so a batch of tasks is one join and not one scan a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.text import ascii_lower
from codeloom.session import materialize

SYMBOL = ["repo_id", "id", "name", "qualified_name", "kind", "file_path", "start_line", "end_line", "signature", "fingerprint"]


def live(symbols: DataFrame) -> DataFrame:
    """Distinct symbols that are not deleted."""
    s = symbols.filter("deleted_at IS NULL") if "deleted_at" in symbols.columns else symbols
    return s.select(*[c for c in SYMBOL if c in s.columns]).distinct()


def exact(symbols: DataFrame, terms: DataFrame) -> DataFrame:
    """Symbols with the name, the qualified name, or a qualified name that ends in ``::name``.

    The last form ignores the case of ASCII letters; as every qualified name is file::name it
    is a lookup of the name without case. Two equi-joins replace the OR. An empty or null term finds nothing.
    """
    t = terms.filter("term <> ''").select("repo_id", "term").distinct()
    tail = ascii_lower(F.substring_index("qualified_name", "::", -1))
    by_tail = symbols.withColumn("_k", tail).join(t.withColumn("_k", ascii_lower(F.col("term"))), ["repo_id", "_k"])
    by_tail = by_tail.filter(F.col("qualified_name").contains("::")).drop("_k")
    plain = symbols.withColumn("term", F.explode(F.array_distinct(F.array("name", "qualified_name"))))
    by_name = plain.join(t, ["repo_id", "term"])
    deep = t.filter(F.col("term").contains("::"))  # a term of several parts: the tail alone cannot be the key
    by_deep = (
        symbols.withColumn("_t", tail)
        .join(deep.withColumn("_t", ascii_lower(F.substring_index("term", "::", -1))), ["repo_id", "_t"])
        .filter(ascii_lower(F.col("qualified_name")).endswith(F.concat(F.lit("::"), ascii_lower(F.col("term")))))
        .drop("_t")
    )
    cols = [*symbols.columns, "term"]
    return by_tail.select(cols).unionByName(by_name.select(cols)).unionByName(by_deep.select(cols)).distinct()


def term_lists(terms: DataFrame, value: Column, size: int = 500) -> DataFrame:
    """(repo_id, part, terms): a repository's values as lists of about ``size``, so no list grows with the tasks."""
    n = terms.groupBy("repo_id").agg(F.ceil(F.count("*") / size).alias("parts"))
    part = F.pmod(F.xxhash64(value), F.col("parts"))
    return terms.join(n, "repo_id").groupBy("repo_id", part.alias("part")).agg(F.collect_set(value).alias("terms"))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _asked(term: pd.Series) -> pd.Series:
    """The runs of three characters of a term, or the whole of a shorter one, as codes."""
    return term.map(lambda t: [_code(t[i : i + 3]) for i in range(max(1, len(t) - 2))])


def _code(run: str) -> int:
    """Up to three characters in one number, 21 bits each."""
    return sum(ord(c) << 21 * k for k, c in enumerate(run))


def _grams(batches):
    """Replaces the last column, a text, by each distinct run of one to three of its characters, as codes."""
    for b in batches:
        texts = b.column(b.num_columns - 1).to_pylist()
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        row = np.repeat(np.arange(len(texts)), size)
        one = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        rows, codes = [row], [one]
        for n in (2, 3):
            inside = row[n - 1 :] == row[: len(row) - n + 1]
            code = sum(one[k : len(one) - n + 1 + k] << 21 * k for k in range(n)) if len(one) >= n else one[:0]
            rows.append(row[: len(code)][inside[: len(code)]]), codes.append(code[inside[: len(code)]])
        r, c = np.concatenate(rows), np.concatenate(codes)
        order = np.lexsort((c, r))
        r, c = r[order], c[order]
        first = np.ones(len(r), bool)
        first[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
        r, c = pa.array(r[first]), pa.array(c[first])
        yield pa.RecordBatch.from_arrays([*(b.column(i).take(r) for i in range(b.num_columns - 1)), c], names=[*b.schema.names[:-1], "_gram"])


def holding(texts: DataFrame, hay: list[Column], terms: DataFrame, key: list[str], fold: Callable[[Column], Column]) -> DataFrame:
    """Rows of ``texts`` with each ``term`` of their repository that one of the columns ``hay`` holds (already folded).

    A term is looked up by the rarest of its runs of three characters (all of it if it is shorter): texts and terms meet in equi-joins on
    (repository, run), and only those that share the rarest run are compared. Only runs that some term has leave the scan. ``key``: columns that tell rows
    apart, ``repo_id`` among them; a row whose key is null is not found. Empty and null terms find nothing.
    """
    t = terms.filter("term <> ''").select("repo_id", "term").distinct().withColumn("_low", fold(F.col("term")))
    asked = t.select("repo_id", "term", "_low", F.explode(_asked("_low")).alias("_gram"))
    joined = texts.select(*key, F.concat_ws("\0", *hay).alias("_hay")).filter("_hay <> ''")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-1]) + ", _gram bigint"
    x = joined.mapInArrow(_grams, schema)
    hits = materialize(x.join(asked.select("repo_id", "_gram").distinct(), ["repo_id", "_gram"], "left_semi").distinct(), "grams")
    often = hits.groupBy("repo_id", "_gram").agg(F.count("*").alias("_n"))
    best = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("b")
    rare = asked.join(often, ["repo_id", "_gram"], "left").groupBy("repo_id", "term", "_low").agg(best).filter("b.n > 0")
    pairs = rare.select("repo_id", "term", "_low", F.col("b._gram").alias("_gram")).join(hits, ["repo_id", "_gram"]).drop("_gram")
    held = F.lit(False)
    for h in hay:
        held = held | F.coalesce(F.contains(h, F.col("_low")), F.lit(False))
    return texts.join(pairs, key).filter(held).drop("_low")


def partial(symbols: DataFrame, terms: DataFrame, limit: int = 20) -> DataFrame:
    """The first ``limit`` symbols per term, by file and line, whose name or qualified name holds the term.

    ASCII case is ignored; the lookup goes by ``holding``. Empty terms find nothing.
    """
    low = [ascii_lower(F.col("name")), ascii_lower(F.col("qualified_name"))]
    found = holding(symbols, low, terms, ["repo_id", "id"], ascii_lower)
    w = Window.partitionBy("repo_id", "term").orderBy("file_path", "start_line", "id", *[c for c in symbols.columns if c not in ("repo_id", "file_path", "start_line", "id")])
    return found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def dependencies(references: DataFrame, definitions: DataFrame, names: DataFrame) -> DataFrame:
    """Callers, callees and imports of each (repo_id, name); an import comes once per definition, as in the reference."""
    n = names.select("repo_id", "name").distinct()
    cols = ["ref_id", "source_file", "source_symbol_name", "target_name", "kind", "line_number"]
    r = references.select("repo_id", *cols)
    calls = r.filter("kind = 'calls'")
    callers = calls.join(n, (calls.repo_id == n.repo_id) & (calls.target_name == n.name)).select(n.repo_id, n.name, F.lit("caller").alias("role"), *cols)
    callees = calls.join(n, (calls.repo_id == n.repo_id) & (calls.source_symbol_name == n.name)).select(n.repo_id, n.name, F.lit("callee").alias("role"), *cols)
    defs = definitions.select("repo_id", "name", F.col("file_path").alias("source_file")).join(n, ["repo_id", "name"])
    imports = r.filter("kind = 'imports'").join(defs, ["repo_id", "source_file"]).select("repo_id", "name", F.lit("import").alias("role"), *cols)
    return callers.unionByName(callees).unionByName(imports)


def related_tests(references: DataFrame, files: DataFrame, names: DataFrame) -> DataFrame:
    """One reference per (name, file, source, target) that tests the name, test references first.

    A reference relates if its kind is ``tests`` and its target or source is the name or its source is ``test_name`` or
    begins with ``test_name_``; or if its target is the name and its file or source is a test. Its
    file must be in the catalog. The disjunction is a union of equi-joins.
    """
    n = names.filter("name <> ''").select("repo_id", "name").distinct()
    f = files.groupBy("repo_id", F.col("relative_path").alias("source_file")).agg(F.max("is_test").alias("is_test"))
    r = references.join(f, ["repo_id", "source_file"])
    by_target = r.join(n.withColumn("target_name", F.col("name")), ["repo_id", "target_name"]).filter(
        (F.col("kind") == "tests") | F.col("is_test") | ascii_lower(F.col("source_symbol_name")).startswith("test_")
    )
    tests = r.filter("kind = 'tests' AND source_symbol_name IS NOT NULL")
    by_source = tests.join(n.withColumn("source_symbol_name", F.col("name")), ["repo_id", "source_symbol_name"])
    # test_a_b relates to "a" and to "a_b": every prefix of the parts behind test_ is a key
    parts = F.split(F.substring("source_symbol_name", 6, 1 << 20), "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "_"))
    named = tests.filter(ascii_lower(F.col("source_symbol_name")).startswith("test_")).withColumn("_k", F.explode(F.array_distinct(F.transform(prefixes, ascii_lower))))
    by_prefix = named.join(n.withColumn("_k", ascii_lower(F.col("name"))), ["repo_id", "_k"]).drop("_k")
    cols = ["repo_id", "name", "source_file", "source_symbol_name", "target_name", "kind", "line_number"]
    found = by_target.select(cols).unionByName(by_source.select(cols)).unionByName(by_prefix.select(cols)).distinct()
    best = F.min(F.struct((F.col("kind") != "tests").alias("other"), "line_number", "kind"))
    return found.groupBy(*cols[:5]).agg(best.alias("b")).select(*cols[:5], "b.kind", "b.line_number")

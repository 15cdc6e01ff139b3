"""Configuration and claim logs."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import redact, redact_text
from codeloom.functions.vocab import parse_edge_kind
from codeloom.sources.locks import locked


@dataclass
class RepoConfig:
    max_file_size_kb: int = 2048
    default_context_tokens: int = 8000
    exclude_secrets: bool = True
    index_tests: bool = True
    index_docs: bool = True
    custom_ignores: list[str] = field(default_factory=list)


def load_config(path: str) -> RepoConfig:
    """The file's settings; the defaults on any error."""
    try:
        with open(path, "rb") as f:
            raw = tomllib.load(f)
        names = {f.name: type(f.default) if f.name != "custom_ignores" else list for f in fields(RepoConfig)}
        if any(k in names and not isinstance(v, names[k]) for k, v in raw.items()):
            return RepoConfig()
        return RepoConfig(**{k: v for k, v in raw.items() if k in names})
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError):
        return RepoConfig()


@dataclass
class Ontology:
    """Allowed kinds of edges and nodes; None allows all."""

    edge_kinds: list[str] | None = None
    node_kinds: list[str] | None = None

    def allows_edge(self, kind: str) -> bool:
        return self.edge_kinds is None or kind in self.edge_kinds

    def allows_node(self, kind: str) -> bool:
        return self.node_kinds is None or kind in self.node_kinds


def load_ontology(path: str) -> Ontology:
    """Absent: everything is allowed. An unknown edge kind is an error."""
    if not os.path.exists(path):
        return Ontology()
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    edges = raw.get("edge_kinds")
    return Ontology([parse_edge_kind(k) for k in edges] if edges is not None else None, raw.get("node_kinds"))


MEMORY = (
    "id string, claim string, kind string, evidence array<struct<file:string,symbols:array<string>,commit:string,fingerprint:string>>,"
    " valid_at string, confidence double, status string, created_at string, updated_at string"
)


def load_memories(spark: SparkSession, path: str) -> DataFrame:
    """Claims of a JSON-lines log; blank, malformed and incomplete lines are skipped, claims masked."""
    rows = spark.read.schema(MEMORY).option("mode", "DROPMALFORMED").json(path)
    needed = ["id", "claim", "kind", "evidence", "confidence", "status"]
    ok = rows.na.drop(subset=needed)
    return ok.withColumn("claim", redact(F.col("claim"))).withColumn("status", F.lower("status"))


def _rewrite(path: str, change) -> bool:
    """Reads the log under its lock, applies ``change`` to its records and swaps it in one step; malformed lines are dropped, as on reading."""
    with locked(path):
        old = []
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                for line in f:
                    try:
                        r = json.loads(line)
                    except ValueError:
                        continue
                    if isinstance(r, dict):
                        old.append(r)
        new = change(old)
        if new is None:
            return False
        tmp = f"{path}.tmp"
        with open(tmp, "w", encoding="utf-8") as f:
            f.writelines(json.dumps({**r, "claim": redact_text(r["claim"])} if isinstance(r.get("claim"), str) else r, ensure_ascii=False) + "\n" for r in new)
        os.replace(tmp, path)
        return True


def append_memory(path: str, record: dict) -> None:
    """Replaces the claim of the same id, else appends; claims are masked."""

    def change(old):
        at = next((i for i, r in enumerate(old) if r.get("id") == record["id"]), None)
        return [record if i == at else r for i, r in enumerate(old)] + ([record] if at is None else [])

    _rewrite(path, change)


def delete_memory(path: str, memory_id: str) -> bool:
    """False if the log has no claim of the id; then it stays as it is."""
    return _rewrite(path, lambda old: [r for r in old if r.get("id") != memory_id] if any(r.get("id") == memory_id for r in old) else None)


def note(spark: SparkSession, repo: str, session: str, text: str, limit: int = 2048 * 1024) -> DataFrame:
    """One pasted or session text as a datapoint; an empty or oversized one is an error."""
    if not text.strip():
        raise ValueError("a note needs text")
    if len(text.encode()) > limit:
        raise ValueError("the note is too large")
    row = spark.createDataFrame([(repo, session, text)], "repo_id string, path string, content string")
    return row.withColumn("content", redact(F.col("content"))).withColumn("kind", F.lit("note"))

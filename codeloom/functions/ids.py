"""Identifiers of nodes, datasets, sets and declarations, and what can be read from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _id(prefix: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), *parts)


def dataset_id(repo: Column, name: Column | str = "default") -> Column:
    return _id("dataset", repo, F.lit(name) if isinstance(name, str) else name)


def node_set_id(repo: Column, name: Column) -> Column:
    return _id("nodeset", repo, name)


def file_node(dataset: Column, path: Column) -> Column:
    return _id("file", dataset, path)


def symbol_node(dataset: Column, symbol: Column) -> Column:
    return _id("symbol", dataset, symbol)


def name_node(dataset: Column, name: Column) -> Column:
    return _id("name", dataset, name)


def commit_node(dataset: Column, commit: Column) -> Column:
    return _id("commit", dataset, commit)


def session_node(dataset: Column, session: Column) -> Column:
    return _id("session", dataset, session)


def declaration_id(path: Column, scope: Column, name: Column, byte: Column) -> Column:
    return F.concat(path, F.lit("::"), scope, F.lit("::"), name, F.lit("@"), byte.cast("string"))


def chunk_owner(kind: Column, path: Column) -> Column:
    """The file of a chunk: its path without a trailing ``#start-end``; other kinds keep theirs."""
    return F.when(kind == "chunk", F.regexp_replace(path, "#[0-9]+-[0-9]+$", "")).otherwise(path)


def import_name(target: Column) -> Column:
    """The last part of an import text that is not blank, without quotes and braces."""
    parts = F.filter(F.split(target, r"[:/. {,]"), lambda p: F.trim(p) != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), target)
    return F.trim(F.regexp_replace(F.trim(last), r"^[\"'`{};,]+|[\"'`{};,]+$", ""))

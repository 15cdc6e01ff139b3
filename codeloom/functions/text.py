"""Text columns: digests, token estimates, redaction, bounded cuts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The documented credential patterns, applied in this order.
REDACTIONS = [
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bghp_[A-Za-z0-9_]{36}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{82}\b",
    r"\bxox[baprs]-[0-9A-Za-z-]{10,48}",
    r"""(?i)(api[_-]?key|secret|token)\s*[:=]\s*["'][A-Za-z0-9_\-]{20,}["']""",
]
MASK = "[REDACTED]"


def redact(text: Column) -> Column:
    """All credential patterns replaced by the mask; ``\\s`` and ``\\b`` follow Unicode. Null stays null."""
    for p in REDACTIONS:
        text = F.regexp_replace(text, F.lit("(?U)" + p), F.lit(MASK))
    return text


def redact_text(text: str) -> str:
    """The same on one string."""
    for p in REDACTIONS:
        text = re.sub(p, MASK, text)
    return text


def estimate_tokens(text: Column) -> Column:
    """UTF-8 bytes divided by four, rounded up; null stays null."""
    return F.ceil(F.octet_length(text) / 4).cast("bigint")


def tokens_of(text: str) -> int:
    return -(-len(text.encode()) // 4)


def bound_text(text: str, tokens: int) -> str:
    """The longest prefix of whole characters within ``4 * tokens`` bytes."""
    data = text.encode()[: max(0, 4 * tokens)]
    return data.decode("utf-8", errors="ignore")


def ascii_lower(text: Column) -> Column:
    """Lower case of A to Z alone, as the reference's case folding does."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def content_id(dataset: Column, kind: Column, path: Column, content: Column) -> Column:
    """SHA-256 over the four parts with a NUL between."""
    nul = F.lit("\0")
    return F.sha2(F.concat(dataset, nul, kind, nul, path, nul, content), 256)


def repo_id(path: Column) -> Column:
    """The first 16 hexadecimal digits of the path's SHA-256."""
    return F.substring(F.sha2(path, 256), 1, 16)


def fingerprint(source: Column) -> Column:
    """SHA-256 of a declaration's text without white space around it."""
    return F.sha2(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""), 256)


def timestamp_or_now(text: Column) -> Column:
    """An RFC 3339 time, or the present time if it does not parse."""
    return F.coalesce(F.try_to_timestamp(text), F.current_timestamp())

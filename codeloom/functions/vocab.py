"""Closed vocabularies with their aliases; unknown names are an error where the reference has one."""

from __future__ import annotations

# Fixed values.
FILE_KINDS = ["source", "test", "documentation", "manifest", "configuration", "data", "unknown"]
SYMBOL_KINDS = [
    "function", "method", "class", "struct", "enum", "trait", "interface", "module", "constant", "variable", "type_alias",
    "unknown",
]
REFERENCE_KINDS = ["calls", "imports", "implements", "extends", "instantiates", "tests", "unknown"]
EDGE_KINDS = ["calls", "imports", "tests", "touched-in-commit", "owns", "decided-by", "supersedes"]
PROJECTED_EDGES = ["calls", "imports", "tests", "owns"]
SOURCE_KINDS = {
    "worktree": ["worktree", "working-tree", "tree"],
    "history": ["history", "git", "commits"],
    "docs": ["docs", "doc", "document", "documents"],
    "session": ["session", "note"],
    "text": ["text", "paste", "pasted", "pasted-text"],
}
MEMORY_STATUS = ["fresh", "degraded", "stale", "invalidated"]


def parse_source_kinds(spec: str) -> list[str]:
    """A comma list of source kinds, aliases allowed, in order without repeats."""
    out = []
    for part in filter(None, (p.strip().lower() for p in spec.split(","))):
        kind = next((k for k, names in SOURCE_KINDS.items() if part in names), None)
        if kind is None:
            raise ValueError(f"unknown source kind: {part}")
        if kind not in out:
            out.append(kind)
    if not out:
        raise ValueError("at least one source is required")
    return out


def parse_edge_kind(name: str) -> str:
    """An edge kind in any case, with blanks around it and underscores for hyphens."""
    kind = name.strip().lower().replace("_", "-")
    if kind not in EDGE_KINDS:
        raise ValueError(f"unknown edge kind: {name}")
    return kind


EXPORT_FORMATS = ["json", "dot", "mermaid"]


def parse_export_format(name: str) -> str:
    form = name.strip().lower()
    if form not in EXPORT_FORMATS:
        raise ValueError(f"unknown export format: {name}")
    return form


def normalise(name: str, names: list[str], default: str = "unknown") -> str:
    """A stored name as one of ``names``, in any case, else the default."""
    return name.lower() if name and name.lower() in names else default

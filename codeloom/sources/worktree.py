"""A Spark data source that scans source trees.

``spark.dataSource.register(WorktreeSource)``, then ``spark.read.format("worktree").load(root)``.
Options: ``max_kb`` (2048), ``ignore`` (comma list of patterns), ``index_tests``, ``index_docs`` (true),
``repo_id`` (else from the root's path), ``ignore_file`` (the name of further ignore files, in Git's form). One partition a folder of the
first level, and one for the root's own files: the driver lists the first level alone, and each task walks its folder, so a large tree is
listed and read by many. Files are opened without following links; what is too large, secret, ignored or unreadable is skipped. Where Git
is there its own ignore rules decide, else ``.gitignore`` files do not count, but those of ``ignore_file`` do.
"""

from __future__ import annotations

import hashlib
import os
import re
import stat
import subprocess
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeloom.functions import paths
from codeloom.functions.text import redact_text

SCHEMA = (
    "repo_id string, relative_path string, file_hash string, git_blob_id string, size_bytes bigint, language string, kind string,"
    " is_test boolean, is_doc boolean, indexed_at timestamp, content string"
)


def language_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    ext = name.rsplit(".", 1)[1] if "." in name[1:] else ""
    return next((n for n, e in paths.LANGUAGES.items() if ext in e), "unknown")


def kind_of(path: str, language: str) -> str:
    low, name = path.lower(), path.rsplit("/", 1)[-1].lower()
    if set(low.split("/")[:-1]) & set(paths.TEST_FOLDERS) or name.startswith("test_") or name.endswith(tuple(paths.TEST_ENDS)):
        return "test"
    if low.startswith("docs/") or "/docs/" in low or name.endswith(tuple(paths.DOC_ENDS)) or name.split(".")[0] in ("readme", "license"):
        return "documentation"
    if name in paths.MANIFESTS:
        return "manifest"
    if name.endswith(tuple(paths.CONFIG_ENDS)) or name in paths.CONFIG_NAMES or language in ("toml", "yaml", "json"):
        return "configuration"
    return "source" if language in [*paths.PARSED, "sql"] else "unknown"


def secret_name(path: str) -> bool:
    name = path.rsplit("/", 1)[-1].lower()
    ext = name.rsplit(".", 1)[1] if "." in name[1:] else ""
    if name in paths.SECRET_NAMES or name.startswith(".env.") or ext in paths.SECRET_EXTENSIONS:
        return True
    plain = name.endswith((".md", ".txt")) or name.endswith(tuple(f".{e}" for e in paths.SOURCE_EXTENSIONS))
    return not plain and any(p in name for p in paths.SECRET_PARTS)


def ignored_path(path: str, patterns: list[str]) -> bool:
    parts = path.split("/")
    for p in (p.strip() for p in patterns):
        if p.endswith("/") and len(p) > 1 and p[:-1] in parts or p and not p.endswith("/") and (path == p or path.startswith(p + "/")):
            return True
    return False


def read_bounded(root: str, relative: str, limit: int) -> bytes | None:
    """A regular file's bytes, opened without following links; None if it is none, too large or unreadable."""
    try:
        full = paths.contained(root, relative)
        before = os.lstat(full)
        if not stat.S_ISREG(before.st_mode) or before.st_size > limit:
            return None
        fd = os.open(full, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0))
        with os.fdopen(fd, "rb") as f:
            now = os.fstat(f.fileno())
            if (now.st_dev, now.st_ino) != (before.st_dev, before.st_ino):
                return None
            data = f.read(limit + 1)
        return data if len(data) <= limit else None
    except (OSError, ValueError):
        return None


def tracked_blobs(root: str) -> dict[str, str]:
    """Path -> blob id of the Git index; empty without Git."""
    try:
        out = subprocess.run(["git", "-C", root, "ls-files", "-s", "-z"], capture_output=True, check=True, timeout=120).stdout
    except (OSError, subprocess.SubprocessError):
        return {}
    rows = (r.split("\t", 1) for r in out.decode(errors="replace").split("\0") if "\t" in r)
    return {path: meta.split()[1] for meta, path in rows if meta.split()[2] == "0"}


def _matcher(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern, negated, folders only) of a line of an ignore file."""
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    negated, line = line.startswith("!"), line.removeprefix("!")
    folder, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.removeprefix("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = line[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out + "$"), negated, folder


def ignored_by(rules: list, path: str) -> bool:
    """Whether the path, or a folder that it lies in, is ignored; the last rule that fits decides."""
    parts = path.split("/")
    for k in range(1, len(parts) + 1):
        hit = False
        for pattern, negated, folder in rules:
            if (not folder or k < len(parts)) and pattern.match("/".join(parts[:k])):
                hit = not negated
        if hit:
            return True
    return False


class Subtree(InputPartition):
    """A folder of the first level, or the root's own files ("")."""

    def __init__(self, folder: str):
        self.folder = folder


class WorktreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.realpath(options["path"])
        self.limit = int(options.get("max_kb", "2048")) * 1024
        self.ignore = [p for p in options.get("ignore", "").split(",") if p.strip()]
        self.ignore_file = options.get("ignore_file", "")
        self.tests = options.get("index_tests", "true").lower() == "true"
        self.docs = options.get("index_docs", "true").lower() == "true"
        self.repo = options.get("repo_id") or hashlib.sha256(self.root.encode()).hexdigest()[:16]

    def _allowed(self, folder: str) -> list[str] | None:
        """Paths of a part that Git does not ignore, or None without Git."""
        spec = f":(literal){folder}/" if folder else ":(glob)*"
        try:
            args = ["git", "-C", self.root, "ls-files", "-co", "--exclude-standard", "-z", "--", spec]
            out = subprocess.run(args, capture_output=True, check=True, timeout=300).stdout
        except (OSError, subprocess.SubprocessError):
            return None
        return [p for p in out.decode(errors="replace").split("\0") if p]

    def _walk(self, folder: str) -> list[str]:
        if not folder:
            return [e.name for e in os.scandir(self.root) if e.is_file(follow_symlinks=False)]
        out = []
        for base, dirs, names in os.walk(os.path.join(self.root, folder), followlinks=False):
            dirs[:] = [d for d in dirs if d != ".git" and not os.path.islink(os.path.join(base, d))]
            out += [os.path.relpath(os.path.join(base, n), self.root) for n in names]
        return out

    def _rules(self, folder: str) -> list:
        """Rules of a folder's own ignore file."""
        try:
            with open(os.path.join(self.root, folder, self.ignore_file), encoding="utf-8") as f:
                return [m for line in f if (m := _matcher(line))]
        except OSError:
            return []

    def _names(self, folder: str) -> list[str]:
        found = self._allowed(folder)
        rules: dict[str, list] = {}

        def ours(path: str) -> bool:
            """Whether an ignore file of a folder around the path ignores it."""
            parts = path.split("/")
            for k in range(len(parts)):
                at = "/".join(parts[:k])
                if at not in rules:
                    rules[at] = self._rules(at)
                if rules[at] and ignored_by(rules[at], "/".join(parts[k:])):
                    return True
            return False

        names = sorted(set(self._walk(folder) if found is None else found))
        return [p for p in names if not ignored_path(p, self.ignore) and not secret_name(p) and not (self.ignore_file and ours(p))]

    def partitions(self) -> list[Subtree]:
        tops = sorted(e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and e.name != ".git")
        return [Subtree(""), *map(Subtree, tops)]

    def read(self, partition: Subtree):
        names = self._names(partition.folder)
        blobs, now = tracked_blobs(self.root) if names else {}, datetime.now(UTC)
        for path in names:
            language = language_of(path)
            kind = kind_of(path, language)
            if kind == "test" and not self.tests or kind == "documentation" and not self.docs:
                continue
            data = read_bounded(self.root, path, self.limit)
            if data is None:
                continue
            try:
                content = redact_text(data.decode("utf-8"))
            except UnicodeDecodeError:
                content = None
            digest = hashlib.sha256(data).hexdigest()
            yield (self.repo, path, digest, blobs.get(path), len(data), language, kind, kind == "test", kind == "documentation", now, content)


class WorktreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "worktree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorktreeReader:
        return WorktreeReader(dict(self.options))

"""History and state of a Git repository as small tables, by the git program."""

from __future__ import annotations

import os
import re
import stat
import subprocess

from pyspark.sql import DataFrame, SparkSession

from codeloom.sources.worktree import secret_name

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=300)
    if done.returncode:
        raise RuntimeError(done.stderr.decode(errors="replace").strip() or f"git {args[0]} failed")
    return done.stdout.decode(errors="replace")


def find_root(start: str) -> str | None:
    """The nearest folder at or above ``start`` that holds ``.git``."""
    at = os.path.realpath(start)
    while not os.path.exists(os.path.join(at, ".git")):
        if at == os.path.dirname(at):
            return None
        at = os.path.dirname(at)
    return at


def head(root: str) -> str | None:
    """The commit of HEAD; None before the first."""
    try:
        return _git(root, "rev-parse", "--verify", "-q", "HEAD").strip() or None
    except RuntimeError:
        return None


def info(spark: SparkSession, root: str) -> DataFrame:
    """One row: root, head (null before the first commit), branch, whether the tree is clean."""
    try:
        branch = _git(root, "symbolic-ref", "--short", "HEAD").strip()
    except RuntimeError:
        branch = "HEAD (detached)"
    clean = not _git(root, "status", "--porcelain").strip()
    return spark.createDataFrame([(root, head(root), branch, clean)], "root string, head string, branch string, clean boolean")


COMMITS = "commit_id string, short_id string, summary string, author string, timestamp bigint"


def recent_commits(spark: SparkSession, root: str, limit: int = 20) -> DataFrame:
    """The newest commits from HEAD; none before the first."""
    try:
        out = _git(root, "log", f"-{limit}", "--format=%H%x1f%h%x1f%s%x1f%an%x1f%ct%x1e")
    except RuntimeError:
        out = ""
    rows = [r.strip("\n").split("\x1f") for r in out.split("\x1e") if r.strip()]
    return spark.createDataFrame([(a, b, c, d, int(e)) for a, b, c, d, e in rows], COMMITS)


def touched_paths(spark: SparkSession, root: str, limit: int = 20) -> DataFrame:
    """(commit_id, path) of the newest commits, each against its first parent; a root commit against nothing."""
    try:
        out = _git(root, "log", f"-{limit}", "--diff-merges=first-parent", "--root", "--name-only", "--no-renames", "-z", "--format=%x1e%H%x1f")
    except RuntimeError:
        out = ""
    rows = []
    for part in out.split("\x1e"):
        if "\x1f" in part:
            commit, names = part.split("\x1f", 1)
            rows += [(commit.strip("\0\n"), p.strip("\n")) for p in names.split("\0") if p.strip("\n")]
    return spark.createDataFrame(rows, "commit_id string, path string")


def status(spark: SparkSession, root: str) -> DataFrame:
    """(path, state, tracked) of every changed or untracked path."""
    rows = []
    parts = iter(_git(root, "status", "--porcelain=v1", "-z", "--untracked-files=all", "--no-renames").split("\0"))
    for p in parts:
        if p:
            rows.append((p[3:], p[:2].strip(), p[:2] != "??"))
    return spark.createDataFrame(rows, "path string, state string, tracked boolean")


def untracked(spark: SparkSession, root: str) -> DataFrame:
    """Untracked and ignored files, sorted."""
    names = {p for a in (["-o"], ["-o", "-i"]) for p in _git(root, "ls-files", *a, "--exclude-standard", "-z").split("\0") if p}
    return spark.createDataFrame([(p,) for p in sorted(names)], "path string")


HUNKS = (
    "file_path string, is_deleted boolean, is_new boolean,"
    " hunks array<struct<old_start:bigint,old_lines:bigint,new_start:bigint,new_lines:bigint>>"
)


def _unquote(name: str) -> str:
    """A path as Git writes it: names with quotes, backslashes or control characters stand in quotes, escaped."""
    if not (len(name) >= 2 and name[0] == name[-1] == '"'):
        return name
    plain = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, '"': 34, "\\": 92}
    out, body, i = bytearray(), name[1:-1], 0
    while i < len(body):
        if body[i] == "\\":
            if body[i + 1] in plain:
                out.append(plain[body[i + 1]])
                i += 2
            else:
                out.append(int(body[i + 1 : i + 4], 8))
                i += 4
        else:
            out += body[i].encode()
            i += 1
    return out.decode(errors="replace")


def _path_of(line: str) -> str:
    """The path of a ``diff --git`` line without renames: both halves name it, so its middle tells them apart."""
    both = line[len("diff --git ") :]
    half = len(both) // 2
    return _unquote(both[half + 1 :].replace("b/", "", 1))


def diff_hunks(spark: SparkSession, root: str) -> DataFrame:
    """Changed ranges of tracked files against HEAD."""
    rows: list[list] = []
    for line in _git(root, "diff", "HEAD", "--no-color", "-U0", "--no-renames", "--no-ext-diff").splitlines():
        if line.startswith("diff --git "):
            rows.append([_path_of(line), False, False, []])
        elif line.startswith("new file"):
            rows[-1][2] = True
        elif line.startswith("deleted file"):
            rows[-1][1] = True
        elif m := _HUNK.match(line):
            rows[-1][3].append(tuple(int(x) if x else 1 for x in m.groups()))
    return spark.createDataFrame([tuple(r) for r in rows], HUNKS)


def text_at_commit(root: str, commit: str, path: str, limit: int = 2048 * 1024) -> str | None:
    """A file's text at a commit; None if it is secret, no regular file, too large, or not UTF-8."""
    if secret_name(path) or commit.startswith("-"):
        return None
    try:
        entry = _git(root, "ls-tree", "-z", "-l", commit, "--", path).split("\0")[0].split()
        if len(entry) < 4 or not entry[0].startswith("100") or int(entry[3]) > limit:
            return None
        data = subprocess.run(["git", "-C", root, "cat-file", "blob", entry[2]], capture_output=True, timeout=60, check=True).stdout
        return data.decode("utf-8")
    except (RuntimeError, ValueError, subprocess.SubprocessError):
        return None


def fingerprint(root: str) -> str:
    """A text that changes when the state of any changed file does."""
    out = []
    for entry in sorted(_git(root, "status", "--porcelain=v1", "-z", "--untracked-files=all", "--no-renames").split("\0")):
        if entry:
            path = entry[3:]
            try:
                st = os.lstat(os.path.join(root, path))
                out.append(f"{path}:{entry[:2]}:{st.st_mtime_ns}:{st.st_size}")
            except OSError:
                out.append(f"{path}:{entry[:2]}:-:-")
    return ";".join(out)


AUDIT = "path string, tracked boolean, secret boolean, world_writable boolean"


def security_audit(spark: SparkSession, root: str) -> DataFrame:
    """Files whose names say that they hold credentials, tracked, untracked or ignored, and tracked or listed files that anyone may write."""
    tracked = {p for p in _git(root, "ls-files", "-z").split("\0") if p}
    listed = {p for p in _git(root, "ls-files", "-o", "--exclude-standard", "-z").split("\0") if p} - tracked
    ignored = {p for p in _git(root, "ls-files", "-o", "-i", "--exclude-standard", "-z").split("\0") if p} - tracked - listed
    rows = []
    for path in sorted(tracked | listed | ignored):
        try:
            st = os.lstat(os.path.join(root, path))
            loose = path not in ignored and stat.S_ISREG(st.st_mode) and bool(st.st_mode & 0o002)
        except OSError:
            loose = False
        if secret_name(path) or loose:
            rows.append((path, path in tracked, secret_name(path), loose))
    return spark.createDataFrame(rows, AUDIT)


def is_secure(audit: DataFrame) -> bool:
    """No tracked secret and no file that anyone may write."""
    return audit.filter("(tracked AND secret) OR world_writable").isEmpty()

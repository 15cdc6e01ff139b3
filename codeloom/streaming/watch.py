"""Watched repositories on one host: a registry in a file, and passes that sync what has changed.

A pass looks at every watched root that exists. A repository is synced if its head differs from the one last indexed or if the
fingerprint of its working tree does; the first look of a process always syncs, as the tree may have changed meanwhile. A failed sync
leaves both as they were, so the next pass tries again.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from codeloom.sources import git
from codeloom.sources.locks import locked


class Registry:
    """A set of paths in a JSON file, changed under a lock and swapped in one step."""

    def __init__(self, path: str):
        self.path = path

    def _read(self) -> set[str]:
        if not os.path.exists(self.path):
            return set()
        with open(self.path, encoding="utf-8") as f:
            return set(json.load(f)["repositories"])

    def _write(self, roots: set[str]) -> None:
        part = f"{self.path}.{os.getpid()}.tmp"
        with open(part, "w", encoding="utf-8") as f:
            json.dump({"repositories": sorted(roots)}, f)
        os.replace(part, self.path)

    def list(self) -> list[str]:
        with locked(self.path):
            return sorted(self._read())

    def _change(self, root: str, there: bool) -> bool:
        with locked(self.path):
            roots = self._read()
            if (root in roots) == there:
                return False
            self._write(roots | {root} if there else roots - {root})
            return True

    def add(self, root: str) -> bool:
        """False if it was there."""
        return self._change(root, True)

    def remove(self, root: str) -> bool:
        """False if it was not."""
        return self._change(root, False)


class Watcher:
    """``sync(root)`` indexes one repository; ``head_of(root)`` is the head that was last indexed, or None for one that never was."""

    def __init__(self, registry: Registry, sync: Callable[[str], None], head_of: Callable[[str], str | None], indexed: Callable[[str], bool] = lambda root: True):
        self.registry, self.sync, self.head_of, self.indexed = registry, sync, head_of, indexed
        self.seen: dict[str, str] = {}
        self.errors: list[tuple[str, Exception]] = []

    def sync_one(self, root: str) -> bool:
        """Whether the repository was synced. One that was never indexed is left alone."""
        if not self.indexed(root):
            return False
        now = git.fingerprint(root)
        if self.seen.get(root) == now and self.head_of(root) == git.head(root):
            return False
        self.sync(root)
        self.seen[root] = now
        return True

    def sync_all(self) -> int:
        """One pass over all watched roots that exist; returns how many failed."""
        self.errors = []
        try:
            roots = self.registry.list()
        except (OSError, ValueError) as e:
            self.errors = [(self.registry.path, e)]
            return 1
        for root in roots:
            if os.path.exists(root):
                try:
                    self.sync_one(root)
                except Exception as e:  # noqa: BLE001  one repository must not stop the others
                    self.errors.append((root, e))
        return len(self.errors)

    def run(self, interval: float = 15.0, passes: int | None = None) -> None:
        """Passes with a fixed pause between."""
        while passes is None or passes > 0:
            self.sync_all()
            passes = None if passes is None else passes - 1
            if passes is None or passes > 0:
                time.sleep(interval)


def _of_uri(uri: str | None) -> str | None:
    parts = urlparse(uri or "")
    return unquote(parts.path) or None if parts.scheme == "file" and parts.netloc in ("", "localhost") else None


def resolve_root(request: dict, session: str | None, watched: list[str], default: str) -> tuple[str, str | None]:
    """(root, session's root from now on): the request's argument, its parameter, the workspace that it opens, the session's, the only watched one, else the default."""
    params = request.get("params") or {}
    given = params.get("arguments") or {}
    named = [given.get("repo_path") if isinstance(given.get("repo_path"), str) else given.get("path"), params.get("repo_path")]
    if request.get("method") == "initialize":
        folders = params.get("workspaceFolders") or []
        named += [_of_uri(params.get("rootUri")), *[_of_uri(f.get("uri")) for f in folders], params.get("rootPath")]
    for root in named:
        if isinstance(root, str) and root:
            return root, root
    if session:
        return session, session
    if len(watched) == 1:
        return watched[0], watched[0]
    return default, session

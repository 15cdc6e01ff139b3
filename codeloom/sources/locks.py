"""Locks between processes of one host."""

from __future__ import annotations

import contextlib
import fcntl
import os
from collections.abc import Iterator


@contextlib.contextmanager
def locked(path: str) -> Iterator[None]:
    """Holds the lock file beside ``path``, against other processes too."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.lock", "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        yield

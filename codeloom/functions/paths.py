"""Path columns: language, kind of file, ignore and secret rules."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each language.
LANGUAGES = {
    "rust": ["rs"],
    "python": ["py", "pyi"],
    "typescript": ["ts", "tsx", "mts", "cts"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "c": ["c", "h"],
    "cpp": ["cpp", "cxx", "cc", "hpp", "hxx", "hh"],
    "bash": ["sh", "bash", "zsh"],
    "dart": ["dart"],
    "go": ["go"],
    "html": ["html", "htm"],
    "css": ["css", "scss", "sass", "less"],
    "json": ["json"],
    "toml": ["toml"],
    "yaml": ["yaml", "yml"],
    "markdown": ["md", "markdown"],
    "sql": ["sql"],
}
#: Languages whose symbols are extracted.
PARSED = ["rust", "python", "typescript", "javascript", "c", "cpp", "bash", "dart", "go"]
# Fixed values of the classifier of file kinds.
TEST_FOLDERS = ["tests", "test", "spec", "specs"]
TEST_ENDS = ["_test.rs", "_test.py", "_test.go", ".test.ts", ".test.js", ".spec.ts", ".spec.js"]
DOC_ENDS = [".md", ".markdown", ".rst", ".adoc"]
MANIFESTS = [
    "cargo.toml", "package.json", "requirements.txt", "pyproject.toml", "go.mod", "pom.xml", "cmakelists.txt",
    "packages.x86_64", "pubspec.yaml", "gemfile",
]
CONFIG_ENDS = [".conf", ".ini", ".desktop", ".service", ".socket"]
CONFIG_NAMES = [".editorconfig", ".gitignore"]
# Fixed values of the rule for secret file names.
SECRET_NAMES = [
    ".env", ".env.local", ".env.production", ".env.development", ".env.test", "id_rsa", "id_ed25519", "id_dsa", "id_ecdsa",
    "credentials", "credentials.json", "service_account.json", "secret.key", "secrets.json", "secrets.toml", "secrets.yaml",
    "secrets.yml",
]
SECRET_EXTENSIONS = ["pem", "key", "p12", "pfx", "kdbx", "keystore", "jks"]
SECRET_PARTS = ["secret", "credential", "private_key"]
SOURCE_EXTENSIONS = [
    "rs", "go", "py", "c", "h", "cc", "cpp", "cxx", "hpp", "hh", "js", "jsx", "ts", "tsx", "dart", "java", "kt", "swift", "rb",
    "php", "cs", "scala", "sh", "bash", "zsh",
]


def file_name(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1))


def extension(path: Column) -> Column:
    """Lower-cased text behind the name's last dot; empty without one or if the dot leads the name."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def _any_end(name: Column, ends: list[str]) -> Column:
    return name.rlike("(?:" + "|".join(map(re.escape, ends)) + ")$")


def language(path: Column) -> Column:
    """The language that the extension declares, else ``unknown``."""
    ext, out = extension(path), F.lit("unknown")
    for name, exts in LANGUAGES.items():
        out = F.when(ext.isin(exts), name).otherwise(out)
    return out


def normalise_language(name: Column) -> Column:
    """A stored language name or alias, in any case, as the closed name."""
    low, out = F.lower(name), F.lit("unknown")
    for lang, exts in LANGUAGES.items():
        out = F.when(low.isin([lang, *exts]), lang).otherwise(out)
    return out


def classify_kind(path: Column, lang: Column) -> Column:
    """test, documentation, manifest, configuration, source or unknown: the first that fits."""
    low, name = F.lower(path), file_name(path)
    folders = F.slice(F.split(low, "/"), F.lit(1), F.size(F.split(low, "/")) - 1)
    test = F.arrays_overlap(folders, F.array(*map(F.lit, TEST_FOLDERS))) | name.startswith("test_") | _any_end(name, TEST_ENDS)
    doc = (
        low.startswith("docs/") | low.contains("/docs/") | _any_end(name, DOC_ENDS) | name.isin("readme", "license")
        | name.startswith("readme.") | name.startswith("license.")
    )
    config = _any_end(name, CONFIG_ENDS) | name.isin(CONFIG_NAMES) | lang.isin("toml", "yaml", "json")
    return (
        F.when(test, "test").when(doc, "documentation").when(name.isin(MANIFESTS), "manifest").when(config, "configuration")
        .when(lang.isin([*PARSED, "sql"]), "source").otherwise("unknown")
    )


def is_secret(path: Column) -> Column:
    """Whether the file's name says that it holds credentials."""
    name = file_name(path)
    part = name.rlike("|".join(SECRET_PARTS)) & ~_any_end(name, [f".{e}" for e in SOURCE_EXTENSIONS] + [".md", ".txt"])
    return name.isin(SECRET_NAMES) | name.startswith(".env.") | extension(path).isin(SECRET_EXTENSIONS) | part


def ignored(path: Column, patterns: Column) -> Column:
    """``x/`` matches any folder or file named x; other patterns the path itself or what lies below it."""
    parts = F.split(path, "/")
    hit = F.exists(
        F.coalesce(patterns, F.array().cast("array<string>")),
        lambda p: F.when(F.trim(p).isin("", "/"), False)
        .when(F.trim(p).endswith("/"), F.array_contains(parts, F.regexp_replace(F.trim(p), "/$", "")))
        .otherwise((path == F.trim(p)) | path.startswith(F.concat(F.trim(p), F.lit("/")))),
    )
    return F.coalesce(hit, F.lit(False))


def is_document(kind: Column, is_doc: Column, path: Column) -> Column:
    """Documentation by kind, flag, a docs folder, or "adr" anywhere in the path (as the reference has it)."""
    low = F.lower(path)
    return (kind == "documentation") | is_doc | low.startswith("docs/") | low.contains("/docs/") | low.contains("adr")


def included(sources: list[str], kind: Column, is_doc: Column, path: Column) -> Column:
    """Whether a file belongs to the chosen sources: the worktree holds all files, docs only documents."""
    if "worktree" in sources:
        return F.lit(True)
    return is_document(kind, is_doc, path) if "docs" in sources else F.lit(False)


def contained(root: str, relative: str) -> str:
    """The path under ``root``; an error if it is absolute, climbs, holds NUL, or crosses a symbolic link."""
    if os.path.isabs(relative) or "\0" in relative or ".." in relative.split("/"):
        raise ValueError(f"path escapes its root: {relative!r}")
    at = root
    for part in relative.split("/"):
        at = os.path.join(at, part)
        if os.path.islink(at):
            raise ValueError(f"path crosses a symbolic link: {relative!r}")
    return at

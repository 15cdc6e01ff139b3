"""Generated, minified or vendored source files, and data saved as code.

Each file is read once by its lexer, which gives

* *notices* in comments (never in strings): of a generator, or of a third party;
* *layout*: lines that repeat a few shapes (accessors emitted by a tool), very long
  lines without white space (minified), hardly any words among the tokens (data);
* *place and name*: folders for third-party code, names that generators give;
* a hash of the code without comments and white space.

The hashes are the leaves of a Merkle tree over each repository's folders, built bottom
up, one aggregation a level. A folder's hash joins its children's without their names
and in no order, so a renamed copy keeps it; it is a sum and an exclusive or, so no
folder's list of children is ever gathered. A subtree marks vendored code by itself if it stands in unrelated
repositories: a folder of ``LEAST_FILES`` files or more in two, a file in ``UNRELATED``. Repositories are related if their whole
trees have one hash, as those of forks and mirrors have. A file or folder whose hash equals that of
one known to be third-party, by place or notice, in any repository is a copy of it as well.

Defined results: only files in a programming language are cases. Null content is
judged by place and name alone; empty content likewise. A file with fewer than ``LEAST_CODE``
characters of code goes by the hash of its whole text, comments included; if that is as short, it is no copy by
itself, but as a part of a folder. Repeated rows count once;
if the rows of a file differ, it is a case if any is. A file that merely speaks of
generators is none: notices count in comments of the fixed forms below only.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.lexing import language_of, lex
from codeloom.session import materialize

PROGRAMMING = {"python", "rust", "javascript", "typescript", "go", "c", "bash"}
LEAST_CODE = 100
#: Files of a folder that marks its copies.
LEAST_FILES = 2
#: Unrelated repositories in which a file by itself is vendored code.
UNRELATED = 3

# Folders of third-party code, and names given by generators.
PLACES = {
    "vendor", "vendored", "vendors", "node_modules", "bower_components", "jspm_packages", "third_party", "thirdparty",
    "third-party", "3rdparty", "3rd_party", "external", "externals", "deps", "site-packages", "godeps", "pods", "carthage",
}
_NAMES = re.compile(
    r"(?:_pb2(?:_grpc)?\.pyi?|[._]pb\.(?:go|js|ts|h|c|rs)|_pb\.[jt]s|\.pb-c\.[ch]|^zz_generated[._].*|_bindgen\.rs|[._]generated\.\w+|[._]gen\.\w+|\.g\.\w+)$"
)
_MIN_NAME = re.compile(r"(?:[.-]min\.|\.bundle\.|\.chunk\.|\.packed\.)[cm]?js$")
_GENERATED_PLACES = {"generated", "__generated__"}
_GENERATED = re.compile(
    r"""(?ix)
    @generated\b | <auto-?generated | ^\W*auto-?generated\s+(?:file|by|from|code)\b | \bgenerated\s+by\b.{0,80}\bdo\s+not\b
    | \b(?:code|file|source|module)\s+(?:was\s+|is\s+)?(?:auto(?:matically)?[\s-]*)?generated\s+(?:by|from|with)\b
    | \bdo\s+not\s+(?:edit|modify|change)\b(?!.*\bunless\b) | \bgenerated\s+(?:on|at|during)\s+build\s+from\b | \bautomatically\s+(?:produced|generated|created)\s+(?:from|by)\b
    | \bmachine[\s-]+(?:written|generated)\b | \bhands\s+off\b | \berzeugt\b.*\bnicht\s+bearbeiten\b | \bgénéré\s+(?:par|automatiquement)\b
    | \bgenerado\s+(?:por|automáticamente)\b | ^\W*source:\s+\S+\.(?:proto|thrift|idl|fbs|avsc)\s*$
    """
)
_THIRD_PARTY = re.compile(
    r"""(?ix)
    ^\W*upstream:\s+\S+ | \bimported\s+from\s+the\s+\S+\s+project\b | \blocal\s+copy\b.*\bupstream\b | \(c\)\s+the\s+\S+\s+contributors\b
    | ^\W*licensed\s+under\b.*\bsee\s+upstream\b | ^\W*@license\b | ^\W*@preserve\b | ^\W*!?\s*\S+\s+v?\d+(?:\.\d+)+\s+-\s+https?://\S+\s*$
    | \bvendored\s+from\b | \bcopied\s+(?:verbatim\s+)?from\s+https?:// | ^\W*\S+\s+v?\d+(?:\.\d+)+\s+\|\s+\(c\)\s
    """
)
_HAND = re.compile(r"(?i)\b(?:by\s+hand|edit\s+it\s+freely|hand[\s-]*written|unlike\s+the|not\s+(?:auto-?)?generated|never\s+run)\b")
_SHAPE = re.compile(r"\w+|\"[^\"]*\"|'[^']*'")


def _comment_lines(tokens, text: str, language: str):
    if language == "bash":
        for m in re.finditer(r"(?m)^[ \t]*#(?!!).*$", text):
            yield m.group()
        return
    for k, a, b in tokens:
        if k == "c" or k == "e" and text.startswith("/*", a):  # a comment without an end is one as well
            yield from text[a:b].splitlines()


def notice(tokens, text: str, language: str) -> str | None:
    """"generated" or "vendored" if a comment says so; the first of them counts."""
    for line in _comment_lines(tokens, text, language):
        body = re.sub(r"^[\s/*#!;-]*", "", line.strip()) if not line.strip().startswith("//!") else line.strip()[2:]
        if _HAND.search(line):
            continue
        if _GENERATED.search(body) or _GENERATED.search(line.strip()):
            return "generated"
        if _THIRD_PARTY.search(body):
            return "vendored"
    return None


def layout(tokens, text: str, language: str) -> str | None:
    """"minified", "data" or "generated" by the looks of the code."""
    code = [t for t in tokens if t[0] not in "cl"]
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines:
        return None
    longest = max(map(len, lines))
    blanks = sum(map(str.isspace, text)) / len(text)
    if language in ("javascript", "typescript", "bash") and longest > 300 and blanks < 0.1 and len(text) / len(lines) > 150:
        words = sum(k == "w" for k, _, _ in code)
        if language == "bash" or words > 0.1 * len(code):
            return "minified"
    if len(code) >= 40:
        words = sum(k == "w" for k, _, _ in code)
        held = sum(k in "sn" for k, _, _ in code)
        if words < 0.1 * len(code) and held > 0.3 * len(code):
            return "data"
    size, held, before = sum(b - a for _, a, b in code), 0, ""
    for k, a, b in code:  # texts that are values, docstrings aside
        if k == "s" and before in ("=", "(", "[", ",", "s"):
            held += b - a
            before = "s"
        else:
            before = text[a:b] if b - a == 1 else k
    if size >= 1000 and held > 0.85 * size and len(lines) >= 12:
        return "data"
    if len(lines) >= 12:
        shapes: dict[str, int] = {}
        n = 0
        for x in lines:
            s = x.strip()
            if s.startswith(("//", "#", "/*", "*")) and not s.startswith("#["):
                continue
            n += 1
            shape = _SHAPE.sub("w", s)
            shapes[shape] = shapes.get(shape, 0) + 1
        top = sum(sorted(shapes.values(), reverse=True)[:6])
        if n >= 12 and len(shapes) <= 0.25 * n and top >= 0.9 * n and re.search(r"\w_?\d+\s*\(", text):
            return "generated"
    return None


def by_path(path: str) -> str | None:
    """"vendored" or "generated" or "minified" by place and name."""
    *folders, name = path.split("/")
    if any(f.lower() in PLACES for f in folders):
        return "vendored"
    if _NAMES.search(name):
        return "generated"
    if _MIN_NAME.search(name.lower()):
        return "minified"
    return None


def features(path: str, text: str | None) -> tuple[str | None, str | None, str | None, int]:
    """(kind, what told it, hash of the code or None, characters that the hash stands for)."""
    language = language_of(path)
    kind, told = by_path(path), "place"
    if not text:
        return kind, told if kind else None, None, 0
    tokens = lex(language, text, whole=True)[0] if language != "bash" else []
    code = "".join(text[a:b] for k, a, b in tokens if k not in "cl")
    if language == "bash":
        code = re.sub(r"(?m)^[ \t]*#.*$|\s+", "", text)
    digest, size = hashlib.sha256(f"{language}\0{code}".encode()).hexdigest(), len(code)
    if size < LEAST_CODE:
        digest, size = hashlib.sha256(f"text\0{language}\0{text}".encode()).hexdigest(), len(text.strip())
    said = notice(tokens, text, language)
    if kind != "vendored" and said == "vendored":
        kind, told = said, "notice"
    if kind is None and said:
        kind, told = said, "notice"
    if kind is None and (looks := layout(tokens, text, language)):
        kind, told = looks, "layout"
    if kind is None and any(f.lower() in _GENERATED_PLACES for f in path.split("/")[:-1]):
        kind, told = "generated", "place"
    return kind, told if kind else None, digest, size


FEATURES = "repo_id string, relative_path string, kind string, told string, digest string, size bigint"


def _run(batches):
    names = [f.split()[0] for f in FEATURES.split(", ")]
    for b in batches:
        rows: list[list] = [[] for _ in names]
        for repo, path, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if not path or language_of(path) not in PROGRAMMING:
                continue
            for c, v in zip(rows, (repo, path, *features(path, text)), strict=True):
                c.append(v)
        kinds = [pa.string()] * 5 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=names)


def _combine(column) -> list:
    """The children's hashes, joined without order: sums and exclusive ors of two hashes, and their number."""
    return [
        F.sum(F.col("files")).alias("files"),
        F.sum("size").alias("size"),
        F.bit_xor(F.xxhash64(column, F.lit(1))).alias("x"),
        F.sum(F.xxhash64(column, F.lit(2)).cast("decimal(38,0)")).alias("s"),
        F.count("*").alias("n"),
    ]


def merkle(files: DataFrame) -> DataFrame:
    """Every node of every repository's tree: (repo_id, node, depth, files, size, digest), leaves included.

    ``files`` has (repo_id, relative_path, digest, size), one row a file.
    """
    parts = F.split("relative_path", "/")
    level = files.select(
        "repo_id", F.col("relative_path").alias("node"), F.size(parts).alias("depth"),
        F.lit(1).cast("bigint").alias("files"), "size", "digest",
    )
    top = level.agg(F.max("depth")).first()[0] or 0
    out, below = level, level.filter(F.lit(False))
    for depth in range(top, 1, -1):
        children = level.filter(F.col("depth") == depth).unionByName(below)
        folder = F.regexp_replace("node", "/[^/]*$", "")
        below = (
            children.groupBy("repo_id", folder.alias("node"))
            .agg(*_combine(F.col("digest")))
            .select(
                "repo_id", "node", F.lit(depth - 1).alias("depth"), "files", "size",
                F.sha2(F.concat_ws(",", "x", F.col("s").cast("string"), "n"), 256).alias("digest"),
            )
        )
        out = out.unionByName(below)
    return out


def classify(files: DataFrame, content: DataFrame) -> DataFrame:
    """Every file of a programming language: (repo_id, relative_path, kind, told, n_repos); kind null is hand-written.

    ``n_repos``: unrelated repositories that hold the file, or a folder around it, if that marks it.
    """
    # Texts are read where they lie and never shuffled; a file without a row of content is judged by its path.
    key = ["repo_id", "relative_path"]
    bare = files.select(*key).distinct().withColumn("content", F.lit(None).cast("string"))
    seen = content.select(*key, "content").unionByName(bare).mapInArrow(_run, FEATURES)
    # One row a file: the first kind in order if its rows differ.
    one = seen.groupBy("repo_id", "relative_path").agg(
        F.min(F.when(F.col("kind").isNotNull(), F.struct("kind", "told"))).alias("k"),
        F.max(F.struct(F.coalesce("size", F.lit(0)).alias("size"), "digest")).alias("d"),
    )
    flat = one.select("repo_id", "relative_path", "k.kind", "k.told", "d.digest", "d.size")
    flat = materialize(flat, "provenance-files")
    tree = merkle(flat.filter("digest IS NOT NULL"))
    # Leaves that are third-party by place or notice, and folders made of nothing else.
    foreign = flat.select("repo_id", F.col("relative_path").alias("node"), F.coalesce(F.col("kind") == "vendored", F.lit(False)).alias("foreign"))
    counted = (
        flat.filter("kind = 'vendored' AND digest IS NOT NULL")
        .select("repo_id", F.explode(_folders("relative_path")).alias("node"))
        .groupBy("repo_id", "node")
        .agg(F.count("*").alias("n_foreign"))
    )
    nodes = tree.join(foreign, ["repo_id", "node"], "left").join(counted, ["repo_id", "node"], "left")
    is_leaf = F.col("foreign").isNotNull()
    known = F.when(is_leaf, F.col("foreign")).otherwise(F.col("n_foreign") == F.col("files"))
    big = (F.col("size") >= LEAST_CODE) & (is_leaf | (F.col("files") >= LEAST_FILES))
    nodes = materialize(nodes.filter(big).select("repo_id", "node", "digest", known.alias("known"), is_leaf.alias("leaf")), "tree")
    root = flat.filter("digest IS NOT NULL").groupBy("repo_id").agg(F.bit_xor(F.xxhash64("digest", "relative_path")).alias("root"))
    # the distinct roots of a hash, so that forks count once; a partial count comes before the shuffle
    held = nodes.join(root, "repo_id").groupBy("digest", "root").agg(
        F.max(F.coalesce("known", F.lit(False))).alias("k"), F.count("*").alias("n"), F.max("leaf").alias("leaf")
    )
    shared = held.groupBy("digest").agg(F.max("k").alias("k"), F.sum("n").alias("n"), F.count("*").alias("n_repos"), F.max("leaf").alias("leaf"))
    alone = F.col("n_repos") >= F.when(F.col("leaf"), UNRELATED).otherwise(2)
    marked = shared.filter((F.col("k") & (F.col("n") > 1)) | alone).select("digest", "n_repos", (~alone).alias("by_mark"))
    copies = nodes.join(marked, "digest")
    leaves = copies.filter("leaf").select("repo_id", F.col("node").alias("relative_path"), "n_repos", "by_mark")
    folders = copies.filter("NOT leaf").select("repo_id", "node", "n_repos", "by_mark")
    under = (
        flat.select("repo_id", "relative_path", F.explode(_folders("relative_path")).alias("node"))
        .join(folders, ["repo_id", "node"])
        .select("repo_id", "relative_path", "n_repos", "by_mark")
    )
    copied = leaves.unionByName(under).groupBy("repo_id", "relative_path").agg(F.max("n_repos").alias("n_repos"), F.min("by_mark").alias("by_mark"))
    hit = F.col("n_repos").isNotNull()
    kind = F.when(F.col("kind").isNotNull(), F.col("kind")).when(hit, "vendored")
    told = F.when(F.col("kind").isNotNull(), F.col("told")).when(hit, F.when(F.col("by_mark"), "copy").otherwise("shared"))
    return flat.join(copied, ["repo_id", "relative_path"], "left").select(
        "repo_id", "relative_path", kind.alias("kind"), told.alias("told"), F.coalesce("n_repos", F.lit(1)).alias("n_repos")
    )


def _folders(path: str):
    """All folders that a path lies in."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))

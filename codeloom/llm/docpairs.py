"""Functions paired with their documentation, as code and description.

Per file the comments (and, in Python, the docstrings) are found by the lexer, so text
in strings is never taken for a comment. Blocks that are commented-out code or hardly
say anything are dropped first. The rest are matched with the file's functions as a
bipartite assignment of greatest weight, one block to one declaration: a block that touches the declaration or its
attributes weighs most, parameter tags that name the function's parameters and mentions
of its name add to it, blank lines between take away. So of a comment and a docstring the one that speaks of the
function's parameters is kept, and a block between two functions goes to the one that it describes. A link across
a gap is plausible only if the block's tags all name parameters of the function, or if it calls the function by name;
other such links are rejected. Every pair has its ``distance`` in blank lines. Declarations that begin on one line share
their documentation.

*Trivial* is a block that is code, or of which at most three words are left without the
words of the function's name, markers, tag names, placeholders and tool directives.

Defined results: symbols that were deleted, are of another kind, or whose line lies
beyond the text give no pair; null content gives none. Several rows of a symbol give one
pair. If a file has several contents, a symbol is paired in each that documents it and
the first in order is kept. A file's symbols meet its content by a join on
(repo_id, relative_path), which the optimizer may split if one file is repeated often;
only distinct symbols of one file are ever gathered.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.lexing import language_of, lex

#: Words that must be left for a description to say something.
LEAST_WORDS = 4
#: Lines between a block and a function that it may still compete for.
REACH = 3

# Words that say nothing by themselves.
MARKERS = set("todo fixme xxx hack note nb wip tbd tba deprecated internal".split())
TAGS = set(
    "param params parameter parameters arg args argument arguments return returns raise raises throw throws except exception"
    " exceptions type rtype yield yields error errors panic panics safety example examples note notes see since author version"
    " brief tparam template inheritdoc override kwargs keyword attributes usage warning warnings output outputs input inputs".split()
)
PLACEHOLDERS = set("description summary placeholder none na docs doc documentation undocumented function method lorem ipsum".split())
_DIRECTIVE = re.compile(
    r"(?i)(?:\bnoqa\b(?::[\w, ]*)?|\btype:\s*ignore\S*|\bpylint:\s*\S+|\bpragma:\s*no\s*\w+|\bfmt:\s*\w+|\bmypy:\s*\S+|\bisort:\s*\S+"
    r"|\b[es|t]slint-(?:disable|enable)\S*[\w ,/@-]*|\beslint-(?:disable|enable)\S*|\bprettier-ignore\S*|@ts-[\w-]+|\bnolint\b\S*|\bgo:\w+\S*"
    r"|\bshellcheck\s+\w+=\S+|\bclang-(?:format|tidy)\b\S*(?:\s+o(?:n|ff))?|\brustfmt::\w+|\bclippy::\w+|\bistanbul\s+ignore\s*\w*|\bc8\s+ignore\s*\w*"
    r"|@internal\b|@inheritdoc\b|@override\b|\bn/a\b|\bcoverage:\s*\w+)"
)
_MARKUP = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!/)|//[/!]?|#+!?)?\s?(.*?)\s*(?:\*+/)?\s*$")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_LETTERS = re.compile(r"[^\W\d_]+")
_CODE_LINE = re.compile(
    r"""^(?:
      (?:return|yield|throw|raise|break|continue|goto)\b(?:[\w\s.,()\[\]"'&*+-]*;?|.*[(=].*[;)])
      | (?:let|const|var|int|char|bool|auto|static|void|double|float|long|unsigned|mut|local|export)\b.*=.*
      | [\w.\[\]>*&$-]+(?:\s*,\s*\w+)*\s*(?::=|[-+*/|&^%]?=(?!=))\s*(?:[\w.]+\s*\(.*|["'\d\[{$(-].*|\w+\s*;|[\w.]+\[.*)
      | \w+="\$.*
      | (?:[\w.:>-]+)\(.*\)\s*[;{:]?
      | [\w-]+\s+"\$\{.*
      | (?:if|for|while|switch|match|else|elif|try|with|def|fn|func|function|class)\b.*[{:;]
      | (?:import|from|use|\#include|package)\s+["'<\w.:*{},\s]+["'>;]?
      | [{}()\[\];]+
    )$""",
    re.X,
)
_DOCSTRING = re.compile(r"[ \t]*(?:async[ \t]+)?def\b[^:\n]*(?:\([^()]*\))?[^:\n]*:[ \t]*\r?\n\s*[rRuU]?(\"\"\"|''')(.*?)\1", re.S)
_TAG_NAME = re.compile(r"@(?:param|arg|tparam)\s+(?:\{[^}]*\}\s*)?\[?(\w+)|:param\s+(?:\w+\s+)?(\w+):|^\s*[-*]?\s*`?(\w+)`?\s*(?:\([^)]*\))?:\s", re.M)


def clean(block: str) -> str:
    """The text of a comment or docstring without its markers."""
    return "\n".join(_MARKUP.match(line).group(1) for line in block.splitlines()).strip()


def is_code(text: str) -> bool:
    """Whether the lines of a cleaned comment are statements rather than prose."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if not lines:
        return False
    code = sum(bool(_CODE_LINE.match(x)) for x in lines)
    return code * 3 >= len(lines) * 2 and not all(re.match(r"(?:import|from|use|package)\s+[\w\s]+$", x) for x in lines)


def words_left(text: str, name: str) -> int:
    """Words that say something about the function ``name``."""
    own = {p.lower() for p in _NAME_PART.findall(name)} | {name.lower()}
    found = _LETTERS.findall(_DIRECTIVE.sub(" ", text))
    left = 0
    for w in found:
        v = w.lower()
        parts = {p.lower() for p in _NAME_PART.findall(w)}
        if v in own or parts and parts <= own or v in MARKERS or v in TAGS or v in PLACEHOLDERS:
            continue
        left += 1
    return left


def trivial(text: str, name: str) -> bool:
    return is_code(text) or words_left(text, name) < LEAST_WORDS


class Source:
    """A text with its lines, each blank, of comments only, or with code."""

    def __init__(self, language: str, text: str):
        self.text, self.language = text, language
        self.starts = [0]
        for m in re.finditer(r"\r\n|\n|\r", text):
            self.starts.append(m.end())
        n = len(self.starts)
        tokens, errors = lex(language, text) if language != "bash" else ([], [])
        self.tokens = tokens
        self.guess = bool(errors)  # a broken text: its tokens cannot be trusted, the look of the lines is
        self.kind = ["blank"] * n
        self.first: dict[int, int] = {}  # line -> its first token
        self.last: dict[int, int] = {}
        self.comment: dict[int, tuple[int, int]] = {}  # line -> span of the comment over it
        for i, (k, a, b) in enumerate(tokens):
            if k == "l" or self.guess:
                continue
            lo, hi = self.line(a), self.line(max(a, b - 1))
            for x in range(lo, hi + 1):
                if k == "c":
                    self.comment.setdefault(x, (a, b))
                    if self.kind[x] == "blank":
                        self.kind[x] = "comment"
                else:
                    self.kind[x] = "code"
                    self.first.setdefault(x, i)
                    self.last[x] = i
        if language == "bash" or errors:  # by the look of each line
            open_block = False
            for x in range(n):
                s = self.line_text(x).strip()
                mark = ("#",) if language in ("bash", "python") else ("//", "/*", "#" if errors else "//", "*" if open_block else "//")
                if not s:
                    self.kind[x] = "blank"
                elif (s.startswith(mark) and not s.startswith(("#[", "#!", "#include"))) or open_block:
                    self.kind[x] = "comment"
                    self.comment[x] = (self.starts[x], self.starts[x] + len(self.line_text(x).rstrip("\r\n")))
                    open_block = (open_block or s.startswith("/*")) and "*/" not in s
                else:
                    self.kind[x] = "code"
        self.partner: dict[int, int] = {}
        stack: list[int] = []
        for i, (k, _, _) in enumerate(tokens):
            if k == "o":
                stack.append(i)
            elif k == "x" and stack:
                j = stack.pop()
                self.partner[i], self.partner[j] = j, i

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at) - 1

    def line_text(self, x: int) -> str:
        return self.text[self.starts[x] : self.starts[x + 1] if x + 1 < len(self.starts) else len(self.text)]

    def word(self, i: int) -> str:
        return self.text[self.tokens[i][1] : self.tokens[i][2]]

    def above_attributes(self, x: int) -> int:
        """The line before the attributes or decorators that end on line x; x if there are none."""
        while x >= 0 and self.kind[x] == "code":
            if x not in self.last:
                s = self.line_text(x).strip()
                if s.startswith(("#[", "@")):
                    x -= 1
                    continue
                return x
            i = self.last[x]
            top = self.line(self.tokens[self.partner[i]][1]) if i in self.partner and self.word(i) in ")]" else x
            f = self.first.get(top)
            if f is None:
                return x
            w = self.word(f)
            if w == "#" and f + 1 < len(self.tokens) and self.word(f + 1) == "[" or w == "@" or w.startswith("__attribute__") or w == "[" and self.language == "c":
                x = top - 1
            else:
                return x
        return x

    def block_ending(self, x: int) -> tuple[int, int] | None:
        """(first line, last line) of the comment-only lines that end on line x."""
        if x < 0 or self.kind[x] != "comment":
            return None
        top = x
        while top > 0 and self.kind[top - 1] == "comment":
            a, _ = self.comment.get(top, (0, 0))
            if self.text.startswith("/*", a) and self.line(a) == top and not self.text.startswith("/*", self.comment.get(top - 1, (0, 0))[0]):
                break  # a block comment stands for itself below line comments
            top -= 1
        return top, x

    def docstring(self, x: int) -> str | None:
        """The docstring of the Python function declared on line x."""
        if self.language != "python":
            return None
        if self.guess:
            m = _DOCSTRING.match(self.text, self.starts[x])
            return m.group(2) if m else None
        i = self.first.get(x)
        if i is None:
            return None
        depth, n = 0, len(self.tokens)
        while i < n:
            k, a, b = self.tokens[i]
            if k == "o":
                depth += 1
            elif k == "x":
                depth -= 1
            elif k == "p" and depth == 0 and self.text[a:b] == ":":
                break
            i += 1
        i += 1
        while i < n and self.tokens[i][0] in "cl":
            i += 1
        if i >= n or self.tokens[i][0] != "s":
            return None
        raw = self.word(i)
        m = re.match(r"(?i)([a-z]*)(\"\"\"|'''|\"|')", raw)
        if set(m.group(1).lower()) & set("fbt"):
            return None
        return raw[m.end() : -len(m.group(2))]


def _assign(weights: dict[tuple[int, int], float], blocks: int) -> dict[int, int]:
    """Block -> function of a matching of greatest weight, by augmenting paths of greatest gain."""
    near: dict[int, list[tuple[int, float]]] = {}
    for (b, f), w in weights.items():
        near.setdefault(b, []).append((f, w))
    of_block: dict[int, int] = {}
    of_function: dict[int, int] = {}
    for root in range(blocks):
        if root not in near:
            continue
        # Best gain of an alternating path from root, by relaxation.
        gain = {root: 0.0}
        via: dict[int, tuple[int, int]] = {}  # function -> (block before it)
        best_f, best = None, 0.0
        reach: dict[int, float] = {}
        queue = [root]
        while queue:
            b = queue.pop()
            for f, w in near[b]:
                g = gain[b] + w
                if g <= reach.get(f, 1e-12):
                    continue
                reach[f] = g
                via[f] = (b, f)
                other = of_function.get(f)
                if other is None:
                    if g > best:
                        best, best_f = g, f
                else:
                    back = g - weights[(other, f)]
                    if back > gain.get(other, 1e-12):
                        gain[other] = back
                        queue.append(other)
                    if back > best:  # the other block goes without
                        best, best_f = back, f
        f, seen = best_f, set()
        if f is None:
            continue
        loser = of_function.get(f)
        if loser is not None:
            of_block.pop(loser, None)
        while f is not None and f not in seen:
            seen.add(f)
            b = via[f][0]
            previous = of_block.get(b)
            of_block[b], of_function[f] = f, b
            f = previous if b != root else None
    return of_block


def pairs_of_file(path: str, text: str, symbols: list[dict], assign=None) -> list[tuple[int, str, str, str, int]]:
    """(number of the symbol, kind of documentation, description, code, distance) of the documented symbols."""
    language = language_of(path)
    if language is None or language in ("json", "toml"):
        return []
    src = Source(language, text)
    n = len(src.starts)
    order = sorted((i for i, s in enumerate(symbols) if s["start_line"] and 1 <= s["start_line"] <= n), key=lambda i: symbols[i]["start_line"])
    blocks: list[tuple[str, str]] = []  # (kind, text)
    spots: dict[tuple[int, int], int] = {}
    weights: dict[tuple[int, int], float] = {}  # (block, line of the declaration)
    gap_of: dict[tuple[int, int], int] = {}
    tags: list[set[str]] = []
    told: dict[tuple[int, int], list[int]] = {}  # the symbols of a line for which a block is not trivial

    def add(kind: str, body: str, number: int, gap: int, spot=None) -> None:
        name, line = symbols[number]["name"] or "", symbols[number]["start_line"]
        if trivial(body, name):
            return
        b = spots.get(spot) if spot else None
        if b is None:
            b = len(blocks)
            blocks.append((kind, body))
            tags.append({t for m in _TAG_NAME.findall(body) for t in m if t})
            if spot:
                spots[spot] = b
        signature = symbols[number]["signature"] or ""
        known = set(_LETTERS.findall(signature)) | set(re.findall(r"\w+", signature))
        named = bool(name and re.search(rf"\b{re.escape(name)}\b", body))
        if gap and not (tags[b] and tags[b] <= known or name and re.search(rf"`{re.escape(name)}(?:\(\))?`|\b{re.escape(name)}\(", body)):
            return  # implausible
        w = 10.0 if gap == 0 else 5.0 - gap
        if tags[b]:
            w += 2.0 * len(tags[b] & known) / len(tags[b])
        w += 0.5 * named
        key = b, line
        weights[key], gap_of[key] = max(w, weights.get(key, 0.0)), gap
        told.setdefault(key, []).append(number)

    for i in order:
        x = symbols[i]["start_line"] - 1
        if body := src.docstring(x):
            add("docstring", body.strip(), i, 0)
        y = src.above_attributes(x - 1)
        gap = 0
        while y >= 0 and gap <= REACH and src.kind[y] == "blank":
            y, gap = y - 1, gap + 1
        if span := src.block_ending(y):
            raw = "".join(src.line_text(k) for k in range(span[0], span[1] + 1))
            add("comment", clean(raw), i, gap, span)
    out = []
    for b, line in (assign or _assign)(weights, len(blocks)).items():
        for i in told[(b, line)]:
            first, last = line - 1, min(symbols[i]["end_line"] or line, n)
            code = "".join(src.line_text(k) for k in range(first, max(first + 1, last)))
            out.append((i, blocks[b][0], blocks[b][1], code, gap_of[(b, line)]))
    return sorted(out)


SCHEMA = "repo_id string, id string, relative_path string, qualified_name string, signature string, source string, description string, code string, distance bigint"


def _run(batches):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        for repo, path, text, symbols in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            symbols.sort(key=lambda s: (s["id"], s["start_line"] or 0))
            for i, kind, body, code, distance in pairs_of_file(path, text, symbols):
                s = symbols[i]
                for c, v in zip(rows, (repo, s["id"], path, s["qualified_name"], s["signature"], kind, body, code, distance), strict=True):
                    c.append(v)
        kinds = [pa.int64() if n == "distance" else pa.string() for n in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=names)


def pairs(symbols: DataFrame, content: DataFrame) -> DataFrame:
    """One row for each documented function or method."""
    live = symbols.filter("deleted_at IS NULL AND kind IN ('function', 'method') AND id IS NOT NULL")
    fields = ["id", "name", "qualified_name", "signature", "start_line", "end_line"]
    listed = live.groupBy("repo_id", F.col("file_path").alias("relative_path")).agg(
        F.collect_set(F.struct(*fields)).alias("symbols")
    )
    texts = content.filter("content IS NOT NULL").select("repo_id", "relative_path", "content")
    found = texts.join(listed, ["repo_id", "relative_path"]).select("repo_id", "relative_path", "content", "symbols")
    rest = [f.split()[0] for f in SCHEMA.split(", ")][2:]
    one = F.min(F.struct("distance", *rest[:-1])).alias("d")  # repeated contents give repeated rows, of which one is kept
    return found.mapInArrow(_run, SCHEMA).groupBy("repo_id", "id").agg(one).select("repo_id", "id", *[F.col(f"d.{c}") for c in rest])

"""Symbols and references of a source text, by its tokens.

``extract(path, text, language)`` gives symbols (id, name, kind, scope, lines, signature,
fingerprint) and references (source, target, kind, line). Brackets delimit bodies and a
stack of scopes names them; Python goes by its own parser. Texts that do not parse give
what can still be told. Ids are ``path::scope::name@byte``; lines count from 1. A test refers
to what it tests: the called function that its name names, or else the name itself. Files of a language without rules
of its own give one-line functions by pattern.
"""

from __future__ import annotations

import ast
import hashlib
import re
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.functions import paths
from codeloom.functions.lexing import lex

# Words that look like calls and are none.
_NOT_CALLS = set(
    "if for while switch match return sizeof typeof catch function func fn def class new await async else do try loop in not and or"
    " with elif except yield lambda print_r super import export default case delete void throw typeof unsafe move where impl struct"
    " enum trait type interface constructor defined".split()
)
#: Calls that are tests, by language.
_RUNNERS = {"javascript": {"test", "it", "describe"}, "typescript": {"test", "group"}, "dart": {"test", "group"}, "go": {"test", "group"}, "cpp": {"test", "group"}}
# Calls that say nothing about what a test is for.
_HELPERS = {
    "assert", "assert_eq", "assert_ne", "assert_matches", "debug_assert", "debug_assert_eq", "unwrap", "expect", "panic",
    "todo", "unimplemented", "dbg", "println", "print", "eprintln", "format", "write", "writeln", "vec", "Some", "None",
    "Ok", "Err", "clone", "to_string", "to_owned", "new", "default", "String", "matches", "pytest", "raises",
}
#: Languages in which every kind of symbol is the source of what stands in it.
_NESTED = {"typescript", "go", "cpp", "dart"}


def _digest(text: str) -> str:
    return hashlib.sha256(text.strip().encode()).hexdigest()


class _Found:
    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.symbols: list[dict] = []
        self.references: list[dict] = []
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.ascii = text.isascii()

    def line(self, at: int) -> int:
        import bisect

        return bisect.bisect_left(self.breaks, at) + 1

    def byte(self, at: int) -> int:
        return at if self.ascii else len(self.text[:at].encode())

    def symbol(self, name: str, kind: str, scope: str, a: int, b: int, signature: str | None = None) -> dict:
        body = self.text[a:b]
        s = {
            "id": f"{self.path}::{scope}::{name}@{self.byte(a)}", "name": name, "qualified_name": f"{self.path}::{name}", "kind": kind,
            "start_line": self.line(a), "end_line": self.line(max(a, b - 1)),
            "signature": signature or body.split("\n", 1)[0].rstrip("\r"), "fingerprint": _digest(body), "span": (a, b),
        }
        self.symbols.append(s)
        return s

    def reference(self, source: dict | None, target: str, kind: str, at: int) -> None:
        self.references.append(
            {"source_symbol_name": source["name"] if source else None, "source_symbol_id": source["id"] if source else None,
             "target_name": target, "kind": kind, "line_number": self.line(at)}
        )


def _python(found: _Found) -> bool:
    text = found.text
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    starts = [0]
    for part in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(part))
    lines = text.splitlines(keepends=True)

    def at(line: int, col: int) -> int:
        part = lines[line - 1] if line <= len(lines) else ""
        return starts[line - 1] + (col if part.isascii() else len(part.encode()[:col].decode(errors="ignore")))

    def visit(node: ast.AST, scope: tuple[str, ...], owner: dict | None) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            s = found.symbol(node.name, kind, "::".join(scope), at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset))
            if kind == "function" and node.name.startswith("test_"):
                found.reference(s, node.name, "tests", at(node.lineno, node.col_offset))
            for d in node.decorator_list:
                visit(d, scope, owner)
            for child in ast.iter_child_nodes(node):
                if child not in node.decorator_list:
                    visit(child, (*scope, node.name), s)
            return
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            a = at(node.lineno, node.col_offset)
            found.reference(None, text[a : at(node.end_lineno, node.end_col_offset)], "imports", a)
        if isinstance(node, ast.Call):
            f = node.func
            name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None
            if name:
                found.reference(owner, name, "calls", at(node.lineno, node.col_offset))
        for child in ast.iter_child_nodes(node):
            visit(child, scope, owner)

    for child in tree.body:
        visit(child, (), None)
    return True


# Fixed value: the pattern of one-line functions.
_FALLBACK = re.compile(r"^(?:pub\s+)?(?:async\s+)?def\s+([A-Za-z0-9_]+)|^fn\s+([A-Za-z0-9_]+)|function\s+([A-Za-z0-9_]+)")


def _fallback(found: _Found) -> None:
    """One-line symbols by pattern, no references."""
    at = 0
    for line in found.text.split("\n"):
        if m := _FALLBACK.search(line.strip()):
            a = at + len(line) - len(line.lstrip())
            found.symbol(m.group(1) or m.group(2) or m.group(3), "function", "", a, a + len(line.strip()))
        at += len(line) + 1


_SHELL_FUNCTION = re.compile(r"^([ \t]*)(?:function[ \t]+([\w:.-]+)[ \t]*(?:\([ \t]*\))?|([\w:.-]+)[ \t]*\([ \t]*\))[ \t]*(?:\n[ \t]*)?\{", re.M)
_SHELL_WORD = re.compile(r"(?:^|[;&|({`]|\$\(|\bthen\b|\bdo\b|\belse\b)[ \t]*(?:\w+=\S*[ \t]+)*([A-Za-z_][\w.-]*)", re.M)
_SHELL_KEYWORDS = set("if then else elif fi for while until do done case esac in function select time local export declare readonly return".split())


_SHELL_TEXT = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'[^']*'|(?<![^\s;&|(])#[^\n]*", re.S)
_SHELL_VALUE = r"[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=(?:\"[^\"]*\"|'[^']*'|\$\((?:[^()]|\([^()]*\))*\)|\$\{[^}]*\}|\((?:[^()]|\([^()]*\))*\)|\\.|[^\s;&|()\"'`])*"
_SHELL_VARIABLES = re.compile(
    rf"(?:^|[;&|({{`]|\$\(|\b(?:then|do|else|local|export|declare|readonly|typeset)\b(?:[ \t]+-\w+)*)[ \t]*((?:{_SHELL_VALUE}[ \t]+)*{_SHELL_VALUE})", re.M
)


def _quiet(m: re.Match) -> str:
    """A quoted text or comment of the same length in which no command stands."""
    t = m.group()
    if t[0] == '"' and ("$(" in t or "`" in t):
        return t
    return t[0] + re.sub(r"[^\n]", "_", t[1:-1]) + t[-1] if t[0] != "#" else " " * len(t)


def _bash(found: _Found) -> None:
    whole = found.text
    text = _SHELL_TEXT.sub(_quiet, whole)
    for m in _SHELL_FUNCTION.finditer(text):
        end = text.find("\n" + m.group(1) + "}", m.end())
        stop = end + 2 + len(m.group(1)) if end >= 0 else len(text)
        name = m.group(2) or m.group(3)
        found.symbol(name, "function", "", m.start() + len(m.group(1)), stop, f"function {name}()")
    owners = [(s["span"], s) for s in found.symbols]
    for m in _SHELL_VARIABLES.finditer(text):
        for v in re.finditer(_SHELL_VALUE, m.group(1)):
            a, b = m.start(1) + v.start(), m.start(1) + v.end()
            scope = [s["name"] for (x, y), s in owners if x <= a < y]
            found.symbol(re.match(r"\w+", v.group()).group(), "variable", "::".join(scope), a, b, whole[a:b].split("\n", 1)[0])
    for m in _SHELL_WORD.finditer(text):
        w = m.group(1)
        if w in _SHELL_KEYWORDS or text[m.end() : m.end() + 1] in ("=", "("):
            continue
        owner = next((s for (a, b), s in owners if a <= m.start(1) < b), None)
        found.reference(owner, w, "calls", m.start(1))


def _braces(found: _Found, language: str) -> None:
    text = found.text
    tokens = [t for t in lex({"cpp": "c", "dart": "typescript"}.get(language, language), text, whole=True)[0] if t[0] not in "l"]
    kept = [t for t in tokens if t[0] != "c"]
    word = [text[a:b] for _, a, b in kept]
    kind = [k for k, _, _ in kept]
    n = len(kept)
    partner: dict[int, int] = {}
    stack: list[int] = []
    for i in range(n):
        if kind[i] == "o":
            stack.append(i)
        elif kind[i] == "x" and stack:
            j = stack.pop()
            partner[j] = i
    opened = {c: o for o, c in partner.items()}
    start = lambda i: kept[i][1]
    scopes: list[tuple[int, str]] = []  # (token at which it ends, name)
    owners: list[tuple[int, dict]] = []
    modifiers = {
        "rust": {"pub", "async", "unsafe", "const", "extern", "default"}, "javascript": {"async", "static", "get", "set"},
        "typescript": {"async", "static", "get", "set", "public", "private", "protected", "readonly", "abstract", "override"},
        "go": set(), "c": set(), "cpp": set(), "dart": {"abstract", "sealed", "base", "final", "interface", "mixin", "static", "external"},
    }[language]

    def body_from(i: int) -> int | None:
        """The token that opens the body behind i, at the same depth; None if a ; comes first."""
        while i < n:
            if word[i] == "{" and kind[i] == "o":
                return i
            if word[i] == ";" or kind[i] == "x":
                return None
            i = partner[i] + 1 if i in partner else i + 1
        return None

    def begin(i: int) -> int:
        while i > 0 and (word[i - 1] in modifiers or word[i - 1] == ")" and language == "rust" and word[i - 4 : i - 2] == ["pub", "("]):
            i -= 3 if word[i - 1] == ")" else 1
            if language == "rust" and word[i] != "pub" and word[i - 1 : i] == ["pub"]:
                i -= 1
        return i

    def declare(name: str, what: str, first: int, open_: int | None, enter: bool = True) -> dict:
        close = partner.get(open_, n - 1) if open_ is not None else None
        end = kept[close][2] if close is not None else kept[min(n - 1, first)][2]
        if open_ is None:
            j = first
            while j < n and word[j] != ";":
                j = partner[j] + 1 if j in partner else j + 1
            end = kept[min(j, n - 1)][2]
        s = found.symbol(name, what, "::".join(x for _, x in scopes), start(first), end)
        if open_ is not None and enter:
            scopes.append((close, name))
            if what in ("function", "method") or language in _NESTED or language != "c" and what != "variable":
                owners.append((close, s))
        return s

    def tested(i: int, first: int, close: int | None) -> bool:
        """Whether a Rust function is a test: by its name, an attribute before it that says so, or one in or shortly before it."""
        a, b = start(first), kept[close][2] if close is not None else start(first)
        j = first - 1
        while j >= 0 and word[j] == "]" and kind[j] == "x":
            open_ = opened.get(j)
            if not open_ or word[open_ - 1] != "#":
                break
            if "test" in text[start(open_) : kept[j][2]]:
                return True
            j = open_ - 2
        return word[i + 1].startswith("test_") or "#[test]" in text[a:b] or "#[test]" in text[max(0, a - 256) : a]

    def after_signature(j: int) -> int | None:
        """The token that opens a C++ function's body behind its parameters; None if there is none."""
        while j < n:
            if word[j] == "{" and kind[j] == "o":
                return j
            if word[j] == ":":  # what the members are made with
                j += 1
                while j < n and kind[j] == "w":
                    while j < n and (kind[j] == "w" or word[j] in ("::", "<", ">", ":")):
                        j += 1
                    if j not in partner:
                        return None
                    j = partner[j] + 1
                    if word[j : j + 1] == [","]:
                        j += 1
                continue
            if kind[j] == "w" or word[j] in ("->", "::", "&", "*", "&&", "<", ">", ","):
                j += 1
            elif kind[j] == "o" and word[j] in "([" and j in partner:
                j = partner[j] + 1
            else:
                return None
        return None

    i = 0
    while i < n:
        while scopes and scopes[-1][0] < i:
            scopes.pop()
        while owners and owners[-1][0] < i:
            owners.pop()
        k, w = kind[i], word[i]
        owner = owners[-1][1] if owners else None
        nxt = word[i + 1] if i + 1 < n else ""
        if k == "d" and language in ("c", "cpp"):
            m = re.match(r"\s*#\s*include\s*(.+?)\s*$", text[kept[i][1] : kept[i][2]])
            if m:
                found.reference(owner if language == "cpp" else None, text[kept[i][1] : kept[i][2]].strip(), "imports", start(i))
        elif language == "rust" and w == "#" and (nxt == "[" or nxt == "!" and word[i + 2 : i + 3] == ["["]):
            i = partner.get(i + 1 + (nxt == "!"), i) + 1  # attributes and the arguments of macros hold no calls
            continue
        elif language == "rust" and k == "w" and nxt == "!" and kept[i][2] == start(i + 1) and i + 2 in partner:
            i = partner[i + 2] + 1
            continue
        elif k == "w" and not (i and word[i - 1] in (".", "?.")):
            if language == "rust":
                if w == "fn" and kind[i + 1 : i + 2] == ["w"]:
                    first, o = begin(i), body_from(i + 2)
                    s = declare(nxt, "function", first, o)
                    if tested(i, first, partner.get(o) if o is not None else None):
                        found.reference(s, nxt, "tests", start(first))
                    i += 2
                    continue
                if w in ("struct", "enum", "trait") and kind[i + 1 : i + 2] == ["w"]:
                    declare(nxt, w, begin(i), body_from(i + 2))
                    i += 2
                    continue
                if w in ("impl", "mod") and (o := body_from(i + 1)) is not None:
                    names = [x for x, y in zip(word[i + 1 : o], kind[i + 1 : o], strict=True) if y == "w"]
                    if "for" in names:
                        names = names[names.index("for") + 1 :]
                    if names:
                        scopes.append((partner.get(o, n), names[0]))
                    i = o + 1
                    continue
                if w == "use":
                    j = i
                    while j < n and word[j] != ";":
                        j += 1
                    found.reference(None, text[start(i) : start(j) if j < n else len(text)].removeprefix("use ").strip(), "imports", start(i))
                    i = j + 1
                    continue
            elif language == "go":
                if w == "func" and (kind[i + 1 : i + 2] == ["w"] or nxt == "("):
                    j = i + 1
                    what = "function"
                    if nxt == "(" and j in partner and kind[partner[j] + 1 : partner[j] + 2] == ["w"] and not owners:
                        j, what = partner[j] + 1, "method"
                    if kind[j] == "w":
                        o = body_from(partner.get(j + 1, j) + 1) if word[j + 1 : j + 2] == ["("] else body_from(j + 1)
                        declare(word[j], what, i, o)
                        i = j + 1
                        continue
                if w == "type" and kind[i + 1 : i + 2] == ["w"]:
                    line = next((t for t in range(i + 2, n) if found.line(start(t)) > found.line(start(i))), n)
                    o = next((t for t in range(i + 2, line) if word[t] == "{" and kind[t] == "o"), None)
                    last = partner.get(o, n - 1) if o is not None else line - 1
                    found.symbol(nxt, "type_alias", "::".join(x for _, x in scopes), start(i + 1), kept[last][2])
                    i += 2
                    continue
                if w == "import":
                    j = i + 1
                    stop = partner.get(j, j)
                    for x in range(j, stop + 1):
                        if kind[x] == "s":
                            found.reference(owner, text[kept[x][1] : kept[x][2]], "imports", start(x))
                    i = stop + 1
                    continue
            elif language in ("javascript", "typescript"):
                inside = scopes[-1] if scopes else None
                if w == "function":
                    j = i + 1 + (nxt == "*")
                    if kind[j : j + 1] == ["w"]:
                        declare(word[j], "function", begin(i), body_from(j + 1))
                        i = j + 1
                        continue
                elif w in ("class", "interface", "enum") and kind[i + 1 : i + 2] == ["w"] and (w == "class" or language == "typescript"):
                    declare(nxt, w, begin(i), body_from(i + 2))
                    i += 2
                    continue
                elif nxt == "(" and inside and i + 1 in partner and word[partner[i + 1] + 1 : partner[i + 1] + 2] and w not in _NOT_CALLS:
                    p = partner[i + 1] + 1
                    in_function = owners and owners[-1][0] == scopes[-1][0] and owners[-1][1]["kind"] in ("function", "method")
                    is_method = word[p] == "{" or language == "typescript" and word[p] == ":" and body_from(p) is not None
                    if is_method and not in_function:
                        declare(w, "function" if language == "javascript" else "method", begin(i), body_from(p))
                        i += 1
                        continue
                if w == "type" and language == "typescript" and kind[i + 1 : i + 2] == ["w"] and word[i + 2 : i + 3] and word[i + 2] in ("=", "<"):
                    j = i
                    while j + 1 < n and word[j] != ";" and not (j > i + 2 and kind[j] == "w" and found.line(start(j)) > found.line(kept[j - 1][1]) and word[j - 1] not in ("=", "|", "&", "<", ",")):
                        j = partner[j] + 1 if j in partner else j + 1
                    found.symbol(nxt, "type_alias", "::".join(x for _, x in scopes), start(i), kept[min(j, n - 1)][2] if word[min(j, n - 1)] == ";" or j + 1 >= n else kept[j - 1][2])
                    i += 2
                    continue
                if w == "import" and nxt != "(":
                    j = i
                    while j + 1 < n and word[j] != ";" and kind[j] != "s":
                        j += 1
                    if word[j + 1 : j + 2] == [";"]:
                        j += 1
                    found.reference(owner if language == "typescript" else None, text[start(i) : kept[j][2]], "imports", start(i))
                    i = j + 1
                    continue
            elif language == "c":
                if w == "struct" and kind[i + 1 : i + 2] == ["w"] and word[i + 2 : i + 3] == ["{"]:
                    declare(nxt, "struct", i, i + 2)
                    i += 3
                    continue
                if not owners and nxt == "(" and i + 1 in partner and w not in _NOT_CALLS and word[partner[i + 1] + 1 : partner[i + 1] + 2] == ["{"]:
                    f = i
                    while f > 0 and (kind[f - 1] == "w" or word[f - 1] == "*"):
                        f -= 1
                    declare(w, "function", f, partner[i + 1] + 1)
                    i += 2
                    continue
            elif language == "cpp":
                if w == "namespace" and kind[i + 1 : i + 2] == ["w"] and (o := body_from(i + 2)) is not None:
                    declare(nxt, "module", i, o)
                    i += 2
                    continue
                j = i + 1 + (w == "enum" and nxt in ("class", "struct"))
                if w in ("class", "struct", "enum") and kind[j : j + 1] == ["w"] and word[j + 1 : j + 2] and word[j + 1] in ("{", ":", "final"):
                    declare(word[j], w, i, body_from(j + 1))
                    i = j + 1
                    continue
                if nxt == "(" and i + 1 in partner and w not in _NOT_CALLS and (o := after_signature(partner[i + 1] + 1)) is not None and (not owners or owners[-1][1]["kind"] not in ("function", "method")):
                    f = i
                    while f > 0 and (kind[f - 1] == "w" and word[f - 1] not in ("return", "public", "private") or word[f - 1] in ("*", "&", "::", "<", ">", ",", "~") or word[f - 1] == ":" and word[f - 2 : f - 1] == [":"]):
                        f -= 1
                    declare(w, "function", f, o)
                    i = o  # members that are made on the way are no calls
                    continue
            elif language == "dart":
                if w in ("class", "mixin", "enum", "extension") and kind[i + 1 : i + 2] == ["w"] and nxt != "class":
                    declare(nxt, "enum" if w == "enum" else "class", begin(i), body_from(i + 2))
                    i += 2
                    continue
                if w == "import" and kind[i + 1 : i + 2] == ["s"]:
                    j = next((t for t in range(i, n) if word[t] == ";"), n - 1)
                    found.reference(owner, text[start(i) : kept[j][2]], "imports", start(i))
                    i = j + 1
                    continue
                if nxt == "(" and i + 1 in partner and w not in _NOT_CALLS and word[i - 1 : i] != ["."]:
                    o = partner[i + 1] + 1
                    while word[o : o + 1] and word[o] in ("async", "sync", "*"):
                        o += 1
                    f = i
                    while f > 0 and (kind[f - 1] == "w" and word[f - 1] not in ("return", "await", "throw", "new", "yield") or word[f - 1] in ("<", ">", "?", ",") and f > 1 and word[f - 2] not in ("(",)):
                        f -= 1
                    typed = f < i or not owners or owners[-1][1]["kind"] == "class"
                    if word[o : o + 1] and word[o] in ("{", "=>") and typed and (f == 0 or word[f - 1] in (";", "{", "}", "]", ")")) and (not owners or word[f - 1] in (";", "{", "}", "]")):
                        inside = owners and owners[-1][1]["kind"] == "class"
                        declare(w, "method" if inside else "function", f, o if word[o] == "{" else None)
                        i += 2
                        continue
        if k == "w" and nxt == "(" and w not in _NOT_CALLS and not (language == "rust" and i and word[i - 1] == "fn"):
            runs = w in _RUNNERS.get(language, ())
            found.reference(owner, w, "tests" if runs else "calls", start(i))
            if runs and language != "javascript" and kind[i + 2 : i + 3] == ["s"]:
                label = text[kept[i + 2][1] + 1 : kept[i + 2][2] - 1]
                if label and not any(x["name"] == label for x in found.symbols):
                    s = found.symbol(label, "function", "::".join(x for _, x in scopes), start(i), kept[i + 2][2], f"{w}('{label}')")
                    s["fingerprint"] = _digest(label)
        i += 1


def _target(test: str, calls: list[str]) -> str | None:
    """What a test is for: a called function with its name, one whose name begins alike, its own name, or what it calls first."""
    name = test.removeprefix("test_") or test
    if name in calls:
        return name
    for c in calls:
        if c.startswith(name) or name.startswith(c) and len(c.encode()) >= 4:
            return c
    return name if name != test else calls[0] if calls else None


def _retarget(references: list[dict]) -> None:
    """Points the references of tests to what they test instead of to themselves."""
    calls: dict[str | None, list[dict]] = {}
    for r in references:
        if r["kind"] == "calls" and (r["source_symbol_name"] or "").startswith("test_") and r["target_name"] not in _HELPERS and not r["target_name"].startswith("assert"):
            calls.setdefault(r["source_symbol_id"], []).append(r)
    for r in references:
        if r["kind"] == "tests" and r["source_symbol_name"] and r["target_name"] == r["source_symbol_name"]:
            own = calls.get(r["source_symbol_id"], [])
            target = _target(r["source_symbol_name"], [c["target_name"] for c in own])
            if target:
                r["line_number"] = next((c["line_number"] for c in own if c["target_name"] == target), r["line_number"])
                r["target_name"] = target


def language_of(path: str) -> str:
    """By the extension, as the catalog has it; ``unknown`` for others."""
    name = path.rsplit("/", 1)[-1].lower()
    ext = name.rsplit(".", 1)[1] if "." in name[1:] else ""
    return next((n for n, e in paths.LANGUAGES.items() if ext in e), "unknown")


def extract(path: str, text: str, language: str | None = None) -> tuple[list[dict], list[dict]]:
    """Symbols and references of one file."""
    found = _Found(path, text)
    language = language or language_of(path)
    if language == "python":
        _python(found) or _fallback(found)
    elif language == "bash":
        _bash(found)
    elif language in ("rust", "go", "javascript", "typescript", "c", "cpp", "dart"):
        _braces(found, language)
    else:
        _fallback(found)
    _retarget(found.references)
    return found.symbols, found.references


#: Texts that hold no code.
_NO_CODE = {"html", "css", "json", "toml", "yaml", "markdown", "sql"}


SYMBOLS = "repo_id string, file_path string, id string, name string, qualified_name string, kind string, start_line bigint, end_line bigint, signature string, fingerprint string"
REFERENCES = "repo_id string, source_file string, source_symbol_name string, source_symbol_id string, target_name string, kind string, line_number bigint"
_KINDS = {"string": pa.string(), "bigint": pa.int64()}


def _table(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _KINDS[t]) for n, t in fields], names=[n for n, _ in fields])


def _run(which: int, schema: str, key: str):
    def run(batches):
        for b in batches:
            rows = []
            for repo, path, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if path and text and language_of(path) not in _NO_CODE:
                    rows += [{"repo_id": repo, key: path, **r} for r in extract(path, text)[which]]
            yield _table(rows, schema)

    return run


def extract_symbols(content: DataFrame) -> DataFrame:
    """Symbols of every file (repo_id, relative_path, content) of a parsed language."""
    return content.select("repo_id", "relative_path", "content").mapInArrow(_run(0, SYMBOLS, "file_path"), SYMBOLS)


def extract_references(content: DataFrame) -> DataFrame:
    """References of every file of a parsed language."""
    return content.select("repo_id", "relative_path", "content").mapInArrow(_run(1, REFERENCES, "source_file"), REFERENCES)

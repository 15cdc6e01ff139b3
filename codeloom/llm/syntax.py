"""Source files that do not parse: a lexer and a pushdown stack for each language.

The lexer (``lexing``) reports unterminated literals and comments and characters that
the language lacks. Its tokens run through a stack of brackets and block words, which
finds unbalanced delimiters, premature ends and merge-conflict markers in code, and
through rules on what may follow what, which find text of another language under a
wrong extension. Text inside strings and comments never counts.

What the stack accepts is no case. For Python, JSON and TOML a parser of the standard library looks at the texts that
the stack rejects, and may acquit them.

Defined results: null content is no case; empty content is one only for JSON. Files with
other extensions are no case. Repeated rows give one row; if the rows of a file differ,
it is a case if any is. Files are judged one at a time, in one pass without a shuffle
but for the final distinct.
"""

from __future__ import annotations

import ast
import bisect
import json
import re
import tomllib
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.lexing import language_of, lex
from codeloom.llm.grammars import check_python, check_toml

Fault = tuple[str, int]
_PAIR = {")": "(", "]": "[", "}": "{"}
_RUST_DOC = re.compile(r"///(?!/)|/\*\*(?![*/])")
_MARKER = re.compile(r"(?:<{7}|>{7}|={7}|\|{7})(?=\s|$)")

# ---- words

_JS_KEYWORDS = set(
    "await break case catch class const continue debugger default delete do else export extends finally for function if"
    " import in instanceof let new return static switch throw try typeof var void while with yield async of".split()
)
_JS_AFTER = _JS_KEYWORDS | set("get set from as accessor using enum".split())
_JS_EXPORTED = set("default function class const let var async import as".split())
_TS_EXPORTED = set("type interface enum abstract declare namespace module".split())
_JS_OPERATOR_WORDS = set("in instanceof of as from".split())
_TS_AFTER = set(
    "type interface enum namespace module declare abstract readonly public private protected keyof infer unique asserts"
    " override implements out is global satisfies require".split()
)
_TS_OPERATOR_WORDS = set("satisfies is extends implements asserts".split())
_GO_KEYWORDS = set(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range"
    " return select struct switch type var".split()
)
_GO_TOP = set("package import func type var const".split())
_RUST_AFTER = set(
    "fn pub let mut ref use mod struct enum trait impl for in as where return break continue move async unsafe extern crate"
    " const static type dyn loop while if else match box macro_rules union default yield auto raw await safe try gen".split()
)
_RUST_INFIX = set("as if else in for where await is fn let".split())
_RUST_TOP = set(
    "fn pub use mod struct enum trait impl const static type extern unsafe async macro_rules union crate default auto macro safe".split()
)
_C_TYPES = set(
    "auto const volatile static extern register inline typedef struct union enum unsigned signed int char short long float"
    " double void _Bool bool _Noreturn restrict constexpr thread_local _Thread_local _Atomic _Alignas alignas".split()
)
_C_STATEMENTS = set("return if for while break continue switch goto case default do else".split())
_C_WORDS = _C_TYPES | _C_STATEMENTS | set("sizeof typeof _Generic".split())

_NEEDS_LEFT = set("== != === !== <= >= / % = += -= *= /= %= << >> >>> ^ && || ?? ?. |= &= ^= <<= >>= := =>".split())
_NEEDS_RIGHT = (_NEEDS_LEFT - {">>", ">>>"}) | set("+ - . -> <".split())
_OPERAND_ENDS = {">", ">>", ">>>", "++", "--", "!", "?", "*"}


class _Run:
    """The tokens that count, with what was between them."""

    def __init__(self, language: str, text: str):
        self.language, self.text = language, text
        tokens, self.errors = lex(language, text)
        self.kind: list[str] = []
        self.word: list[str] = []
        self.at: list[int] = []
        self.fresh: list[bool] = []  # a line end came before
        self.docs: list[int] = []  # documentation comments of Rust
        find = text.find
        lone = text.count("\r") > text.count("\r\n")  # line ends of a carriage return alone
        end, nl = 0, find("\n")
        kind, word, at, fresh = self.kind.append, self.word.append, self.at.append, self.fresh.append
        first = True
        for k, a, b in tokens:
            if k == "c" or k == "l":
                if language == "rust" and k == "c" and _RUST_DOC.match(text, a, b):
                    self.docs.append(a)
                continue
            kind(k)
            word(text[a:b] if k not in "srd" or b - a < 40 else text[a : a + 40])
            at(a)
            fresh(first or 0 <= nl < a or lone and "\r" in text[end:a])
            first, end = False, b
            if 0 <= nl < b:
                nl = find("\n", b)


def _brackets(run: _Run) -> tuple[Fault | None, dict[int, int]]:
    """The first unbalanced delimiter or marker, and the partner of each bracket."""
    stack: list[int] = []
    partner: dict[int, int] = {}
    saved: list[list[int]] = []
    text = run.text
    for i, k in enumerate(run.kind):
        if k == "o":
            stack.append(i)
        elif k == "x":
            opener = run.word[stack[-1]][-1] if stack else ""
            if opener != _PAIR[run.word[i]]:
                return (f"unbalanced {run.word[i]}", run.at[i]), partner
            j = stack.pop()
            partner[i], partner[j] = j, i
        elif k == "p":
            a = run.at[i]
            if run.fresh[i] and (a == 0 or text[a - 1] in "\r\n") and _MARKER.match(text, a):
                return ("merge-conflict marker", a), partner
            if run.word[i] == "*" and text.startswith("*/", a) and run.language not in ("python", "toml"):
                return ("stray */", a), partner
        elif k == "d":
            m = re.match(r"[ \t]*#[ \t]*(\w*)", run.word[i])
            name = m.group(1) if m else ""
            if not name and run.word[i].strip(" \t#\\\r\n"):
                return ("unknown directive", run.at[i]), partner
            if name.isdigit():  # a line marker
                name = ""
            if name in ("if", "ifdef", "ifndef"):
                saved.append(stack[:])
            elif name in ("else", "elif", "elifdef", "elifndef"):
                if not saved:
                    return ("#else without #if", run.at[i]), partner
                stack = saved[-1][:]
            elif name == "endif":
                if not saved:
                    return ("#endif without #if", run.at[i]), partner
                saved.pop()
            elif name not in ("define", "undef", "include", "line", "error", "warning", "pragma", "embed", "include_next", "ident", "import", ""):
                return ("unknown directive", run.at[i]), partner
    if stack:
        return (f"unclosed {run.word[stack[-1]]}", run.at[stack[-1]]), partner
    if saved:
        return ("#if without #endif", len(text)), partner
    return None, partner


def _operators(run: _Run, skip: list[bool]) -> Fault | None:
    """Binary operators without one of their operands."""
    lang, kind, word = run.language, run.kind, run.word
    left = set(_NEEDS_LEFT)
    right = set(_NEEDS_RIGHT)
    if lang == "rust":
        left -= {"||", "&&", "<<", "=>"}
        right -= {"||", "<", "&&", "+"}
    if lang in ("typescript", "javascript"):
        left -= {"<<", "=>"}
        right -= {"<"}
        if lang == "typescript":
            right -= {"+", "-"}
    n = len(kind)
    for i in range(n):
        if kind[i] != "p" or skip[i]:
            continue
        w = word[i]
        if w in left:
            p = i - 1
            if p < 0 or kind[p] == "o" or kind[p] == "p" and word[p] not in _OPERAND_ENDS and not (w == "=" and word[p] in "&|"):
                if lang == "go" and w == ":=" or lang == "c" and w == "=" and p >= 0 and word[p] == "]":
                    continue
                return f"operator {w} without left side", run.at[i]
        if w in right:
            q = i + 1
            if q >= n or kind[q] == "x" or kind[q] == "p" and word[q] in (";", ","):
                if lang == "go" and w == "." or lang == "javascript" and w == "=>":
                    continue
                return f"operator {w} without right side", run.at[i]
    return None


def _operand_end(kind: str, word: str) -> bool:
    return kind in "snr" or kind == "w" or kind == "x"


def _check_js(run: _Run, partner: dict[int, int]) -> Fault | None:
    ts = run.language == "typescript"
    kind, word, fresh, at = run.kind, run.word, run.fresh, run.at
    after = _JS_AFTER | _TS_AFTER if ts else _JS_AFTER
    infix = _JS_OPERATOR_WORDS | _TS_OPERATOR_WORDS if ts else _JS_OPERATOR_WORDS
    frames: list[str] = []
    types: list[int] = []  # depth at which a function waits for its body after a return type
    class_at = -1
    head_at = -1  # interface, enum, namespace: their brace is next
    n = len(kind)
    for i in range(n):
        k, w = kind[i], word[i]
        p = i - 1
        pk, pw = (kind[p], word[p]) if p >= 0 else ("", "")
        member = pw in (".", "?.")
        if k == "o":
            if w == "{":
                if class_at >= 0:
                    frame, class_at = "class", -1
                elif head_at >= 0:
                    frame, head_at = "fields", -1
                elif pw == "=>":
                    frame = "function"
                elif pw == ")" and p in partner:
                    o = partner[p]
                    b = word[o - 1] if o else ""
                    if b == "await" and o > 1:
                        b = word[o - 2]
                    head = word[o - 2] if o > 1 else ""
                    if (
                        (not frames or frames[-1] in ("block", "function", "loop", "switch"))
                        and o and kind[o - 1] == "w" and b not in _JS_KEYWORDS and head not in ("function", "*") and not fresh[i]
                    ):
                        return "unexpected {", at[i]
                    if b in ("for", "while"):
                        frame = "loop"
                    elif b == "switch":
                        frame = "switch"
                    elif b in ("if", "catch", "with"):
                        frame = "block"
                    else:
                        frame = "function"
                elif types and types[-1] == len(frames) and pw not in (":", "|", "&", "<", ","):
                    frame = "function"
                    types.pop()
                elif pw == "do":
                    frame = "loop"
                elif pw in ("else", "try", "finally", "catch", "static") and pk == "w":
                    frame = "block"
                elif p < 0 or pw in (";", "}") or pk == "o" and pw == "{" and frames and frames[-1] in ("block", "function", "loop", "switch") or (
                    pw == ":" and frames and frames[-1] == "switch"
                ):
                    frame = "block"
                else:
                    frame = "object"
                frames.append(frame)
            else:
                frames.append(w)
            if w == "{" and pk in "sn" and not fresh[i] and not types and pk != "":
                return "unexpected {", at[i]
            if not fresh[i] and pk == "w" and w == "{" and pw not in after and frames[-1] == "object" and pw not in infix and pk:
                if not (ts or word[p - 1 : p] == ["class"]):
                    return "unexpected {", at[i]
        elif k == "x":
            while types and types[-1] >= len(frames):
                types.pop()
            if frames:
                frames.pop()
            if ts and w == ")" and i + 1 < n and word[i + 1] == ":":
                o = partner[i]
                b = word[o - 1] if o else ""
                if b not in ("if", "for", "while", "switch"):
                    types.append(len(frames))
        if member:
            continue
        if k == "w" and not (i + 1 < n and word[i + 1] == ":" and kind[i + 1] == "p" and frames and frames[-1] in ("object", "fields")):
            inside = frames[-1] if frames else ""
            if w[0] == "#" and "class" not in frames:
                return "stray #", at[i]
            if w == "class" and inside not in ("class", "fields"):
                class_at = i
            elif w in ("interface", "enum", "namespace", "module") and ts and i + 1 < n and kind[i + 1] == "w" and not fresh[i + 1]:
                head_at = i
            elif w == "return" and inside not in ("class", "object", "fields") and "function" not in frames:
                return "return outside of a function", at[i]
            elif w in ("break", "continue") and inside not in ("class", "object", "fields"):
                home = next((f for f in reversed(frames) if f in ("loop", "function") or f == "switch" and w == "break"), "")
                labelled = i + 1 < n and kind[i + 1] == "w" and not fresh[i + 1]
                if home in ("", "function") and not labelled and not _single_loop(word, kind, partner, i):
                    return f"{w} outside of a loop", at[i]
            elif w == "case" and inside not in ("switch", "class", "object", "fields"):
                return "case outside of a switch", at[i]
            elif w == "const" and not (ts and i + 1 < n and word[i + 1] == "enum") and inside not in ("object", "fields", "class", "<", "("):
                j = i + 1
                if j < n and word[j] in ("{", "["):
                    j = partner.get(j, n)
                j += 1
                if j >= n or word[j] not in ("=", "of", "in", ":", "!"):
                    return "const without a value", at[i]
            if w in ("const", "let", "var") and not ts and i + 2 < n and kind[i + 1] == "w" and word[i + 2] == ":":
                return "type annotation", at[i]
            if w == "export" and inside == "" and i + 1 < n and kind[i + 1] == "w" and word[i + 1] not in _JS_EXPORTED | (_TS_EXPORTED if ts else set()):
                return "nothing exported", at[i]
            if w == "import" and inside == "" and i + 1 < n and word[i + 1] == "{" and (
                i + 1 not in partner or word[partner[i + 1] + 1 : partner[i + 1] + 2] != ["from"]
            ):
                return "import without from", at[i]
            if w in ("var", "let", "const") and inside == "(" and kind[i + 1 : i + 2] == ["w"] and pw == "(" and word[p - 1 : p] not in (["for"], ["await"]):
                return f"unexpected {w}", at[i]
            if w == "import" and inside == "" and i + 1 < n and kind[i + 1] == "w":
                follow = word[i + 2] if i + 2 < n else ""
                if not (follow in ("from", ",") or ts and (follow == "=" or word[i + 1] in ("type", "defer")) or word[i + 1] in ("defer", "source") and follow != ";"):
                    return "import without from", at[i]
            if w == "function" and inside not in ("class", "object", "fields"):
                j = i + 1
                j += j < n and word[j] == "*"
                j += j < n and kind[j] == "w"
                if j >= n or word[j] not in ("(", "<"):
                    return "function without parameters", at[i]
                if word[j] == "(" and (j not in partner or partner[j] + 1 >= n or word[partner[j] + 1] != "{" and not ts):
                    return "function without a body", at[i]
                if ts and word[j] == "(" and partner.get(j, n) + 1 >= n:
                    return "function without a body", at[i]
        if p < 0 or fresh[i]:
            continue
        # two operands in a row on one line
        if k in "wsn" and pk in "wsnr" or k in "wn" and pw == "]" and pk == "x":
            if k == "w" and (w in infix or w in after and pk == "w" and pw in after):
                continue
            if k == "s" and (pk == "s" or run.text[at[i]] == "`" or run.text[at[i]] == "}" or pw in ("${",)):
                if pk == "s" and run.text[at[i]] not in "`}" and run.text[at[p]] not in "`}":
                    return "two texts in a row", at[i]
                continue
            if pk == "s" and run.text[at[p]] in "`}" or pk == "s" and k == "w" and w in ("with", "assert"):
                continue
            if pk == "w" and pw in after:
                continue
            if pk == "r":
                continue
            if pw == "]" and ts and k == "w":
                continue
            return "two operands in a row", at[i]
        if not ts and k == "p" and w == "." and pw == "!" and pk == "p":
            return "unexpected .", at[i]
        if not ts and k == "p" and w == ":" and pk in "wx" and frames and frames[-1] == "(":
            o = _opener(partner, i, word)
            if o is not None and "?" not in word[o:i]:
                return "type annotation", at[i]
        if k == "p" and w == ":" and pk == "s" and frames and frames[-1] in ("block", "function"):
            j = p - 1
            if j < 0 or word[j] in ("{", ";", "}"):
                return "unexpected :", at[i]
    if n and kind[n - 1] == "w" and word[n - 1] in _JS_KEYWORDS - {"default", "static", "of", "let", "async", "await", "yield", "return", "break", "continue", "debugger"} and (n < 2 or word[n - 2] not in (".", "?.")):
        return "premature end", at[n - 1]
    if class_at >= 0 or head_at >= 0:
        return "premature end", at[max(class_at, head_at)]
    return None


def _opener(partner: dict[int, int], i: int, word: list[str]) -> int | None:
    """The bracket around position i."""
    j = i - 1
    while j >= 0:
        if word[j] in (")", "]", "}") and j in partner and partner[j] < j:
            j = partner[j] - 1
            continue
        if word[j] in ("(", "[", "{") and partner.get(j, -1) > i:
            return j
        j -= 1
    return None


def _single_loop(word, kind, partner, i) -> bool:
    """Whether the statement at i is the body of a loop without braces."""
    j = i - 1
    while j >= 0 and word[j] not in (";", "{", "}"):
        if word[j] in ("for", "while", "do") and kind[j] == "w":
            return True
        j -= 1
    return False


def _check_go(run: _Run, partner: dict[int, int]) -> Fault | None:
    kind, word, fresh, at = run.kind, run.word, run.fresh, run.at
    n = len(kind)
    if n == 0 or word[0] != "package" or n < 2 or kind[1] != "w" or fresh[1]:
        return "no package clause", at[0] if n else 0
    frames: list[str] = []
    body_next = ""
    for i in range(n):
        k, w = kind[i], word[i]
        p = i - 1
        pk, pw = (kind[p], word[p]) if p >= 0 else ("", "")
        if not frames and fresh[i] and k != "x" and not (pk == "p" and pw not in (";",) and i):
            if w not in _GO_TOP:
                return "statement outside of a function", at[i]
        if not frames and k == "w" and w in ("func", "type", "const", "var", "import"):
            nxt = word[i + 1] if i + 1 < n else ""
            if not nxt or (w == "func" and not (kind[i + 1] == "w" or nxt == "(")):
                return "premature end", at[i]
            if w == "func":
                j = i + 1
                if nxt == "(":
                    j = partner.get(j, n) + 1
                    j += j < n and kind[j] == "w"
                else:
                    j += 1
                if j >= n or word[j] not in ("(", "["):
                    if fresh[i]:
                        return "function without parameters", at[i]
            if w == "type" and nxt != "(" and (i + 2 >= n or fresh[i + 2]):
                return "premature end", at[i]
            if w == "const" and nxt != "(" and kind[i + 1] == "w" and "=" not in word[i + 2 : i + 5]:
                return "const without a value", at[i]
            if w == "var" and nxt != "(" and (i + 2 >= n or fresh[i + 2]):
                return "premature end", at[i]
            if w == "import" and nxt != "(" and not (kind[i + 1] == "s" or i + 2 < n and kind[i + 2] == "s"):
                return "import without a path", at[i]
        if k == "o":
            if w == "{":
                if fresh[i] and pk == "x" and pw == ")" and frames[-1:] != ["list"] and (not frames or frames[-1] == "body"):
                    return "unexpected line end before {", at[i]
                if pw == "struct":
                    frame = "fields"
                elif pw == "interface":
                    frame = "methods"
                else:
                    j = p
                    frame = "body" if _go_block(word, kind, fresh, partner, i, frames) else "list"
                frames.append(frame)
            else:
                frames.append("group" if w == "(" and pw in ("import", "const", "var", "type") else w)
        elif k == "x" and frames:
            frames.pop()
        inside = frames[-1] if frames else ""
        if p >= 0 and not fresh[i] and inside in ("body", "list"):
            if (k in "wsn" and pk in "wsn" or k in "wsn" and pk == "x" and pw in ")]" and inside == "body" and k != "w") and pw not in _GO_KEYWORDS and w not in _GO_KEYWORDS:
                # var x T, and labels aside
                j = p
                while j >= 0 and not fresh[j] and word[j] not in ("{", ";"):
                    j -= 1
                line = word[j : i + 1]
                if not any(x in ("var", "const", "type", "func", "chan", "map", "struct", "interface") for x in line):
                    return "two operands in a row", at[i]
        if fresh[i] and p >= 0 and k == "p" and w not in ("*", "&", "<-", "+", "-", "!", "^", "...", "~", ".", ":", ";") and (pk in "wsn" and pw not in _GO_KEYWORDS or pk == "x"):
            return "line begins with an operator", at[i]
        if w in (";",) and inside in ("(", "[") and pw != "" and "for" not in word[max(0, i - 40) : i]:
            return "unexpected ;", at[i]
    if frames:
        return "premature end", at[-1]
    if kind[-1] == "w" and word[-1] in _GO_KEYWORDS:
        return "premature end", at[-1]
    del body_next
    return None


def _go_block(word, kind, fresh, partner, i, frames) -> bool:
    """Whether the brace at i opens statements rather than the values of a literal."""
    j = i - 1
    if j < 0 or frames and frames[-1] in ("(", "list", "["):
        # a function literal in an argument
        while j >= 0 and word[j] not in ("(", ",", "{", "}", ";") or j in partner and word[j] in ")]":
            if word[j] == "func":
                return True
            j = partner[j] - 1 if j in partner and word[j] in ")]" else j - 1
        return False
    while j >= 0:
        w = word[j]
        if w in (")", "]") and j in partner:
            j = partner[j] - 1
            continue
        if w == "}" and j in partner:
            j = partner[j] - 1
            continue
        if kind[j] == "w" and w in ("func", "if", "for", "switch", "select", "else", "case", "default"):
            return True
        if w in ("{", ";") or w in (":=", "=", "return") and kind[j] in "pw":
            k = j
            while k >= 0 and not fresh[k]:
                k -= 1
            return kind[k] == "w" and word[k] in ("if", "for", "switch", "select", "func") or word[max(0, k) : j].count("func") > 0 and False
        if fresh[j]:
            return w in ("{", "}")
        j -= 1
    return False


def _check_rust(run: _Run, partner: dict[int, int], skip: list[bool]) -> Fault | None:
    kind, word, fresh, at = run.kind, run.word, run.fresh, run.at
    n = len(kind)
    if n == 0:
        return ("documentation of nothing", run.docs[0]) if run.docs else None
    depth = 0
    begin = True
    for i in range(n):
        k, w = kind[i], word[i]
        p = i - 1
        pk, pw = (kind[p], word[p]) if p >= 0 else ("", "")
        if depth == 0 and begin and k != "x":
            if w == "#" and i + 1 < n and word[i + 1] in ("[", "!"):
                pass
            elif k == "w" and (w in _RUST_TOP or i + 1 < n and word[i + 1] in ("!", "::")):
                begin = False
            elif k == "o" and pw in ("#", "!"):
                pass
            elif w == "!" and pw == "#":
                pass
            elif w == ";":
                pass
            else:
                return "expected an item", at[i]
        if k == "o":
            depth += 1
        elif k == "x":
            depth -= 1
            if depth == 0:
                o = partner.get(i, 0)
                b = word[o - 1] if o else ""
                if w == "}" or w == "]" and b in ("#", "!"):
                    begin = True
        elif w == ";" and depth == 0:
            begin = True
        if skip[i] or p < 0 or skip[p]:
            continue
        if (k in "wsn" and pk in "wsn" or k in "ws" and pw == "]" and pk == "x" and not (p in partner and word[partner[p] - 1] in ("#", "!"))) and not (
            pk == "w" and pw in _RUST_AFTER or k == "w" and w in _RUST_AFTER and pk in "wsnx" and w not in ("let", "fn", "use", "struct", "mod", "return")
        ):
            if not (pw == "]" and k == "w"):
                return "two operands in a row", at[i]
        if (
            k in "wsn" and pk == "x" and pw in ")]" and p in partner and word[partner[p] - 1] not in ("pub", "#", "in")
            and w not in _RUST_INFIX and not (pw == "]" and word[partner[p] - 1] == "!")
        ):
            return "two operands in a row", at[i]
        if k == "w" and w in ("let", "fn") and (pk in "sn" or pk == "x" and pw in ")]" and not (pw == "]" and p in partner and word[partner[p] - 1] in ("#", "!"))):
            if not (w == "fn" and pw == ")" and "pub" in word[max(0, p - 5) : p]):
                return f"{w} without ; before it", at[i]
        if w == "fn" and k == "w" and i + 1 < n and kind[i + 1] == "w":
            j = i + 2
            if j >= n or word[j] not in ("(", "<"):
                return "fn without parameters", at[i]
    if word[-1] not in ("}", ";"):
        return "premature end", at[-1]
    for m in run.docs:
        q = bisect.bisect_right(at, m)
        if q >= n or kind[q] == "x":
            return "documentation of nothing", m
    return None if begin else ("premature end", at[-1])


def _rust_skip(run: _Run, partner: dict[int, int]) -> list[bool]:
    """Tokens inside macro calls and attributes, which follow no common grammar."""
    skip = [False] * len(run.kind)
    i = 0
    while i < len(skip):
        if run.kind[i] == "o" and i and i in partner and (run.word[i - 1] in ("!", "#") and run.kind[i - 1] == "p" or i > 2 and run.word[i - 2] == "!" and run.kind[i - 1] == "w"):
            for j in range(i + 1, partner[i]):
                skip[j] = True
            i = partner[i]
        i += 1
    return skip


def _check_c(run: _Run, partner: dict[int, int]) -> Fault | None:
    kind, word, fresh, at = run.kind, run.word, run.fresh, run.at
    n = len(kind)
    frames: list[tuple[str, int]] = []
    names = 0  # plain words in a row
    last = -1  # last token that is no directive
    for i in range(n):
        k, w = kind[i], word[i]
        if k == "d":
            continue
        p = last
        last = i
        pk, pw = (kind[p], word[p]) if p >= 0 else ("", "")
        inside = frames[-1][0] if frames else ""
        if k == "w":
            names = 0 if w in _C_WORDS else names + 1
            if names >= 4:
                return "words in a row", at[i]
        elif k != "p" or w != "*":
            names = 0
        if k == "n" and pk in "wsn" and pw not in _C_STATEMENTS and not (pk == "w" and pw in _C_WORDS):
            return "two operands in a row", at[i]
        if k == "n" and re.search(r"[g-zG-Z_]", re.sub(r"^0[xX]|[uUlLfFzZpPwWbBiIjJ]+\d*$", "", w)):
            return "malformed number", at[i]
        if pk == "n" and k in "ws":
            return "two operands in a row", at[i]
        if pk == "s" and k == "w" and not w.isupper() and "PRI" not in w:
            return "two operands in a row", at[i]
        if k == "s" and pk == "w" and pw not in _C_STATEMENTS and not pw.isupper() and pw not in ("L", "u8", "u", "U", "extern", "asm", "__asm__") and "PRI" not in pw:
            return "two operands in a row", at[i]
        if k == "w" and w in _C_STATEMENTS and inside == "{" and pk == "x" and pw in ")]" and p in partner:
            o = partner[p]
            before = word[o - 1] if o else ""
            if before not in ("if", "for", "while", "switch") and w not in ("else",):
                if pw == "]" or kind[o - 1] == "w" and not before.isupper():
                    return "statement without ; before it", at[i]
        if k == "w" and w in _C_STATEMENTS and not frames:
            return "statement outside of a function", at[i]
        if k == "p" and w == ":":
            if not frames and "?" not in word[max(0, i - 30) : i]:
                return "unexpected :", at[i]
            if inside == "(":
                o = frames[-1][1]
                if "?" not in word[o:i] and word[o - 1 : o] not in (["asm"], ["__asm__"], ["_Generic"]) and "asm" not in word[max(0, o - 3) : o]:
                    return "unexpected :", at[i]
            if pw == ":":
                return "unexpected ::", at[i]
        if k == "o":
            if w == "{":
                if not frames:
                    head = word[max(0, i - 4) : i]
                    ok = pw in (")", "=", "]") or any(x in ("struct", "union", "enum") for x in head) or pk == "s" and "extern" in head
                    if not ok and pk == "w" and not pw.isupper():
                        return "unexpected {", at[i]
                    if p < 0 or pw in (";", "}"):
                        return "unexpected {", at[i]
                head = word[max(0, i - 4) : i]
                brace = "{"
                if pw == "=" or pw == "," or pk == "o":
                    brace = "init" if pw == "=" or inside == "init" else "{"
                elif any(x in ("struct", "union", "enum") for x in head) and pw != ")":
                    brace = "fields"
                frames.append((brace, i))
            else:
                frames.append((w, i))
        elif k == "x" and frames:
            f, o = frames.pop()
            if w == ")" and word[o - 1 : o] == ["for"]:
                depth = semis = 0
                for x, y in zip(kind[o + 1 : i], word[o + 1 : i], strict=True):
                    depth += (x == "o") - (x == "x")
                    semis += y == ";" and depth == 0
                if semis != 2:
                    return "for without its three parts", at[o]
            if w == "}" and f in ("fields", "init"):
                q = i + 1
                while q < n and kind[q] == "d":
                    q += 1
                if q >= n or kind[q] == "o" and word[q] == "{" or kind[q] == "w" and word[q] in _C_STATEMENTS and f == "init" or kind[q] in "sn":
                    return "premature end", at[i]
        elif k == "p" and w in ("=>", "`", "@", "$"):
            return f"unexpected {w}", at[i]
        if k == "p" and w == ">" and pw == "=" and at[i] == at[p] + 1:
            return "unexpected =>", at[i]
    if last >= 0 and word[last] not in ("}", ";"):
        return "premature end", at[last]
    return None


# ---- shell

_SH_CLOSERS = {"fi": "if", "done": "do", "esac": "case", "}": "{"}
_SH_WORD = re.compile(r"[^\s|&;()<>\"'`$\\#][^\s|&;()<>\"'`$\\]*")


class _Shell:
    """A pushdown reader of shell text: frames of [block word, a command was seen in it]."""

    def __init__(self, text: str):
        self.t, self.n, self.i = text, len(text), 0
        self.here: list[tuple[str, bool]] = []

    def fault(self, why: str, at: int | None = None) -> Fault:
        return why, self.i if at is None else at

    def quoted(self, end: str) -> Fault | None:
        """Inside double quotes or backquotes; i stands after the opening one."""
        start = self.i - 1
        while self.i < self.n:
            c = self.t[self.i]
            if c == "\\":
                self.i += 2
            elif c == end:
                self.i += 1
                return None
            elif c == "$":
                if f := self.dollar():
                    return f
            elif c == "`" and end != "`":
                self.i += 1
                if f := self.quoted("`"):
                    return f
            elif c == "'" and end == "`" or c == '"' and end == "`":
                self.i += 1
                if c == "'":
                    j = self.t.find("'", self.i)
                    if j < 0:
                        return self.fault("unterminated literal", self.i)
                    self.i = j + 1
                elif f := self.quoted('"'):
                    return f
            else:
                self.i += 1
        return self.fault("unterminated literal", start)

    def dollar(self) -> Fault | None:
        """At a dollar sign."""
        t, i = self.t, self.i
        if t.startswith("$((", i):
            save = self.i
            self.i += 3
            if self.arith() is None:
                return None
            self.i = save
        if t.startswith("$(", i):
            self.i += 2
            return self.commands(")", i)
        if t.startswith("${", i):
            self.i += 2
            return self.braces(i)
        if t.startswith("$'", i):
            self.i += 2
            while self.i < self.n and t[self.i] != "'":
                self.i += 2 if t[self.i] == "\\" else 1
            if self.i >= self.n:
                return self.fault("unterminated literal", i)
            self.i += 1
            return None
        self.i += 1
        return None

    def braces(self, start: int) -> Fault | None:
        while self.i < self.n:
            c = self.t[self.i]
            if c == "\\":
                self.i += 2
            elif c == "}":
                self.i += 1
                return None
            elif c == "$":
                if f := self.dollar():
                    return f
            elif c == '"':
                self.i += 1
                if f := self.quoted('"'):
                    return f
            elif c == "`":
                self.i += 1
                if f := self.quoted("`"):
                    return f
            elif c == "'" and self.t[self.i - 1] not in "\\":
                j = self.t.find("'", self.i + 1)
                if j < 0:
                    return self.fault("unterminated literal", self.i)
                self.i = j + 1
            else:
                self.i += 1
        return self.fault("unclosed ${", start)

    def arith(self) -> Fault | None:
        """Up to )) ; i stands after ((."""
        depth, start = 0, self.i
        while self.i < self.n:
            c = self.t[self.i]
            if c == "\\":
                self.i += 2
                continue
            if c == "$":
                if f := self.dollar():
                    return f
                continue
            if c == '"':
                self.i += 1
                if f := self.quoted('"'):
                    return f
                continue
            if c == "(":
                depth += 1
            elif c == ")":
                if depth == 0:
                    if self.t.startswith("))", self.i):
                        self.i += 2
                        return None
                    return self.fault("unclosed ((", start)
                depth -= 1
            self.i += 1
        return self.fault("unclosed ((", start)

    def heredocs(self) -> None:
        """At a line's start: skips the bodies that wait. One without its end runs to the end of the text."""
        for word, tabs in self.here:
            while self.i < self.n:
                j = self.t.find("\n", self.i)
                line = self.t[self.i : j if j >= 0 else self.n]
                self.i = j + 1 if j >= 0 else self.n
                if (line.lstrip("\t") if tabs else line) == word:
                    break
        self.here = []

    def word(self) -> tuple[str | None, Fault | None]:
        """A word at i: its plain text (None if it holds quotes or expansions)."""
        start, plain = self.i, True
        t = self.t
        while self.i < self.n:
            c = t[self.i]
            if c in " \t\r\n|&;()<>":
                if c == "(" and self.i > start and t[self.i - 1] in "@!?*+" and self.i - start >= 1:
                    j = t.find(")", self.i)
                    if 0 < j and "\n" not in t[self.i : j]:
                        self.i = j + 1
                        plain = False
                        continue
                if c == "(" and self.i > start and t[self.i - 1] == "=":  # an array
                    self.i += 1
                    if f := self.array(self.i - 1):
                        return None, f
                    plain = False
                    continue
                if c in "<>" and t.startswith("(", self.i + 1):
                    at = self.i
                    self.i += 2
                    if f := self.commands(")", at):
                        return None, f
                    plain = False
                    continue
                break
            if c == "\\":
                if t.startswith("\\\n", self.i) and self.i == start:
                    self.i += 2
                    start = self.i
                    continue
                self.i += 2
                plain = False
            elif c == "'":
                j = t.find("'", self.i + 1)
                if j < 0:
                    return None, self.fault("unterminated literal", self.i)
                self.i, plain = j + 1, False
            elif c == '"' or c == "`":
                self.i += 1
                plain = False
                if f := self.quoted(c):
                    return None, f
            elif c == "$":
                plain = False
                if f := self.dollar():
                    return None, f
            else:
                self.i += 1
        self.i = min(self.i, self.n)
        return (t[start : self.i] if plain else None), None

    def array(self, start: int) -> Fault | None:
        while self.i < self.n:
            c = self.t[self.i]
            if c == ")":
                self.i += 1
                return None
            if c in " \t\r\n":
                self.i += 1
                if c == "\n" and self.here:
                    self.heredocs()
            elif c == "#" and self.t[self.i - 1] in " \t\n(":
                self.comment()
            elif c in "|&;<>(" and not self.t.startswith(("<(", ">("), self.i):
                return self.fault(f"unexpected {c}")
            else:
                _, f = self.word()
                if f:
                    return f
        return self.fault("unclosed (", start)

    def comment(self) -> None:
        j = self.t.find("\n", self.i)
        self.i = j if j >= 0 else self.n

    def commands(self, until: str = "", start: int = 0) -> Fault | None:
        """A list of commands up to ``until`` (")" of a subshell) or the end of the text."""
        t = self.t
        frames: list[list] = [["(" if until else "", False]]
        fresh = True  # a command may begin
        need = ""  # an operator that waits for a command
        mode = ""  # "for": after for NAME; "case": before in; "pattern"
        func = False  # name() was read: a compound command must follow
        closed = False  # a compound command has just ended: no word may follow
        args = 0
        while True:
            if self.i >= self.n:
                break
            c = t[self.i]
            if c in " \t\r" or t.startswith("\\\n", self.i):
                self.i += 2 if c == "\\" else 1
                continue
            if c == "#" and (self.i == 0 or t[self.i - 1] in " \t\r\n;&|()"):
                self.comment()
                continue
            top = frames[-1]
            if c == "\n":
                self.i += 1
                if self.here:
                    self.heredocs()
                if not need:
                    fresh, args = True, 0
                closed = False
                continue
            if mode == "pattern":
                if c == "(":
                    self.i += 1
                    continue
                if t.startswith("esac", self.i) and (self.i + 4 >= self.n or t[self.i + 4] in " \t\r\n;&|)"):
                    mode, fresh = "", True
                    continue
                while True:
                    _, f = self.word()
                    if f:
                        return f
                    while self.i < self.n and t[self.i] in " \t":
                        self.i += 1
                    if t.startswith("|", self.i):
                        self.i += 1
                        while self.i < self.n and t[self.i] in " \t":
                            self.i += 1
                        continue
                    break
                if not t.startswith(")", self.i):
                    return self.fault("case pattern without )")
                self.i += 1
                mode, fresh = "", True
                frames.append(["pattern", True])
                continue
            if t.startswith((";;&", ";;", ";&"), self.i):
                if top[0] != "pattern":
                    return self.fault("unexpected ;;")
                if need:
                    return self.fault(f"nothing after {need}")
                self.i += 3 if t.startswith(";;&", self.i) else 2
                frames.pop()
                mode, fresh, args, closed = "pattern", True, 0, False
                continue
            if c in ";&|":
                op = next(o for o in ("&&", "||", "|&", "&>>", "&>", ";", "&", "|") if t.startswith(o, self.i))
                if op in ("&>>", "&>"):
                    self.i += len(op)
                    if f := self.target(op):
                        return f
                    continue
                if mode == "for" and op == ";":
                    self.i += 1
                    mode, fresh = "", True
                    continue
                if fresh and (args == 0) or need:
                    return self.fault(f"unexpected {op}")
                self.i += len(op)
                fresh, args, closed = True, 0, False
                need = op if op in ("&&", "||", "|", "|&") else ""
                continue
            if c in "<>" and not t.startswith(("<(", ">("), self.i):
                op = next(o for o in ("<<<", "<<-", "<<", "<>", "<&", ">>", ">&", ">|", "<", ">") if t.startswith(o, self.i))
                self.i += len(op)
                if f := self.target(op):
                    return f
                args += 1
                fresh, need = False, ""
                top[1] = True
                continue
            if c == "(":
                if t.startswith("((", self.i) and fresh:
                    save = self.i
                    self.i += 2
                    if self.arith() is None:
                        fresh, need, args = False, "", 1
                        top[1] = True
                        if frames[-1][0] == "for":
                            mode, fresh = "for", False
                        continue
                    self.i = save
                if not fresh and args == 1 and re.match(r"\([ \t]*\)", t[self.i :]):  # name ()
                    self.i = t.index(")", self.i) + 1
                    func, fresh, args = True, True, 0
                    continue
                if not fresh:
                    return self.fault("unexpected (")
                at = self.i
                self.i += 1
                if f := self.commands(")", at):
                    return f
                fresh, need, args, func, closed = False, "", 1, False, True
                top[1] = True
                continue
            if c == ")":
                if until and len(frames) == 1:
                    if need:
                        return self.fault(f"nothing after {need}")
                    self.i += 1
                    return None
                return self.fault("unbalanced )")
            at = self.i
            text, f = self.word()
            if f:
                return f
            if self.i == at:
                return self.fault(f"unexpected {c}")
            if mode == "case":
                if text == "in":
                    mode = "pattern"
                continue
            if mode == "name":
                mode = "for"
                continue
            if mode == "for":
                if text == "do" and fresh:
                    mode = ""
                else:
                    continue
            if closed:
                if text not in ("then", "elif", "else", "do", "fi", "done", "esac", "}"):
                    return self.fault("words after a block", at)
                fresh, closed = True, False
            if fresh and text is not None:
                if text in ("if", "while", "until"):
                    frames.append([text, False])
                    need = ""
                    func = False
                    continue
                if text in ("for", "select"):
                    frames.append(["for", True])
                    rest = t[self.i :]
                    mode = "" if re.match(r"[ \t]*\(\(", rest) else "name"
                    need = ""
                    func = False
                    continue
                if text == "case":
                    top[1] = True
                    frames.append(["case", True])
                    mode, need, fresh, args = "case", "", False, 1
                    func = False
                    continue
                if text == "then":
                    if top[0] not in ("if", "elif") or not top[1]:
                        return self.fault("unexpected then", at)
                    top[0], top[1] = "then", False
                    continue
                if text in ("elif", "else"):
                    if top[0] != "then" or not top[1]:
                        return self.fault(f"unexpected {text}", at)
                    top[0], top[1] = ("elif" if text == "elif" else "else"), False
                    continue
                if text == "do":
                    if top[0] not in ("while", "until", "for") or not top[1]:
                        return self.fault("unexpected do", at)
                    top[0], top[1] = "do", False
                    mode = ""
                    continue
                if text == "{":
                    frames.append(["{", False])
                    need, func = "", False
                    continue
                if text in ("fi", "done", "esac", "}"):
                    ok = {"fi": ("then", "else"), "done": ("do",), "esac": ("case",), "}": ("{",)}[text]
                    if text == "esac" and top[0] == "pattern":
                        frames.pop()
                        top = frames[-1]
                    if top[0] not in ok or not top[1] or need:
                        return self.fault(f"unexpected {text}", at)
                    frames.pop()
                    frames[-1][1] = True
                    fresh, args, closed = False, 1, True
                    continue
                if text in ("!", "time"):
                    continue
                if text == "function":
                    while self.i < self.n and t[self.i] in " \t":
                        self.i += 1
                    name, f = self.word()
                    if f or not name:
                        return f or self.fault("function without a name")
                    m = re.match(r"[ \t]*\([ \t]*\)", t[self.i :])
                    if m:
                        self.i += m.end()
                    func, fresh, args = True, True, 0
                    continue
                if text == "[[":
                    j = self.double(at)
                    if j:
                        return j
                    fresh, need, args = False, "", 1
                    top[1] = True
                    continue
            if func:
                return self.fault("function without a body", at)
            args += 1
            fresh, need = False, ""
            top[1] = True
        if need or mode in ("case", "name", "pattern") or func:
            return self.fault("premature end")
        if until:
            return self.fault("unclosed (", start)
        if len(frames) > 1:
            return self.fault(f"unclosed {frames[-1][0]}")
        return None

    def target(self, op: str) -> Fault | None:
        """What a redirection is followed by."""
        t = self.t
        while self.i < self.n and (t[self.i] in " \t" or t.startswith("\\\n", self.i)):
            self.i += 2 if t[self.i] == "\\" else 1
        at = self.i
        text, f = self.word()
        if f:
            return f
        if self.i == at:
            return self.fault(f"nothing after {op}")
        if op in ("<<", "<<-"):
            raw = t[at : self.i]
            self.here.append((re.sub(r"[\"'\\]", "", raw), op == "<<-"))
        return None

    def double(self, start: int) -> Fault | None:
        """A [[ condition; i stands after [[."""
        t = self.t
        while self.i < self.n:
            c = t[self.i]
            if c in " \t\r\n|&()<>;!":
                self.i += 1
                if c == ";":
                    return self.fault("unclosed [[", start)
                continue
            at = self.i
            text, f = self.word()
            if f:
                return f
            if text == "]]":
                return None
            if self.i == at:
                self.i += 1
        return self.fault("unclosed [[", start)


def _check_json(run: _Run) -> Fault | None:
    """A pushdown automaton of the whole grammar."""
    stack: list[str] = []
    want = "value"  # value, first (value or ]), key, firstkey (key or }), colon, next, end
    for k, w, a in zip(run.kind, run.word, run.at, strict=True):
        if want == "end":
            return "text after the end", a
        done = False
        if want in ("value", "first") and (k in "sn" or k == "w"):
            done = True
        elif want in ("value", "first") and k == "o":
            stack.append(w)
            want = "first" if w == "[" else "firstkey"
        elif want == "first" and w == "]" and k == "x" or want == "firstkey" and w == "}" and k == "x":
            stack.pop()
            done = True
        elif want in ("key", "firstkey") and k == "s":
            want = "colon"
        elif want == "colon" and w == ":" and k == "p":
            want = "value"
        elif want == "next" and w == "," and k == "p":
            want = "value" if stack[-1] == "[" else "key"
        elif want == "next" and k == "x" and _PAIR[w] == stack[-1]:
            stack.pop()
            done = True
        else:
            return f"unexpected {w[:10]}", a
        if done:
            want = "next" if stack else "end"
    return None if want == "end" else ("premature end", len(run.text))


#: The parser's answer where a text is nested too deeply for it.
_GAVE_UP = "nested too deeply"


def _exact(language: str, text: str) -> str | None:
    """What a full parser of the standard library says; None if it accepts the text."""
    try:
        if language == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        elif language == "json":
            json.loads(text)
        else:
            tomllib.loads(text)
    except (RecursionError, MemoryError):
        return _GAVE_UP
    except (SyntaxError, ValueError) as e:
        return str(e)[:80]
    return None


def fault(language: str, text: str) -> Fault | None:
    """The first fault of a text in a language, as (what, character position)."""
    if language == "bash":
        return _Shell(text.replace("\r\n", "\n")).commands()
    run = _Run(language, text)
    found = run.errors[0] if run.errors else None
    if language == "json":
        found = found or _check_json(run)
    else:
        partner: dict[int, int] = {}
        if not found:
            found, partner = _brackets(run)
        if not found and language not in ("python", "toml"):
            skip = _rust_skip(run, partner) if language == "rust" else [False] * len(run.kind)
            found = _operators(run, skip)
            if not found:
                if language in ("javascript", "typescript"):
                    found = _check_js(run, partner)
                elif language == "go":
                    found = _check_go(run, partner)
                elif language == "rust":
                    found = _check_rust(run, partner, skip)
                else:
                    found = _check_c(run, partner)
    if not found and language == "python":
        found = check_python(run, partner)
    elif not found and language == "toml":
        found = check_toml(run)
    if found and language in ("python", "json", "toml") and _exact(language, text) is None:
        return None
    return found


SCHEMA = "repo_id string, relative_path string, language string, fault string, line_number bigint"


def _run_batches(batches):
    for b in batches:
        rows: list[list] = [[], [], [], [], []]
        for repo, path, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            language = language_of(path) if path else None
            if language is None or text is None:
                continue
            found = fault(language, text)
            line = text.count("\n", 0, found[1]) + 1 if found else None
            for c, v in zip(rows, (repo, path, language, found[0] if found else None, line), strict=True):
                c.append(v)
        kinds = [pa.string()] * 4 + [pa.int64()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=names)


def judge(content: DataFrame) -> DataFrame:
    """Each file of a checked language with its first fault, or null."""
    return content.select("repo_id", "relative_path", "content").mapInArrow(_run_batches, SCHEMA)


def broken(judged: DataFrame) -> DataFrame:
    """Distinct files with a fault."""
    return judged.filter("fault IS NOT NULL").select("repo_id", "relative_path").distinct()


def rates(judged: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per repository and language: files, broken files, their share, and broken files that still list symbols."""
    files = judged.groupBy("repo_id", "relative_path", "language").agg(F.max(F.col("fault").isNotNull()).alias("bad"))
    listed = symbols.filter("deleted_at IS NULL").select("repo_id", F.col("file_path").alias("relative_path")).distinct()
    joined = files.join(listed.withColumn("listed", F.lit(True)), ["repo_id", "relative_path"], "left")
    return joined.groupBy("repo_id", "language").agg(
        F.count("*").alias("n_files"),
        F.count_if("bad").alias("n_broken"),
        F.round(F.count_if("bad") / F.count("*"), 6).alias("share"),
        F.count_if(F.col("bad") & F.col("listed").isNotNull()).alias("n_broken_listed"),
    )

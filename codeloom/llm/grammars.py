"""Pushdown checks of Python and TOML: blocks by indentation, statements, and what may follow what.

Both take the tokens of a text whose brackets are balanced. The stack of Python holds the open blocks with
their columns; within a statement an operand and an operator must take turns, at every depth of brackets.
"""

from __future__ import annotations

import re

Fault = tuple[str, int]

_HEADERS = set("if elif else for while try except finally with def class async match case".split())
#: What an else, elif, except or finally may follow at its own column.
_FOLLOWS = {
    "else": {"if", "elif", "for", "while", "except", "try"}, "elif": {"if", "elif"}, "except": {"try", "except"},
    "finally": {"try", "except", "else"},
}
_KEYWORDS = set(
    "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal"
    " not or pass raise return try while with yield".split()
)
#: Keywords that end a statement as an operand does, and those that need no operand behind them.
_BARE = {"break", "continue", "pass", "return", "raise", "yield", "else", "try", "finally", "except", "lambda"}
_SOFT = {"match", "case", "type", "print", "exec", "_"}
_UNARY = {"+", "-", "~", "*", "**"}
_LEFT = set("== != <= >= < > // % @ & | ^ << >> . = += -= *= /= //= %= @= &= |= ^= <<= >>= **= := ->".split())
_INFIX = {"and", "or", "in", "is", "if", "else", "for", "as", "import", "from", "not", "async"}


def _column(text: str, at: int) -> int:
    start = text.rfind("\n", 0, at) + 1
    col = 0
    for c in text[start:at]:
        col = (col // 8 + 1) * 8 if c == "\t" else 0 if c == "\x0c" else col + (c != "\ufeff")
    return col


def _joined(run, i: int) -> bool:
    """Whether a backslash joins the line of token i to the one before; one in a comment does not."""
    text, at = run.text, run.at[i]
    nl = text.rfind("\n", 0, at)
    if nl <= 0 or text[nl - 1 - (text[nl - 1] == "\r")] != "\\":
        return False
    word = run.word[i - 1]
    return len(word) >= 40 or "#" not in text[run.at[i - 1] + len(word) : nl]


def _statements(run, partner: dict[int, int]) -> list[tuple[int, int]]:
    """(first, end) of the logical lines; brackets and backslashes join lines."""
    starts, i, n = [], 0, len(run.kind)
    while i < n:
        if i == 0 or run.fresh[i] and not _joined(run, i):
            starts.append(i)
        i = partner[i] + 1 if run.kind[i] == "o" and i in partner else i + 1
    return list(zip(starts, [*starts[1:], n], strict=True)) if n else []


def _colon(run, partner: dict[int, int], i: int, end: int) -> int | None:
    """The colon that ends a header between i and end, past brackets and lambdas."""
    lambdas = 0
    while i < end:
        if run.word[i] == "lambda" and run.kind[i] == "w":
            lambdas += 1
        elif run.word[i] == ":" and run.kind[i] == "p":
            if not lambdas:
                return i
            lambdas -= 1
        i = partner[i] + 1 if run.kind[i] == "o" and i in partner else i + 1
    return None


def _terms(run, first: int, end: int, decorated: bool) -> Fault | None:
    """Operands and operators that do not take turns in one statement."""
    kind, word, at = run.kind, run.word, run.at
    operand, literal = False, False  # whether an operand has just ended, and whether it was a string
    for i in range(first, end):
        k, w = kind[i], word[i]
        if k == "w" and w in _KEYWORDS or k == "w" and i == first and w in _SOFT and i + 1 < end and kind[i + 1] in "wsno" and word[i + 1] not in _INFIX:
            if operand and w not in _INFIX:
                return f"unexpected {w}", at[i]
            if not operand and w in ("and", "or", "is", "as") and i > first and not (w == "as" and word[i - 1] == "*"):
                return f"{w} without left side", at[i]
            last = i + 1 >= end or kind[i + 1] == "x"
            if last and w not in _BARE or i + 1 < end and word[i + 1] == ":" and kind[i + 1] == "p" and w not in _BARE and w not in ("case", "match", "type"):
                return f"nothing after {w}", at[i]
            operand = literal = False
        elif k in "wn" or k == "p" and w == "...":
            if operand:
                return f"unexpected {w[:20]}", at[i]
            operand, literal = w != "..." or not (i > first and word[i - 1] in ("from", ".", "...")), False
        elif k == "s":
            if operand and not literal:
                return "unexpected text", at[i]
            operand = literal = True
        elif k == "o":
            if operand and w == "{":
                return "unexpected {", at[i]
            operand = literal = False
        elif k == "x":
            before = word[i - 1] if i > first else ""
            if not operand and kind[i - 1] != "o" and before not in (",", ":", "*", "/") and not (before in _BARE and before != "lambda"):
                return f"nothing before {w}", at[i]
            operand, literal = True, False
        elif k == "p":
            star = w == "*" and i > first and word[i - 1] == "import" or w == "=" and i > first and word[i - 1] == "," or w in ("*", "/") and i + 1 < end and (word[i + 1] in (",", ")", ":")) or w in ("/", "*") and word[i - 1] in (",", "(")
            if not operand and w in _LEFT and not (w == "@" and i == first and decorated) and not (w == "->" and word[i - 1] == ")") and not (w == "=" and word[i - 1] in ("...",)) and not star and w != ".":
                return f"operator {w} without left side", at[i]
            if w in (".", "...") and not operand and not any(x in ("from", ".", "...") for x in word[i - 1 : i]):
                return f"operator {w} without left side", at[i]
            if w in _LEFT | _UNARY | {"/"} and not star and (i + 1 >= end or kind[i + 1] == "x" or kind[i + 1] == "p" and word[i + 1] in (",", ":", ";", "=")) and w not in (".",):
                return f"operator {w} without right side", at[i]
            if w == "." and i + 1 >= end:
                return "nothing after .", at[i]
            if w == ";" and not operand and word[i - 1] not in _BARE:
                return "unexpected ;", at[i]
            operand = literal = False
    return None


def check_python(run, partner: dict[int, int]) -> Fault | None:
    """The first fault of blocks and statements."""
    text, word, kind, at = run.text, run.word, run.kind, run.at
    stack = [0]
    heads: list[dict[int, str]] = [{}]  # by depth: what statement stood last, as the head of a block that may go on
    open_at: int | None = None  # a header awaits its block
    decorated: int | None = None
    for first, end in _statements(run, partner):
        col = _column(text, at[first])
        if open_at is not None:
            if col <= stack[-1]:
                return "no block after a header", at[first]
            stack.append(col)
            heads.append({})
            open_at = None
        elif col > stack[-1]:
            return "unexpected indent", at[first]
        else:
            while stack and col < stack[-1]:
                stack.pop()
                heads.pop()
            if not stack or col != stack[-1]:
                return "indentation of no block", at[first]
        w = word[first] if kind[first] == "w" else ""
        if decorated is not None and not (w in ("def", "class", "async") or word[first] == "@"):
            return "decorator of nothing", decorated
        decorated = at[first] if word[first] == "@" else None
        follows = _FOLLOWS.get(w)
        if follows is not None and heads[-1].get(0) not in follows:
            return f"{w} without its head", at[first]
        if heads[-1].get(0) == "try" and w not in ("except", "finally"):
            return "try without except", at[first]
        soft = w in ("match", "case") and first + 1 < end and (kind[first + 1] in "wsn" and word[first + 1] not in _INFIX or kind[first + 1] == "o" or word[first + 1] in ("-", "*")) and word[end - 1] == ":"
        header = w in _HEADERS - {"match", "case"} or soft
        if f := _terms(run, first, end, word[first] == "@"):
            return f
        heads[-1][0] = ""
        if header:
            colon = _colon(run, partner, first, end)
            if colon is None:
                return f"{w} without colon", at[first]
            if w == "async" and word[first + 1 : first + 2] and word[first + 1] not in ("def", "for", "with"):
                return "async of nothing", at[first]
            if w in ("def", "class") and (first + 1 >= end or kind[first + 1] != "w" or word[first + 1] in _KEYWORDS):
                return f"{w} without name", at[first]
            heads[-1][0] = "for" if w == "async" and word[first + 1] == "for" else w
            if colon == end - 1:
                open_at = at[first]
        elif kind[end - 1] == "p" and word[end - 1] == ":":
            return "colon of no header", at[end - 1]
    if open_at is not None:
        return "premature end of a block", len(text)
    if decorated is not None:
        return "decorator of nothing", decorated
    for h in heads:
        if h.get(0) == "try":
            return "premature end of try", len(text)
    return None


# ---- TOML

_KEY = re.compile(r"[A-Za-z0-9_-]+$")
_VALUE = re.compile(
    r"(?:true|false|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9]\d*(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?|0x[\da-fA-F]+(?:_[\da-fA-F]+)*|0o[0-7]+(?:_[0-7]+)*|0b[01]+(?:_[01]+)*"
    r"|\d{4}-\d\d-\d\d(?:[Tt]\d\d:\d\d(?::\d\d)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d)?(?:[Zz]|[+-]\d\d:\d\d)?)$"
)
_FRACTION = re.compile(r"\d+(?:_\d+)*(?:[eE][+-]?\d+)?(?:[Zz]|[+-]\d\d:\d\d)?$")


class _Toml:
    def __init__(self, run):
        self.run, self.i, self.n = run, 0, len(run.kind)

    def fault(self, what: str) -> Fault:
        return what, self.run.at[self.i] if self.i < self.n else len(self.run.text)

    def is_(self, w: str) -> bool:
        return self.i < self.n and self.run.word[self.i] == w and self.run.kind[self.i] in "pox"

    def same_line(self) -> bool:
        return self.i < self.n and not self.run.fresh[self.i]

    def key(self, first: bool = True) -> Fault | None:
        """A dotted key; all its parts on one line."""
        while True:
            if self.i >= self.n or not first and not self.same_line():
                return self.fault("no key")
            k, w = self.run.kind[self.i], self.run.word[self.i]
            if not (k == "w" and _KEY.match(w) or k == "s" and not w.startswith(('"""', "'''"))):
                return self.fault(f"unexpected {w[:10]}")
            self.i += 1
            if not (self.is_(".") and self.same_line()):
                return None
            self.i += 1
            first = False

    def value(self) -> Fault | None:
        """A value, arrays and inline tables by a stack of what they wait for."""
        stack: list[str] = []
        while True:
            if self.i >= self.n:
                return self.fault("premature end")
            k, w = self.run.kind[self.i], self.run.word[self.i]
            if k == "o":
                stack.append(w)
                self.i += 1
                if self.is_("]" if w == "[" else "}"):
                    pass
                elif w == "{":
                    if f := self.pair():
                        return f
                    continue
                else:
                    continue
            elif k == "s":
                self.i += 1
            elif k == "w" and _VALUE.match(w):
                self.i += 1
                if self.is_(".") and self.same_line():
                    self.i += 1
                    if self.i >= self.n or not _FRACTION.match(self.run.word[self.i]):
                        return self.fault("no fraction")
                    self.i += 1
            else:
                return self.fault(f"unexpected {w[:10]}")
            while True:  # what may follow a value
                if not stack:
                    return None
                close = "]" if stack[-1] == "[" else "}"
                if self.is_(","):
                    self.i += 1
                    if close == "]" and self.is_("]"):
                        continue
                    if close == "}":
                        if f := self.pair():
                            return f
                    break
                if not self.is_(close):
                    return self.fault(f"no {close}")
                stack.pop()
                self.i += 1

    def pair(self) -> Fault | None:
        if f := self.key():
            return f
        if not self.is_("=") or not self.same_line():
            return self.fault("no = after a key")
        self.i += 1
        return None if self.same_line() else self.fault("no value")


def check_toml(run) -> Fault | None:
    """The first line that is neither a table's head nor a key with its value, or a head or key that stands twice."""
    p = _Toml(run)
    heads: set[tuple] = set()
    table: tuple = ()
    seen: set[tuple] = set()
    arrays = 0
    while p.i < p.n:
        at = p.i
        if p.is_("["):
            twice = p.i + 1 < p.n and run.word[p.i + 1] == "[" and run.at[p.i + 1] == run.at[p.i] + 1
            p.i += 1 + twice
            begin = p.i
            if f := p.key():
                return f
            name = tuple(w.strip("\"'") for w in run.word[begin : p.i] if w != ".")
            for _ in range(1 + twice):
                if not p.is_("]") or not p.same_line():
                    return p.fault("unclosed [")
                p.i += 1
            arrays += twice
            if not twice and not arrays and name in heads:
                return "a table stands twice", run.at[at]
            heads.add(name)
            table = (*name, arrays) if twice or arrays else name
        else:
            if f := p.key():
                return f
            name = (table, tuple(w.strip("\"'") for w in run.word[at : p.i] if w != "."))
            if name in seen:
                return "a key stands twice", run.at[at]
            seen.add(name)
            p.i = at
            if f := p.pair() or p.value():
                return f
        if p.same_line():
            return p.fault("more on the line")
    return None

"""Lexers for the indexed languages.

``lex(language, text)`` gives tokens (kind, start, end) without white space, and the
errors that the lexer itself meets. Kinds: ``c`` comment, ``s`` string, ``r`` regular
expression, ``w`` word, ``n`` number, ``o`` opening and ``x`` closing bracket, ``p``
other punctuation, ``d`` preprocessor line, ``l`` line end (where it matters).
The scan is one compiled alternation a language; only template strings and the
choice between division and regular expression need a hand-kept state.
"""

from __future__ import annotations

import re

Token = tuple[str, int, int]

#: The language that an extension declares.
EXTENSIONS = {
    "py": "python", "pyi": "python", "rs": "rust", "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "jsx": "javascript", "ts": "typescript", "go": "go", "c": "c", "h": "c", "sh": "bash", "bash": "bash",
    "json": "json", "toml": "toml",
}


def language_of(path: str) -> str | None:
    """By the extension, in any case; None for others and for names without one."""
    name = path.rsplit("/", 1)[-1]
    return EXTENSIONS.get(name.rsplit(".", 1)[1].lower()) if "." in name[1:] else None


_WORD = r"[^\W\d]\w*"
_NUMBER = r"(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.(?!\.)[\d_]*)?(?:[eE][+-]?\d[\d_]*)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)"

_RULES = {
    "c": rf"""
        (?P<c>//(?:[^\n\\]|\\.|\\\r?\n)*|/\*.*?\*/)
        |(?P<e1>/\*.*)
        |(?P<s>(?:u8|[uUL])?"(?:[^"\\\r\n]|\\\r\n|\\.)*"|(?:u8|[uUL])?'(?:[^'\\\r\n]|\\\r\n|\\.)+')
        |(?P<e2>["'])
        |(?P<n>(?:0[xXbB][\da-fA-F']+|\d(?:'?\d)*(?:\.[\d']*)?(?:[eEpP][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)[a-zA-Z]*)
        |(?P<w>{_WORD})
        |(?P<o>[(\[{{])|(?P<x>[)\]}}])
        |(?P<p>\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|[-+*/%&|^=!<>]=|&&|\|\||[-+*/%&|^=!<>~?:;,.])
        |(?P<z>\s+|\\\r?\n)
        |(?P<e3>.)""",
    "go": rf"""
        (?P<c>//[^\n]*|/\*.*?\*/)
        |(?P<e1>/\*.*)
        |(?P<s>"(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]{{1,9}}?)')
        |(?P<e2>["'`])
        |(?P<n>{_NUMBER}[a-zA-Z]?)
        |(?P<w>{_WORD})
        |(?P<o>[(\[{{])|(?P<x>[)\]}}])
        |(?P<p>\.\.\.|<<=|>>=|&\^=|&\^|<-|:=|\+\+|--|<<|>>|[-+*/%&|^=!<>]=|&&|\|\||[-+*/%&|^=!<>~:;,.])
        |(?P<l>\n)
        |(?P<z>[^\S\n]+)
        |(?P<e3>.)""",
    "rust": rf"""
        (?P<c>//[^\n]*)
        |(?P<k>/\*)
        |(?P<s>(?:b|c)?r(?P<h>\#*)".*?"(?P=h)|(?:b|c)?"(?:[^"\\]|\\.)*"|b?'(?:[^'\\\n]|\\[^\n]{{1,12}}?)')
        |(?P<e1>(?:b|c)?r\#*"|(?:b|c)?")
        |(?P<q>'{_WORD})
        |(?P<e2>')
        |(?P<n>(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*|\.(?![\w.]))?(?:[eE][+-]?\d[\d_]*)?)\w*)
        |(?P<w>r\#{_WORD}|{_WORD})
        |(?P<o>[(\[{{])|(?P<x>[)\]}}])
        |(?P<p>\.\.=|\.\.\.|\.\.|::|=>|->|<<=|>>=|<<|>>|[-+*/%&|^=!<>]=|&&|\|\||[-+*/%&|^=!<>~?:;,.@\#$])
        |(?P<z>\s+)
        |(?P<e3>.)""",
    "javascript": rf"""
        (?P<c>//[^\n\r\u2028\u2029]*|/\*.*?\*/|\A\#![^\n]*)
        |(?P<e1>/\*.*)
        |(?P<s>"(?:[^"\\\r\n]|\\\r\n|\\.)*"|'(?:[^'\\\r\n]|\\\r\n|\\.)*')
        |(?P<e2>["'])
        |(?P<t>`)
        |(?P<n>{_NUMBER}n?)
        |(?P<w>\#?(?:[$]|[^\W\d])[\w$\u200c\u200d]*)
        |(?P<o>[(\[{{])|(?P<x>[)\]}}])
        |(?P<p>\.\.\.|=>|>>>=|>>>|<<=|>>=|\*\*=|\?\?=|&&=|\|\|=|===|!==|\*\*|\?\?|\?\.(?!\d)|\+\+|--|<<|>>|[-+*/%&|^=!<>]=|&&|\|\||[-+*/%&|^=!<>~?:;,.@])
        |(?P<l>\r?\n|\r)
        |(?P<z>[^\S\n\r]+|\ufeff)
        |(?P<e3>.)""",
    "python": rf"""
        (?P<c>\#[^\n]*)
        |(?P<s>(?i:[rbuft]|br|rb|fr|rf|tr|rt)?(?:'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))
        |(?P<e1>'''|\"\"\")
        |(?P<e2>["'])
        |(?P<n>{_NUMBER}[jJ]?)
        |(?P<w>{_WORD})
        |(?P<o>[(\[{{])|(?P<x>[)\]}}])
        |(?P<p>\*\*=|//=|<<=|>>=|\.\.\.|:=|->|\*\*|//|<<|>>|[-+*/%&|^=!<>@]=|[-+*/%&|^=<>~:;,.@])
        |(?P<l>\r?\n|\r)
        |(?P<z>[^\S\n\r]+|\\\r?\n|\ufeff|\x0c)
        |(?P<e3>.)""",
    "json": r"""
        (?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[\da-fA-F]{4}))*")
        |(?P<e1>")
        |(?P<n>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))
        |(?P<w>(?:true|false|null)\b)
        |(?P<o>[\[{])|(?P<x>[\]}])
        |(?P<p>[,:])
        |(?P<z>[ \t\r\n]+)
        |(?P<e3>.)""",
    "toml": r"""
        (?P<c>\#[^\n]*)
        |(?P<s>\"\"\"(?:[^\\]|\\.)*?\"{3,5}|'''.*?'{3,5}|"(?:[^"\\\n]|\\.)*"|'[^'\n]*')
        |(?P<e1>\"\"\"|''')
        |(?P<e2>["'])
        |(?P<w>[\w+:-]+)
        |(?P<o>[\[{])|(?P<x>[\]}])
        |(?P<p>[.,=])
        |(?P<l>\r?\n)
        |(?P<z>[ \t]+)
        |(?P<e3>.)""",
}
_RULES["typescript"] = _RULES["javascript"]
_SCAN = {k: re.compile(v, re.X | re.S) for k, v in _RULES.items()}
_MESSAGES = {"e1": "unterminated comment or text", "e2": "unterminated literal", "e3": "stray character"}
_COMMENT_STEP = re.compile(r"/\*|\*/")

#: Words after which a slash begins a regular expression.
_JS_BEFORE_REGEX = set(
    "return typeof case in of delete void throw new instanceof else do yield await default extends".split()
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\.|\[(?:[^\]\\\n\r]|\\.)*\])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_C_LINE = re.compile(r"[ \t]*#(?:[^\n\\/\"']|\\\r?\n|\\.|/(?![*/])|//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[\"'])*", re.S)


def lex(language: str, text: str, whole: bool = False) -> tuple[list[Token], list[tuple[str, int]]]:
    """Tokens and the lexer's own errors (message, position).

    The scan ends at an unterminated comment or text, or after 20 errors; with ``whole`` it goes on to the end of
    the text, and what no token can be told from is one token ``e``.
    """
    if language in ("javascript", "typescript"):
        return _lex_js(text, whole)
    tokens: list[Token] = []
    errors: list[tuple[str, int]] = []
    scan, pos, n = _SCAN[language].match, 0, len(text)
    is_c = language == "c"
    if not is_c and language != "rust":  # no state but the pattern's own: one sweep
        for m in _SCAN[language].finditer(text):
            kind = m.lastgroup
            if kind == "z":
                continue
            pos, end = m.span()
            if kind[0] == "e":
                errors.append((_MESSAGES[kind], pos))
                if not whole and (kind == "e1" or len(errors) > 20):
                    return tokens, errors
                kind = "e"
            tokens.append((kind, pos, end))
        return tokens, errors
    fresh = True  # nothing but white space since the line began
    add = tokens.append
    while pos < n:
        if is_c and fresh and (m := _C_LINE.match(text, pos)):
            add(("d", pos, m.end()))
            pos, fresh = m.end(), False
            continue
        m = scan(text, pos)
        kind, end = m.lastgroup, m.end()
        if kind == "h":
            kind = "s"
        if kind == "z":
            if is_c:
                fresh = "\n" in m.group()
        elif kind == "k":  # nested comment
            depth, at = 1, end
            while depth and (s := _COMMENT_STEP.search(text, at)):
                depth += 1 if s.group() == "/*" else -1
                at = s.end()
            if depth:
                errors.append((_MESSAGES["e1"], pos))
                if whole:
                    add(("e", pos, n))
                return tokens, errors
            end = at
            add(("c", pos, end))
        elif kind[0] == "e":
            errors.append((_MESSAGES[kind], pos))
            if not whole and (kind == "e1" or len(errors) > 20):
                return tokens, errors
            add(("e", pos, end))
            fresh = False
        else:
            add((kind, pos, end))
            fresh = is_c and kind == "c" and fresh
        pos = end
    return tokens, errors


def _lex_js(text: str, whole: bool = False) -> tuple[list[Token], list[tuple[str, int]]]:
    tokens: list[Token] = []
    errors: list[tuple[str, int]] = []
    scan, pos, n = _SCAN["javascript"].match, 0, len(text)
    depth: list[int] = []  # open braces since each template's ${
    last = ""  # the last token that counts
    last_kind = ""
    while pos < n:
        ch = text[pos]
        if ch == "/" and (
            last_kind in ("", "p", "o") and last not in ("++", "--") or last_kind == "w" and last in _JS_BEFORE_REGEX
            or last == "}"
        ) and (m := _JS_REGEX.match(text, pos)):
            tokens.append(("r", pos, m.end()))
            last_kind, last, pos = "r", "", m.end()
            continue
        m = scan(text, pos)
        kind, end = m.lastgroup, m.end()
        if depth and kind in "ox" and ch in "{}":
            if ch == "{":
                depth[-1] += 1
            elif depth[-1]:
                depth[-1] -= 1
            else:  # back in the template
                depth.pop()
                tokens.append(("x", pos, end))
                kind = "t"
        if kind == "t":
            body = _TEMPLATE.match(text, end).end()
            if body >= n:
                errors.append(("unterminated literal", pos))
                if whole:
                    tokens.append(("e", pos if ch == "`" else end, n))
                return tokens, errors
            if text[body] == "`":
                tokens.append(("s", pos if ch == "`" else end, body + 1))
                last_kind, last, pos = "s", "", body + 1
            else:
                tokens.append(("s", pos if ch == "`" else end, body))
                tokens.append(("o", body, body + 2))
                depth.append(0)
                last_kind, last, pos = "o", "${", body + 2
            continue
        if kind[0] == "e":
            errors.append((_MESSAGES[kind], pos))
            if not whole and (kind == "e1" or len(errors) > 20):
                return tokens, errors
            tokens.append(("e", pos, end))
            last_kind = "e"
        elif kind != "z":
            tokens.append((kind, pos, end))
            if kind not in "cl":
                last_kind, last = kind, m.group()
        pos = end
    if depth:
        errors.append(("unterminated literal", n))
    return tokens, errors


def comments(language: str, text: str) -> list[tuple[int, int]]:
    """Spans of the comments."""
    return [(a, b) for k, a, b in lex(language, text)[0] if k == "c"]

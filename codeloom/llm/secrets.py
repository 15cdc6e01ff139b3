"""Credentials embedded in source code, found through encodings and redacted in place.

A text is scanned for values in the published token formats, for private-key blocks, for
passwords in addresses, and for literals that stand where a credential is given: under a
name that says so, in a login call, a header, a command line or a remark. Every longer
literal is also decoded (base64, hex, percent, escapes), layer by layer, and what comes
out is scanned again; binary containers are read by their grammar (DER sequences), which
tells private keys from certificates and public keys. A find in an inner layer is charged
to the literal that encloses it.

Redaction overwrites the value, or the whole enclosing encoded literal, by as many letters
``x``, keeping line ends and escapes, so that offsets and syntax stay; a second scan of the
result finds nothing.

Defined results: null content gives no row; placeholders, masked and documented sample
values, references to variables or vaults, digests, identifiers, public keys and
certificates are no finds. Repeated rows give one find a line. Whole texts are scanned,
one pass without a shuffle but for the final distinct; very long literals are decoded too.
"""

from __future__ import annotations

import base64
import binascii
import re
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Find = tuple[int, int, str]  # start and end of what is overwritten, kind

# Published token formats.
_FORMATS = re.compile(
    r"""(?x)
    (?P<aws>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9]))
    | (?P<github>(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{40,255})(?![A-Za-z0-9_]))
    | (?P<gitlab>(?<![A-Za-z0-9_])glpat-[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_]))
    | (?P<slack>(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9-]{20,}(?![A-Za-z0-9]))
    | (?P<stripe>(?<![A-Za-z0-9])[sr]k_live_[A-Za-z0-9]{16,}(?![A-Za-z0-9]))
    | (?P<google>(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-]))
    | (?P<mail>(?<![A-Za-z0-9])SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,})
    | (?P<npm>(?<![A-Za-z0-9])(?:npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{40,})(?![A-Za-z0-9]))
    | (?P<jwt>(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,})
    """
)
_HEADS = (
    "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "k_live_", "AIza", "SG.", "npm_", "pypi-", "eyJ",
)
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----")
_URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.-]{1,20}://([^\s:/@\"'`<>]*):([^\s/@\"'`<>]+)@[^\s\"'`<>]")
_SCHEME = re.compile(r"(?i)\b(basic|bearer)[ \t]+([A-Za-z0-9+/_=.~-]{8,})")

# Names under which credentials are kept, without separators.
_NAMES = re.compile(
    r"apikey|apitoken|authtoken|accesstoken|refreshtoken|bearertoken|accesskey|secretkey|secrettoken|clientsecret|signingsecret|signingkey"
    r"|privatekey|encryptionkey|masterkey|webhooksecret|sharedsecret|dbpass|password|passwd|passphrase|passcode|kennwort|passwort|motdepasse"
    r"|pwd|contrasena|senha|secret|credential"
)
_NAME_HINT = re.compile(r"(?i)key|token|secret|pass|pwd|pw|auth|cred|kennwort|senha|contrase|jwt|psk")
_SHORT_NAMES = {"pw", "pwd", "pass", "jwt", "creds", "psk"}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

_QUOTED = r"""(?P<q>\"\"\"|'''|["'`])(?P<v>(?:\\.|(?!(?P=q))[^\n\\])*)(?P=q)"""
_ASSIGNED = re.compile(
    r"""(?P<key>[A-Za-z_$][\w$.-]*)["']?\]?[ \t]*(?::[ \t]*[&\w<>\[\]' ]{1,30}[ \t]*(?==))?(?::=|=>|=|:)[ \t]*(?:[bBrRuUfF]|&|\(|(?:concat!|String::from|String|str|bytes|Buffer\.from|atob|(?:base64\.)?b64decode|(?:binascii\.)?unhexlify|bytes\.fromhex|\[\]byte)\([ \t]*b?)?[ \t]*(?:\r?\n[ \t]*)?""" + _QUOTED
)
_OPTION = re.compile(r"(?P<key>[A-Za-z_][\w.:]*)[ \t]*,[ \t]*(?:\r?\n[ \t]*)?" + _QUOTED)  # an option's name and its value
_DEFINED = re.compile(r"#[ \t]*define[ \t]+(?P<key>\w+)[ \t]+" + _QUOTED)
_CONTINUED = re.compile(r"[ \t]*(?:\\?\r?\n[ \t]*)?(?:\+|\.(?!\w)|\.\.|,(?=[^\n]*\"\)))?[ \t]*(?:\\?\r?\n[ \t]*)?" + _QUOTED)
_BARE = re.compile(r"(?m)^[ \t]*(?:export[ \t]+|set[ \t]+|//[^\s=]*:)?(?P<key>[A-Za-z_][\w.-]*)[ \t]*[=:][ \t]*(?P<v>[^\s\"'`#;{\[(<$&|][^\s\"'`;,]*)[ \t]*(?:#.*)?\r?$")
_CALLS = [
    re.compile(r"""(?i)\b(?:login|sign_?in|authenticate|set_?basic_?auth|basic_?auth|http_?basic\w*|auth)\b[ \t]*(?:=[ \t]*)?\([ \t]*["'][^"'\n]*["'][ \t]*,[ \t]*""" + _QUOTED),
    re.compile(r"""(?i)\.(?:password|passwd|pass|api_?key|token|secret)[ \t]*\([ \t]*""" + _QUOTED),
    re.compile(r"""(?i)["'](?:x-api-key|x-auth-token|api-key|x-access-token|private-token)["'][ \t]*\]?[ \t]*[,:=][ \t]*""" + _QUOTED),
]
_INLINE = [
    re.compile(r"""(?i)(?:x-api-key|x-auth-token|api-key|x-access-token|private-token)[ \t]*:[ \t]*(?P<v>[^\s"'`\\,;]{6,})"""),
    re.compile(r"""(?i)--(?:password|passwd|pass|pw|token|api[-_]?key|secret|client-secret|auth-token)(?:=|[ \t]+)["']?(?P<v>[^\s"'`\\,;]{6,})"""),
    re.compile(r"""(?i)\bcurl\b[^\n]*?[ \t](?:-u|--user)[ \t=]*["']?[^\s:"'`]+:(?P<v>[^\s"'`\\@]+)"""),
    re.compile(r"""(?i)\b(?:password|passwd|passphrase|pw|pwd|token|secret|api[ _-]?key|kennwort)[ \t]+(?:was|is|used[ \t]+to[ \t]+be|ist|war|=|:)[ \t]*(?P<v>[^\s"'`]{6,}?)[.,;]?(?=[ \t\r\n]|$)"""),
    re.compile(r"""(?i)\b(?:IDENTIFIED[ \t]+BY|PGPASSWORD=|MYSQL_PWD=|sshpass[ \t]+-p)[ \t]*["']?(?P<v>[^\s"'`;]{6,})"""),
]
_LITERAL = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_ESCAPE = re.compile(r"\\x[0-9A-Fa-f]{2}|\\u\{?[0-9A-Fa-f]{2}|\\[0-3][0-7]{2}")
_CODED = re.compile(r"[^\s\"'`<>]*(?:%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\u\{?[0-9A-Fa-f]{2,6}\}?|\\[0-3][0-7]{2})[^\s\"'`<>]*")

# What stands for a credential without being one.
_STAND_IN = re.compile(
    r"""(?ix)
    change[-_ ]?me|todo|fixme|your[-_ ]?|example|place[-_ ]?holder|redacted|dummy|insert|replace[-_ ]?(?:me|with)|not[-_ ]?a[-_ ]?(?:real|secret)
    |^<.*>$|^\[.*\]$|^\{.*\}$|\$\{|\$\(|\{\{|^\$\w+$|^%\w+%$|^%[sdv]$|os\.environ|getenv|process\.env|env!|vault:|^vault|arn:|fake|lorem|foobar|sekret
    |none$|null$|undefined|^x-api|(?:0123456789|1234567890|abcdefgh)|^test|^string$|xxxx|\*\*\*|\.\.\.|0000000|secrets?/
    """
)
_UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
_DIGEST = re.compile(r"(?i)(?:sha\d+|md5|blake\w+)[:-]\S+$|(?:[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})$")


def names_credential(key: str) -> bool:
    """Whether a name says that its value is a credential."""
    if _NAMES.search(re.sub(r"[^a-z]", "", key.lower())):
        return True
    return any(p.lower() in _SHORT_NAMES for p in _PARTS.findall(key))


def credential(key: str, v: str) -> bool:
    """Whether the literal ``v`` under the name ``key`` is one."""
    if names_credential(key):
        hashed = re.search(r"(?i)hash|sha\d|md5|checksum|digest|fingerprint|etag", key)
        return usable(v) or not hashed and bool(re.fullmatch(r"[0-9a-fA-F]{32,128}", v)) and not masked(v)
    # "token" or "key" alone also names other things: only a random value decides
    if re.search(r"(?i)token|key|auth(?!or)", key):
        return (
            bool(re.fullmatch(r"[A-Za-z0-9+/_=-]{20,}", v)) and usable(v) and all(re.search(p, v) for p in (r"\d", r"[a-z]", r"[A-Z]"))
            and len(re.findall(r"[a-z][A-Z0-9]|[A-Z0-9][a-z]", v)) >= len(v) // 5
        )
    return False


def masked(v: str) -> bool:
    """Stands in for a credential: empty, masked, a placeholder, or one repeated sign."""
    return len(set(v)) <= 3 or bool(_STAND_IN.search(v))


def usable(v: str) -> bool:
    """Whether a literal given as a credential may be one."""
    if len(v) < 6 or masked(v) or _UUID.match(v) or _DIGEST.match(v) or re.search(r"\s", v):
        return False
    if v.startswith(("data:", "http://", "https://", "./", "../", "/")) or v.endswith((".pem", ".key", ".txt", ".json", ".crt")):
        return False
    digits, lower, upper = (bool(re.search(p, v)) for p in (r"\d", r"[a-z]", r"[A-Z]"))
    if digits and (lower or upper):
        # a plain word with a few digits is a setting rather than a credential
        return not re.fullmatch(r"(?:[A-Z]?[a-z]+|[A-Z]+)[-_]?\d{1,2}", v) or len(v) >= 16
    if digits:
        return len(v) >= 12 and not re.fullmatch(r"[\d.:-]+", v)
    if lower and upper:  # letters only: cased as no name is
        return len(v) >= 10 and not re.fullmatch(r"[A-Z]*[a-z]+(?:[-_. ]?[A-Z][a-z]+)*[A-Z]?(?:[-_. ][A-Za-z][a-z]*)*", v)
    return False


# Object identifiers, encoded, of the password-based encryptions (PKCS#5, PKCS#12) and of plain data (PKCS#7).
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_DATA = bytes.fromhex("2a864886f70d010701")
_OPENSSH = b"openssh-key-v1\0"


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER elements that fill ``data[at:end]`` exactly, or None."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            k = size & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            size, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def _der(data: bytes) -> str | None:
    """"private", "public" or "other" if the bytes are one container of keys by its grammar.

    Private: PKCS#1 and DSA (a version and six integers or more), PKCS#8 (version, algorithm, octets) and its encrypted form
    (a password-based algorithm, octets), SEC 1 (version 1, octets), PKCS#12 (version 3, content, perhaps a MAC), OpenSSH.
    A container of another kind is searched for one of these in its sequences and octets.
    """
    if data.startswith(_OPENSSH):
        return "private"
    outer = _elements(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return None
    todo, kind = [outer[0]], "other"
    while todo:
        tag, at, end = todo.pop()
        if tag == 0x04:  # octets may hold a sequence of their own
            inner = _elements(data, at, end) if data[at : at + 1] == b"\x30" else None
            todo += inner if inner and len(inner) == 1 else []
            continue
        parts = _elements(data, at, end)
        if not parts:
            continue
        tags = [t for t, _, _ in parts]
        first = data[parts[0][1] : parts[0][2]]
        if tags[0] == 0x02 and tag == 0x30:
            if first in (b"\0", b"\1") and (tags.count(0x02) == len(tags) >= 6 or tags[1:3] == [0x30, 0x04] or first == b"\1" and tags[1:2] == [0x04]):
                return "private"
            if first == b"\3" and tags[1:] in ([0x30], [0x30, 0x30]):
                inner = _elements(data, *parts[1][1:]) or []
                if inner and inner[0][0] == 0x06 and data[inner[0][1] : inner[0][2]] == _DATA:
                    return "private"
        if tags == [0x30, 0x04]:
            inner = _elements(data, *parts[0][1:]) or []
            if inner and inner[0][0] == 0x06 and data[inner[0][1] : inner[0][2]].startswith(_PBE):
                return "private"
        if tags in ([0x30, 0x03], [0x30, 0x30, 0x03], [0x02, 0x02]) and kind == "other":
            kind = "public"
        todo += [p for p in parts if p[0] in (0x30, 0x31, 0x04) or p[0] & 0xE0 == 0xA0]
    return kind


def _text_of(data: bytes) -> str | None:
    """The text that bytes hold: UTF-8, or UTF-16 told by its mark or by zeros in every other byte."""
    codec = "utf-8"
    if len(data) >= 12 and len(data) % 2 == 0:
        if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
            codec = "utf-16"
        elif not any(data[1::2]):
            codec = "utf-16-le"
        elif not any(data[::2]):
            codec = "utf-16-be"
    try:
        s = data.decode(codec)
    except UnicodeDecodeError:
        return None
    return s if len(s) >= 6 and sum(c.isprintable() or c in "\n\r\t" for c in s) == len(s) else None


def _layers(literal: str) -> Iterator[tuple[str | None, bytes | None]]:
    """What a literal decodes to: text, or bytes where it is none."""
    if re.fullmatch(r"(?:[0-9a-fA-F]{2}){8,}", literal):
        data = bytes.fromhex(literal)
        yield _text_of(data), data
    if len(literal) >= 16 and re.fullmatch(r"[A-Za-z0-9+/_-]+={0,2}", literal):
        body = literal.rstrip("=").replace("-", "+").replace("_", "/")
        if len(body) % 4 != 1:
            try:
                data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
            except (binascii.Error, ValueError):
                data = b""
            if data:
                yield _text_of(data), data
    if re.search(r"%[0-9A-Fa-f]{2}", literal):
        s = urllib.parse.unquote(literal)
        if s != literal:
            yield s, None
    if "\\" in literal:
        s = re.sub(
            r"\\x([0-9A-Fa-f]{2})|\\u\{?([0-9A-Fa-f]{2,6})\}?|\\([0-3][0-7]{2})",
            lambda m: chr(min(int(m.group(1) or m.group(2) or "0", 16) or int(m.group(3) or "0", 8), 0x10FFFF)),
            literal,
        )
        if s != literal:
            yield s, None


def _strong(text: str) -> Iterator[Find]:
    """Finds that need no name: formats, key blocks, addresses, header values."""
    for m in _FORMATS.finditer(text) if any(h in text for h in _HEADS) else ():
        v = m.group()
        body = re.sub(r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|xox\w-)", "", v)
        if not masked(body) and not re.search(r"(?i)example|sample|(.)\1{6}", v) and (m.lastgroup == "aws" or re.search(r"\d", body)):
            yield m.start(), m.end(), m.lastgroup
    for m in _PEM.finditer(text):
        last = text.find("-----BEGIN ", m.end())  # a block without an end reaches to the next one
        last = last if last >= 0 else len(text)
        end = text.find("-----END ", m.end(), last)
        stop = end if end >= 0 else last
        body = re.sub(r"\\+[nrt]|[\s\"'+\\]|//|#", "", text[m.end() : stop])
        if len(body) < 16 or masked(body):
            continue
        yield m.start(), stop, "private key"
    for m in _URL.finditer(text):
        v = urllib.parse.unquote(m.group(2))
        cased = len(v) >= 8 and len(re.findall(r"[a-z][A-Z]", v)) >= 2 and not names_credential(v)
        if not masked(v) and (cased or re.search(r"\d|[^A-Za-z]", v)) and not re.match(r"(?i)pass(?:word|wd)?\d?$", v) and v.lower() != m.group(1).lower():
            yield m.start(2), m.end(2), "password in an address"
    for m in _SCHEME.finditer(text):
        v = m.group(2)
        if m.group(1).lower() == "basic":
            for inner, _ in _layers(v):
                if inner and ":" in inner and not masked(inner.split(":", 1)[1]) and len(inner.split(":", 1)[1]) >= 6 and re.search(r"\d|[^\w]", inner.split(":", 1)[1]):
                    yield m.start(2), m.end(2), "basic"
        elif usable(v) and len(v) >= 16:
            yield m.start(2), m.end(2), "bearer"


def _at_names(text: str) -> Iterator[re.Match]:
    """Assignments and options whose name may be a credential's: the patterns are tried only where such a word stands."""
    done = -1
    for h in _NAME_HINT.finditer(text):
        i = h.start()
        if i < done:
            continue
        while i > 0 and (text[i - 1].isalnum() or text[i - 1] in "_$.-"):
            i -= 1
        while i < h.end() and not (text[i].isascii() and text[i].isalpha() or text[i] in "_$"):
            i += 1  # a name begins with an ASCII letter; others may stand before it without a blank
        if m := _ASSIGNED.match(text, i) or _OPTION.match(text, i):
            done = m.end("key")
            if m.re is _ASSIGNED or names_credential(m.group("key")):
                yield m


def _named(text: str) -> Iterator[Find]:
    """Finds where a name, a call, a header, a command line or a remark gives a credential."""
    for pattern in (_ASSIGNED, _DEFINED):
        for m in _at_names(text) if pattern is _ASSIGNED else pattern.finditer(text):
            if credential(m.group("key"), m.group("v")):
                yield m.start("v"), m.end("v"), "named"
                rest = _CONTINUED.match(text, m.end())
                while rest and re.fullmatch(r"[\w+/=.~-]{6,}", rest.group("v")):
                    yield rest.start("v"), rest.end("v"), "continued"
                    rest = _CONTINUED.match(text, rest.end())
    for m in _BARE.finditer(text):
        if credential(m.group("key"), m.group("v")) and not re.search(r"[()\[\]{}]|::|->", m.group("v")):
            yield m.start("v"), m.end("v"), "named"
    for pattern in _CALLS:
        for m in pattern.finditer(text):
            if usable(m.group("v")):
                yield m.start("v"), m.end("v"), "call"
    for pattern in _INLINE:
        for m in pattern.finditer(text):
            if usable(m.group("v")) and not re.search(r"[()\[\]{}]|::|->", m.group("v")):
                yield m.start("v"), m.end("v"), "inline"


def _decoded(text: str) -> Iterator[tuple[re.Match, str | None]]:
    """Every encoded literal with the text inside it; None where it is a private key."""
    coded = "%" in text or "\\" in text and _ESCAPE.search(text)
    for pattern in (_LITERAL, _CODED) if coded else (_LITERAL,):
        for m in pattern.finditer(text):
            literal = m.group()
            for inner, data in _layers(literal):
                if data is not None and _der(data) == "private":
                    yield m, None
                elif inner is not None and len(inner) < len(literal):  # so that the layers come to an end
                    yield m, inner


def _hidden(text: str) -> Iterator[Find]:
    """Finds inside encoded literals, charged to the outermost literal."""
    for m, inner in _decoded(text):
        if inner is None:
            yield m.start(), m.end(), "encoded private key"
        elif _any(inner):
            yield m.start(), m.end(), "encoded"


def _any(text: str) -> bool:
    """Whether a decoded text holds a credential, itself or in any layer below."""
    todo, seen = [text], {text}
    while todo:
        t = todo.pop()
        if any(True for _ in _strong(t)) or any(True for _ in _named(t)):
            return True
        for _, inner in _decoded(t):
            if inner is None:
                return True
            if inner not in seen:
                seen.add(inner)
                todo.append(inner)
    return False


_HINTS = (
    "key", "token", "secret", "pass", "pwd", "pw", "auth", "cred", "kennwort", "senha", "contrase", "jwt", "psk", "login", "sign_in", "signin", "://", "eyj",
    "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat", "glpat", "xox", "k_live", "aiza", "npm_", "pypi-", "sg.", "begin", "basic",
    "bearer", "curl", "identified",
)


def finds(text: str) -> list[Find]:
    """All finds of a text, in order, without overlaps."""
    if not text:
        return []
    found: list[Find] = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += _strong(text)
        found += _named(text)
    found += _hidden(text)
    found.sort(key=lambda f: (f[0], -f[1]))
    out: list[Find] = []
    for f in found:
        if out and f[0] < out[-1][1]:
            if f[1] > out[-1][1]:
                out[-1] = (out[-1][0], f[1], out[-1][2])
            continue
        out.append(f)
    return out


_KEEP = re.compile(r"-----(?:BEGIN|END)[^-\n]*-----|\\+(?:[nrtb0\"'\\/]|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})|[^A-Za-z0-9]+")


def redact(text: str, found: list[Find] | None = None) -> str:
    """The text with all finds overwritten; its length, lines and quoting stay."""
    found = finds(text) if found is None else found
    out, at = [], 0
    for a, b, kind in found:
        out.append(text[at:a])
        body = text[a:b]
        if kind == "private key":
            done, p = [], 0
            for m in _KEEP.finditer(body):
                done.append("x" * (m.start() - p))
                done.append(re.sub(r"[+/=]", "x", m.group()) if not m.group().startswith(("\\", "-----")) and "//" not in m.group() else m.group())
                p = m.end()
            done.append("x" * (len(body) - p))
            out.append("".join(done))
        else:
            out.append("x" * len(body))
        at = b
    out.append(text[at:])
    return "".join(out)


FOUND = "repo_id string, relative_path string, line_number bigint, kind string"
CLEAN = "repo_id string, relative_path string, content string, n_secrets int, n_left int"


def _find_batches(batches):
    names = [f.split()[0] for f in FOUND.split(", ")]
    for b in batches:
        rows: list[list] = [[] for _ in names]
        for repo, path, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for a, _, kind in finds(text) if text else ():
                if kind == "continued":  # a further part of a credential that has its row
                    continue
                for c, v in zip(rows, (repo, path, text.count("\n", 0, a) + 1, kind), strict=True):
                    c.append(v)
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=names)


def _clean_batches(batches):
    names = [f.split()[0] for f in CLEAN.split(", ")]
    for b in batches:
        rows: list[list] = [[] for _ in names]
        for repo, path, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found = finds(text) if text else []
            clean = redact(text, found) if found else text
            # what nothing was found in needs no second look
            for c, v in zip(rows, (repo, path, clean, len(found), len(finds(clean)) if found else 0), strict=True):
                c.append(v)
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=names)


def locate(content: DataFrame) -> DataFrame:
    """Distinct (repo_id, relative_path, line_number, kind) of every credential."""
    return content.select("repo_id", "relative_path", "content").mapInArrow(_find_batches, FOUND).distinct()


def cleaned(content: DataFrame) -> DataFrame:
    """Every row of the table with its credentials overwritten, how many there were, and how many a second search still finds."""
    return content.select("repo_id", "relative_path", "content").mapInArrow(_clean_batches, CLEAN)


def lines(located: DataFrame) -> DataFrame:
    return located.select("repo_id", "relative_path", F.col("line_number")).distinct()

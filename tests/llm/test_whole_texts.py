"""Texts are judged as a whole: behind lexical errors, in small keys, and in every layer."""

from __future__ import annotations

import base64

import pytest

from codeloom.functions.lexing import lex
from codeloom.llm import provenance, secrets, syntax


STRAY = "int a = 1;\n" * 12 + "@ ` @ ` @ ` @ ` @ ` @ ` @ ` @ ` @ ` @ ` @ ` @ `\n"


def test_provenance_reads_on_behind_lexical_errors():
    a, b = (provenance.features("src/a.c", STRAY + x) for x in ("int one(void);\n", "int two(void);\n"))
    assert a[2] != b[2]
    assert provenance.features("src/a.c", STRAY + "// Code generated by protoc. DO NOT EDIT.\n")[:2] == ("generated", "notice")
    for path, cut in (("src/a.c", "/* open "), ("src/a.rs", "/* open "), ("src/a.js", "`open "), ("src/a.py", "'''open ")):
        a, b = (provenance.features(path, "x = 1;\n" * 30 + cut + x) for x in ("one\n", "two\n"))
        assert a[2] != b[2], path
    assert provenance.features("src/a.c", "/* Code generated by protoc. DO NOT EDIT.\n")[0] == "generated"
    assert len(lex("c", STRAY + "int last;")[1]) == 21  # the early stop stays for other callers


@pytest.mark.parametrize("head", ["302e020100300506032b657004220420", "302e020100300506032b656e04220420", "30250201010420", "303102010104 20a00a06082a8648ce3d030107"])
def test_short_private_keys_are_found(head):
    head = bytes.fromhex(head)
    key = bytes((i * 37 + 129) % 256 for i in range(32))
    data = head[:7] + key + head[7:] if head[1] == 0x31 else head + key
    for literal in (base64.b64encode(data).decode(), data.hex()):
        assert [f[2] for f in secrets.finds(f'SERVER_DER = "{literal}"')] == ["encoded private key"]
    public = bytes.fromhex("302a300506032b6570032100") + key
    assert not secrets.finds(f'SERVER_DER = "{base64.b64encode(public).decode()}"')


@pytest.mark.parametrize("before", ["密码", "é", "ключ-", "1é2.", "", "a密"])
def test_names_behind_other_letters_are_found(before):
    for name in ("password", "db_password", "api_key"):
        text = f'x = 1 # {before}{name}: "Zq7vR2mK9xTb"'
        assert [text[a:b] for a, b, _ in secrets.finds(text)] == ["Zq7vR2mK9xTb"]


CALLS = [f'c.{n}("deploy", "Zq7vR2mK9xTb")' for n in ("login", "sign_in", "signIn", "authenticate", "set_basic_auth", "setBasicAuth", "basic_auth", "http_basic", "auth")]
CALLS += [f'c.{n}("Zq7vR2mK9xTb")' for n in ("password", "passwd", "pass", "api_key", "apikey", "token", "secret")]
CALLS += [f'h["{n}"] = "Zq7vR2mK9xTb"' for n in ("x-api-key", "x-auth-token", "api-key", "x-access-token", "private-token")]
CALLS += [f"run --{n} Zq7vR2mK9xTb" for n in ("password", "passwd", "pass", "pw", "token", "api-key", "secret", "client-secret", "auth-token")]
CALLS += [f"the {n} was Zq7vR2mK9xTb" for n in ("password", "passwd", "passphrase", "pw", "pwd", "token", "secret", "api key", "kennwort")]
CALLS += ["curl -u me:Zq7vR2mK9xTb http", "IDENTIFIED BY 'Zq7vR2mK9xTb'", "PGPASSWORD=Zq7vR2mK9xTb", "MYSQL_PWD=Zq7vR2mK9xTb", "sshpass -p Zq7vR2mK9xTb"]


@pytest.mark.parametrize("line", CALLS)
def test_every_guarded_form_holds_a_hint(line):
    assert any(h in line.lower() for h in secrets._HINTS)
    assert secrets.finds(line)


@pytest.mark.parametrize("layers", [1, 4, 5, 9])
def test_every_layer_is_opened(layers):
    inner = 'password = "Zq7vR2mK9xTb"'
    for i in range(layers):
        inner = base64.b64encode(inner.encode()).decode() if i % 2 == 0 else inner.encode().hex()
    text = f'x = "{inner}"'
    assert [f[2] for f in secrets.finds(text)] == ["encoded"]
    assert inner not in secrets.redact(text) and not secrets.finds(secrets.redact(text))


def test_long_chains_of_layers_end():
    assert not secrets.finds("x = '%" + "25" * 400 + "41'")


def test_deep_nesting_keeps_the_verdict_of_the_stack():
    n = 200_000
    assert syntax.fault("json", "[" * n) and syntax.fault("json", "[" * n + "]" * (n - 1))
    assert syntax.fault("json", "[" * n + "]" * n) is None
    assert syntax.fault("toml", "a = " + "[" * n) and syntax.fault("toml", "a = " + "[" * n + "]" * n) is None

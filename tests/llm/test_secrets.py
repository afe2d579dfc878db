"""Secret spans against the patterns run plainly, and planted keys."""

import base64
import hashlib
import random
import re

import pyarrow as pa

from flowlink.llm import secrets

PLAIN = re.compile(
    "(" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) if w != "api_key" else "[aA][pP][iI]_?[kK][eE][yY]" for w in ("password", "passwd", "secret", "token", "api_key"))
    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def brute(text):
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in PLAIN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def pieces():
    key = hashlib.sha1(b"k").hexdigest()
    return [
        "password", "PassWd", "secret", "toKen", "api_key", "apikey", "ſecret", "toKen", "=", ":", " ", "'", '"', "abc", "abcdef1",
        key, key[:23], "AKIA", "AKIA" + "A1" * 8, "AKIA" + "A1" * 7 + "A", "\n", "é", "😀", ".", "_", "==",
    ]


def test_base_spans_match_the_patterns(odd):
    draw = random.Random(5)
    texts = odd + ["".join(draw.choice(pieces()) for _ in range(draw.randint(1, 14))) for _ in range(1500)]
    found = secrets.scan(pa.array(texts, pa.string()))
    for text, spans in zip(texts, found):
        assert [s[:3] for s in spans if s[0] != "novel"] == brute(text), text
        assert spans == sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_random_keys_in_sensitive_places_are_novel():
    key = base64.b64encode(hashlib.sha512(b"x").digest()).decode()[:40]
    told = f"export SESSION_AUTH {key} # keep\n"
    assert [s[0] for s in secrets.scan(pa.array([told]))[0]] == ["novel"]
    # Said twice, near or far, it is as much a key at both places.
    for between in (0, 1000, 1990, 2100, 6000):
        apart = told + "some words in between " * (between // 22) + told
        assert [s[0] for s in secrets.scan(pa.array([apart]))[0]] == ["novel", "novel"], between
    # No sensitive word near, or made of known names: nothing.
    assert secrets.scan(pa.array([f"the picture {key} is here"]))[0] == []
    assert secrets.scan(pa.array(["auth request_handler_response_timeout_00000000"]))[0] == []


def test_an_unspaced_name_is_the_context_of_its_value():
    key = base64.b64encode(hashlib.sha512(b"y").digest()).decode()[:39] + "="
    for name in ("AWS_SECRET_ACCESS_KEY", "PRIVATE_KEY", "AUTH", "?session"):
        told = f"{name}={key}\nnext line"
        novel = [s[1:3] for s in secrets.scan(pa.array([told]))[0] if s[0] == "novel"]
        assert novel == [(len(name) + 1, len(name) + 1 + len(key))], name
    # A key that another assignment follows, and a name that isn't sensitive.
    told = f"auth={key[:39]}=on"
    assert [s[1:3] for s in secrets.scan(pa.array([told]))[0]] == [(5, 44)]
    assert secrets.scan(pa.array([f"picture={key}"]))[0] == []


def test_random_keys_of_every_length_and_alphabet_are_novel():
    draw = random.Random(8)
    for length in (16, 24, 40, 64, 128, 256, 1024, 4096):
        for size in (8, 10, 12):
            raw = [draw.randbytes(length) for _ in range(5)]
            code = {8: lambda b: b.hex().upper(), 10: lambda b: base64.b32encode(b).decode(), 12: lambda b: base64.b64encode(b).decode()}[size]
            for b in raw:
                key = code(b)[: length - 1] + "7A"[length % 2]
                told = f"private key {key}\n"
                assert "novel" in [s[0] for s in secrets.scan(pa.array([told]))[0]], (length, key)
    # Long runs of known names, or that repeat themselves, are not.
    names = [w for w in secrets.IDENTIFIERS.decode().split() if w.isalpha()]
    for length in (8, 32, 128):
        told = "auth " + "_".join(draw.choice(names) for _ in range(length)) + "_2\nauth " + "Ab3" * length
        assert secrets.scan(pa.array([told]))[0] == [], told


def test_operator_keeps_rows_and_other_columns(spark, odd):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(odd)], "doc_id bigint, text string, secrets int")
    out = secrets.find_secrets(docs)
    assert out.columns == docs.columns and out.count() == len(odd)
    assert secrets.find_secrets(docs.limit(0)).collect() == []

import base64
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemill.llm import kernel, secrets

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


PIECES = st.sampled_from(["password", "TOKEN", "api_key", "apikey", "=", ": ", '"', "'", "AKIA", "ABCDEFGHIJKLMNOP", "AKIA1234", "0123456789abcdef", "deadbeef", "é", " ", "\n", "x", "secret token", "ſecret", "toKen=abcdef", "a.b_c-d", "-----"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert [s[:3] for s in secrets.find(text) if s[0] in secrets.BASE] == base(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=10).map("".join), max_size=6))
def test_no_row_with_a_secret_is_passed_over(texts):
    import pyarrow as pa

    rows = set(secrets._candidates(pa.array(["lead", *texts], pa.string())[1:]).tolist())
    assert {i for i, t in enumerate(texts) if secrets.find(t)} <= rows


def test_candidates_across_cuts(monkeypatch):
    import pyarrow as pa

    texts = ["x " * 3_000_000 + "password=hunter22", "0" * 5_000_000, None, "y " * 1_000_000]
    assert set(secrets._candidates(pa.array(texts)).tolist()) >= {0, 1}
    assert kernel.SPACES[0x20]


def der(*parts, tag=0x30):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


def number(x, n=1):
    return der(x.to_bytes(n, "big"), tag=2)


RSA = der(number(0), *[number(2**500 + i, 64) for i in range(8)])
EC = der(number(1), der(b"k" * 32, tag=4))
PKCS8 = der(number(0), der(der(b"\x2a\x03", tag=6)), der(EC, tag=4))


@pytest.mark.parametrize(("key", "kind"), [(RSA, "rsa"), (EC, "ec"), (PKCS8, "pkcs8")])
def test_keys_are_confirmed_by_their_lengths(key, kind):
    coded = base64.b64encode(key).decode()
    assert [(s[0], s[3]) for s in secrets.find(f"see {coded} there") if s[0] == "key"] == [("key", kind)]
    assert [(s[0], s[3]) for s in secrets.find(f"see {key.hex()} there") if s[0] == "key"] == [("key", kind)]
    assert not [s for s in secrets.find(f"see {base64.b64encode(key[:-1]).decode()} there") if s[0] == "key"]
    pem = f"-----BEGIN PRIVATE KEY-----\n{coded[:40]}\n{coded[40:]}\n-----END PRIVATE KEY-----"
    assert [(s[0], s[1], s[2], s[3]) for s in secrets.find("é " + pem) if s[0] in ("pem", "key")] == [("pem", 2, 2 + len(pem), kind)]


def test_tokens_need_a_header_that_names_an_algorithm():
    code = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    good = f"{code({'alg': 'HS256', 'typ': 'JWT'})}.{code({'sub': 1})}.c2lnbmF0dXJl"
    assert [(s[0], s[3]) for s in secrets.find(good)] == [("jwt", "HS256")]
    assert not secrets.find(f"{code({'typ': 'JWT'})}.{code({'sub': 1})}.c2lnbmF0dXJl") and not secrets.find("eyJabc.eyJdef.xyz")


def elements(data):
    """The DER elements that fill the bytes, by cutting one after the other off the front; None if they don't."""
    out = []
    while data:
        if len(data) < 2:
            return None
        tag, n, rest = data[0], data[1], data[2:]
        if n > 127:
            n, size = 0, n - 128
            if not 1 <= size <= 4 or len(rest) < size:
                return None
            for byte in rest[:size]:
                n = n * 256 + byte
            rest = rest[size:]
        if len(rest) < n:
            return None
        out.append((tag, rest[:n]))
        data = rest[n:]
    return out


def plain_kind(data):
    outer = elements(data)
    if outer is None or len(outer) != 1 or outer[0][0] != 0x30 or len(data) < 16:
        return None
    inner = elements(outer[0][1])
    if not inner or inner[0][0] != 2 or len(inner[0][1]) != 1:
        return None
    tags = bytes(t for t, _ in inner)
    if tags[:9] == b"\x02" * 9:
        return "rsa"
    if tags[1:3] == b"\x30\x04":
        return "pkcs8"
    if tags[1:2] == b"\x04" and inner[0][1] == b"\x01":
        return "ec"
    return "dsa" if tags == b"\x02" * 6 else None


DSA = der(number(0), *[number(2**400 + i, 60) for i in range(5)])
KEYS = [RSA, EC, PKCS8, DSA, RSA[:-1], EC + b"x", b"\x31" + PKCS8[1:], der(number(1, 2), der(b"k" * 32, tag=4)), der(der(b"k" * 40, tag=4)), b"noise that is no key at all, of some length"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(KEYS), st.sampled_from(("base64", "url", "hex", "HEX")), st.sampled_from((" ", "\n", ", ", "é", '"'))), max_size=5))
def test_encoded_keys_are_those_of_a_plain_decoder(parts):
    text, expected = "", []
    for key, code, gap in parts:
        run = {"base64": base64.b64encode(key).decode(), "url": base64.urlsafe_b64encode(key).decode(), "hex": key.hex(), "HEX": key.hex().upper()}[code]
        if kind := plain_kind(key):
            expected.append(("key", len(text), len(text) + len(run), kind))
        text += run + gap
    assert [s for s in secrets.find(text) if s[0] == "key"] == expected


def test_repetitive_texts_take_linear_time():
    import time

    texts = ["eyJ" * 100_000, "-----BEGIN PRIVATE KEY-----" * 10_000, "a" * 300_000, "token " * 50_000, "AKIA" * 70_000, "password" + " " * 300_000]
    start = time.process_time()
    found = [len(secrets.find(t)) for t in texts]
    assert found == [0, 0, 1, 0, 1, 0] and time.process_time() - start < 10


def test_odd_rows_and_redaction(spark, odd_docs, no_docs):
    found = secrets.find_secrets(odd_docs).collect()
    assert len(found) == 13 and all(r.spans == [] for r in found)
    assert secrets.find_secrets(no_docs).count() == 0
    docs = spark.createDataFrame([(1, "a token=abcdefgh b token=xy " + "0" * 30), (2, None), (3, "none"), (4, "key token=" + "a" * 30)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in secrets.redact_secrets(docs).collect()} == {1: "a <secret> b token=xy <secret>", 2: None, 3: "none", 4: "key <secret>"}
    assert secrets.redact_secrets(odd_docs).columns == odd_docs.columns


def test_the_query_gives_what_the_texts_say(spark, data):
    import hashlib
    import os

    from tidemill.llm.queries import op10_secrets

    data = f"{os.path.dirname(data)}/sf0.1"  # the smaller tables have few secrets or none
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    found = op10_secrets(spark, data).collect()
    assert len(found) == len(texts) and any(r.spans for r in found)
    for r in found:
        plain = base(texts[r.doc_id])
        told = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in plain) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(told(plain).encode()).hexdigest() and {told([s]) for s in plain} <= set(r.spans.split(","))

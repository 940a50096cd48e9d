"""Secrets in texts, with structural confirmation of encoded keys and tokens.

Patterns propose spans. Long base64, base64url and hex runs are reported only if
they decode to something a secret is made of: a DER sequence whose nested
lengths add up and which opens like a private key, an OpenSSH private key, or a
signed token whose header names its algorithm.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import kernel
from tidemill.llm.work import own_columns

#: Fixed by the contract of the query.
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
#: The others are confirmed by decoding. Their patterns start where a run starts and stop at the next dashes, so that no text takes more than linear time.
KINDS = (*BASE, "jwt", "pem", "key")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++")
PEM = re.compile(r"-----BEGIN ([A-Z ]{0,40}PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s:,.]|-(?!----))*+)-----END \1-----")
KEY = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_KEY = re.compile(r"(?:[0-9a-fA-F]{2}){32,}")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey", b"private key-----")
_RUN = 20  # every kind but assign and pem is within an unbroken run of at least so many bytes


def _decode(run: str) -> bytes | None:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _length(data: bytes, at: int) -> tuple[int, int] | None:
    """(length, where the content begins) of the DER element whose length field is at ``at``."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(data):
        return None
    return int.from_bytes(data[at + 1 : at + 1 + n], "big"), at + 1 + n


def der_key(data: bytes) -> str | None:
    """What kind of private key the bytes are, if they are one DER sequence whose elements fill it exactly."""
    if len(data) < 16 or data[0] != 0x30 or (outer := _length(data, 1)) is None or outer[0] + outer[1] != len(data):
        return None
    tags, at = [], outer[1]
    while at < len(data):
        if (inner := _length(data, at + 1)) is None or sum(inner) > len(data):
            return None
        tags.append((data[at], data[inner[1] : sum(inner)]))
        at = sum(inner)
    shape = [t for t, _ in tags]
    if not tags or shape[0] != 0x02 or len(tags[0][1]) != 1:
        return None
    if len(shape) >= 9 and set(shape[:9]) == {0x02}:
        return "rsa"
    if len(shape) >= 3 and shape[1] == 0x30 and shape[2] == 0x04:
        return "pkcs8"
    if len(shape) >= 2 and shape[1] == 0x04 and tags[0][1] == b"\x01":
        return "ec"
    return "dsa" if shape == [0x02] * 6 else None


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    if data.startswith(b"openssh-key-v1\0"):
        n = int.from_bytes(data[15:19], "big")  # the cipher's name comes next, by length
        return "openssh" if len(data) > 23 and 0 < n < 64 and data[19 : 19 + n].isascii() else None
    return der_key(data)


def token_algorithm(token: str) -> str | None:
    """The algorithm a signed token's header names; header and claims must be JSON objects."""
    head, claims, _ = token.split(".")
    try:
        head, claims = json.loads(_decode(head) or b""), json.loads(_decode(claims) or b"")
    except (ValueError, RecursionError):
        return None
    found = head.get("alg") if isinstance(head, dict) and isinstance(claims, dict) else None
    return found if isinstance(found, str) else None


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, detail) in code points, by start, then kind as listed in KINDS."""
    out = [("assign", m.start(), m.end(), m[1].lower()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end(), "") for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), "") for m in HEX.finditer(text)]
    out += [("jwt", m.start(), m.end(), a) for m in JWT.finditer(text) if (a := token_algorithm(m[0]))]
    inside = []
    for m in PEM.finditer(text):
        body = "".join(x for x in m[2].splitlines() if ":" not in x)
        if found := ("encrypted" if "ENCRYPTED" in m[1] or "ENCRYPTED" in m[2] else key_kind(_decode("".join(body.split())))):
            out.append(("pem", m.start(), m.end(), found))
            inside.append(m.span())
    for pattern, decode in ((KEY, _decode), (HEX_KEY, binascii.unhexlify)):
        for m in pattern.finditer(text):
            if (found := key_kind(decode(m[0]))) and not any(a <= m.start() and m.end() <= b for a, b in inside):
                out.append(("key", m.start(), m.end(), found))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _candidates(texts: pa.Array) -> np.ndarray:
    """Rows that may hold a secret: a keyword, or an unbroken run of _RUN bytes. The others can't match any pattern."""
    data, at = kernel.buffers(texts)
    rows = [np.zeros(0, np.int64)]
    a, step = int(at[0]), 4 << 20
    while a < at[-1]:
        b = min(a + step, int(at[-1]))
        part = data[a:b]
        low = part.tobytes().lower()
        for word in _WORDS:
            k = low.find(word)
            while k >= 0:
                rows.append(np.array([a + k]))
                k = low.find(word, k + 1)
        stops = np.concatenate([[-1], np.flatnonzero(kernel.SPACES[part]), [len(part)]])
        rows.append(a + stops[:-1][np.diff(stops) > _RUN] + 1)
        if b == at[-1]:
            break
        a = b - 64 if b - 64 > a else b  # words and runs across the cut
    found = np.searchsorted(at, np.concatenate(rows), side="right") - 1
    whole = np.flatnonzero(np.diff(at) >= _RUN)  # a run may also cross rows; then its first row alone would be marked
    edges = _edge_runs(data, at)
    return np.unique(np.concatenate([found[(found >= 0) & (found < len(at) - 1)], np.intersect1d(whole, edges)]))


def _edge_runs(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows that begin with an unbroken run of _RUN bytes."""
    rows = np.flatnonzero(np.diff(at) >= _RUN)
    if not len(rows):
        return rows
    heads = data[at[rows][:, None] + np.arange(_RUN)]
    return rows[~kernel.SPACES[heads].any(axis=1)]


SPAN_TYPE = "array<struct<kind:string,start:int,end:int,detail:string>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("detail", pa.string())])


def secret_spans(texts: pa.Array) -> pa.Array:
    """The secrets of each text; null texts have none."""
    out: list = [[]] * len(texts)
    for i in _candidates(texts).tolist():
        if text := texts[i].as_py():
            out[i] = [{"kind": k, "start": a, "end": b, "detail": d} for k, a, b, d in find(text)]
    return pa.array(out, pa.list_(_SPAN))


def redacted(texts: pa.Array) -> pa.Array:
    """The texts with each secret, or run of overlapping ones, replaced by <secret>; nulls stay null."""
    found = {}
    for i in _candidates(texts).tolist():
        if (text := texts[i].as_py()) and (spans := find(text)):
            parts, done = [], 0
            for _, a, b, _ in spans:
                if a >= done:
                    parts += [text[done:a], "<secret>"]
                done = max(done, b)
            found[i] = "".join([*parts, text[done:]])
    if not found:
        return texts
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    mask = np.zeros(len(texts), dtype=bool)
    mask[list(found)] = True
    return pc.replace_with_mask(texts, pa.array(mask), pa.array([found[i] for i in sorted(found)], texts.type))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, spans), spans being structs of kind, start, end and detail by start.

    Positions are code points, the end exclusive. Null and empty texts have no
    spans; texts of any length are searched whole; repeated rows and null ids
    stay as they are; other columns are not read; an empty table gives an empty
    result. Each row depends on its own text alone, so nothing is shuffled.
    """
    return own_columns(docs, {"id": id_col, "text": text_col}).select(F.col("id").alias(id_col), F.arrow_udf(secret_spans, SPAN_TYPE)("text").alias("spans"))


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the secrets in its texts replaced; all rows and other columns stay.

    Null texts stay null and empty ones empty; texts of any length are searched
    whole; repeated rows change alike; an empty table stays empty.
    """
    return docs.withColumn(text_col, F.arrow_udf(redacted, "string")(F.col(f"`{text_col}`")))

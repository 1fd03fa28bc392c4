"""Secret scan with structural confirmation.

Patterns find assignments, access keys and long hex runs. Candidates in base64 or hex are
decoded and parsed besides, and only those whose structure holds are reported: DER private
keys (RSA, DSA, EC, PKCS#8) whose nested lengths add up, OpenSSH key containers whose
length-prefixed fields fit, PEM blocks whose body is such a key, and signed tokens whose header
is JSON that names an algorithm. A candidate may start anywhere in a run of base64 or hex
digits, if by its own length it ends where the run does; base64 may be wrapped over lines, and line ends
in PEM blocks may be escaped, as in JSON.

Offsets are code points, the end is exclusive. Null and empty texts have no spans. Texts are
scanned whole, each in linear time: a candidate is decoded only as far as its length tells, and
keys have MOST_BYTES at most. Repeated rows are scanned one by one. An empty table gives an empty
result. An input column that has the output's name is replaced; other columns are kept.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.common import with_columns

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
BASE = KINDS[:3]
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])e[A-Za-z0-9_-]{9,}\.[A-Za-z0-9_-]{3,}\.[A-Za-z0-9_-]*")
_BLOB = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40,80}\r?\n[\x20\t]*)+[A-Za-z0-9+/]{1,80}={0,2}")
_HEXBLOB = re.compile(r"[0-9A-Fa-f]{64,}")
#: Where DER elements may start: a sequence, with a length of at least 32 bytes.
_STARTS64 = re.compile(r"(?=M[C-I])")
_STARTS16 = re.compile(r"(?=30(?:82|81|[2-7]))")
MOST_BYTES = 1 << 14
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
_SSH = b"openssh-key-v1\x00"
_SSH64 = base64.b64encode(_SSH[:12]).decode()


def unbase64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def tlv(b: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value of the DER element at a place, if its length fits."""
    if at + 2 > end:
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end or b[at] == 0:
            return None
        n, at = int.from_bytes(b[at : at + size], "big"), at + size
    return (tag, at, at + n) if at + n <= end else None


def children(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill a range exactly."""
    found = []
    while at < end:
        if not (x := tlv(b, at, end)):
            return None
        found.append(x)
        at = x[2]
    return found


def is_der_key(b: bytes) -> bool:
    """A private key: RSA (nine integers), DSA (six), PKCS#8 (version, algorithm, octets), EC (1, octets), or encrypted PKCS#8."""
    if not (top := tlv(b, 0, len(b))) or top[0] != 0x30 or top[2] != len(b) or not (parts := children(b, *top[1:])):
        return False
    tags = [t for t, _, _ in parts]
    if len(parts) >= 9 and tags[:9] == [0x02] * 9:
        return parts[0][2] - parts[0][1] == 1
    if tags == [0x02] * 6:  # version 0, p, q, g and two keys; q has 20 to 32 bytes
        sizes = [e - a for _, a, e in parts]
        return b[parts[0][1] : parts[0][2]] == b"\0" and sizes[1] >= 64 and 20 <= sizes[2] <= 33
    algorithm = lambda p: bool((x := children(b, *p[1:])) and x[0][0] == 0x06)
    if len(parts) >= 3 and tags[:3] == [0x02, 0x30, 0x04]:
        return algorithm(parts[1])
    if len(parts) >= 2 and tags[:2] == [0x02, 0x04]:
        return b[parts[0][1] : parts[0][2]] == b"\x01" and parts[1][2] - parts[1][1] >= 16
    return tags == [0x30, 0x04] and algorithm(parts[0])


def is_ssh_key(b: bytes) -> bool:
    """The container of OpenSSH private keys: magic, then cipher, KDF and its options, each behind its length, and a count."""
    if not b.startswith(_SSH):
        return False
    at = len(_SSH)
    for _ in range(3):
        if at + 4 > len(b):
            return False
        at += 4 + int.from_bytes(b[at : at + 4], "big")
    return at + 4 <= len(b) and 1 <= int.from_bytes(b[at : at + 4], "big") <= 64


def der_bytes(head: bytes) -> int | None:
    """How many bytes a DER sequence has by its first bytes, if it can be a key."""
    if len(head) < 2 or head[0] != 0x30:
        return None
    n, size = head[1], head[1] & 0x7F
    if n & 0x80:
        if not 1 <= size <= 2 or len(head) < 2 + size:
            return None
        n = int.from_bytes(head[2 : 2 + size], "big") + size
    return n + 2 if 32 <= n + 2 <= MOST_BYTES else None


def keys_in_base64(run: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the key that ends a run of base64 digits."""
    found, at = [], 0
    digits = len(run.rstrip("="))
    while m := _STARTS64.search(run, at):
        at = m.start() + 1
        n = der_bytes(unbase64(run[m.start() : m.start() + 8]) or b"")
        end = m.start() + -(-(n or 0) * 4 // 3)
        if n and end == digits and (b := unbase64(run[m.start() : end])) and is_der_key(b[:n]):
            found.append((m.start(), len(run), "der"))
            break
    at = run.find(_SSH64)
    if at >= 0:
        part = run[at:digits]
        if (b := unbase64(part[: len(part) - (len(part) % 4 == 1)])) and is_ssh_key(b):
            found.append((at, len(run), "ssh"))
    return found


def keys_in_hex(run: str) -> list[tuple[int, int, str]]:
    """As keys_in_base64, of hex digits."""
    found, at, low = [], 0, run.lower()
    while m := _STARTS16.search(low, at):
        at = m.start() + 1
        head = low[m.start() : m.start() + 8]
        n = der_bytes(bytes.fromhex(head[: len(head) // 2 * 2]))
        end = m.start() + 2 * (n or 0)
        if n and end == len(run) and is_der_key(bytes.fromhex(low[m.start() : end])):
            found.append((m.start(), end, "der"))
            break
    at = low.find(_SSH.hex())
    if at >= 0 and is_ssh_key(bytes.fromhex(low[at : at + (len(low) - at) // 2 * 2])):
        found.append((at, at + (len(low) - at) // 2 * 2, "ssh"))
    return found


def is_signed_token(s: str) -> bool:
    """A token whose header and claims are JSON objects and whose header names an algorithm; unsigned ones have no third part."""
    head, claims, mark = s.split(".")
    try:
        h, c = (json.loads((unbase64(x) or b"").decode("utf-8")) for x in (head, claims))
    except (ValueError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(c, dict) and isinstance(h.get("alg"), str) and (bool(mark) and unbase64(mark) is not None or h["alg"].lower() == "none")


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text, by start, then kind in the order of KINDS, then end."""
    if not text:
        return []
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    blobs = [(m.start() + a, m.start() + e, k) for m in _BLOB.finditer(text) for a, e, k in keys_in_base64(m.group())]
    if "30" in text or _SSH.hex()[:8] in text.lower():
        blobs += [(m.start() + a, m.start() + e, k) for m in _HEXBLOB.finditer(text) for a, e, k in keys_in_hex(m.group())]
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            places = [k for k, c in enumerate(m.group()) if c not in "\r\n\x20\t"]
            blobs += [(m.start() + places[a], m.start() + places[e - 1] + 1, k) for a, e, k in keys_in_base64("".join(m.group().split()))]
    if "." in text and ("ey" in text or "ew" in text):
        found += [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if is_signed_token(m.group())]
    if "-----BEGIN " in text:
        at, ended = 0, set()  # labels that no later END line has: each is looked for once
        while m := _BEGIN.search(text, at):
            at, mark = m.end(), f"-----END {m[1]}-----"
            if mark in ended or (end := text.find(mark, at)) < 0:
                ended.add(mark)
                continue
            inside = text[m.end() : end].replace("\\r", "").replace("\\n", "\n")
            body = "".join(x for x in inside.split() if ":" not in x)
            if (b := unbase64(body)) and (is_der_key(b) or is_ssh_key(b)):
                found.append((m.start(), end + len(mark), "pem"))
                at = end
    blocks = [(a, e) for a, e, k in found if k == "pem"]
    for span in dict.fromkeys(blobs):  # what is in a block is that block's; a wrapped run's first line is one key, found once
        if not any(a <= span[0] and span[1] <= e for a, e in blocks):
            found.append(span)
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def scan_secrets(df: DataFrame, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """df with an array of (start, end, kind) in each row."""

    def spans(texts: pa.Array) -> list[pa.Array]:
        rows = [[{"start": s, "end": e, "kind": k} for s, e, k in find_spans(t)] for t in texts.to_pylist()]
        return [pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])))]

    return with_columns(df, [text], [T.StructField(out, SPANS)], spans)


def redact(df: DataFrame, text: str = "text", spans: str = "secret_spans") -> DataFrame:
    """The text with each run of overlapping spans replaced by [SECRET]; null texts stay null."""
    s, t = F.col(spans), F.col(text)
    # state: what is written so far, and the code point up to which the text is used
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        fresh = x["start"] >= a["at"]
        done = F.when(fresh, F.concat(a["done"], F.substring(t, a["at"] + 1, x["start"] - a["at"]), F.lit("[SECRET]"))).otherwise(a["done"])
        return F.struct(done.alias("done"), F.greatest(a["at"], x["end"]).alias("at"))

    clean = F.aggregate(s, start, step, lambda a: F.concat(a["done"], F.substring(t, a["at"] + 1, F.length(t))))
    return df.withColumn(text, F.when(F.size(s) > 0, clean).otherwise(t))


def rendered(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

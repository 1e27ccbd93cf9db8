"""Secret scan with structural confirmation.

Three plain patterns (assigned values, access key ids, long hex runs) give the base spans. Candidates in base64 or
hex are then decoded and only reported where their inside has the structure of a secret: a private key's DER with
nested lengths that add up, the OpenSSH private key container, or a signed token whose header and claims are JSON.
Base64 is read in both alphabets and across line breaks (plain, escaped, quoted or behind a comment or mail mark): a key
may begin at any line and has to end where a line does. Decoded base64 is also searched for PEM blocks. PEM blocks may
have RFC 1421 header lines; an encrypted body is then no DER, and is confirmed by a Proc-Type or DEK-Info that says so.
Confirmed candidates add spans; base spans always stay.

One scan, no shuffle; a row's cost is linear in its text. Null and empty texts have no spans. Spans that begin
at one place come in the order of their kinds. Repeated rows give repeated results. An empty table gives no rows. Columns other
than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table, text_or_empty

#: Kinds in the order that ties at one start take.
KINDS = ("assign", "access", "hex", "pem", "token", "key64", "keyhex")

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
BREAK = r"(?:\r\n|[\r\n]|\\r\\n|\\n|\\r)"
#: Header lines (a name, a colon, a value; those that begin with a blank go on), and the body.
PEM = re.compile(rf"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:\s|\\n|\\r)*+(?:[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+{BREAK}(?:[ \t]++[^\r\n\\]*+{BREAK})*+[ \t]*+)*+)((?:[A-Za-z0-9+/=\s]|\\n|\\r)++)-----END \1-----")
ENCRYPTED = re.compile(r"Proc-Type:[ \t]*4[ \t]*,[ \t]*ENCRYPTED|DEK-Info:[ \t]*[A-Za-z0-9-]+[ \t]*,[ \t]*[0-9A-Fa-f]{8,}")
#: A JSON object in base64 begins so, also with white space behind its brace.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}+={0,2}")
URL64 = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{40,}+={0,2}")
#: Lines of base64, and what may stand between two of them.
LINE64 = re.compile(r"[A-Za-z0-9+/_-]++={0,2}")
NEXT_LINE = re.compile(rf"[\"']?[ \t]*+[,+.\\]?[ \t]*+(?:\r\n|[\r\n]|\\r\\n|\\n|\\r)[ \t]*+(?:(?:[#*>;]|//(?=[ \t]))[ \t]*+)*+[\"']?|[\"'][ \t]*+[,+.]?[ \t]*+[\"']")
#: A key or PEM block in base64 begins so, by its first bytes.
HEAD64 = re.compile(r"M[A-P]|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJT")
LONG64 = re.compile(r"[A-Za-z0-9+/_-]{16}")
#: The least characters of base64 for a key.
LEAST64 = 40
HEXKEY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}+")
SSH = b"openssh-key-v1\0"
SEQUENCE, INTEGER, OCTETS, OID = 0x30, 2, 4, 6
#: Bytes of the modulus of an RSA or DSA key of 512 bits.
LEAST_MODULUS = 64


def _item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER value at `at`, or None if its length isn't in shortest form or runs past `end`."""
    if at + 2 > end:
        return None
    tag, size, start = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or start + n > end:
            return None
        size = int.from_bytes(data[start : start + n], "big")
        start += n
        if size < 0x80 or size >> (8 * (n - 1)) == 0:
            return None
    return (tag, start, start + size) if start + size <= end else None


def _items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill start..end exactly."""
    found = []
    while start < end:
        x = _item(data, start, end)
        if x is None:
            return None
        found.append(x)
        start = x[2]
    return found


def private_key(data: bytes) -> bool:
    """Is this a DER private key (PKCS#1, also of several primes, DSA, SEC 1 or PKCS#8, plain or encrypted), or an OpenSSH one?"""
    if data.startswith(SSH):
        return _ssh(data)
    top = _item(data, 0, len(data))
    if top is None or top[0] != SEQUENCE or top[2] != len(data):
        return False
    parts = _items(data, top[1], top[2])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    version = data[parts[0][1] : parts[0][2]] if tags[0] == INTEGER else None
    if set(tags[:9]) == {INTEGER} and (version == b"\0" and len(tags) == 9 or version == b"\1" and tags[9:] == [SEQUENCE]):
        return parts[1][2] - parts[1][1] >= LEAST_MODULUS
    if version == b"\0" and tags == [INTEGER] * 6:
        return parts[1][2] - parts[1][1] >= LEAST_MODULUS
    if version == b"\1" and len(tags) >= 2 and tags[1] == OCTETS:
        return parts[1][2] - parts[1][1] >= 16
    if version in (b"\0", b"\1") and tags[1:3] == [SEQUENCE, OCTETS]:
        inner = _items(data, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == OID
    if tags == [SEQUENCE, OCTETS]:
        inner = _items(data, parts[0][1], parts[0][2])
        return bool(inner) and inner[0][0] == OID and len(inner) == 2 and parts[1][2] - parts[1][1] >= 32
    return False


def _ssh(data: bytes) -> bool:
    """Cipher, key derivation, its options, the number of keys, then that many public parts and one private part."""
    at, strings = len(SSH), []
    for _ in range(3):
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        strings.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not strings[0] or not 1 <= keys <= 64:
        return False
    for _ in range(keys + 1):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at <= len(data)


def _base64(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def signed_token(text: str) -> bool:
    """header.claims.signature: both first parts decode to JSON objects, and the header names an algorithm."""
    parts = text.split(".")
    try:
        head, claims = (json.loads(_base64(p, url=True) or b"") for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(claims, dict) and (bool(parts[2]) or head["alg"].lower() == "none")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if "PRIVATE KEY-----" in text:
        found += _pem(text)
    if "ey" in text or "ew" in text:
        found += [(m.start(), m.end(), "token") for m in TOKEN.finditer(text) if signed_token(m[0])]
    single = {}
    for pattern, url in ((BASE64, False), (URL64, True)):
        for m in pattern.finditer(text):
            body = _base64(m[0], url)
            if body and ((body[0] == SEQUENCE or body.startswith(SSH)) and private_key(body) or b"-----BEGIN" in body and _has_pem(body)):
                single[m.span()] = (m.start(), m.end(), "key64")
    found += single.values()
    if HEAD64.search(text) or LONG64.search(text):
        found += [x for x in _wrapped(text) if not any(a < x[1] and x[0] < b for a, b, k in found if k in ("pem", "key64"))]
    for m in HEXKEY.finditer(text):
        if len(m[0]) % 2 == 0 and private_key(bytes.fromhex(m[0])):
            found.append((m.start(), m.end(), "keyhex"))
    return found


def _wrapped(text: str) -> list[tuple[int, int, str]]:
    """Keys and PEM blocks in base64 that goes over several lines.

    A key's size is in its head, so that at most one end is decoded for each line that it may begin at: where a line ends.
    """
    found, at = [], 0
    while m := LINE64.search(text, at):
        lines, at = [m], m.end()
        while not lines[-1][0].endswith("=") and (gap := NEXT_LINE.match(text, at)) and (m := LINE64.match(text, gap.end())):
            lines.append(m)
            at = m.end()
        if len(lines) > 1 and (any(HEAD64.match(x[0]) for x in lines) or lines[-1].end() - lines[0].start() >= LEAST64):
            found += _in_block(lines)
    return found


def _in_block(lines: list[re.Match]) -> list[tuple[int, int, str]]:
    parts = [x[0].rstrip("=").replace("-", "+").replace("_", "/") for x in lines]
    whole, ends, starts, n = "".join(parts), {}, [], 0
    for k, p in enumerate(parts):
        starts.append(n)
        n += len(p)
        ends[n] = k
    found, done, barren = [], 0, set()
    for k, p in enumerate(parts):
        begin = starts[k]
        if begin < done or k and not HEAD64.match(p):
            continue
        chars = lambda size: -(-size * 4 // 3)

        def read(a: int, b: int, begin=begin) -> bytes:
            low = a // 3
            return (_base64(whole[begin + 4 * low : begin + 4 * -(-b // 3)]) or b"")[a - 3 * low : b - 3 * low]

        key = False
        if (not k or p.startswith("LS0tLS1CRUdJT")) and begin % 4 not in barren:
            body = _base64(whole[begin : n - ((n - begin) % 4 == 1)]) or b""
            inside = _pem(body.decode("latin-1")) if b"PRIVATE KEY-----" in body else []
            if inside:
                stop = begin + chars(inside[-1][1])
                key, end = True, min(e for e in ends if e >= stop)
            else:  # what begins later at the same place of four characters has none either
                barren.add(begin % 4)
        if key:
            pass
        elif p[:1] == "M":
            head = read(0, 6)
            more = head[1] & 0x7F if len(head) > 1 and head[1] & 0x80 else 0
            size = (2 + more + int.from_bytes(head[2 : 2 + more], "big")) if more else 2 + (head[1] if len(head) > 1 else 0)
            end = begin + chars(size)
            key = more <= 4 and end in ends and end - begin >= LEAST64 and private_key(_base64(whole[begin:end]) or b"")
        elif p.startswith("b3Blb"):
            size = _ssh_size(read)
            end = begin + chars(size or 0)
            key = bool(size) and end in ends
        if key:
            done = end
            if ends[end] > k:
                found.append((lines[k].start(), lines[ends[end]].end(), "key64"))
    return found


def _ssh_size(read) -> int | None:
    """The size of an OpenSSH container from its lengths alone."""
    word = lambda at: int.from_bytes(x, "big") if len(x := read(at, at + 4)) == 4 else None
    at = len(SSH)
    for k in range(3):
        n = word(at)
        if n is None or (k == 0 and n == 0):
            return None
        at += 4 + n
    keys = word(at)
    if keys is None or not 1 <= keys <= 64:
        return None
    at += 4
    for _ in range(keys + 1):
        n = word(at)
        if n is None:
            return None
        at += 4 + n
    return at


def _has_pem(body: bytes) -> bool:
    return b"PRIVATE KEY-----" in body and bool(_pem(body.decode("latin-1")))


def _pem(text: str) -> list[tuple[int, int, str]]:
    found = []
    for m in PEM.finditer(text):
        body = _base64(re.sub(r"\s|\\n|\\r", "", m[3]))
        if body and (private_key(body) or ENCRYPTED.search(m[2]) and len(body) >= 32):
            found.append((m.start(), m.end(), "pem"))
    return found


def render(spans: list[tuple[int, int, str]], kinds: tuple[str, ...]) -> str:
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], order[s[2]], s[1])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, and its spans as array<struct<kind, start, end, confirmed>>."""

    def make():
        def each(ids, texts):
            out = []
            for t in texts:
                spans = [(a, b, k, False) for a, b, k in base_spans(t)] + [(a, b, k, True) for a, b, k in confirmed_spans(t)]
                out.append([{"kind": k, "start": a, "end": b, "confirmed": c} for a, b, k, c in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))])
            return ids, out

        return each

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs.select(F.col(id_col), text_or_empty(text_col)), make, f"`{id_col}` {kind}, spans array<struct<kind string, start int, end int, confirmed boolean>>")


def spans_text(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans of every document, and all its spans."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: ~s["confirmed"])
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_confirmed"),
    )

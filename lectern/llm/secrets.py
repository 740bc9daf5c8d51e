"""Secret scan with structural confirmation.

Base kinds are patterns: ``assign`` (a named value), ``access`` (an access key id), ``hex`` (a long
run of hex digits). Further spans are reported only after their bytes have been decoded and parsed:

* ``pem``: a PEM block whose body is base64 and holds a private key structure; line ends may be escaped, as in JSON;
* ``jwt``: three base64url parts of which the first is a JSON object naming an algorithm and the
  second a JSON object;
* ``key``: base64 or hex that decodes to a private key: DER whose nested lengths all fit
  (PKCS#1, PKCS#8, SEC1, DSA), or the OpenSSH format with its length-prefixed strings. It may start anywhere in a run of such
  characters and be wrapped over adjacent lines; its own length says where it ends. Wrapped keys within a ``pem`` span aren't given again.

Spans are code points, end exclusive. Defined results: a null or empty text has no spans, zero
counts and the digest of the empty string; overlapping spans of different kinds are all reported;
repeated rows get equal results; ``doc_id`` passes through as it is; only those two columns are read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, slices, table

# The patterns of the base kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so a minimum here finds the same runs as one checked after

KINDS = ("assign", "access", "hex", "pem", "jwt", "key")

MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
BODY = re.compile(r"[A-Za-z0-9+/=\s:,\\\-]*", re.ASCII)
JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)")
#: Adjacent lines of base64 or hex; line ends may be escaped.
RUNS = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}(?:[\x20\t]*(?:[\r\n]|\\+[rn])+[\x20\t]*[A-Za-z0-9+/_-]+={0,2})*")
BREAK = re.compile(r"=|[\x20\t]*(?:[\r\n]|\\+[rn])+[\x20\t]*")
LEAST = 40
#: How a DER private key (SEQUENCE) or an OpenSSH key starts, in base64 and in hex, at any offset.
STARTS = re.compile(r"(?=M[A-P]|b3BlbnNzaC1rZXk|30[0-9a-fA-F]{2}|6f70656e7373682d6b6579)")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def decoded(run: str) -> list[bytes]:
    """The bytes a run stands for as hex and as base64, standard or for URLs; none if it is neither."""
    out = []
    if not len(run) % 2 and re.fullmatch(r"[0-9A-Fa-f]+", run):
        out.append(bytes.fromhex(run))
    bare = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(bare) % 4 != 1:
        try:
            out.append(base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True))
        except binascii.Error:
            pass
    return out


#: Elements of the widest structure looked for (PKCS#1 with further primes has ten), and more.
WIDEST = 16


def der_items(data, at: int = 0, stop: int | None = None) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of the content of each element that ``data`` from ``at`` to ``stop`` is made of.

    None if a length doesn't fit, or if there are more than any private key has; only the elements' heads are read.
    """
    items, stop = [], len(data) if stop is None else stop
    while at < stop:
        head = data[at : min(at + 6, stop)]
        if len(head) < 2 or len(items) == WIDEST:
            return None
        tag, n, at = head[0], head[1], at + 2
        if n >= 0x80:
            wide = n & 0x7F
            if not 1 <= wide <= 4 or 2 + wide > len(head):
                return None
            n, at = int.from_bytes(head[2 : 2 + wide], "big"), at + wide
        if at + n > stop:
            return None
        items.append((tag, at, at + n))
        at += n
    return items


def der_private_key(data, stop: int | None = None) -> bool:
    """One SEQUENCE that is a PKCS#1, PKCS#8 (also encrypted) or SEC1 private key, lengths nested exactly."""
    top = der_items(data, 0, stop)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der_items(data, *top[0][1:])
    if not parts:
        return False
    tags, sizes = [t for t, _, _ in parts], [b - a for _, a, b in parts]
    is_number = lambda i, value: sizes[i] == 1 and data[parts[i][1] : parts[i][2]] == bytes([value])
    names = lambda i: bool(inner := der_items(data, *parts[i][1:])) and inner[0][0] == 0x06
    if len(tags) == 9 and set(tags) == {0x02}:  # PKCS#1: version, modulus, exponents, primes, coefficients
        return sizes[1] >= 32
    if len(tags) == 6 and set(tags) == {0x02} and is_number(0, 0):  # DSA: version 0, the group, both halves of the key
        return sizes[1] >= 32 and sizes[5] >= 16
    if tags[:2] == [0x02, 0x04] and is_number(0, 1):  # SEC1: version 1, the scalar
        return sizes[1] >= 16
    if tags[:3] == [0x02, 0x30, 0x04]:  # PKCS#8: version, algorithm, the key
        return names(1) and sizes[2] >= 16 and wrapped_key(data, *parts[2][1:])
    if tags == [0x30, 0x04]:  # PKCS#8 encrypted: algorithm, the ciphertext
        return names(0) and sizes[1] >= 16
    return False


def wrapped_key(data, at: int, stop: int) -> bool:
    """What PKCS#8 wraps: one integer (DSA), one octet string (Edwards curves), or a SEQUENCE of integers or of a scalar and more."""
    items = der_items(data, at, stop)
    if not items or len(items) != 1:
        return False
    tag, a, b = items[0]
    return tag in (0x02, 0x04) or (tag == 0x30 and bool(inner := der_items(data, a, b)) and inner[0][0] == 0x02)


def ssh_strings(data, at: int, n: int) -> list[tuple[int, int]] | None:
    """Where the next ``n`` length-prefixed strings start and end; None if one doesn't fit. Only the lengths are read."""
    out = []
    for _ in range(n):
        if at + 4 > len(data):
            return None
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        if end > len(data):
            return None
        out.append((at + 4, end))
        at = end
    return out


def openssh_length(data) -> int | None:
    """Bytes of an OpenSSH private key that ``data`` starts with: cipher, key derivation and its options, as many public keys
    as it says, each led by the name of its type, and the private part, whole eight-byte blocks; None if it is none."""
    if data[: len(MAGIC)] != MAGIC or not (head := ssh_strings(data, len(MAGIC), 3)):
        return None
    at = head[-1][1]
    n = int.from_bytes(data[at : at + 4], "big")
    strings = ssh_strings(data, at + 4, n + 1) if 1 <= n <= 64 else None
    if not strings:
        return None
    for a, b in strings[:-1]:
        end = a + 4 + int.from_bytes(data[a : min(a + 4, b)], "big")
        if a + 4 > b or end > b or not re.match(rb"(?:sk-)?(?:ssh|ecdsa)-", data[a + 4 : min(end, a + 14)]):
            return None
    a, b = strings[-1]
    return b if b > a and (b - a) % 8 == 0 else None


def private_key(data: bytes) -> bool:
    return der_private_key(data) or openssh_length(data) is not None


class Encoded:
    """Bytes that base64 (standard or for URLs) or hex stands for from a place on, decoded only where they are read."""

    def __init__(self, chars: str, at: int, stop: int, hexadecimal: bool):
        self.chars, self.at, self.hexadecimal = chars, at, hexadecimal
        self.size = (stop - at) // 2 if hexadecimal else (stop - at) // 4 * 3 + (0, 0, 1, 2)[(stop - at) % 4]
        self.head = self._read(0, min(48, self.size))

    def __len__(self) -> int:
        return self.size

    def _read(self, a: int, b: int) -> bytes:
        if b <= a:
            return b""
        if self.hexadecimal:
            return bytes.fromhex(self.chars[self.at + 2 * a : self.at + 2 * b])
        first = a // 3
        part = self.chars[self.at + 4 * first : self.at + -(-4 * b // 3)].replace("-", "+").replace("_", "/")
        return base64.b64decode(part + "=" * (-len(part) % 4))[a - 3 * first : b - 3 * first]

    def __getitem__(self, where: slice) -> bytes:
        a, b = where.start or 0, self.size if where.stop is None else min(where.stop, self.size)
        return self.head[a:b] if b <= len(self.head) else self._read(a, b)


_HEX = re.compile(r"[0-9A-Fa-f]*")
MAGIC = b"openssh-key-v1\0"


def key_length(head: bytes) -> int | None:
    """Bytes of a DER value that starts with ``head`` and can be a private key."""
    if len(head) < 10 or head[0] != 0x30:
        return None
    n, at = head[1], 2
    if n >= 0x80:
        wide = n & 0x7F
        if not 1 <= wide <= 4:
            return None
        n, at = int.from_bytes(head[2 : 2 + wide], "big"), 2 + wide
    return at + n if head[at] == 0x30 or head[at : at + 2] == b"\x02\x01" else None


def keys_in(chars: str) -> list[tuple[int, int]]:
    """Where private keys start and end in joined base64 or hex. A start costs the heads of a few elements, whatever follows it."""
    found, end, hex_end = [], 0, 0
    for m in STARTS.finditer(chars):
        at = m.start()
        if at < end:
            continue
        is_hex = chars[at] in "36"
        if is_hex and at >= hex_end:
            hex_end = _HEX.match(chars, at).end()
        data, a_byte = Encoded(chars, at, hex_end if is_hex else len(chars), is_hex), 2 if is_hex else 4 / 3
        if chars[at] in "b6":
            n = openssh_length(data)
        else:
            n = key_length(data[:10])
            if n is None or n > len(data) or not der_private_key(data, n):
                n = None
        if n is not None and math.ceil(n * a_byte) >= LEAST:
            end = min(len(chars), at + math.ceil(n * a_byte))
            found.append((at, end))
    return found


def key_spans(text: str) -> list[tuple[int, int]]:
    found = []
    for m in RUNS.finditer(text):
        if m.end() - m.start() < LEAST or not STARTS.search(m[0]):
            continue
        pieces, at = [], m.start()  # where each piece without line ends and padding starts and ends in the text
        for b in BREAK.finditer(text, m.start(), m.end()):
            pieces.append((at, b.start()))
            at = b.end()
        pieces = [(a, b) for a, b in [*pieces, (at, m.end())] if a < b]
        firsts = list(accumulate((b - a for a, b in pieces), initial=0))
        for start, end in keys_in("".join(text[a:b] for a, b in pieces)):
            i, j = bisect_right(firsts, start) - 1, bisect_right(firsts, end - 1) - 1
            last = pieces[j][0] + end - firsts[j]
            padding = re.compile("={0,2}").match(text, last).end()
            found.append((pieces[i][0] + start - firsts[i], padding))
    return found


def signed_token(header: str, payload: str) -> bool:
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in (header, payload))
    except (binascii.Error, ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def pem_blocks(text: str):
    """Start, end and body of each PEM block: an END mark and the last BEGIN mark before it, of one label."""
    begin = None
    for m in MARK.finditer(text):
        if m[1] == "BEGIN":
            begin = m
            continue
        if begin is not None and begin[2] == m[2] and BODY.fullmatch(text, begin.end(), m.start()):
            yield begin.start(), m.end(), text[begin.end() : m.start()]
        begin = None


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    for start, end, text_of in pem_blocks(text) if "PRIVATE KEY-----" in text else ():
        body = re.sub(r"(?:\\+[rn])+", "\n", text_of)
        body = re.sub(r"^[A-Za-z-]+:.*$", "", body, flags=re.MULTILINE)
        data = decoded("".join(body.split()))
        if any(map(private_key, data)) or ("ENCRYPTED" in text_of and data):
            found.append((start, end, "pem"))
    if "eyJ" in text:
        found += [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if m[1].startswith("eyJ") and signed_token(m[1], m[2])]
    blocks = [(a, b) for a, b, kind in found if kind == "pem"]  # one after the other
    starts = [a for a, _ in blocks]
    for a, b in key_spans(text):
        at = bisect_right(starts, a) - 1
        if not (at >= 0 and b <= blocks[at][1] and BREAK.search(text[a:b].rstrip("="))):
            found.append((a, b, "key"))
    return found


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def _scan(batches):
    for batch in slices(batches, "text", rows=512):
        rows = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            n = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
            digest = hashlib.sha256(listed(base).encode()).hexdigest()
            rows.append((*n, digest, listed(base + confirmed_spans(text or ""))))
        columns = list(zip(*rows))
        types = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


SCANNED = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Counts of base spans, their digest and all spans for every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), _scan, f"doc_id {kind}, {SCANNED}")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op6_secrets": op6_secrets}
ORACLES: dict[str, str] = {}

"""Secret scans that confirm a candidate by its structure.

Base patterns report by form alone. What looks like base64 or hex is decoded and
reported only if the bytes parse: a private key as nested ASN.1 lengths, an
OpenSSH key as nested length-prefixed strings, a signed token by its JSON header.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from tracequilt.llm.common import keyed_text
from tracequilt.llm.tokens import slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: A run of 32 or more is a whole run of the pattern above; this only saves visiting shorter ones.
LONG_HEX = re.compile(r"[0-9a-f]{32,}")

KINDS = ("assign", "access", "hex", "der", "jwt", "ssh")
#: Armour of private keys. Both marks are looked up in one pass each, also where they overlap; what stands in between must be clean.
BEGIN = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----")
END = re.compile(r"(?=-----END ([A-Z ]*PRIVATE KEY)-----)")
FOREIGN = re.compile(r"[^\sA-Za-z0-9+/=:,_.\\-]", re.A)
#: Line ends inside a run, real or escaped (once or more), and the escape before a slash.
BREAK = re.compile(r"(?:\\+[rn]|\\+(?=/)|[\r\n][ \t]*)+")
ESCAPED = re.compile(r"\\+[rn]")
#: A first line of 20 or more; what follows breaks belongs to the run whatever its length.
BASE64_RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{20,}}+(?:{BREAK.pattern}[A-Za-z0-9+/_-]++)*+={{0,2}}")
HEX_RUN = re.compile(r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Za-z])")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(ey[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)(?:\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*))?")
SSH_MAGIC = b"openssh-key-v1\0"
#: "openssh-key-v1" and its zero byte fill base64 letters exactly.
SSH_START = base64.b64encode(SSH_MAGIC).decode()
#: What "-----BEGIN " is in base64 after 0, 1 and 2 other bytes, and how many letters before it those bytes begin.
ARMOUR = (("LS0tLS1CRUdJTi", 0), ("0tLS0tQkVHSU4g", 2), ("tLS0tLUJFR0lOI", 3))
#: ASN.1 tags
INTEGER, BIT_STRING, OCTET_STRING, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def base_spans(text: str) -> list[Span]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return out


def decoded(run: str) -> bytes | None:
    """The bytes of a base64 run in either alphabet, or None."""
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def asn1(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of the elements that fill ``data`` exactly, or None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            length, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + length > len(data):
            return None
        out.append((tag, data[at : at + length]))
        at += length
    return out


def is_private_key(data: bytes) -> bool:
    """Whether DER bytes are a private key: RSA, EC, or either in its common wrapping, plain or encrypted."""
    outer = asn1(data)
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    parts = asn1(outer[0][1])
    if not parts:
        return False
    tags = [t for t, _ in parts]
    if tags[:3] == [INTEGER, SEQUENCE, OCTET_STRING] and parts[0][1] in (b"\0", b"\1"):
        return _starts_with_oid(parts[1][1])
    if tags[0] == INTEGER and tags.count(INTEGER) >= 6 and parts[0][1] in (b"\0", b"\1"):
        return all(t == INTEGER for t in tags[:6])
    if tags[:2] == [INTEGER, OCTET_STRING] and parts[0][1] == b"\1":
        return len(parts[1][1]) >= 16
    return tags == [SEQUENCE, OCTET_STRING] and _starts_with_oid(parts[0][1]) and len(parts[1][1]) >= 16


def _starts_with_oid(data: bytes) -> bool:
    inner = asn1(data)
    return bool(inner) and inner[0][0] == OID


def ssh_length(read: Callable[[int, int], bytes], size: int) -> int | None:
    """Bytes of the OpenSSH private key that ``size`` bytes begin with: magic, three strings, a count, and as many keys as it says.

    Only the lengths are read (``read`` gives some bytes at a place), so a start that is none costs the same in any text.
    """
    if size < len(SSH_MAGIC) or read(0, len(SSH_MAGIC)) != SSH_MAGIC:
        return None
    at = len(SSH_MAGIC)

    def string() -> bool:
        nonlocal at
        if at + 4 > size:
            return False
        at += 4 + int.from_bytes(read(at, 4), "big")
        return at <= size

    if not (string() and string() and string()) or at + 4 > size:
        return None
    keys = int.from_bytes(read(at, 4), "big")
    at += 4
    return at if 1 <= keys <= 64 and all(string() for _ in range(keys + 1)) else None


def is_ssh_key(data: bytes) -> bool:
    """Whether bytes begin with an OpenSSH private key."""
    return ssh_length(lambda at, n: data[at : at + n], len(data)) is not None


def key_kind(data: bytes | None) -> int | None:
    if not data:
        return None
    if data[0] == SEQUENCE and is_private_key(data):
        return KINDS.index("der")
    return KINDS.index("ssh") if is_ssh_key(data) else None


def is_signed_token(parts: tuple[str | None, ...]) -> bool:
    """Whether dotted parts are a signed token (JSON header with alg, JSON claims) or an encrypted one (header with enc)."""
    header = _json_object(parts[0])
    if header is None or not isinstance(header.get("alg"), str):
        return False
    if parts[3] is not None:
        return isinstance(header.get("enc"), str)
    return _json_object(parts[1]) is not None and (bool(parts[2]) or header["alg"].lower() == "none")


def _json_object(part: str | None) -> dict | None:
    raw = decoded(part) if part else None
    try:
        value = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def pem_spans(text: str) -> list[Span]:
    """Armoured private keys; line ends may be escaped. One pass over the marks, however many do not match."""
    out, done, foreign = [], 0, -1
    if "-----BEGIN " not in text:
        return out
    ends: dict[str, list[int]] = {}
    for m in END.finditer(text):
        ends.setdefault(m[1], []).append(m.start())
    for m in BEGIN.finditer(text) if ends else ():
        places = ends.get(m[1], [])
        i = bisect_left(places, m.end())
        if m.start() < done or i == len(places):
            continue
        if foreign < m.end():
            odd = FOREIGN.search(text, m.end())
            foreign = odd.start() if odd else len(text)
        if foreign < places[i]:
            continue
        done = places[i] + len(f"-----END {m[1]}-----")
        inner = text[m.end() : places[i]]
        lines = ESCAPED.sub("\n", inner).replace("\\", "").splitlines()
        body = "".join(line.strip() for line in lines if ":" not in line)
        kind = key_kind(decoded(body)) if body else None
        if kind is None and "ENCRYPTED" in inner:
            kind = KINDS.index("der") if decoded(body) else None
        if kind is not None:
            out.append((m.start(), kind, done))
    return out


def _der_letters(run: str, at: int) -> int | None:
    """Letters of the DER sequence that begins at a letter of a run, if it begins like a key and ends inside the run."""
    head = decoded(run[at : at + 12]) or b""
    if len(head) < 9 or head[0] != SEQUENCE:
        return None
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 4 or head[1] == 0x80:
        return None
    length = int.from_bytes(head[2 : 2 + n], "big") if n else head[1]
    if head[2 + n] != SEQUENCE and (head[2 + n] != INTEGER or head[3 + n] != 1 or head[4 + n] > 1):
        return None
    letters = -(-(2 + n + length) * 4 // 3)
    return letters if at + letters <= len(run) else None


def run_spans(run: str) -> list[Span]:
    """Keys inside a run of base64 letters: at each place where one can start, and as armour inside the decoded bytes.

    A sequence that parses and is no private key is passed over as a whole, so
    nothing inside a public key or certificate counts.
    """
    out: list[Span] = []
    at = run.find("M")  # 0x30, the first byte of a key, is an M in base64
    while at >= 0:
        letters, past = _der_letters(run, at), at + 1
        if letters:
            data = decoded(run[at : at + letters])
            outer = asn1(data) if data else None
            if outer and is_private_key(data):
                out.append((at, KINDS.index("der"), at + letters))
            if outer and asn1(outer[0][1]):
                past = at + letters
        at = run.find("M", past)
    at = run.find(SSH_START)
    while at >= 0:
        found = ssh_length(partial(_letters, run, at), (len(run) - at) * 3 // 4)
        if found:
            out.append((at, KINDS.index("ssh"), at + -(-found * 4 // 3)))
        at = run.find(SSH_START, at + (-(-found * 4 // 3) if found else 1))
    for letters, before in ARMOUR:
        end, at = 0, run.find(letters)
        while at >= 0:
            if at >= end and at >= before:
                first = at - before
                for a, kind, b in pem_spans(_lenient(run[first:]).decode("latin-1")):
                    end = first + -(-b * 4 // 3)
                    out.append((first + a * 4 // 3, kind, end))
                end = max(end, len(run))  # all armour of this alignment is found in one go
            at = run.find(letters, at + 1) if at + 1 > end else -1
    return out


def _letters(run: str, start: int, at: int, n: int) -> bytes:
    """Up to 15 bytes at a place of what a run encodes from one of its letters on."""
    first = start + at // 3 * 4
    return _lenient(run[first : first + 24])[at % 3 : at % 3 + n]


def _lenient(run: str) -> bytes:
    """The whole bytes of a run that may end anywhere."""
    return decoded(run[:-1] if len(run) % 4 == 1 else run) or b""


def confirmed_spans(text: str) -> list[Span]:
    """Spans whose decoded bytes have the structure of a secret."""
    out: list[Span] = pem_spans(text)
    armoured = list(out)
    for m in BASE64_RUN.finditer(text):
        if m.end() - m.start() < 40:
            continue
        whole = m[0].rstrip("=")
        starts, ends, at = [], [], 0
        for s in BREAK.finditer(whole):
            starts.append(at)
            ends.append(s.start())
            at = s.end()
        starts.append(at)
        ends.append(len(whole))
        near = bisect_right(armoured, m.start(), key=lambda span: span[0]) - 1
        if len(starts) > 1 and near >= 0 and m.start() < armoured[near][2]:
            continue  # the lines of a key that is reported with its armour
        sums = [0, *accumulate(b - a for a, b in zip(starts, ends))]
        for a, kind, b in run_spans("".join(whole[x:y] for x, y in zip(starts, ends))):
            i, j = bisect_right(sums, a) - 1, bisect_left(sums, b) - 1
            end = m.start() + starts[j] + b - sums[j]
            out.append((m.start() + starts[i] + a - sums[i], kind, m.end() if b == sums[-1] else end))
    for m in HEX_RUN.finditer(text):
        if m[0].startswith("30") or m[0].lower().startswith(SSH_MAGIC[:4].hex()):
            kind = key_kind(bytes.fromhex(m[0]))
            if kind is not None:
                out.append((m.start(), kind, m.end()))
    for m in TOKEN.finditer(text) if "ey" in text else ():
        if is_signed_token(m.groups()):
            out.append((m.start(), KINDS.index("jwt"), m.end()))
    return out


def find_secrets(text: str) -> list[Span]:
    """All spans in order of start and kind; code-point offsets."""
    return sorted(set(base_spans(text)) | set(confirmed_spans(text)))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row.

    Null text is empty and has no spans; null ids and repeated rows are scanned
    like any other; extra columns are ignored. One pass without a shuffle. Base64
    goes on over line ends, real or escaped, and may hold an armoured key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_secrets(t.as_py()) for t in batch["text"]]
            base = [[s for s in spans if s[1] < 3] for spans in found]
            made = {"doc_id": batch["doc_id"]}
            for kind in range(3):
                made[f"n_{KINDS[kind]}"] = pa.array([sum(s[1] == kind for s in spans) for spans in base], pa.int64())
            made["base_sha256"] = pa.array([hashlib.sha256(listed(s).encode()).hexdigest() for s in base], pa.string())
            made["spans"] = pa.array([listed(s) for s in found], pa.string())
            yield pa.record_batch(made)

    return keyed_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span], mark: str) -> str:
    """The text with every maximal run of spans replaced by the mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with secrets in ``text`` replaced; ``n_chars`` follows the text. Null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1024):
                texts = [t if t is None else redacted(t, find_secrets(t), mark) for t in batch["text"].to_pylist()]
                made = {name: batch[name] for name in batch.schema.names} | {"text": pa.array(texts, pa.string())}
                if "n_chars" in made:
                    counts = [n if t is None else len(t) for t, n in zip(texts, batch["n_chars"].to_pylist())]
                    made["n_chars"] = pa.array(counts, batch["n_chars"].type)
                yield pa.record_batch(made)

    return docs.mapInArrow(run, docs.schema)

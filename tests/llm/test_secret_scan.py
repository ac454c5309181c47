import base64
import hashlib
import json
import re

import corpus
from tracequilt.llm import secret_scan as scan


def der(tag: int, content: bytes) -> bytes:
    n = len(content)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + content


def integer(n: int) -> bytes:
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


RSA = der(0x30, integer(0) + b"".join(integer(3**k) for k in range(200, 208)))
PKCS8 = der(0x30, integer(0) + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, RSA))
PUBLIC = der(0x30, der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(3, b"\0" + RSA))
string = lambda b: len(b).to_bytes(4, "big") + b
SSH = scan.SSH_MAGIC + string(b"none") * 2 + string(b"") + (1).to_bytes(4, "big") + string(b"k" * 51) + string(b"s" * 136)
b64 = lambda b: base64.b64encode(b).decode()
url = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
JWT = url({"alg": "HS256", "typ": "JWT"}) + "." + url({"sub": "a"}) + ".c2lnbmF0dXJl"


def kinds(text: str) -> list[str]:
    return [scan.KINDS[k] for _, k, _ in scan.confirmed_spans(text)]


def test_structures_are_confirmed():
    for key in (RSA, PKCS8):
        assert kinds(f"x {b64(key)} y") == ["der"] and "der" in kinds(f"x {key.hex()} y")
    wrapped = "\n".join(re.findall(".{1,64}", b64(PKCS8)))
    pem = f"a -----BEGIN PRIVATE KEY-----\n{wrapped}\n-----END PRIVATE KEY----- b"
    (start, kind, end), *_ = scan.confirmed_spans(pem)
    assert pem[start:end].startswith("-----BEGIN") and pem[start:end].endswith("KEY-----")
    assert kinds(b64(SSH)) == ["ssh"]
    assert kinds(f"bearer {JWT}, end") == ["jwt"]


def test_what_does_not_parse_is_not_reported():
    assert kinds(f"{b64(RSA[:-3])} {b64(PUBLIC)} {b64(bytes(range(90)))} {'ab' * 40}") == []
    assert kinds("MIIE" + "A" * 60) == []
    assert kinds(b64(SSH[:60] + b"\xff" * 40)) == []
    assert kinds(url({"typ": "JWT"}) + "." + url({"sub": "a"}) + ".c2ln") == []
    assert kinds("eyJhbGciOi" + "x" * 30 + ".aaaa.bbbb") == []
    assert kinds("ey" + b64(b"[" * 4000).rstrip("=") + ".e30.aa") == []


def base(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]


def test_scan_equals_brute_force(spark):
    rows = corpus.awkward(3000) + [
        (50, f'é PASSWORD = "hunter2hunter2" token:short api_key=abcdefgh token=password=abcdefgh1 AKIAABCDEFGHIJKL {"0f" * 20} AKIAAB toKen: x.y-z_12'),
        (51, f"key {JWT} and {b64(RSA)}"),
    ]
    got = scan.scan(corpus.table(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [t for d, t, *_ in rows if d == r["doc_id"]]
        spans = [sorted(base(t or "")) for t in texts]
        assert r["base_sha256"] in [hashlib.sha256(scan.listed(s).encode()).hexdigest() for s in spans]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) in [tuple(sum(x[1] == k for x in s) for k in range(3)) for s in spans]
    by = {r["doc_id"]: r["spans"] for r in got}
    assert by[51].split(",")[0].startswith("jwt:4:") and "der" in by[51] and by[8] == ""


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, f"é token = {'0f' * 20} end"), (2, None), (3, "clean"), (3, "clean")]
    got = scan.redact(corpus.table(spark, rows, extra=True)).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["é [SECRET] end", None, "clean", "clean"]
    assert got[0]["n_chars"] == len("é [SECRET] end") and got[0]["key"] == "x"
    assert scan.scan(corpus.table(spark, rows).limit(0)).count() == 0

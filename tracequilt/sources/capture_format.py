"""pcap and pcapng records in a byte stream.  Small helpers used inside tasks."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

# --- fixed values: file magics
PCAP_MAGICS = {
    b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1),
    b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000),
}
PCAPNG_MAGIC = b"\x0a\x0d\x0d\x0a"
BYTE_ORDERS = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
SECTION, INTERFACE, ENHANCED = 0x0A0D0D0A, 1, 6
#: fixed parts of the blocks that are read, without type and lengths
LEAST_BODY = {SECTION: 16, INTERFACE: 8, ENHANCED: 20}
END_OF_OPTIONS, TIME_RESOLUTION = 0, 9
GLOBAL_HEADER = 24
RECORD_HEADER = 16
MAX_RECORD = 1 << 26

Record = tuple[int, int, int, int, int, bytes]  # offset, ts_us, captured, original, link type, data


class CaptureFormatError(ValueError):
    """The file is not a well-formed capture."""


@dataclass(frozen=True)
class PcapHeader:
    order: str
    unit: int  # time sub-units per microsecond
    link_type: int

    def record(self, head: bytes) -> tuple[int, int, int]:
        sec, sub, captured, original = struct.unpack(self.order + "IIII", head)
        return sec * 1_000_000 + sub // self.unit, captured, original


def read_header(stream: BinaryIO) -> PcapHeader | None:
    """Header of a classic pcap file; null for pcapng."""
    head = stream.read(GLOBAL_HEADER)
    if head[:4] == PCAPNG_MAGIC:
        return None
    if len(head) < GLOBAL_HEADER or head[:4] not in PCAP_MAGICS:
        raise CaptureFormatError("not a pcap or pcapng file")
    order, unit = PCAP_MAGICS[head[:4]]
    # the upper bits of the field carry checksum-length flags
    link_type = struct.unpack(order + "I", head[20:24])[0] & 0xFFFF
    return PcapHeader(order, unit, link_type)


def pcap_records(stream: BinaryIO, header: PcapHeader, start: int, end: int | None,
                 on_truncated: str = "fail") -> Iterator[Record]:
    """Records whose header starts in ``[start, end)``."""
    stream.seek(start)
    at = start
    while end is None or at < end:
        head = stream.read(RECORD_HEADER)
        if not head:
            return
        if len(head) == RECORD_HEADER:
            ts_us, captured, original = header.record(head)
            if captured > MAX_RECORD:
                raise CaptureFormatError(f"record at {at} claims {captured} bytes")
            data = stream.read(captured)
            if len(data) == captured:
                yield at, ts_us, captured, original, header.link_type, data
                at += RECORD_HEADER + captured
                continue
        if on_truncated == "stop":
            return
        raise CaptureFormatError(f"file ends inside the record at {at}")


def _options(raw: bytes, order: str) -> dict[int, bytes]:
    """Options of a block by code; of repeated codes the first counts."""
    found: dict[int, bytes] = {}
    view = memoryview(raw)
    while len(view) >= 4:
        code, size = struct.unpack_from(order + "HH", view)
        if code == END_OF_OPTIONS:
            break
        value, view = view[4 : 4 + size], view[4 + -(-size // 4) * 4 :]
        if len(value) < size:
            raise CaptureFormatError("option runs past its block")
        found.setdefault(code, bytes(value))
    return found


def _units_per_second(options: dict[int, bytes]) -> int:
    """Exact: the option's top bit says whether its other bits are a power of two or of ten."""
    (stated,) = options.get(TIME_RESOLUTION, b"")[:1] or b"\x06"
    return 2 ** (stated & 0x7F) if stated & 0x80 else 10**stated


def _blocks(stream: BinaryIO, on_truncated: str) -> Iterator[tuple[int, str, int, bytes]]:
    """(offset, byte order, type, body) of every block; a section header sets the order for what follows."""
    order, at, size = "<", 0, stream.seek(0, 2)
    while at + 8 <= size:
        stream.seek(at)
        head = stream.read(12)
        if head[:4] == PCAPNG_MAGIC:
            if head[8:] not in BYTE_ORDERS:
                raise CaptureFormatError("bad byte-order magic")
            order = BYTE_ORDERS[head[8:]]
        kind, length = struct.unpack_from(order + "II", head)
        if length < 12:
            raise CaptureFormatError(f"block at {at} has length {length}")
        if at + length > size:
            if on_truncated == "stop":
                return
            raise CaptureFormatError(f"file ends inside the block at {at}")
        stream.seek(at + 8)
        body = stream.read(length - 12)
        if len(body) < LEAST_BODY.get(kind, 0):
            raise CaptureFormatError(f"block at {at} is too short for its type")
        yield at, order, kind, body
        at += length


def pcapng_records(stream: BinaryIO, on_truncated: str = "fail") -> Iterator[Record]:
    """Enhanced packet blocks; every other block is skipped, as are unknown interfaces."""
    interfaces: list[tuple[int, int]] = []  # link type, time units per second; anew in every section
    for at, order, kind, body in _blocks(stream, on_truncated):
        if kind == SECTION:
            interfaces = []
        elif kind == INTERFACE:
            (link_type,) = struct.unpack_from(order + "H", body)
            interfaces.append((link_type, _units_per_second(_options(body[8:], order))))
        elif kind == ENHANCED:
            number, high, low, captured, original = struct.unpack_from(order + "5I", body)
            if number >= len(interfaces):
                continue
            if 20 + captured > len(body):
                raise CaptureFormatError("packet data is cut short")
            link_type, units = interfaces[number]
            yield at, (high << 32 | low) * 1_000_000 // units, captured, original, link_type, body[20 : 20 + captured]


def sync_point(stream: BinaryIO, header: PcapHeader, start: int, end: int, size: int, run: int = 8) -> int | None:
    """First offset in ``[start, end)`` from which ``run`` plausible records chain.

    A guess: :mod:`capture_index` verifies every guess against its neighbour.
    """
    window = 1 << 16
    at = start
    while at < end:
        stream.seek(at)
        block = stream.read(window + RECORD_HEADER)
        for i in range(min(window, end - at)):
            if len(block) - i < RECORD_HEADER:
                break
            _, captured, original = header.record(block[i:i + RECORD_HEADER])
            if 0 < captured <= original <= MAX_RECORD and _chains(stream, header, at + i, size, run):
                return at + i
        at += window
    return None


def _chains(stream: BinaryIO, header: PcapHeader, at: int, size: int, run: int) -> bool:
    previous = None
    for _ in range(run):
        if at == size:
            return True
        stream.seek(at)
        head = stream.read(RECORD_HEADER)
        if len(head) < RECORD_HEADER:
            return False
        ts_us, captured, original = header.record(head)
        if not 0 < captured <= original <= MAX_RECORD:
            return False
        if previous is not None and abs(ts_us - previous) > 86_400_000_000:
            return False
        previous = ts_us
        at += RECORD_HEADER + captured
        if at > size:
            return False
    return True


def walk(stream: BinaryIO, header: PcapHeader, start: int, end: int) -> int:
    """Offset of the first record at or after ``end``, following headers from ``start``."""
    at = start
    while at < end:
        stream.seek(at)
        head = stream.read(RECORD_HEADER)
        if len(head) < RECORD_HEADER:
            return at
        at += RECORD_HEADER + header.record(head)[1]
    return at


def pcap_file_header(link_type: int, snaplen: int = 262_144) -> bytes:
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, snaplen, link_type)


def pcap_record(ts_us: int, original: int, data: bytes) -> bytes:
    return struct.pack("<IIII", ts_us // 1_000_000, ts_us % 1_000_000, len(data), original) + data

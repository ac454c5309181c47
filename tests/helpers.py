"""Byte builders and row builders used by the tests."""

from __future__ import annotations

import ipaddress
import struct

from pyspark.sql import DataFrame, SparkSession

from tracequilt import schema


def ip4(src: str, dst: str, proto: int, payload: bytes, *, flags: int = 0, options: bytes = b"", total: int | None = None) -> bytes:
    ihl = 5 + len(options) // 4
    size = ihl * 4 + len(payload) if total is None else total
    head = struct.pack(">BBHHHBBH", 0x40 | ihl, 0, size, 0, flags, 64, proto, 0)
    return head + ipaddress.ip_address(src).packed + ipaddress.ip_address(dst).packed + options + payload


def ip6(src: str, dst: str, nxt: int, payload: bytes) -> bytes:
    head = struct.pack(">IHBB", 0x60000000, len(payload), nxt, 64)
    return head + ipaddress.ip_address(src).packed + ipaddress.ip_address(dst).packed + payload


def tcp(sport: int, dport: int, flags: int, payload: bytes = b"", words: int = 5) -> bytes:
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, words << 4, flags, 0, 0, 0) + b"\0" * (words - 5) * 4 + payload


def udp(sport: int, dport: int, payload: bytes = b"", length: int | None = None) -> bytes:
    return struct.pack(">HHHH", sport, dport, 8 + len(payload) if length is None else length, 0) + payload


def eth(ethertype: int, payload: bytes, tags: tuple[int, ...] = ()) -> bytes:
    return b"\0" * 12 + b"".join(struct.pack(">HH", t, 1) for t in tags) + struct.pack(">H", ethertype) + payload


def arp(op: int, sender: str, target: str, plen: int = 4) -> bytes:
    return struct.pack(">HHBBH", 1, 0x800, 6, plen, op) + b"\0" * 6 + ipaddress.ip_address(sender).packed + b"\0" * 6 + ipaddress.ip_address(target).packed


def hello(name: bytes, before: bytes = b"") -> bytes:
    """A ClientHello; ``before`` is extension bytes in front of the server name."""
    entry = b"\0" + struct.pack(">H", len(name)) + name
    ext = before + struct.pack(">HH", 0, len(entry) + 2) + struct.pack(">H", len(entry)) + entry
    body = b"\x03\x03" + b"\0" * 32 + b"\0" + struct.pack(">H", 2) + b"\x13\x01" + b"\x01\0" + struct.pack(">H", len(ext)) + ext
    shake = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(shake)) + shake


def frames(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(seq, seconds, link type, bytes[, wire length]) to a frame table."""
    full = [
        ("c", r[0], int(r[1] * 1_000_000), len(r[3]), r[4] if len(r) > 4 else len(r[3]), r[2], bytearray(r[3])) for r in rows
    ]
    return spark.createDataFrame(full, schema.FRAMES)


def packets(spark: SparkSession, rows: list[dict], capture: str = "c") -> DataFrame:
    """Sparse packet rows to a conforming packet table."""
    names = "capture_id string, seq bigint, ts_us bigint, src_ip string, dst_ip string, src_port int, dst_port int, proto string," \
            " tcp_flags int, packet_len bigint, payload_len bigint, sni string, arp_op int, decoded boolean"
    order = [n.split()[0] for n in names.split(",")]
    full = []
    for i, row in enumerate(rows):
        base = dict(capture_id=capture, seq=i, ts_us=i, proto="udp", packet_len=60, payload_len=0, decoded=True)
        full.append(tuple({**base, **row}.get(c) for c in order))
    return schema.conform_packets(spark.createDataFrame(full, names))

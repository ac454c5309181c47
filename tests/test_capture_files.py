"""Golden capture, capture files, decode and server names."""

import io
import os
import struct

import pytest
from helpers import arp, eth, frames, hello, ip4, ip6, tcp, udp

from tracequilt.functions import ip
from tracequilt.operators import aggregates as agg, decode, inspect as ins, ranking, ticks
from tracequilt.sources import capture_format as cf, capture_index, pcap

GOLDEN = [
    (1, eth(0x0800, ip4("192.168.1.10", "93.184.216.34", 6, tcp(50123, 443, 0x12, b"hello")))),
    (1, b"\1\2\3\4"),
    (3, eth(0x0800, ip4("8.8.8.8", "192.168.1.10", 17, udp(53, 53000, b"abcd")))),
]


def write_pcap(path, records, order="<", magic=0xA1B2C3D4, link=1, unit=1):
    with open(path, "wb") as out:
        out.write(struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link))
        for seconds, data in records:
            out.write(struct.pack(order + "IIII", int(seconds), 7 * unit, len(data), len(data)) + data)


def test_golden_capture(spark, tmp_path):
    path = str(tmp_path / "golden.pcap")
    write_pcap(path, GOLDEN)
    packets = decode.decode(pcap.read_captures(spark, path))
    quality = agg.capture_quality(packets).first()
    assert (quality.packets_seen, quality.bytes_seen, quality.packets_decoded, quality.packets_failed) == (3, 109, 2, 1)
    table = ticks.tick_table(ticks.assign_ticks(packets)).orderBy("tick").collect()
    assert [(t.tick, t.packets, t.bytes, t.gap_seconds) for t in table] == [(1, 2, 63, 1), (3, 1, 46, 0)]
    assert table[0].last_packet_us // 1_000_000 == 3
    tables = agg.capture_tables(packets)
    flows = ranking.rank_by_traffic(tables["flows"], "flows", 10).orderBy("rank").selectExpr(
        f"{ip.to_text('a_bin')} AS a", f"{ip.to_text('b_bin')} AS b", "bytes", "tcp_state", "initiator_is_a").collect()
    assert [tuple(f) for f in flows] == [
        ("192.168.1.10", "93.184.216.34", 59, "SYN_ACK", None), ("192.168.1.10", "8.8.8.8", 46, None, None)]
    assert tables["hosts"].count() == 3
    services = ranking.rank_by_traffic(tables["services"], "services", 5).orderBy("rank").collect()
    assert [s.service for s in services] == ["https", "dns"]
    session = tables["tcp"].first()
    assert (session.state, session.syn_count, session.payload_bytes, session.initiator) == ("SYN_ACK", 1, 5, None)
    only_tcp = packets.where(ins.packet_filter(proto="tcp"))
    assert agg.totals(only_tcp).first().bytes == 59 and ticks.tick_table(ticks.assign_ticks(only_tcp)).count() == 1


@pytest.mark.parametrize("order,magic,unit", [("<", 0xA1B2C3D4, 1), (">", 0xA1B2C3D4, 1), ("<", 0xA1B23C4D, 1000), (">", 0xA1B23C4D, 1000)])
def test_pcap_byte_orders_and_nanoseconds(spark, tmp_path, order, magic, unit):
    write_pcap(str(tmp_path / "x.pcap"), GOLDEN, order, magic, unit=unit)
    rows = pcap.read_captures(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.ts_us for r in rows] == [1_000_007, 1_000_007, 3_000_007]
    assert [bytes(r.data) for r in rows] == [d for _, d in GOLDEN]


def test_truncated_file_fails_unless_told_otherwise(spark, tmp_path):
    path = tmp_path / "cut.pcap"
    write_pcap(str(path), GOLDEN)
    path.write_bytes(path.read_bytes()[:-3])
    with pytest.raises(Exception, match="ends inside the record"):
        pcap.read_captures(spark, str(path)).collect()
    assert pcap.read_captures(spark, str(path), onTruncated="stop").count() == 2


def block(kind, body, order="<"):
    body += b"\0" * (-len(body) % 4)
    size = len(body) + 12
    return struct.pack(order + "II", kind, size) + body + struct.pack(order + "I", size)


def test_pcapng_mixed_links_and_resolution(spark, tmp_path):
    order = ">"
    section = block(0x0A0D0D0A, b"\x1a\x2b\x3c\x4d" + struct.pack(order + "HHq", 1, 0, -1), order)
    ethernet = block(1, struct.pack(order + "HHI", 1, 0, 0), order)
    millis = block(1, struct.pack(order + "HHI", 101, 0, 0) + struct.pack(order + "HHB3x", 9, 1, 3) + struct.pack(order + "HH", 0, 0), order)

    def packet(interface, stamp, data):
        return block(6, struct.pack(order + "IIIII", interface, stamp >> 32, stamp & 0xFFFFFFFF, len(data), len(data)) + data, order)

    raw = ip4("1.2.3.4", "10.0.0.1", 17, udp(1, 2))
    content = section + ethernet + millis + packet(0, 5_000_001, GOLDEN[0][1]) + block(5, b"\0" * 12, order) + packet(1, 7_123, raw) + packet(9, 1, raw)
    (tmp_path / "m.pcapng").write_bytes(content)
    rows = pcap.read_captures(spark, str(tmp_path)).orderBy("seq")
    assert [(r.ts_us, r.link_type) for r in rows.collect()] == [(5_000_001, 1), (7_123_000, 101)]
    assert decode.link_types(rows).first().mixed
    assert [r.proto for r in decode.decode(rows).orderBy("seq").collect()] == ["tcp", "udp"]


def test_write_splits_by_capture_and_link(spark, tmp_path):
    source = frames(spark, [(1, 1, 1, GOLDEN[0][1]), (2, 2, 101, GOLDEN[2][1][14:]), (3, 3, 1, GOLDEN[2][1])])
    pcap.write_captures(source, str(tmp_path / "out"))
    back = pcap.read_captures(spark, str(tmp_path / "out"))
    assert sorted((r.ts_us, r.link_type, bytes(r.data)) for r in back.collect()) == sorted((r.ts_us, r.link_type, bytes(r.data)) for r in source.collect())
    with pytest.raises(ValueError):
        pcap.write_captures(source, str(tmp_path / "no"), allow_mixed=False)


def test_index_is_exact_even_when_payloads_hold_captures(spark, tmp_path):
    inner = b"".join(cf.pcap_record(1_000_000 * i, 40, b"\x55" * 40) for i in range(200))
    records = []
    for i in range(120):
        records.append((i, b"\xaa" * (37 * i % 900 + 1)))
        if i % 40 == 20:
            records.append((i, inner))  # a transferred capture file: plausible headers in the payload
    path = str(tmp_path / "big.pcap")
    write_pcap(path, records)
    ranges = capture_index.index_captures(spark, path, chunk_bytes=4096)
    with open(path, "rb") as stream:
        header = cf.read_header(stream)
        whole = [r[0] for r in cf.pcap_records(stream, header, cf.GLOBAL_HEADER, None)]
        parts = [r[0] for _, start, end in ranges for r in cf.pcap_records(stream, header, start, end)]
    assert parts == whole and len(ranges) > 5
    capture_index.write_index(spark, path, str(tmp_path / "index"), 4096)
    indexed = pcap.read_captures(spark, path, index=str(tmp_path / "index"))
    assert indexed.rdd.getNumPartitions() == len(ranges) and indexed.count() == len(whole)


def decoded(spark, *cases):
    return decode.decode(frames(spark, [(i, 1, link, data) for i, (link, data) in enumerate(cases)])).selectExpr(
        "seq", f"{ip.to_text('src_bin')} AS src", "src_port", "dst_port", "proto", "tcp_flags", "payload_len", "decoded", "arp_op", "sni"
    ).orderBy("seq").collect()


def test_link_types(spark):
    v4, v6 = ip4("1.2.3.4", "10.0.0.1", 17, udp(1, 2)), ip6("2001:db8::1", "::1", 17, udp(1, 2))
    good = [
        (1, eth(0x0800, v4)), (1, eth(0x86DD, v6)), (1, eth(0x0800, v4, (0x8100,))), (1, eth(0x0800, v4, (0x88A8, 0x8100, 0x9100))),
        (12, v4), (101, v6), (228, v4), (229, v6), (0, struct.pack("<I", 2) + v4), (0, struct.pack("<I", 28) + v6), (108, struct.pack(">I", 30) + v6),
        (113, struct.pack(">HHH8xH", 0, 1, 6, 0x0800) + v4), (276, struct.pack(">H18x", 0x86DD) + v6),
    ]
    rows = decoded(spark, *good)
    assert all(r.decoded and r.proto == "udp" and (r.src_port, r.dst_port) == (1, 2) for r in rows)
    bad = [(1, b"\0" * 13), (1, eth(0x1234, v4)), (12, b"\x55" + v4[1:]), (0, struct.pack("<I", 7) + v4), (108, b"\0\0"), (113, b"\0" * 15),
           (147, v4), (228, v4[:19]), (229, v6[:39]), (1, eth(0x0806, arp(1, "1.1.1.1", "2.2.2.2", plen=6)))]
    assert not any(r.decoded for r in decoded(spark, *bad))


def test_transport_rules(spark):
    opts = b"\0" * 8
    rows = decoded(
        spark,
        (228, ip4("1.1.1.1", "2.2.2.2", 6, tcp(5, 6, 0xFF, b"xyz", words=7), options=opts)),
        (228, ip4("1.1.1.1", "2.2.2.2", 6, tcp(5, 6, 2)[:12])),  # cut inside the TCP header
        (228, ip4("1.1.1.1", "2.2.2.2", 6, tcp(5, 6, 2), flags=0x2000)),  # first fragment
        (228, ip4("1.1.1.1", "2.2.2.2", 17, udp(5, 6, b"1234567890", length=12))),  # shorter length field
        (228, ip4("1.1.1.1", "2.2.2.2", 17, udp(5, 6, b"1234", length=0))),
        (228, ip4("1.1.1.1", "2.2.2.2", 1, b"\x08" + b"\0" * 9)),
        (228, ip4("1.1.1.1", "2.2.2.2", 132, b"\0" * 9)),
        (229, ip6("fd00::2", "fe80::1", 0, b"\x3c\0" + b"\0" * 6 + b"\x06\1" + b"\0" * 14 + tcp(5, 6, 16, b"q"))),  # hop-by-hop, options
        (229, ip6("fd00::2", "fe80::1", 44, b"\x06\0\0\1" + b"\0" * 4 + tcp(5, 6, 16))),  # fragment with more to come
        (229, ip6("fd00::2", "fe80::1", 58, b"\x80" + b"\0" * 7 + b"ping")),
        (1, eth(0x0800, ip4("1.1.1.1", "2.2.2.2", 6, tcp(5, 6, 16)) + b"\0" * 6)),  # Ethernet padding is not payload
        (228, ip4("1.1.1.1", "2.2.2.2", 6, tcp(5, 6, 16, b"tso"), total=0)),
        (1, eth(0x0806, arp(2, "10.0.0.1", "10.0.0.2"))),
    )
    assert [(r.proto, r.src_port, r.tcp_flags, r.payload_len) for r in rows] == [
        ("tcp", 5, 255, 3), ("other", None, None, 12), ("other", None, None, 20), ("udp", 5, None, 4), ("udp", 5, None, 4),
        ("icmp", None, None, 2), ("other", None, None, 9), ("tcp", 5, 16, 1), ("other", None, None, 20), ("icmpv6", None, None, 4),
        ("tcp", 5, 16, 0), ("tcp", 5, 16, 3), ("arp", None, None, 0)]
    assert (rows[-1].src, rows[-1].arp_op) == ("10.0.0.1", 2)


def test_server_names(spark):
    filler = struct.pack(">HH", 10, 4) + b"abcd"
    cases = {
        "example.com": hello(b"example.com"), "spaced.org": hello(b" spaced.org "), "after.ext": hello(b"after.ext", filler * 20),
    }
    nothing = [b"\1\2\3", hello(b"example.com")[:50], hello(b"\xff\xfe.bad"), hello(b""), hello(b"x" * 254), b"\x16" + b"\0" * 80,
               hello(b"late.example", filler * 70)]
    payloads = list(cases.values()) + nothing
    rows = decoded(spark, *[(228, ip4("1.1.1.1", "2.2.2.2", 6, tcp(5, 443, 24, p))) for p in payloads])
    assert [r.sni for r in rows] == [*cases, *[None] * len(nothing)]
    framed = frames(spark, [(0, 1, 228, ip4("1.1.1.1", "2.2.2.2", 6, tcp(5, 443, 24, payloads[0])))])
    assert decode.decode(framed, sni_window=8).first().sni is None and decode.decode(framed, sni=False).first().sni is None
    assert decode.decode(framed, sni_window=len(payloads[0])).first().sni == "example.com"


def test_rotated_and_late_captures_are_found(spark, tmp_path):
    for name in ("x.pcap", "x.pcap1", "x.pcap.002", "y.PCAPNG3", "notes.txt", "z.pcapx"):
        write_pcap(str(tmp_path / name), GOLDEN)
    assert len(pcap.list_captures(str(tmp_path))) == 4
    reader = pcap.PcapStreamReader({"path": str(tmp_path)})
    before = reader.latestOffset()
    (tmp_path / "a").mkdir()
    write_pcap(str(tmp_path / "a" / "late.pcap"), GOLDEN)
    os.utime(tmp_path / "a" / "late.pcap", (1, 1))
    assert [p.path.endswith("a/late.pcap") for p in reader.partitions(before, reader.latestOffset())] == [True]
    assert len(reader.partitions(reader.initialOffset(), before)) == 4


def test_pcapng_power_of_two_resolution_and_broken_options(tmp_path):
    def capture(option):
        section = block(0x0A0D0D0A, b"\x4d\x3c\x2b\x1a" + struct.pack("<HHq", 1, 0, -1))
        interface = block(1, struct.pack("<HHI", 1, 0, 0) + option)
        packet = block(6, struct.pack("<IIIII", 0, 3, 1 << 31, 4, 4) + b"abcd")
        return io.BytesIO(section + interface + packet)

    note = struct.pack("<HH5s3x", 1, 5, b"hello")
    assert [r[1] for r in cf.pcapng_records(capture(note + struct.pack("<HHB3x", 9, 1, 0x80 | 32)))] == [3_500_000]
    assert [r[1] for r in cf.pcapng_records(capture(struct.pack("<HHB3x", 9, 1, 9)))] == [((3 << 32) + (1 << 31)) // 1000]
    with pytest.raises(cf.CaptureFormatError, match="past its block"):
        list(cf.pcapng_records(capture(struct.pack("<HHB3x", 9, 9, 9))))

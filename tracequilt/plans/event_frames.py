"""Raw frames built from the packet table, byte by byte, in SQL.

Gives the decode and capture-file queries an input that grows with ``events``:
every packet becomes a frame of one of nine link types, with VLAN tags,
ClientHello payloads and frames cut to four bytes where ``decoded`` is false.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schema
from .event_packets import packets_from_events


def _n(x: str | int, width: int) -> str:
    """Unsigned integer as fixed-width hex text."""
    return f"lpad(hex(CAST({x} AS BIGINT)), {width * 2}, '0')"


def _hello() -> str:
    """TLS record with a ClientHello that names ``sni`` (61 bytes and the name)."""
    size = "octet_length(sni)"
    return (
        f"concat('160301', {_n(f'{size} + 56', 2)}, '01', {_n(f'{size} + 52', 3)}, '0303{'00' * 32}', '00', '00021301', '0100',"
        f" {_n(f'{size} + 9', 2)}, '0000', {_n(f'{size} + 5', 2)}, {_n(f'{size} + 3', 2)}, '00', {_n(size, 2)}, hex(sni))"
    )


def frames_from_packets(packets: DataFrame) -> DataFrame:
    """``packets`` needs the binary addresses and ``whole`` (false = cut the frame)."""
    ports = f"concat({_n('coalesce(src_port, 0)', 2)}, {_n('coalesce(dst_port, 0)', 2)})"
    staged = packets.selectExpr(
        "*", "length(src_bin) = 16 AS v6",
        f"CASE WHEN sni IS NOT NULL THEN {_hello()} ELSE repeat('00', CAST(payload_len AS INT)) END AS body",
        "CASE WHEN proto = 'arp' THEN element_at(array(1, 113, 276), CAST(seq % 3 AS INT) + 1)"
        " WHEN seq % 7 = 2 AND length(src_bin) = 16 THEN 229"
        " ELSE element_at(array(1, 101, 228, 0, 108, 113, 276), CAST(seq % 7 AS INT) + 1) END AS link_type",
    ).selectExpr(
        "*",
        f"CASE proto WHEN 'tcp' THEN concat({ports}, '{'00' * 8}50', {_n('tcp_flags', 1)}, '{'00' * 6}', body)"
        f" WHEN 'udp' THEN concat({ports}, {_n('length(body) div 2 + 8', 2)}, '0000', body)"
        f" WHEN 'icmp' THEN '08{'00' * 7}' END AS l4",
        "CASE proto WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 ELSE 1 END AS number",
        "CASE WHEN proto = 'arp' THEN '0806' WHEN v6 THEN '86DD' ELSE '0800' END AS ether",
        "CASE WHEN seq % 5 = 0 THEN '81000001' ELSE '' END AS tag",
    )
    network = (
        f"CASE WHEN proto = 'arp' THEN concat('000108000604', {_n('coalesce(arp_op, 0)', 2)}, '{'00' * 6}', hex(src_bin), '{'00' * 6}', hex(dst_bin))"
        f" WHEN v6 THEN concat('60000000', {_n('length(l4) div 2', 2)}, {_n('number', 1)}, '40', hex(src_bin), hex(dst_bin), l4)"
        f" ELSE concat('4500', {_n('length(l4) div 2 + 20', 2)}, '0000000040', {_n('number', 1)}, '0000', hex(src_bin), hex(dst_bin), l4) END"
    )
    head = (
        f"CASE link_type WHEN 1 THEN concat('{'00' * 12}', tag, ether)"
        " WHEN 0 THEN CASE WHEN v6 THEN '1E000000' ELSE '02000000' END WHEN 108 THEN CASE WHEN v6 THEN '0000001E' ELSE '00000002' END"
        f" WHEN 113 THEN concat('000000010006{'00' * 8}', ether) WHEN 276 THEN concat(ether, '{'00' * 18}') ELSE '' END"
    )
    built = staged.selectExpr("*", f"unhex(concat({head}, {network})) AS frame")
    return built.selectExpr(
        "capture_id", "seq", "ts_us",
        "CASE WHEN whole THEN CAST(length(frame) AS BIGINT) ELSE 4L END AS captured_len", "packet_len", "link_type",
        "CASE WHEN whole THEN frame ELSE substring(frame, 1, 4) END AS data",
    )


def load_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # the fields of undecodable rows are kept: their frame is built whole and then cut
    packets = schema.conform_packets(packets_from_events(events).drop("decoded"))
    return frames_from_packets(packets.selectExpr("*", "seq % 97 <> 0 AS whole"))

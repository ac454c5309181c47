"""The rollup: one scan of the packets, one shuffle, everything else derives from it.

A rollup row is a directed 5-tuple (plus ARP operation and SNI) of one capture,
optionally of one tick.  Every accumulator is a fixed-width number, so Spark
plans a hash aggregate with map-side combine: a hot flow, host or capture is
already collapsed inside each scan task before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..functions.octets import has_flag

INIT, SYN_ACK, ESTABLISHED, FIN, RST = range(5)

KEY = ("src_bin", "dst_bin", "src_port", "dst_port", "proto", "arp_op", "sni")

TRACKED = "proto = 'tcp' AND tcp_flags IS NOT NULL AND src_port IS NOT NULL AND dst_port IS NOT NULL"


def tcp_class(flags: str = "tcp_flags") -> str:
    """Class of one TCP packet: reset, then finish, then the SYN combinations."""
    syn, ack = has_flag(flags, C.SYN), has_flag(flags, C.ACK)
    return (
        f"CASE WHEN {has_flag(flags, C.RST)} THEN {RST} WHEN {has_flag(flags, C.FIN)} THEN {FIN}"
        f" WHEN {syn} AND NOT {ack} THEN {INIT} WHEN {syn} THEN {SYN_ACK} ELSE {ESTABLISHED} END"
    )


def rollup(packets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Packets to directed 5-tuple counters, per capture and per column in ``by``.

    Undecodable frames collapse into one row per capture with ``decoded = false``.
    """
    def flagged(mask: int, name: str) -> str:
        return f"sum(CASE WHEN tracked AND {has_flag('tcp_flags', mask)} THEN 1 ELSE 0 END) AS {name}"

    paid = "CASE WHEN tracked AND payload_len > 0 THEN seq END"
    other = f"CASE WHEN _class <> {INIT} THEN seq END"
    aggregates = [
        "count(1) AS packets", "sum(packet_len) AS bytes",
        "min(seq) AS first_seq", "min_by(ts_us, seq) AS first_us",
        "max(seq) AS last_seq", "max_by(ts_us, seq) AS last_us",
        "sum(CASE WHEN tracked THEN payload_len ELSE 0 END) AS payload_bytes",
        f"max({paid}) AS payload_seq", f"max_by(ts_us, {paid}) AS payload_us",
        flagged(C.SYN, "syn_count"), flagged(C.FIN, "fin_count"), flagged(C.RST, "rst_count"),
        "max_by(_class, seq) AS last_class",
        f"max({other}) AS other_seq", f"max_by(_class, {other}) AS other_class",
        f"max(CASE WHEN _class = {INIT} THEN seq END) AS init_seq",
    ]
    return (
        packets.selectExpr("*", f"coalesce({TRACKED}, false) AS tracked")
        .selectExpr("*", f"CASE WHEN tracked THEN {tcp_class()} END AS _class")
        .groupBy("capture_id", *by, "decoded", "tracked", *KEY)
        .agg(*[F.expr(a) for a in aggregates])
    )


def packet_rows(packets: DataFrame) -> DataFrame:
    """Every packet as a rollup row of its own.

    For streams, where one aggregate is all a query may have: flows, sessions and
    hosts then add up from these rows as they do from a rollup's.
    """
    def flagged(mask: int, name: str) -> str:
        return f"CASE WHEN tracked AND {has_flag('tcp_flags', mask)} THEN 1L ELSE 0L END AS {name}"

    paid, other = "tracked AND payload_len > 0", f"_class <> {INIT}"
    return (
        packets.selectExpr("*", f"coalesce({TRACKED}, false) AS tracked")
        .selectExpr("*", f"CASE WHEN tracked THEN {tcp_class()} END AS _class")
        .selectExpr(
            "capture_id", "decoded", "tracked", *KEY, "1L AS packets", "packet_len AS bytes", "seq AS first_seq", "ts_us AS first_us",
            "seq AS last_seq", "ts_us AS last_us", "CASE WHEN tracked THEN payload_len ELSE 0L END AS payload_bytes",
            f"CASE WHEN {paid} THEN seq END AS payload_seq", f"CASE WHEN {paid} THEN ts_us END AS payload_us",
            flagged(C.SYN, "syn_count"), flagged(C.FIN, "fin_count"), flagged(C.RST, "rst_count"), "_class AS last_class",
            f"CASE WHEN {other} THEN seq END AS other_seq", f"CASE WHEN {other} THEN _class END AS other_class",
            f"CASE WHEN _class = {INIT} THEN seq END AS init_seq",
        )
    )

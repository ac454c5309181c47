"""Direction, service and orientation.

All of these depend on the packet's 5-tuple and its ARP operation only, so they
run on the rollup (one row per directed 5-tuple) and not on every packet.
Functions take and return SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import constants as C
from ..functions import ip
from ..runtime import computed

SIDE_FLAGS = ("src_is_local", "dst_is_local", "has_locals")


def with_local_sides(df: DataFrame, local_addresses: DataFrame | None) -> DataFrame:
    """Add ``src_is_local``, ``dst_is_local`` and ``has_locals`` from a
    ``local_addresses(capture_id, ip)`` table; all false without one.

    Plain equi-joins without hints: Spark broadcasts the address table when its
    size allows, and otherwise shuffles with skew handling.
    """
    if local_addresses is None:
        return df.selectExpr("*", *[f"false AS {f}" for f in SIDE_FLAGS])
    known = local_addresses.selectExpr("capture_id", f"{ip.from_text('ip')} AS _ip").distinct()
    src = known.selectExpr("capture_id", "_ip AS src_bin", "true AS _src_is_local")
    dst = known.selectExpr("capture_id", "_ip AS dst_bin", "true AS _dst_is_local")
    captures = known.select("capture_id").distinct().selectExpr("capture_id", "true AS _has_locals")
    joined = (
        df.join(src, ["capture_id", "src_bin"], "left")
        .join(dst, ["capture_id", "dst_bin"], "left")
        .join(captures, "capture_id", "left")
    )
    return joined.selectExpr(*df.columns, *[f"coalesce(_{f}, false) AS {f}" for f in SIDE_FLAGS])


def direction(offline: bool, src: str = "src_bin", dst: str = "dst_bin",
              src_local: str = "src_is_local", dst_local: str = "dst_is_local") -> str:
    """inbound, outbound, loopback or unknown; the first rule that applies wins."""
    near, far = ip.is_local_side(src), ip.is_local_side(dst)
    by_scope = f"WHEN {near} AND NOT {far} THEN 'outbound' WHEN NOT {near} AND {far} THEN 'inbound'" if offline else ""
    return (
        f"CASE WHEN {ip.is_loopback(src)} AND {ip.is_loopback(dst)} THEN 'loopback'"
        f" WHEN {ip.is_unspecified(src)} OR {ip.is_unspecified(dst)} THEN 'unknown'"
        f" WHEN {src_local} AND {dst_local} THEN 'loopback' WHEN {src_local} THEN 'outbound'"
        f" WHEN {dst_local} THEN 'inbound' {by_scope} ELSE 'unknown' END"
    )


def service_port(src_port: str, dst_port: str, way: str) -> str:
    """The port that names the service: the remote side, else the well-known or smaller one."""
    known = C.WELL_KNOWN_MAX_PORT
    return (
        f"CASE WHEN {way} = 'outbound' THEN coalesce({dst_port}, {src_port})"
        f" WHEN {way} = 'inbound' THEN coalesce({src_port}, {dst_port})"
        f" WHEN {src_port} <= {known} AND {dst_port} > {known} THEN {src_port}"
        f" WHEN {dst_port} <= {known} AND {src_port} > {known} THEN {dst_port}"
        f" ELSE least({src_port}, {dst_port}) END"
    )


def _port_name(proto: str, port: str) -> str:
    def names(table: dict[int, str]) -> str:
        return f"CASE {port} {' '.join(f'WHEN {p} THEN {chr(39)}{n}{chr(39)}' for p, n in table.items())} END"

    return f"CASE {proto} WHEN 'tcp' THEN {names(C.TCP_SERVICES)} WHEN 'udp' THEN {names(C.UDP_SERVICES)} END"


def _protocol_name(proto: str, arp_op: str) -> str:
    return (
        f"CASE WHEN {proto} = 'arp' AND {arp_op} = 1 THEN 'arp-request' WHEN {proto} = 'arp' AND {arp_op} = 2 THEN 'arp-reply'"
        f" WHEN {proto} IN ('arp', 'icmp', 'icmpv6') THEN {proto} END"
    )


def with_service(df: DataFrame, proto: str = "proto", src_port: str = "src_port", dst_port: str = "dst_port",
                 arp_op: str = "arp_op", way: str = "direction") -> DataFrame:
    """Add ``service`` and ``confidence_rank`` (0 low, 1 medium, 2 high)."""
    staged = computed(df, _by_protocol=_protocol_name(proto, arp_op), _port=service_port(src_port, dst_port, way))
    staged = computed(staged, _by_port=_port_name(proto, "_port"))
    return staged.selectExpr(
        *df.columns,
        "coalesce(_by_protocol, _by_port, 'unknown') AS service",
        f"CASE WHEN _by_protocol IS NULL AND _by_port IS NULL THEN 0 WHEN {way} = 'unknown' THEN 1"
        f" WHEN {way} = 'loopback' AND _by_protocol IS NULL THEN 0 ELSE 2 END AS confidence_rank",
    )


def confidence_label(rank: str = "confidence_rank") -> str:
    return f"element_at(array({', '.join(repr(c) for c in C.CONFIDENCES)}), {rank} + 1)"


def swap_endpoints() -> str:
    """True when the flow's source and destination trade places so that the local
    side (or, without one, the smaller endpoint) comes first."""
    near = f"(CASE WHEN has_locals THEN src_is_local ELSE {ip.is_local_side('src_bin')} END)"
    far = f"(CASE WHEN has_locals THEN dst_is_local ELSE {ip.is_local_side('dst_bin')} END)"
    return (
        f"CASE WHEN {near} AND NOT {far} THEN false WHEN NOT {near} AND {far} THEN true"
        f" ELSE {ip.after('src_bin', 'src_port', 'dst_bin', 'dst_port')} END"
    )


def session_direction(a: str = "a_bin", b: str = "b_bin") -> str:
    """Direction label of an oriented flow; ties of byte balance count as outbound."""
    balance = "CASE WHEN bytes_out >= bytes_in THEN 'outbound' ELSE 'inbound' END"
    near, far = ip.is_local_side(a), ip.is_local_side(b)
    return (
        f"CASE WHEN {ip.is_loopback(a)} AND {ip.is_loopback(b)} THEN 'loopback'"
        f" WHEN has_locals THEN CASE WHEN a_is_local AND b_is_local THEN 'loopback' WHEN a_is_local THEN {balance}"
        f" WHEN b_is_local THEN 'inbound' ELSE 'unknown' END"
        f" WHEN {near} AND {far} THEN 'loopback' WHEN NOT {near} AND {far} THEN 'inbound' ELSE {balance} END"
    )


def projection_service(src_port: str = "a_port", dst_port: str = "b_port") -> str:
    """The short label of flow listings: https, dns or unknown."""
    return f"CASE coalesce({dst_port}, {src_port}, 0) WHEN 443 THEN 'https' WHEN 53 THEN 'dns' ELSE 'unknown' END"


def remote_endpoint() -> str:
    """The non-local side when exactly one side is local, else the destination."""
    return "CASE WHEN b_is_local AND NOT a_is_local THEN a_bin ELSE b_bin END"


def proto_rank(proto: str = "proto") -> str:
    return f"array_position(array({', '.join(repr(p) for p in C.PROTO_ORDER)}), {proto})"



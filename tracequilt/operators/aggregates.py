"""Flows, TCP sessions, hosts, services and totals, all derived from the rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..functions import ip, text
from ..runtime import computed, materialize
from . import classify
from .rollup import FIN, INIT, RST, rollup

FLOW_KEY = ("a_bin", "b_bin", "a_port", "b_port", "proto")


def classified(rolled: DataFrame, local_addresses: DataFrame | None = None, offline: bool = True) -> DataFrame:
    """Decoded rollup rows with direction, service, confidence rank and local flags."""
    sides = classify.with_local_sides(rolled.where("decoded"), local_addresses)
    return classify.with_service(computed(sides, direction=classify.direction(offline)))


def _aggs(df: DataFrame, keys: list[str], aggregates: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(a) for a in aggregates])


def _way(way: str, column: str) -> str:
    return f"sum(CASE WHEN direction = '{way}' THEN {column} ELSE 0 END)"


WAY_SUMS = [
    "sum(packets) AS packets", "sum(bytes) AS bytes",
    f"{_way('inbound', 'packets')} AS packets_in", f"{_way('outbound', 'packets')} AS packets_out",
    f"{_way('inbound', 'bytes')} AS bytes_in", f"{_way('outbound', 'bytes')} AS bytes_out",
]
SEEN = ["min_by(first_us, first_seq) AS first_us", "max_by(last_us, last_seq) AS last_us"]


def flows(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Oriented flows with their TCP statistics.

    ``rows`` is the output of :func:`classified`.  The TCP session key is a
    function of the flow key, so flow counters and session state come out of
    one aggregation and need no join.
    """
    def side(src: str, dst: str) -> str:
        return f"CASE WHEN _swap THEN {dst} ELSE {src} END"

    oriented = computed(
        computed(rows, _swap=classify.swap_endpoints()),
        a_bin=side("src_bin", "dst_bin"), b_bin=side("dst_bin", "src_bin"),
        a_port=side("src_port", "dst_port"), b_port=side("dst_port", "src_port"),
        a_is_local=side("src_is_local", "dst_is_local"), b_is_local=side("dst_is_local", "src_is_local"),
        # 1 = the flow's first endpoint sent the packets of this rollup row
        _by_a="CASE WHEN _swap THEN 0 ELSE 1 END",
        # order of the packets of a tracked TCP session; null elsewhere, which aggregates skip
        _tlast="CASE WHEN tracked THEN last_seq END", _tfirst="CASE WHEN tracked THEN first_seq END",
    )

    def tracked(column: str) -> str:
        return f"sum(CASE WHEN tracked THEN {column} ELSE 0 END)"

    grouped = _aggs(oriented, ["capture_id", *by, *FLOW_KEY], [
        *WAY_SUMS, *SEEN,
        "bool_or(a_is_local) AS a_is_local", "bool_or(b_is_local) AS b_is_local", "bool_or(has_locals) AS has_locals",
        "min_by(sni, CASE WHEN sni IS NOT NULL THEN first_seq END) AS sni",
        f"{tracked('packets')} AS tcp_packets", f"{tracked('bytes')} AS tcp_bytes",
        "sum(payload_bytes) AS tcp_payload_bytes",
        "sum(syn_count) AS syn_count", "sum(fin_count) AS fin_count", "sum(rst_count) AS rst_count",
        "min_by(first_us, _tfirst) AS tcp_first_us", "max_by(last_us, _tlast) AS tcp_last_us",
        "max_by(payload_us, payload_seq) AS tcp_payload_us",
        "max_by(last_class, _tlast) AS _last", "max_by(other_class, other_seq) AS _other",
        "max_by(_by_a, init_seq) AS initiator_is_a",
    ])
    # The latest packet decides, except that a bare SYN cannot leave RST or FIN.
    state = f"CASE WHEN _last <> {INIT} THEN _last WHEN _other IN ({RST}, {FIN}) THEN _other ELSE {INIT} END"
    labels = ", ".join(repr(s) for s in C.TCP_STATES)
    kept = [c for c in grouped.columns if c not in ("_last", "_other")]
    return grouped.selectExpr(
        *kept, f"CASE WHEN tcp_packets > 0 THEN element_at(array({labels}), {state} + 1) END AS tcp_state"
    )


def tcp_sessions(flow_rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """TCP sessions: a projection of the flows, endpoints ordered by address text then port."""
    named = computed(flow_rows.where("tcp_packets > 0"), _a=ip.to_text("a_bin"), _b=ip.to_text("b_bin"))
    named = computed(named, _flip="(_a > _b OR (_a = _b AND a_port > b_port))")

    def first(a: str, b: str) -> str:
        return f"CASE WHEN _flip THEN {b} ELSE {a} END"

    sender = f"CASE initiator_is_a WHEN 1 THEN {text.endpoint('_a', 'a_port')} WHEN 0 THEN {text.endpoint('_b', 'b_port')} END"
    return named.selectExpr(
        "capture_id", *by,
        f"{first('_a', '_b')} AS endpoint_a_ip", f"{first('a_port', 'b_port')} AS endpoint_a_port",
        f"{first('_b', '_a')} AS endpoint_b_ip", f"{first('b_port', 'a_port')} AS endpoint_b_port",
        f"{first('a_bin', 'b_bin')} AS endpoint_a_bin", f"{first('b_bin', 'a_bin')} AS endpoint_b_bin",
        "tcp_state AS state", "syn_count", "fin_count", "rst_count",
        "tcp_packets AS packets", "tcp_bytes AS bytes", "tcp_payload_bytes AS payload_bytes",
        f"{sender} AS initiator",
        "tcp_first_us AS first_us", "tcp_last_us AS last_us", "tcp_payload_us AS last_payload_us",
    )


def hosts(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per-address counters: each packet is outbound for its source and inbound for its
    destination (twice the same address counts twice).  The SNI names the destination."""
    roles = rows.selectExpr(
        "capture_id", *by, "packets", "bytes", "first_us", "first_seq", "last_us", "last_seq",
        "CASE WHEN src_bin <> dst_bin THEN sni END AS _sni",
        "explode(array(named_struct('host_bin', src_bin, 'direction', 'outbound'),"
        " named_struct('host_bin', dst_bin, 'direction', 'inbound'))) AS _role",
    ).selectExpr("*", "_role.host_bin", "_role.direction")
    named = "min_by(_sni, CASE WHEN direction = 'inbound' AND _sni IS NOT NULL THEN first_seq END) AS sni"
    return _aggs(roles, ["capture_id", *by, "host_bin"], [*WAY_SUMS, *SEEN, named])


def services(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counters by service name and transport; confidence is the best one seen."""
    grouped = _aggs(rows, ["capture_id", *by, "service", "proto"], [*WAY_SUMS, "max(confidence_rank) AS confidence_rank"])
    return grouped.selectExpr("*", f"{classify.confidence_label()} AS confidence")


def totals(packets: DataFrame) -> DataFrame:
    """Session totals and times over every observed frame, decodable or not."""
    return _aggs(packets, ["capture_id"], [
        "count(1) AS packets", "sum(packet_len) AS bytes",
        "min_by(ts_us, seq) AS started_us", "max_by(ts_us, seq) AS ended_us",
    ])


def capture_quality(packets: DataFrame, as_of_us: str | None = None, dropped: DataFrame | None = None) -> DataFrame:
    """Seen, decoded, failed and dropped frames and the age of the last packet.

    ``dropped(capture_id, dropped_packets)`` is capture metadata; files have none.
    """
    seen = _aggs(packets, ["capture_id"], [
        "count(1) AS packets_seen", "sum(packet_len) AS bytes_seen",
        "count_if(decoded) AS packets_decoded", "count_if(NOT decoded) AS packets_failed",
        "max_by(ts_us, seq) AS last_packet_us",
    ])
    if dropped is None:
        seen = seen.selectExpr("*", "0L AS packets_dropped")
    else:
        lost = dropped.selectExpr("capture_id", "CAST(dropped_packets AS BIGINT) AS _lost")
        seen = seen.join(lost, "capture_id", "left").selectExpr(*seen.columns, "coalesce(_lost, 0L) AS packets_dropped")
    if as_of_us is not None:
        seen = seen.selectExpr("*", f"greatest({as_of_us} - last_packet_us, 0L) AS last_packet_age_us")
    return seen


def capture_tables(packets: DataFrame, local_addresses: DataFrame | None = None, offline: bool = True,
                   by: tuple[str, ...] = (), store: bool = False) -> dict[str, DataFrame]:
    """All session tables of a set of captures from one rollup.

    ``store=True`` writes the rollup and the flows to the shared folder first.
    Use it when several tables feed one job: the packets are then scanned once,
    whatever the number of tables.
    """
    rolled = rollup(packets, by)
    if store:
        rolled = materialize(rolled, "rollup")
    rows = classified(rolled, local_addresses, offline)
    flow_rows = flows(rows, by)
    if store:
        flow_rows = materialize(flow_rows, "flows")
    return {
        "totals": totals_of(rolled),
        "rows": rows,
        "flows": flow_rows,
        "tcp": tcp_sessions(flow_rows, by),
        "hosts": hosts(rows, by),
        "services": services(rows, by),
    }


def totals_of(rolled: DataFrame) -> DataFrame:
    """:func:`totals` from rollup rows instead of packets."""
    return _aggs(rolled, ["capture_id"], [
        "sum(packets) AS packets", "sum(bytes) AS bytes",
        "min_by(first_us, first_seq) AS started_us", "max_by(last_us, last_seq) AS ended_us",
    ])

"""Frames to packets, as SQL expressions over the frame bytes.

Headers are read in small chunks (link, network, transport); each chunk becomes
hex text once and fields are cut from it.  No Python runs per row, and the raw
bytes are dropped as soon as the fields are out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as C, schema
from ..functions import let, tls
from ..functions.octets import chunk, hex_at, hex_at_le, hex_int
from ..runtime import computed

ETH_IPV4, ETH_ARP, ETH_IPV6 = 0x0800, 0x0806, 0x86DD
VLAN_TAGS = (0x8100, 0x88A8, 0x9100)
VLAN_DEPTH = 3
# extension headers (authentication also follows IPv4) and how many to walk
HOP, ROUTING, FRAGMENT, AUTH, OPTIONS = 0, 43, 44, 51, 60
EXTENSION_DEPTH = 8
ICMP, TCP, UDP, ICMP6 = 1, 6, 17, 58


def strip_link(frames: DataFrame) -> DataFrame:
    """Add ``ethertype`` and ``l3_at`` (byte offset of the network header); ethertype is
    null when the link header is unsupported or cut short."""
    families = "WHEN 2 THEN {} WHEN 24 THEN {} WHEN 28 THEN {} WHEN 30 THEN {} END".format(ETH_IPV4, ETH_IPV6, ETH_IPV6, ETH_IPV6)
    ethertype = f"""CASE
      WHEN link_type = {C.LINK_ETHERNET} AND _size >= 14 THEN {hex_at('_head', 12, 2)}
      WHEN link_type IN ({C.LINK_RAW}, {C.LINK_RAW_DLT}) THEN CASE substring(_head, 1, 1) WHEN '4' THEN {ETH_IPV4} WHEN '6' THEN {ETH_IPV6} END
      WHEN link_type = {C.LINK_IPV4} THEN {ETH_IPV4}
      WHEN link_type = {C.LINK_IPV6} THEN {ETH_IPV6}
      WHEN link_type = {C.LINK_NULL} AND _size >= 4 THEN CASE {hex_at_le('_head', 0, 4)} {families}
      WHEN link_type = {C.LINK_LOOP} AND _size >= 4 THEN CASE {hex_at('_head', 0, 4)} {families}
      WHEN link_type = {C.LINK_SLL} AND _size >= 16 THEN
        CASE WHEN {hex_at('_head', 0, 2)} <= 7 AND {hex_at('_head', 2, 2)} NOT IN (770, 778, 803, 824) THEN {hex_at('_head', 14, 2)} END
      WHEN link_type = {C.LINK_SLL2} AND _size >= 20 THEN {hex_at('_head', 0, 2)} END"""
    start = frames.selectExpr("*", f"{chunk('data', '0', 16)} AS _head", "length(data) AS _size").selectExpr(
        *frames.columns, "_size", f"CAST({ethertype} AS BIGINT) AS ethertype",
        f"CAST(CASE link_type WHEN {C.LINK_ETHERNET} THEN 14 WHEN {C.LINK_NULL} THEN 4 WHEN {C.LINK_LOOP} THEN 4"
        f" WHEN {C.LINK_SLL} THEN 16 WHEN {C.LINK_SLL2} THEN 20 ELSE 0 END AS BIGINT) AS l3_at",
    )
    # each VLAN tag is four bytes: tag control and the next ethertype
    tagged = f"ethertype IN ({', '.join(str(t) for t in VLAN_TAGS)})"
    for _ in range(VLAN_DEPTH):
        start = start.selectExpr(
            *frames.columns, "_size",
            f"CASE WHEN {tagged} THEN {hex_int(chunk('data', 'l3_at + 2', 2), '0', 2)} ELSE ethertype END AS ethertype",
            f"CASE WHEN {tagged} THEN l3_at + 4 ELSE l3_at END AS l3_at",
        )
    return start


def _after_extensions() -> str:
    """struct(next, at, split): past the extension headers; ``split`` marks fragments."""
    begin = "named_struct('next', _next, 'at', _l4_at, 'split', _split)"
    known = (
        f"CASE WHEN _version = 6 THEN s.next IN ({ROUTING}, {FRAGMENT}, {AUTH}, {OPTIONS}) OR (s.next = {HOP} AND s.at = l3_at + 40)"
        f" ELSE s.next = {AUTH} END"
    )
    units = hex_int("h", "1", 1)
    size = f"CASE s.next WHEN {FRAGMENT} THEN 8 WHEN {AUTH} THEN ({units} + 2) * 4 ELSE ({units} + 1) * 8 END"
    fragment = f"s.next = {FRAGMENT} AND ({hex_int('h', '2', 2)} & {0xFFF9}) <> 0"
    moved = f"named_struct('next', {hex_int('h', '0', 1)}, 'at', s.at + n, 'split', coalesce({fragment}, false))"
    step = let(
        chunk("data", "s.at", 4), "h",
        let(size, "n", f"CASE WHEN coalesce({known}, false) AND NOT s.split AND coalesce(s.at + n <= _ip_end, false) THEN {moved} ELSE s END"),
    )
    some = f"CASE WHEN _version = 6 THEN _next IN ({HOP}, {ROUTING}, {FRAGMENT}, {AUTH}, {OPTIONS}) ELSE _next = {AUTH} END"
    return f"CASE WHEN {some} THEN aggregate(sequence(1, {EXTENSION_DEPTH}), {begin}, (s, i) -> {step}) ELSE {begin} END"


def decode(frames: DataFrame, sni_window: int = C.SNI_WINDOW_DEFAULT, sni: bool = True) -> DataFrame:
    """Frames to packets.  ``decoded = false`` keeps the frame for the totals only."""
    keep = ["capture_id", "seq", "ts_us", "packet_len", "data"]
    ihl = "CAST(conv(substring(_net, 2, 1), 16, 10) AS BIGINT) * 4"
    kind = f"""CASE
      WHEN ethertype = {ETH_IPV4} AND substring(_net, 1, 1) = '4' AND _ihl >= 20 AND _rest >= _ihl THEN 4
      WHEN ethertype = {ETH_IPV6} AND substring(_net, 1, 1) = '6' AND _rest >= 40 THEN 6
      WHEN ethertype = {ETH_ARP} AND _rest >= 8 AND {hex_int('_net', '5', 1)} = 4 AND _rest >= 16 + 2 * {hex_int('_net', '4', 1)} THEN 1 END"""
    net = strip_link(frames).selectExpr(
        *keep, "ethertype", "l3_at", "_size - l3_at AS _rest", f"{chunk('data', 'l3_at', 40)} AS _net"
    ).selectExpr("*", f"CASE WHEN ethertype = {ETH_IPV4} THEN {ihl} END AS _ihl").selectExpr("*", f"{kind} AS _kind")

    def octets(at: str, count: int) -> str:
        return f"substring(data, CAST({at} + 1 AS INT), {count})"

    hw, total, plen = hex_at("_net", 4, 1), hex_at("_net", 2, 2), hex_at("_net", 4, 2)
    l3 = net.selectExpr(
        *keep, "_kind", "l3_at", "CASE WHEN _kind IN (4, 6) THEN _kind END AS _version",
        # a length field that is zero or too small means "to the end of the capture"
        f"CASE _kind WHEN 4 THEN l3_at + CASE WHEN {total} < _ihl THEN _rest ELSE least({total}, _rest) END"
        f" WHEN 6 THEN l3_at + CASE WHEN {plen} = 0 THEN _rest ELSE least({plen} + 40, _rest) END END AS _ip_end",
        "CASE _kind WHEN 4 THEN l3_at + _ihl WHEN 6 THEN l3_at + 40 END AS _l4_at",
        f"CASE _kind WHEN 4 THEN {hex_at('_net', 9, 1)} WHEN 6 THEN {hex_at('_net', 6, 1)} END AS _next",
        f"coalesce(_kind = 4 AND ({hex_at('_net', 6, 2)} & {0x3FFF}) <> 0, false) AS _split",
        f"CASE _kind WHEN 4 THEN {octets('l3_at + 12', 4)} WHEN 6 THEN {octets('l3_at + 8', 16)} WHEN 1 THEN {octets(f'l3_at + 8 + {hw}', 4)} END AS src_bin",
        f"CASE _kind WHEN 4 THEN {octets('l3_at + 16', 4)} WHEN 6 THEN {octets('l3_at + 24', 16)} WHEN 1 THEN {octets(f'l3_at + 12 + 2 * {hw}', 4)} END AS dst_bin",
        f"CASE WHEN _kind = 1 THEN {hex_at('_net', 6, 2)} END AS arp_op",
        "_kind IS NOT NULL AS decoded",
    )
    fields = ["src_bin", "dst_bin", "arp_op", "decoded"]
    l4 = (
        l3.selectExpr(*keep, *fields, "_kind", "_ip_end", f"CASE WHEN _version IS NOT NULL THEN {_after_extensions()} END AS _x")
        .selectExpr(
            *keep, *fields, "_kind", "_x.next AS _next", "_x.at AS _l4_at", "_x.split AS _split",
            "_ip_end - _x.at AS _room", f"{chunk('data', '_x.at', 20)} AS _l4",
        )
        .selectExpr(
            "*", "CASE WHEN _room >= 20 THEN CAST(conv(substring(_l4, 25, 1), 16, 10) AS BIGINT) * 4 END AS _doff",
            f"coalesce(_next = {ICMP} AND {hex_int('_l4', '0', 1)} IN (13, 14) AND {hex_int('_l4', '1', 1)} = 0, false) AS _timed",
        )
    )
    proto = f"""CASE WHEN _kind = 1 THEN 'arp'
      WHEN NOT _split AND _next = {TCP} AND _doff >= 20 AND _room >= _doff THEN 'tcp'
      WHEN NOT _split AND _next = {UDP} AND _room >= 8 THEN 'udp'
      WHEN NOT _split AND _next = {ICMP} AND _room >= 8 AND (NOT _timed OR _room = 20) THEN 'icmp'
      WHEN NOT _split AND _next = {ICMP6} AND _room >= 8 THEN 'icmpv6'
      WHEN decoded THEN 'other' END"""
    skip = "CASE proto WHEN 'tcp' THEN _doff WHEN 'icmp' THEN CASE WHEN _timed THEN 20 ELSE 8 END WHEN 'udp' THEN 8 WHEN 'icmpv6' THEN 8 ELSE 0 END"
    udp_len = hex_at("_l4", 4, 2)
    done = l4.selectExpr("*", f"{proto} AS proto").selectExpr(
        *keep, *fields, "proto", f"_l4_at + {skip} AS _pay_at",
        f"CASE WHEN proto IN ('tcp', 'udp') THEN {hex_at('_l4', 0, 2)} END AS src_port",
        f"CASE WHEN proto IN ('tcp', 'udp') THEN {hex_at('_l4', 2, 2)} END AS dst_port",
        f"CASE WHEN proto = 'tcp' THEN {hex_at('_l4', 13, 1)} END AS tcp_flags",
        f"CASE WHEN proto = 'udp' AND {udp_len} BETWEEN 8 AND _room THEN {udp_len} - 8 ELSE coalesce(_room - {skip}, 0) END AS payload_len",
    )
    if sni and sni_window > 0:
        # cut out only what can be a ClientHello
        window = min(sni_window, C.SNI_WINDOW_MAX)
        done = done.selectExpr(
            "*", f"CASE WHEN proto = 'tcp' AND payload_len >= 9 AND {octets('_pay_at', 1)} = X'16' THEN"
            f" substring(data, CAST(_pay_at + 1 AS INT), CAST(least(payload_len, {window}) AS INT)) END AS _hello",
        ).selectExpr("*", f"{tls.server_name('_hello', window)} AS sni")
    else:
        done = done.selectExpr("*", "CAST(NULL AS STRING) AS sni")
    # filters on decoded fields stay above the byte arithmetic
    made = {f.name: f"CAST({f.name} AS {f.dataType.simpleString()})" for f in schema.PACKETS.fields if f.name not in keep}
    renamed = {f"_{name}": expression for name, expression in made.items()}
    packed = computed(done.select(*[c for c in done.columns if c not in ("data", "_hello")]), **renamed)
    return packed.selectExpr(*[f.name if f.name in keep else f"_{f.name} AS {f.name}" for f in schema.PACKETS.fields])


def link_types(frames: DataFrame) -> DataFrame:
    """Link types per capture; ``mixed`` marks captures with more than one."""
    return frames.groupBy("capture_id").agg(F.count_distinct("link_type").alias("link_types")).selectExpr(
        "*", "link_types > 1 AS mixed"
    )

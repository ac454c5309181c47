"""IP addresses.

Tables carry addresses as BINARY (4 or 16 bytes): smaller to shuffle than text,
and byte order is numeric order.  Text is rendered after aggregation.
"""

from __future__ import annotations

import ipaddress

from . import any_of, let


def address(value: str) -> str:
    """BINARY literal of an address."""
    return f"X'{ipaddress.ip_address(value).packed.hex()}'"


def _range(x: str, cidr: str) -> str:
    net = ipaddress.ip_network(cidr, strict=False)
    low, high = net.network_address.packed.hex(), net.broadcast_address.packed.hex()
    return f"{x} = X'{low}'" if low == high else f"{x} BETWEEN X'{low}' AND X'{high}'"


def in_network(x: str, cidr: str) -> str:
    """True when the binary address lies in ``cidr``."""
    size = ipaddress.ip_network(cidr, strict=False).max_prefixlen // 8
    return f"(length({x}) = {size} AND {_range(x, cidr)})"


def from_text(x: str) -> str:
    """Address text to BINARY; null for anything that is not an address."""
    octet = [f"try_cast(substring_index(substring_index({x}, '.', {i}), '.', -1) AS BIGINT)" for i in range(1, 5)]
    packed = f"4294967296 + {octet[0]} * 16777216 + {octet[1]} * 65536 + {octet[2]} * 256 + {octet[3]}"
    return (
        f"CASE WHEN contains({x}, ':') THEN {_v6_from_text(x)}"
        f" WHEN {x} RLIKE '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' AND greatest({', '.join(octet)}) <= 255"
        f" THEN unhex(substring(hex({packed}), 2, 8)) END"
    )


def _v6_from_text(x: str) -> str:
    quad = [f"lpad(hex(try_cast(substring_index(substring_index(q, '.', {i}), '.', -1) AS BIGINT)), 2, '0')" for i in range(1, 5)]
    # a dotted tail becomes two ordinary groups
    dotted = let(
        f"substring_index({x}, ':', -1)", "q",
        f"concat(substring({x}, 1, length({x}) - length(q)), {quad[0]}, {quad[1]}, ':', {quad[2]}, {quad[3]})",
    )
    plain = f"CASE WHEN contains({x}, '.') THEN {dotted} ELSE {x} END"
    halves = [f"filter(split(coalesce(try_element_at(split(p, '::'), {i}), ''), ':'), g -> g <> '')" for i in (1, 2)]
    # only '::' stands for missing groups
    filled = "concat(h[0], array_repeat('0', CASE WHEN contains(p, '::') THEN greatest(8 - size(h[0]) - size(h[1]), 0) ELSE 0 END), h[1])"
    digits = let(
        plain, "p", let(f"array({halves[0]}, {halves[1]})", "h", f"array_join(transform({filled}, g -> lpad(g, 4, '0')), '')")
    )
    return let(digits, "d", "CASE WHEN d RLIKE '^[0-9A-Fa-f]{32}$' THEN unhex(d) END")


def to_text(x: str) -> str:
    """BINARY address to canonical text (RFC 5952 short form for IPv6)."""
    return f"CASE WHEN length({x}) = 4 THEN {_v4_text(x)} WHEN length({x}) = 16 THEN {_v6_text(x)} END"


def _v4_text(x: str) -> str:
    return "concat_ws('.', " + ", ".join(f"conv(hex(substring({x}, {i}, 1)), 16, 10)" for i in range(1, 5)) + ")"


def _v6_text(x: str) -> str:
    # The longest run of two or more zero groups becomes "::", the first one on a tie.
    cases = []
    for run in range(8, 1, -1):
        pattern = f"^(.*?)(?:^|:)0(?::0){{{run - 1}}}(?::|$)(.*)$"
        cases.append(f"WHEN p RLIKE '{pattern}' THEN regexp_replace(p, '{pattern}', '$1::$2')")
    short = f"CASE {' '.join(cases)} ELSE p END"
    groups = "concat_ws(':', transform(sequence(0, 7), i -> substring(d, i * 4 + 1, 4)))"
    plain = f"regexp_replace({groups}, '(^|:)0{{1,3}}(?=[0-9a-f])', '$1')"
    mapped = f"concat('::ffff:', {_v4_text(f'substring({x}, 13, 4)')})"
    return let(
        f"lower(hex({x}))", "d",
        f"CASE WHEN startswith(d, '00000000000000000000ffff') THEN {mapped} ELSE {let(plain, 'p', short)} END",
    )


# --- fixed values: special address ranges by family
_SCOPES = {
    4: [("unspecified", ["0.0.0.0/32"]), ("loopback", ["127.0.0.0/8"]),
        ("private", ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"]), ("link_local", ["169.254.0.0/16"]),
        ("broadcast", ["255.255.255.255/32"]), ("multicast", ["224.0.0.0/4"])],
    16: [("unspecified", ["::/128"]), ("loopback", ["::1/128"]), ("private", ["fc00::/7"]),
         ("link_local", ["fe80::/10"]), ("multicast", ["ff00::/8"])],
}
LOCAL_SCOPES = ("loopback", "private", "link_local")


def scope(x: str) -> str:
    """unspecified, loopback, private, link_local, multicast, broadcast or public."""
    families = []
    for size, scopes in _SCOPES.items():
        whens = " ".join(f"WHEN {any_of([_range(x, n) for n in nets])} THEN '{name}'" for name, nets in scopes)
        families.append(f"WHEN length({x}) = {size} THEN CASE {whens} ELSE 'public' END")
    return f"CASE {' '.join(families)} END"


def in_scopes(x: str, *names: str) -> str:
    """Membership in some scopes, without naming the scope."""
    families = []
    for size, scopes in _SCOPES.items():
        nets = [_range(x, n) for name, cidrs in scopes if name in names for n in cidrs]
        families.append(f"WHEN length({x}) = {size} THEN {any_of(nets)}")
    return f"(CASE {' '.join(families)} END)"


def is_loopback(x: str) -> str:
    return in_scopes(x, "loopback")


def is_unspecified(x: str) -> str:
    return in_scopes(x, "unspecified")


def is_local_side(x: str) -> str:
    """Private, link-local or loopback: the rule for orientation, direction and labels."""
    return in_scopes(x, *LOCAL_SCOPES)


def has_public_name(x: str) -> str:
    """Addresses worth a reverse lookup: not private, link-local or of a special scope."""
    return f"({scope(x)} = 'public')"


def order_key(x: str) -> list[str]:
    """Sort expressions: IPv4 before IPv6, then numeric."""
    return [f"length({x})", x]


def after(left: str, left_port: str, right: str, right_port: str) -> str:
    """(left ip, left port) sorts after (right ip, right port); a missing port sorts first."""
    return (
        f"(CASE WHEN length({left}) <> length({right}) THEN length({left}) > length({right})"
        f" WHEN {left} <> {right} THEN {left} > {right}"
        f" ELSE coalesce({left_port}, -1) > coalesce({right_port}, -1) END)"
    )

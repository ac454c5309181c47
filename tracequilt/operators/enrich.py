"""Country, ASN, host name and process enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..functions import ip, text
from ..runtime import computed
from . import classify
from .lookup import latest_within, range_lookup


def geo_blocks(df: DataFrame) -> DataFrame:
    """Range table with text bounds (``start_ip``, ``end_ip``) to binary bounds."""
    rest = [c for c in df.columns if c not in ("start_ip", "end_ip")]
    return df.selectExpr(f"{ip.from_text('start_ip')} AS start_bin", f"{ip.from_text('end_ip')} AS end_bin", *rest)


def add_country(df: DataFrame, ip_column: str, geo_country: DataFrame, prefix: str = "") -> DataFrame:
    """Add ``country_code``, ``country_name``, ``country_kind`` and ``country_label`` of an address.

    Loopback and private or link-local addresses are never looked up.
    """
    blocks = geo_country.selectExpr("start_bin", "end_bin", "code", "coalesce(name, code) AS name")
    kind = (
        f"CASE WHEN {ip.is_loopback(ip_column)} THEN 'loopback' WHEN {ip.is_local_side(ip_column)} THEN 'local'"
        " WHEN _geo.code IS NOT NULL THEN 'country' ELSE 'unknown' END"
    )

    def by_kind(loopback: str, local: str, unknown: str, country: str) -> str:
        return f"CASE _kind WHEN 'loopback' THEN '{loopback}' WHEN 'local' THEN '{local}' WHEN 'country' THEN {country} ELSE '{unknown}' END"

    found = computed(range_lookup(df, ip_column, blocks, "_geo"), _kind=kind)
    return computed(
        found,
        **{
            f"{prefix}country_code": by_kind("LO", "LOCAL", "ZZ", "_geo.code"),
            f"{prefix}country_name": by_kind("Loopback", "Local", "Unknown", "_geo.name"),
            f"{prefix}country_kind": "_kind",
            f"{prefix}country_label": by_kind("Loopback", "Local", "Unknown", "concat(_geo.code, ' · ', _geo.name)"),
        },
    ).drop("_geo", "_kind")


def asn_label(number: str = "asn_number", organization: str = "asn_organization") -> str:
    return f"CASE WHEN {number} = 0 THEN '' ELSE concat_ws(' · ', concat('AS', {number}), nullif({organization}, '')) END"


def add_asn(df: DataFrame, ip_column: str, geo_asn: DataFrame, prefix: str = "") -> DataFrame:
    """Add ``asn_number`` (0 = unknown), ``asn_organization`` and ``asn_label`` of an address."""
    blocks = geo_asn.where("asn <> 0").selectExpr("start_bin", "end_bin", "CAST(asn AS BIGINT) AS asn", "organization")
    hit = f"NOT {ip.is_local_side(ip_column)} AND _asn.asn IS NOT NULL"
    number, organization = f"{prefix}asn_number", f"{prefix}asn_organization"
    found = computed(range_lookup(df, ip_column, blocks, "_asn"), **{
        number: f"CASE WHEN {hit} THEN _asn.asn ELSE 0L END",
        organization: f"CASE WHEN {hit} THEN coalesce(_asn.organization, '') ELSE '' END",
    }).drop("_asn")
    return computed(found, **{f"{prefix}asn_label": asn_label(number, organization)})


def add_geo(df: DataFrame, ip_column: str, geo_country: DataFrame | None = None,
            geo_asn: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """Country and ASN columns for one address column."""
    if geo_country is not None:
        df = add_country(df, ip_column, geo_country, prefix)
    return df if geo_asn is None else add_asn(df, ip_column, geo_asn, prefix)


def distinct_ips(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct addresses of the given columns."""
    return df.selectExpr(f"explode(array({', '.join(columns)})) AS ip_bin").where("ip_bin IS NOT NULL").distinct()


def remote_hosts(hosts: DataFrame, geo_country: DataFrame, local_addresses: DataFrame | None = None) -> DataFrame:
    """Hosts with a country, without the capture's own, private and loopback addresses."""
    named = add_country(hosts, "host_bin", geo_country).where("country_kind NOT IN ('local', 'loopback')")
    if local_addresses is None:
        return named
    own = local_addresses.selectExpr("capture_id", f"{ip.from_text('ip')} AS host_bin").distinct()
    return named.join(own, ["capture_id", "host_bin"], "left_anti")


def resolve_names(rows: DataFrame, ptr_records: DataFrame, ip_column: str = "ip_bin", at: str = "as_of_us") -> DataFrame:
    """Add ``hostname``: the reverse name of an address as of an instant.

    The latest record decides: a positive one lives 300 s, a negative one 45 s
    (which gives no name either way).
    """
    records = ptr_records.selectExpr("ip", "observed_us", "nullif(trim(TRAILING '.' FROM trim(hostname)), '') AS _name").selectExpr(
        f"{ip.from_text('ip')} AS _ip", "observed_us", "CASE WHEN _name <> ip THEN _name END AS hostname"
    )
    # addresses that have no public name carry no key and so match nothing
    asked = computed(rows, _ip=f"CASE WHEN {ip.has_public_name(ip_column)} THEN {ip_column} END")
    found = latest_within(asked, records, ["_ip"], C.PTR_TTL_SECONDS, "named_struct('hostname', hostname)", "_ptr", at)
    return found.selectExpr(*rows.columns, "_ptr.hostname AS hostname")


def candidate_ports() -> str:
    """Local ports to ask for the owning process, best first; at most two."""
    def usable(ports: str) -> str:
        return f"filter({ports}, p -> p IS NOT NULL AND p <> 0)"

    own = usable("array(CASE WHEN a_is_local THEN a_port END, CASE WHEN b_is_local THEN b_port END)")
    first = usable("CASE WHEN bytes_out >= bytes_in THEN array(a_port, b_port) ELSE array(b_port, a_port) END")
    both = f"concat(filter({first}, p -> p >= 1024), filter({first}, p -> p < 1024))"
    return f"array_distinct(CASE WHEN size({own}) > 0 THEN {own} ELSE {both} END)"


def attribute_processes(flows: DataFrame, socket_inventory: DataFrame, at: str = "as_of_us") -> DataFrame:
    """Owning process of each flow as of an instant (TCP and UDP only).

    Candidate ports are tried in order.  The latest inventory entry of a port
    answers: it lives 60 s with a process and 3 s without one.
    """
    asked = computed(flows, _ports=f"CASE WHEN proto IN ('tcp', 'udp') THEN {candidate_ports()} ELSE CAST(array() AS ARRAY<INT>) END")
    entry = "named_struct('name', name, 'pid', pid, 'path', path)"
    for turn in (1, 2):
        port = f"_port{turn}"
        asked = computed(asked, **{port: f"try_element_at(_ports, {turn})"})
        sockets = socket_inventory.selectExpr("capture_id", "proto", f"CAST(port AS INT) AS {port}", "observed_us", "name", "pid", "path")
        asked = latest_within(asked, sockets, ["capture_id", "proto", port], C.PROCESS_TTL_SECONDS, entry, f"_found{turn}", at)
    best = computed(
        asked, _process="CASE WHEN _found1.name IS NOT NULL THEN _found1 WHEN _found2.name IS NOT NULL THEN _found2 END"
    )
    return best.selectExpr(
        *flows.columns,
        "coalesce(_process.name, '') AS process_name", "coalesce(CAST(_process.pid AS BIGINT), 0L) AS process_pid",
        "coalesce(_process.path, '') AS process_path", f"{text.bundle_name('_process.path')} AS process_bundle",
        "_process IS NOT NULL AS process_inferred",
    )


def process_bytes(connections: DataFrame) -> DataFrame:
    """One entry per connection with a process (not summed by process)."""
    return connections.where("process_name <> ''")


def top_regions(flows: DataFrame, geo_country: DataFrame, geo_asn: DataFrame, top_n: int | None = None) -> DataFrame:
    """Bytes by destination country with the dominant ASN and the share of all regions.

    The dominant ASN is the one of the largest single flow that has one; among
    equal flows the later in rank order wins.  Flows are first summed per
    (capture, destination), so the lookup sees addresses and not flows.
    """
    later = (
        f"max(struct(bytes, -packets, length(a_bin), a_bin, length(b_bin), b_bin, coalesce(a_port, -1), coalesce(b_port, -1),"
        f" {classify.proto_rank()})) AS _latest"
    )
    per_ip = (
        flows.where(f"NOT {ip.is_local_side('b_bin')}").groupBy("capture_id", "b_bin")
        .agg(F.sum("bytes").alias("bytes"), F.expr(later))
    )
    placed = add_geo(per_ip, "b_bin", geo_country, geo_asn).where("country_kind = 'country'")
    regions = placed.groupBy("capture_id", "country_code", "country_label").agg(
        F.sum("bytes").alias("bytes"),
        F.expr("max_by(struct(asn_number, asn_organization, asn_label), CASE WHEN asn_number <> 0 THEN _latest END) AS _asn"),
    )
    whole = "sum(bytes) OVER (PARTITION BY capture_id)"
    shaped = regions.selectExpr(
        "capture_id", "country_code", "country_label", "bytes",
        f"CASE WHEN {whole} = 0 THEN 0.0D ELSE CAST(bytes AS DOUBLE) / {whole} END AS ratio",
        "coalesce(_asn.asn_number, 0L) AS asn_number", "coalesce(_asn.asn_organization, '') AS asn_organization",
        "coalesce(_asn.asn_label, '') AS asn_label",
        "row_number() OVER (PARTITION BY capture_id ORDER BY bytes DESC, country_code) AS rank",
    )
    return shaped if top_n is None else shaped.where(f"rank <= {top_n}")

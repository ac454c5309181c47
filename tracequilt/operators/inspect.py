"""Packet filters, row shaping, inspect filters, pivots and evidence."""

from __future__ import annotations

import ipaddress
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as C
from ..functions import all_of, any_of, ip, lit, text
from ..runtime import computed, materialize
from . import classify
from .enrich import add_country


# ---- packet filter ------------------------------------------------------------

def packet_filter(proto: str | None = None, host: str | None = None, net: str | None = None,
                  port: int | None = None, side: str = "any", negate: bool = False) -> Column:
    """Whole-packet predicate over the packet table; combine with ``&``, ``|``, ``~``.

    ``side`` is ``any``, ``src`` or ``dst``.  Apply it before any counting.
    Undecodable frames match no test, so they pass only a negated one.
    """
    if side not in ("any", "src", "dst"):
        raise ValueError("side must be any, src or dst")
    sides = ("src", "dst") if side == "any" else (side,)
    parts = []
    if proto is not None:
        parts.append(f"proto = {lit(proto)}")
    if host is not None:
        parts.append(any_of([f"{s}_bin = {ip.address(host)}" for s in sides]))
    if net is not None:
        parts.append(any_of([ip.in_network(f"{s}_bin", net) for s in sides]))
    if port is not None:
        parts.append(any_of([f"{s}_port = {int(port)}" for s in sides]))
    test = F.expr(f"coalesce({all_of(parts)}, false)")
    return ~test if negate else test


def exclude_endpoint(address: str, port: int) -> Column:
    """Keep everything but the analyser's own TCP control traffic.

    An unspecified bind address stands for both loopback hosts; port 0 excludes nothing.
    """
    if port == 0:
        return F.lit(True)
    hosts = ["127.0.0.1", "::1"] if ipaddress.ip_address(address).is_unspecified else [address]
    own = reduce(or_, [packet_filter(host=h) for h in hosts])
    return ~(packet_filter(proto="tcp", port=port) & own)


# ---- row shaping --------------------------------------------------------------

def connection_rows(flows: DataFrame, service: str = "ports") -> DataFrame:
    """Display rows of flows, missing values as '' and 0.

    ``service='ports'`` names services from the full port table by session
    direction; ``service='short'`` knows https and dns only.
    """
    have = set(flows.columns)
    shaped = computed(
        flows, direction=classify.session_direction(), source_address=ip.to_text("a_bin"), destination_address=ip.to_text("b_bin")
    )
    if service == "short":
        shaped = computed(shaped, service=classify.projection_service())
    else:
        shaped = classify.with_service(shaped, "proto", "a_port", "b_port", "CAST(NULL AS INT)")

    def given(column: str, default: str) -> str:
        return f"coalesce({column}, {default}) AS {column}" if column in have else f"{default} AS {column}"

    extra = [c for c in ("rank", "a_bin", "b_bin", "remote_asn_label") if c in have]
    return shaped.selectExpr(
        "capture_id", *extra,
        "source_address", "coalesce(a_port, 0) AS source_port",
        "destination_address", "coalesce(b_port, 0) AS destination_port",
        "proto AS protocol", "service AS service_name", "direction", "packets", "bytes", "bytes_in", "bytes_out",
        given("process_name", "''"), given("process_pid", "0L"), given("process_path", "''"),
        given("process_bundle", "''"), given("process_inferred", "false"), "coalesce(sni, '') AS sni",
    )


def host_rows(hosts: DataFrame) -> DataFrame:
    have = set(hosts.columns)

    def given(column: str, default: str) -> str:
        return f"coalesce({column}, {default}) AS {column}" if column in have else f"{default} AS {column}"

    return hosts.selectExpr(
        "capture_id", *(["rank"] if "rank" in have else []),
        f"{ip.to_text('host_bin')} AS host", "packets", "bytes",
        *[given(c, "''") for c in ("country_label", "hostname", "asn_organization", "asn_label", "sni")],
        given("asn_number", "0L"),
    )


def service_rows(services: DataFrame) -> DataFrame:
    extra = ["rank"] if "rank" in services.columns else []
    return services.selectExpr("capture_id", *extra, "service AS name", "proto AS transport", "packets", "bytes")


def tcp_rows(sessions: DataFrame) -> DataFrame:
    extra = ["rank"] if "rank" in sessions.columns else []
    return sessions.selectExpr(
        "capture_id", *extra, "endpoint_a_ip AS endpoint_a_address", "endpoint_a_port",
        "endpoint_b_ip AS endpoint_b_address", "endpoint_b_port",
        "state", "syn_count", "fin_count", "rst_count", "packets", "bytes", "first_us", "last_us",
    )


# ---- filters ------------------------------------------------------------------

FILTER_FIELDS, SEARCH_FIELDS, PIVOTS = C.FILTER_FIELDS, C.SEARCH_FIELDS, C.PIVOTS
_A, _B = (text.endpoint(f"endpoint_{s}_address", f"endpoint_{s}_port") for s in "ab")


def connection_filter(**fields: str | None) -> Column:
    """AND of case-insensitive 'contains' tests; blank fields pass."""
    unknown = set(fields) - set(FILTER_FIELDS)
    if unknown:
        raise ValueError(f"unknown filter fields: {sorted(unknown)}")
    return F.expr(all_of([text.blank_or_contains(v, FILTER_FIELDS[k]) for k, v in fields.items()]))


def search_filter(query: str | None) -> Column:
    """Free text over six columns, any of which may contain it."""
    if not (query or "").strip():
        return F.lit(True)
    return F.expr(any_of([text.folded_contains(c, query) for c in SEARCH_FIELDS]))


def tcp_filter(address: str | None = None, port: str | None = None, state: str | None = None) -> Column:
    """Address or ``ip:port`` contains, port digits contain, state contains."""
    tests = [text.blank_or_contains(state, "state")]
    if (address or "").strip():
        # the bare address is a prefix of its "ip:port" form, so two tests cover all four
        tests.append(any_of([text.blank_or_contains(address, _A), text.blank_or_contains(address, _B)]))
    if (port or "").strip():
        digits = lit(port.strip())
        tests.append(any_of([f"contains(CAST(endpoint_{s}_port AS STRING), {digits})" for s in "ab"]))
    return F.expr(all_of(tests))


def tcp_search(query: str | None = None, address: str | None = None, port: str | None = None,
               state: str | None = None) -> Column:
    """Free text over the label ``a:p ↔ b:p`` or the state, and the same on its parts."""
    label = f"concat({_A}, ' ↔ ', {_B})"
    tests = []
    if (query or "").strip():
        tests.append(any_of([text.folded_contains(label, query), text.folded_contains("state", query)]))
    for value, column in ((address, label), (port, label), (state, "state")):
        if (value or "").strip():
            tests.append(text.folded_contains(column, value))
    return F.expr(all_of(tests))


def filter_country(rows: DataFrame, geo_country: DataFrame, token: str | None) -> DataFrame:
    """Rows whose source or destination country label contains the token."""
    if not (token or "").strip():
        return rows
    placed = add_country(add_country(rows, "a_bin", geo_country, "_a_"), "b_bin", geo_country, "_b_")
    test = any_of([text.folded_contains(f"_{s}_country_label", token) for s in "ab"])
    return placed.where(test).select(*rows.columns)


def pivot_target(kind: str) -> str:
    """The filter field a pivot sets: one of the seven fields, ``search`` or ``country``."""
    return PIVOTS.get(kind.strip().lower(), "search")


def pivot_filter(kind: str, value: str) -> Column:
    """One cleared-then-set filter.  Country pivots need a lookup: use :func:`apply_pivot`."""
    target = pivot_target(kind)
    if not value.strip():
        return F.lit(True)
    if target == "search":
        return search_filter(value)
    if target == "country":
        raise ValueError("a country pivot is a lookup; use apply_pivot")
    return F.expr(text.folded_contains(FILTER_FIELDS[target], value))


def apply_pivot(rows: DataFrame, kind: str, value: str, geo_country: DataFrame | None = None) -> DataFrame:
    if pivot_target(kind) == "country":
        if geo_country is None:
            return rows.where(F.lit(False)) if value.strip() else rows
        return filter_country(rows, geo_country, value)
    return rows.where(pivot_filter(kind, value))


def inspect(ranked_rows: DataFrame, top_n: int | None = C.TOP_N_DEFAULT, search: str | None = None,
            geo_country: DataFrame | None = None, country: str | None = None, **fields: str | None) -> DataFrame:
    """Filter ranked display rows, then keep the first ``top_n`` per capture in rank order."""
    kept = ranked_rows.where(connection_filter(**fields) & search_filter(search))
    if (country or "").strip():
        kept = filter_country(kept, geo_country, country) if geo_country is not None else kept.where(F.lit(False))
    if top_n is None:
        return kept
    window = Window.partitionBy("capture_id").orderBy("rank")
    return kept.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= top_n).drop("_n")


def summarize(pool: DataFrame, visible: Column) -> DataFrame:
    """Pool size, visible rows and the packets and bytes of the visible ones."""
    return pool.withColumn("_v", visible).groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if("_v").alias("visible_rows"),
        F.expr("sum(CASE WHEN _v THEN packets ELSE 0 END) AS total_packets"),
        F.expr("sum(CASE WHEN _v THEN bytes ELSE 0 END) AS total_bytes"),
    )


# ---- evidence -----------------------------------------------------------------

def evidence(findings: DataFrame, rows: DataFrame) -> DataFrame:
    """Connections behind each pivot of the findings: those its filter would show.

    Findings with the same pivot share its rows, which come once.

    'Contains' is turned into equality: the distinct texts of the connection
    table are cut into substrings of exactly the lengths that pivot values
    have, and joined by equality.  Work follows distinct texts and true
    matches; nothing is compared pairwise.  The table is read twice, so it is
    stored first and what it comes from is worked out once.
    """
    rows = materialize(rows, "evidence-rows")
    whens = " ".join(f"WHEN '{kind}' THEN '{target}'" for kind, target in PIVOTS.items())
    asked = findings.where("trim(coalesce(pivot_value, '')) <> ''").selectExpr(
        "capture_id", "pivot_kind", "pivot_value", f"CASE lower(trim(pivot_kind)) {whens} ELSE 'search' END AS _target",
        "lower(trim(pivot_value)) AS _piece",
    ).where("_target <> 'country'").distinct()

    def fields(searched: bool) -> str:
        flag = ", '_searched', {}" if searched else ""
        return ", ".join(
            f"named_struct('_field', '{name}', '_text', lower({column})" + flag.format(str(column in SEARCH_FIELDS).lower()) + ")"
            for name, column in FILTER_FIELDS.items()
        )

    texts = (
        rows.selectExpr("capture_id", f"explode(array({fields(True)})) AS _t").select("capture_id", "_t.*")
        .where("_text <> ''").distinct()
    )
    lengths = asked.groupBy("capture_id").agg(F.expr("collect_set(length(_piece)) AS _lengths"))
    pieces = (
        texts.join(lengths, "capture_id")
        .selectExpr("*", "explode(_lengths) AS _len").where("_len <= length(_text)")
        .selectExpr(
            "capture_id", "_field", "_text", "_searched",
            "explode(array_distinct(transform(sequence(1, length(_text) - _len + 1), i -> substring(_text, i, _len)))) AS _piece",
        )
    )
    hits = (
        pieces.join(asked, ["capture_id", "_piece"])
        .where("_target = _field OR (_target = 'search' AND _searched)")
        .select("capture_id", "pivot_kind", "pivot_value", "_field", "_text").distinct()
    )
    by_text = rows.selectExpr("*", f"explode(array({fields(False)})) AS _t").select(*rows.columns, "_t.*")
    return by_text.join(hits, ["capture_id", "_field", "_text"]).select("pivot_kind", "pivot_value", *rows.columns).distinct()


def nearest_point(findings: DataFrame, timeline: DataFrame) -> DataFrame:
    """The timeline point closest to each finding's time; the earlier one on a tie.

    Both sides become one ordered stream per capture; the neighbours are the
    last point before and the first point after.
    """
    marks = findings.select(
        "capture_id", F.col("second").alias("_at"), "dedupe_key",
        F.lit(None).cast("bigint").alias("_point"),
    )
    axis = timeline.select(
        "capture_id", F.col("second").alias("_at"), F.lit(None).cast("string").alias("dedupe_key"),
        F.col("second").alias("_point"),
    )
    stream = marks.unionByName(axis)
    frame = (Window.unboundedPreceding, Window.currentRow)
    forward = Window.partitionBy("capture_id").orderBy("_at").rangeBetween(*frame)
    backward = Window.partitionBy("capture_id").orderBy(F.col("_at").desc()).rangeBetween(*frame)
    before = F.last("_point", ignorenulls=True).over(forward)
    after = F.last("_point", ignorenulls=True).over(backward)
    both = stream.withColumns({"_before": before, "_after": after}).where(F.col("dedupe_key").isNotNull())
    near = (
        "CASE WHEN _before IS NULL THEN _after WHEN _after IS NULL OR _at - _before <= _after - _at THEN _before"
        " ELSE _after END"
    )
    return both.selectExpr("capture_id", "dedupe_key", "_at AS second", f"{near} AS point_second")

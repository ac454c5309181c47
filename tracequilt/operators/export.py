"""CEF lines for findings and flows, and JSON reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .. import __version__, constants as C
from ..functions import cef, clock, ip


@dataclass(frozen=True)
class Exporter:
    """Who sends the lines; every part is an argument so output is testable."""

    vendor: str = "tracequilt"
    product: str = "tracequilt"
    version: str = __version__
    host: str = "spark"
    app: str = "tracequilt"
    facility: int = C.SYSLOG_FACILITY

    @property
    def device(self) -> tuple[str, str, str]:
        return (self.vendor, self.product, self.version)


def export_summary(findings: DataFrame) -> DataFrame:
    """Findings with the exported summary: the detail follows when there is one."""
    joined = "CASE WHEN trim(coalesce(detail, '')) = '' THEN summary ELSE concat(summary, ' — ', detail) END AS summary"
    return findings.selectExpr(*[joined if c == "summary" else c for c in findings.columns])


def signal_cef(at_us: str, exporter: Exporter = Exporter()) -> str:
    """CEF body of a finding row (after :func:`export_summary`)."""
    signature = "CASE WHEN kind = '' THEN 'signal' ELSE kind END"
    name = f"CASE WHEN summary = '' THEN {signature} ELSE substring_index(summary, ' — ', 1) END"
    pivots = "pivot_kind NOT IN ('', 'none')"
    valued = f"{pivots} AND pivot_value <> ''"
    pairs = [
        cef.pair("rt", clock.epoch_millis(at_us)), cef.label("cat", "signal"), cef.pair("externalId", "id"),
        cef.pair("msg", "summary"),
        cef.pair("cs1", "subject"), cef.label("cs1Label", "Subject"),
        cef.pair("cs2", "mode"), cef.label("cs2Label", "Mode"),
        cef.pair("cs3", "status"), cef.label("cs3Label", "Status"),
        cef.pair("cs4", "kind"), cef.label("cs4Label", "SignalKind"),
        cef.pair("cs5", "pivot_kind", pivots), cef.label("cs5Label", "PivotKind", pivots),
        cef.pair("cs6", "pivot_value", valued), cef.label("cs6Label", "PivotValue", valued),
        cef.pair("dst", "pivot_value", f"{valued} AND pivot_kind = 'host'"),
        cef.pair("request", "pivot_value", f"{valued} AND pivot_kind = 'sni'"),
        cef.pair("sproc", "pivot_value", f"{valued} AND pivot_kind = 'process'"),
        cef.pair("sourceProcessName", "pivot_value", f"{valued} AND pivot_kind = 'process'"),
        cef.pair("app", "pivot_value", f"{valued} AND pivot_kind = 'service'"),
        cef.pair("cfp1", "format_string('%.2f', confidence)"), cef.label("cfp1Label", "Confidence"),
        cef.pair("outcome", "status"),
    ]
    return cef.header(exporter.device, signature, name, cef.severity_0_10("severity"), pairs)


def signal_lines(findings: DataFrame, at_us: str, exporter: Exporter = Exporter()) -> DataFrame:
    """One RFC 5424 line per finding; ``at_us`` is the export instant (SQL expression)."""
    line = cef.syslog_line(
        signal_cef(at_us, exporter), cef.severity_0_7("severity"), at_us, exporter.host, exporter.app, exporter.facility
    )
    return export_summary(findings).selectExpr("capture_id", "dedupe_key", f"{line} AS value")


def flow_cef(at_us: str, exporter: Exporter = Exporter()) -> str:
    """CEF body of an exported flow row in the shape of :func:`flow_events`."""
    act = "CASE WHEN event IN ('closed', 'end', 'finish') THEN 'end' WHEN event IN ('start', 'new') THEN 'start' ELSE 'update' END"
    proto = "CASE lower(trim(protocol)) WHEN '6' THEN 'tcp' WHEN '17' THEN 'udp' WHEN '1' THEN 'icmp' ELSE lower(trim(protocol)) END"
    message = (
        "concat('flow ', event, ' ', src, ':', sport, ' -> ', dst, ':', dport, ' out=', bytes_out, ' in=', bytes_in, ' pkts=', packets)"
    )
    pairs = [
        cef.pair("rt", clock.epoch_millis(at_us)), cef.label("cat", "traffic"),
        cef.pair("src", "src"), cef.pair("dst", "dst"),
        cef.pair("spt", "sport", "sport > 0"), cef.pair("dpt", "dport", "dport > 0"),
        cef.pair("proto", proto), cef.pair("in", "bytes_in"), cef.pair("out", "bytes_out"),
        cef.pair("cn1", "packets"), cef.label("cn1Label", "Packets"), cef.pair("act", act),
        cef.pair("app", "service"), cef.pair("request", "sni"), cef.pair("destinationDnsDomain", "sni"),
        cef.pair("sproc", "process"), cef.pair("sourceProcessName", "process"), cef.pair("cs1", "process"),
        cef.label("cs1Label", "Process", "process <> ''"),
        cef.pair("cs2", "direction"), cef.label("cs2Label", "Direction", "direction <> ''"),
        cef.label("deviceDirection", "0", "lower(direction) IN ('in', 'inbound', 'download')"),
        cef.label("deviceDirection", "1", "lower(direction) IN ('out', 'outbound', 'upload')"),
        cef.pair("msg", message),
    ]
    return cef.header(exporter.device, f"concat('flow:', {act})", f"concat('Network flow ', {act})", "0", pairs)


def flow_events(flows: DataFrame) -> DataFrame:
    """Flow rows (gate output, closed keys or plain flows) in the shape of :func:`flow_cef`."""
    have = set(flows.columns)

    def given(name: str, default: str, source: str | None = None) -> str:
        column = source or name
        return f"coalesce({column}, {default}) AS {name}" if column in have else f"{default} AS {name}"

    keep = [c for c in ("tick", "rank") if c in have]
    return flows.selectExpr(
        "capture_id", *keep,
        "CASE WHEN coalesce(event, '') = '' THEN 'active' ELSE event END AS event" if "event" in have else "'active' AS event",
        f"{ip.to_text('a_bin')} AS src", given("sport", "0", "a_port"),
        f"{ip.to_text('b_bin')} AS dst", given("dport", "0", "b_port"),
        "proto AS protocol", given("service", "''"), given("sni", "''"), given("process", "''", "process_name"),
        given("direction", "'session'"), given("packets", "0L"), given("bytes_in", "0L"), given("bytes_out", "0L"),
    )


def flow_lines(flows: DataFrame, at_us: str, exporter: Exporter = Exporter()) -> DataFrame:
    """One RFC 5424 line per exported flow; ``at_us`` may use the columns of :func:`flow_events`."""
    line = cef.syslog_line(
        flow_cef(at_us, exporter), str(C.FLOW_SYSLOG_SEVERITY), at_us, exporter.host, exporter.app, exporter.facility
    )
    rows = flow_events(flows)
    return rows.selectExpr("capture_id", *[c for c in ("tick", "rank") if c in rows.columns], f"{line} AS value")


def write_lines(lines: DataFrame, path: str) -> None:
    """Text sink: one CEF line per row."""
    lines.select("value").write.mode("overwrite").text(path)


def report_tables(totals: DataFrame, ticks: DataFrame, gaps: DataFrame, ranked: dict[str, DataFrame],
                  findings: DataFrame) -> dict[str, DataFrame]:
    """The JSON report as tables, one row per line and no per-capture collection."""
    return {"totals": totals, "ticks": ticks, "gaps": gaps, **ranked, "findings": findings}


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON-lines folder per table, so a report of any size is written in parallel."""
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def report_documents(totals: DataFrame, ranked: dict[str, DataFrame], top_n: int) -> DataFrame:
    """One JSON document per capture with its totals and top lists.

    Only ranked tables are nested, and only their first ``top_n`` rows, so a
    document's size does not follow the capture's.
    """
    docs = totals
    for name, table in ranked.items():
        row = F.struct("rank", *[c for c in table.columns if c not in ("rank", "capture_id")])
        nested = (
            table.where(F.col("rank") <= top_n)
            .groupBy("capture_id")
            .agg(F.sort_array(F.collect_list(row)).alias(name))
        )
        docs = docs.join(nested, "capture_id", "left")
    body = F.struct(*[c for c in docs.columns])
    return docs.select("capture_id", F.to_json(body).alias("document"))

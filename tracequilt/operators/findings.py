"""Behaviour detectors and the finding log."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from .. import constants as C
from ..functions import all_of, any_of, ip, lit, text
from ..runtime import computed
from . import ranking
from .classify import proto_rank


@dataclass(frozen=True)
class Policy:
    """Thresholds and lists of the detectors."""

    data_threshold_bytes: int = 50_000_000
    watched_hosts: tuple[str, ...] = ()
    watched_services: tuple[str, ...] = ()
    watched_processes: tuple[str, ...] = ()
    bad_hosts: tuple[str, ...] = ()
    bad_services: tuple[str, ...] = ()
    bad_processes: tuple[str, ...] = ()
    exfil_enabled: bool = True
    exfil_min_bytes: int = 50_000_000
    exfil_ratio: float = 20.0
    idle_enabled: bool = True
    idle_min_age_seconds: int = 3600
    idle_silence_seconds: int = 600
    idle_max_bytes: int = 65_536
    p2p_enabled: bool = True
    p2p_allow: tuple[str, ...] = ()

    @staticmethod
    def of(watched: list[str] = (), known_bad: list[str] = (), **settings) -> "Policy":
        """Policy from watch-list tokens; zero or negative numbers mean the default."""
        good, bad = parse_patterns(watched), parse_patterns(known_bad)
        kept = {k: v for k, v in settings.items() if isinstance(v, (bool, tuple)) or not isinstance(v, (int, float)) or v > 0}
        return Policy(
            watched_hosts=good["host"], watched_services=good["service"], watched_processes=good["process"],
            bad_hosts=bad["host"], bad_services=bad["service"], bad_processes=bad["process"], **kept,
        )


def parse_patterns(tokens: list[str]) -> dict[str, tuple[str, ...]]:
    """Watch-list tokens by kind.  Prefixes are case-sensitive; bare and ``sni:`` count as hosts."""
    kinds = {"service:": "service", "process:": "process", "sni:": "host", "host:": "host"}
    out: dict[str, list[str]] = {"host": [], "service": [], "process": []}
    for raw in tokens:
        token = raw.strip()
        if not token:
            continue
        prefix = next((p for p in kinds if token.startswith(p)), "")
        out[kinds.get(prefix, "host")].append(token[len(prefix):].strip())
    return {k: tuple(v) for k, v in out.items()}


@dataclass(frozen=True)
class Session:
    """How and when detectors look at a capture.

    ``as_of_us`` is the evaluation instant column name in the session totals;
    the wall clock is always an argument.
    """

    offline: bool = True
    source_label: str = "Offline capture"
    mode: str = field(default="offline")

    @staticmethod
    def live(source_label: str = "Live capture") -> "Session":
        return Session(offline=False, source_label=source_label, mode="live")

    @property
    def status(self) -> str:
        return "finding" if self.offline else "active"


def _key(x: str) -> str:
    """Address as one sortable binary: family length, then the bytes."""
    return f"concat(CASE WHEN length({x}) = 4 THEN X'04' ELSE X'10' END, {x})"


def _order(detector: int, kind: str) -> str:
    """Evaluation order of an occurrence: detector, then rank order of its row.

    One struct shape for all detectors, so that their outputs union.
    """
    name, first, port, second, more = "''", "X''", "0", "X''", ["0", "0"]
    sent, count = "-bytes", "-packets"
    if kind in ("flows", "processes"):
        first, second, more = _key("a_bin"), _key("b_bin"), ["coalesce(a_port, -1)", f"coalesce(b_port, -1) * 10 + {proto_rank()}"]
    elif kind == "hosts":
        first = _key("host_bin")
    elif kind == "services":
        name, more = "service", [proto_rank(), "0"]
    elif kind == "tcp":
        # rank compares the first endpoint's port before the second address
        first, port, second, more = _key("endpoint_a_bin"), "endpoint_a_port", _key("endpoint_b_bin"), ["endpoint_b_port", "0"]
    numbers = [f"CAST({n} AS BIGINT)" for n in (detector, sent, count, port, *more)]
    return (
        f"named_struct('detector', {numbers[0]}, 'sent', {numbers[1]}, 'count', {numbers[2]}, 'name', {name}, 'first', {first},"
        f" 'port', {numbers[3]}, 'second', {second}, 'm', {numbers[4]}, 'n', {numbers[5]})"
    )


def _phrase(*parts: str) -> str:
    """concat of literal text and ``{expression}`` parts."""
    return "concat(" + ", ".join(p[1:-1] if p.startswith("{") else lit(p) for p in parts) + ")"


def _occurrence(df: DataFrame, session: Session, order: str, *, kind: str, severity: str, subject: str,
                summary: str, detail: str, key: str, tag: str, confidence: str, pivot_kind: str, pivot_value: str,
                seen: bool = False, cooldown: str = "entity") -> DataFrame:
    """Shape detector hits.  ``seen`` takes first and last time from the row, else the evaluation instant."""
    return df.selectExpr(
        "capture_id", f"concat({tag}, '-', as_of_us div 1000000) AS id",
        f"{lit(kind)} AS kind", f"{lit(session.mode)} AS mode", f"{lit(session.status)} AS status",
        f"{lit(severity)} AS severity", f"{subject} AS subject", f"{lit(summary)} AS summary", f"{detail} AS detail",
        "first_us AS first_us" if seen else "as_of_us AS first_us", "last_us AS last_us" if seen else "as_of_us AS last_us",
        f"{confidence} AS confidence", f"{key} AS dedupe_key", f"{pivot_kind} AS pivot_kind", f"{pivot_value} AS pivot_value",
        f"'{cooldown}' AS cooldown", "as_of_us", f"{order} AS ord",
    )


def threshold(totals: DataFrame, policy: Policy, session: Session = Session()) -> DataFrame:
    """Session bytes at or over the threshold (0 turns it off)."""
    limit = policy.data_threshold_bytes
    return _occurrence(
        totals.where(f"{limit} > 0 AND bytes >= {limit}"), session, _order(0, "session"),
        kind="DataThresholdExceeded", severity="warning", subject=lit(session.source_label),
        summary="Data threshold exceeded" + (" (offline finding)" if session.offline else ""),
        detail=_phrase("Observed ", "{bytes}", f" bytes (threshold {limit})."),
        key=lit(f"DataThresholdExceeded|{limit}"), tag="'threshold'", confidence="0.9D",
        pivot_kind="'none'", pivot_value="''", cooldown="threshold",
    )


def _state(session: Session, what: str) -> str:
    return f"{what} (offline finding)" if session.offline else f"{what} active"


def watched_hosts(hosts: DataFrame, policy: Policy, session: Session = Session()) -> list[DataFrame]:
    """Hosts whose address or SNI contains a watched or known-bad pattern."""
    rows = computed(hosts, _host=ip.to_text("host_bin"), _sni="coalesce(sni, '')")

    def hit(patterns: tuple[str, ...]) -> str:
        return any_of([text.any_pattern("_host", patterns), text.any_pattern("_sni", patterns)])

    watched = _occurrence(
        rows.where(hit(policy.watched_hosts)), session, _order(1, "hosts"),
        kind="WatchedEntityTransmitted", severity="info", subject="_host", summary=_state(session, "Watched host"),
        detail=_phrase(
            "{_host}", " transmitted ", "{bytes}", " bytes",
            "{CASE WHEN _sni = '' THEN '' ELSE concat(' (sni=', _sni, ')') END}", ".",
        ),
        key=_phrase("WatchedEntityTransmitted|host|", "{_host}"), tag=_phrase("watch-host-", "{_host}"),
        confidence="0.85D", pivot_kind="CASE WHEN _sni = '' THEN 'host' ELSE 'sni' END",
        pivot_value="CASE WHEN _sni = '' THEN _host ELSE _sni END",
    )
    bad = _occurrence(
        rows.where(hit(policy.bad_hosts)), session, _order(1, "hosts"),
        kind="KnownBadHostTransmitted", severity="error", subject="_host", summary=_state(session, "Known-bad host"),
        detail=_phrase("{_host}", " matched a known-bad entry (", "{bytes}", " bytes)."),
        key=_phrase("KnownBadHostTransmitted|host|", "{_host}"), tag=_phrase("bad-host-", "{_host}"),
        confidence="0.9D", pivot_kind="'host'", pivot_value="_host",
    )
    return [watched, bad]


def watched_services(services: DataFrame, policy: Policy, session: Session = Session()) -> list[DataFrame]:
    watched = _occurrence(
        services.where(text.any_pattern("service", policy.watched_services)), session, _order(2, "services"),
        kind="WatchedEntityTransmitted", severity="info", subject="service", summary=_state(session, "Watched service"),
        detail=_phrase("Service `", "{service}", "` transmitted ", "{bytes}", " bytes."),
        key=_phrase("WatchedEntityTransmitted|service|", "{service}"), tag=_phrase("watch-svc-", "{service}"),
        confidence="0.8D", pivot_kind="'service'", pivot_value="service",
    )
    bad = _occurrence(
        services.where(text.any_pattern("service", policy.bad_services)), session, _order(2, "services"),
        kind="KnownBadHostTransmitted", severity="error", subject="service", summary=_state(session, "Known-bad service"),
        detail=_phrase("Service `", "{service}", "` matched a known-bad entry (", "{bytes}", " bytes)."),
        key=_phrase("KnownBadHostTransmitted|service|", "{service}"), tag=_phrase("bad-svc-", "{service}"),
        confidence="0.85D", pivot_kind="'service'", pivot_value="service",
    )
    return [watched, bad]


def watched_processes(processes: DataFrame, policy: Policy, session: Session = Session()) -> list[DataFrame]:
    """Watched, known-bad and peer-to-peer / proxy processes.

    ``processes``: one row per connection, with the flow's key, packets and bytes, ``process_name`` and ``as_of_us``.
    """
    rows, name = processes.where("process_name <> ''"), "{process_name}"
    common = dict(subject="process_name", pivot_kind="'process'", pivot_value="process_name")
    watched = _occurrence(
        rows.where(text.any_pattern("process_name", policy.watched_processes)), session, _order(6, "processes"),
        kind="WatchedEntityTransmitted", severity="info", summary=_state(session, "Watched process"),
        detail=_phrase("Process `", name, "` transmitted ", "{bytes}", " bytes."),
        key=_phrase("WatchedEntityTransmitted|process|", name), tag=_phrase("watch-proc-", name),
        confidence="0.8D", **common,
    )
    bad = _occurrence(
        rows.where(text.any_pattern("process_name", policy.bad_processes)), session, _order(6, "processes"),
        kind="KnownBadHostTransmitted", severity="error", summary=_state(session, "Known-bad process"),
        detail=_phrase("Process `", name, "` matched a known-bad entry (", "{bytes}", " bytes)."),
        key=_phrase("KnownBadHostTransmitted|process|", name), tag=_phrase("bad-proc-", name),
        confidence="0.85D", **common,
    )
    tooling = all_of([
        str(policy.p2p_enabled).lower(), text.any_pattern("process_name", C.PROCESS_NEEDLES),
        f"NOT {allowed(_phrase('process:', name), policy)}",
    ])
    p2p = _occurrence(
        rows.where(tooling), session, _order(6, "processes"),
        kind="UnauthorizedP2pOrProxy", severity="warning", summary="Unauthorized P2P or proxy process",
        detail=_phrase("Process `", name, "` matched built-in P2P/proxy heuristics (", "{bytes}", " bytes)."),
        key=_phrase("UnauthorizedP2pOrProxy|process|", name), tag=_phrase("p2p-proc-", name),
        confidence="0.85D", cooldown="dpi", **common,
    )
    return [watched, bad, p2p]


def allowed(token: str, policy: Policy) -> str:
    """Allow-list: the entry, bare or as ``process:entry``, is part of the token.

    An entry contained in the token covers its longer ``process:`` form, except
    that a blank entry still matches as ``process:``.
    """
    entries = [p for p in policy.p2p_allow if p.strip()]
    if any(not p.strip() for p in policy.p2p_allow):
        entries.append("process:")
    return text.any_pattern(token, entries)


def one_decimal(numerator: str, denominator: str) -> str:
    """The double quotient with one decimal, as exact formatting prints it: nearest, ties to even.

    A double's fraction times 2^59 is a whole number (of doubles from 2^-7 on), so
    tenths and what is left of them are exact integers.
    """
    ratio = f"(CAST({numerator} AS DOUBLE) / {denominator})"
    unit = 1 << 59
    scaled = f"(CAST(({ratio} - floor({ratio})) * {float(unit)!r}D AS BIGINT) * 10L)"
    tenths = f"(CAST(floor({ratio}) AS BIGINT) * 10 + {scaled} div {unit}L)"
    left = f"({scaled} % {unit}L)"
    up = f"CASE WHEN {left} > {unit // 2}L OR ({left} = {unit // 2}L AND {tenths} % 2 = 1) THEN 1L ELSE 0L END"
    rounded = f"({tenths} + {up})"
    return f"concat({rounded} div 10, '.', {rounded} % 10)"


def _number(value: float) -> str:
    return str(int(value)) if float(value).is_integer() else repr(float(value))


def exfil(flows: DataFrame, policy: Policy, session: Session = Session()) -> DataFrame:
    """One-sided large transfers: bytes out over a minimum and a multiple of bytes in."""
    floor = "greatest(bytes_in, 1L)"
    test = all_of([
        str(policy.exfil_enabled).lower(), f"bytes_out >= {policy.exfil_min_bytes}",
        f"CAST(bytes_out AS DOUBLE) / {floor} >= {float(policy.exfil_ratio)!r}D",
    ])
    hit = computed(flows.where(test), _peer=ip.to_text("b_bin"))
    return _occurrence(
        hit, session, _order(3, "flows"), kind="UnidirectionalLargeTransfer", severity="warning", subject="_peer",
        summary="Unidirectional large transfer (possible exfil)",
        detail=_phrase(
            "Outbound ", "{bytes_out}", " bytes vs inbound ", "{bytes_in}", " (ratio ", "{" + one_decimal("bytes_out", floor) + "}",
            f"x, min {policy.exfil_min_bytes}, ratio≥{_number(policy.exfil_ratio)}). peer=", "{_peer}",
            " sni/service≈", "{coalesce(sni, 'unknown')}",
        ),
        key=_phrase("UnidirectionalLargeTransfer|", "{_peer}", "|", "{coalesce(b_port, 0)}"), tag=_phrase("exfil-", "{_peer}"),
        confidence="0.8D", pivot_kind="'host'", pivot_value="_peer", seen=True, cooldown="dpi",
    )


def idle_tcp(sessions: DataFrame, policy: Policy, session: Session = Session()) -> DataFrame:
    """Established sessions that are old, small and silent as of ``as_of_us``."""
    rows = sessions.selectExpr(
        "*",
        "greatest(as_of_us div 1000000 - first_us div 1000000, 0L) AS _age",
        "greatest(as_of_us div 1000000 - coalesce(last_payload_us, first_us) div 1000000, 0L) AS _silence",
        f"{text.endpoint('endpoint_a_ip', 'endpoint_a_port')} AS _a", f"{text.endpoint('endpoint_b_ip', 'endpoint_b_port')} AS _b",
    ).where(all_of([
        str(policy.idle_enabled).lower(), "state = 'ESTABLISHED'", f"bytes <= {policy.idle_max_bytes}",
        f"_age >= {policy.idle_min_age_seconds}", f"_silence >= {policy.idle_silence_seconds}",
    ]))
    return _occurrence(
        rows, session, _order(4, "tcp"), kind="LongIdleTcpConnection", severity="info",
        subject="concat(_a, ' ↔ ', _b)", summary="Long-lived idle TCP connection",
        detail=_phrase(
            "Established age=", "{_age}", "s silence=", "{_silence}", "s total_bytes=", "{bytes}", " payload_bytes=", "{payload_bytes}",
            f" (min_age={policy.idle_min_age_seconds}s silence≥{policy.idle_silence_seconds}s max_bytes={policy.idle_max_bytes})",
        ),
        key=_phrase("LongIdleTcpConnection|", "{_a}", "-", "{_b}"), tag=_phrase("idle-", "{_a}"), confidence="0.75D",
        pivot_kind="'host'", pivot_value="endpoint_b_ip", seen=True, cooldown="dpi",
    )


def p2p_connections(flows: DataFrame, policy: Policy, session: Session = Session()) -> DataFrame:
    """Proxy or peer-to-peer ports on either side, or a proxy-infrastructure SNI, not allow-listed."""
    listed = ", ".join(str(p) for p in sorted(C.PROXY_PORTS + C.P2P_PORTS))
    rows = flows.selectExpr(
        "*", "coalesce(b_port, 0) AS _dport", "coalesce(a_port, 0) AS _sport", "coalesce(sni, '') AS _sni",
        f"coalesce(a_port IN ({listed}), false) OR coalesce(b_port IN ({listed}), false) AS _port_hit",
        f"{text.any_pattern('sni', C.SNI_NEEDLES)} AS _sni_hit",
    )
    cleared = any_of([
        allowed(_phrase("port:", "{_dport}"), policy), allowed(_phrase("port:", "{_sport}"), policy),
        f"(_sni <> '' AND {allowed(_phrase('sni:', '{_sni}'), policy)})",
    ])
    hit = rows.where(all_of([str(policy.p2p_enabled).lower(), "(_port_hit OR _sni_hit)", f"NOT {cleared}"]))
    hit = computed(hit, _peer=ip.to_text("b_bin"))
    return _occurrence(
        hit, session, _order(5, "flows"), kind="UnauthorizedP2pOrProxy", severity="warning", subject="_peer",
        summary="Unauthorized P2P or proxy traffic",
        detail=_phrase(
            "Heuristic match sport=", "{_sport}", " dport=", "{_dport}", " sni=", "{_sni}", " peer=", "{_peer}", " bytes=", "{bytes}"
        ),
        key=_phrase("UnauthorizedP2pOrProxy|port|", "{_dport}", "|", "{_peer}"), tag=_phrase("p2p-", "{_dport}", "-", "{_peer}"),
        confidence="CASE WHEN _port_hit AND _sni_hit THEN 0.9D WHEN _port_hit THEN 0.55D ELSE 0.6D END",
        pivot_kind="CASE WHEN _sni = '' THEN 'host' ELSE 'sni' END",
        pivot_value="CASE WHEN _sni = '' THEN _peer ELSE _sni END", seen=True, cooldown="dpi",
    )


def occurrences(totals: DataFrame, tables: dict[str, DataFrame], policy: Policy, session: Session = Session(),
                as_of_us: str | None = None, processes: DataFrame | None = None,
                pool: int | None = None) -> DataFrame:
    """All detectors over session tables: the union of their hits.

    ``as_of_us`` defaults to the capture's last packet.  ``pool`` limits each
    ranking first, as a display-bound tool does; ``None`` looks at all rows.
    """
    timed = totals.selectExpr("*", f"{as_of_us or 'ended_us'} AS as_of_us")
    clock_rows = timed.select("capture_id", "as_of_us")

    def ready(kind: str) -> DataFrame:
        rows = tables[kind] if pool is None else ranking.rank_by_traffic(tables[kind], kind, max(pool, 1))
        return rows.join(clock_rows, "capture_id")

    parts = [threshold(timed, policy, session)]
    # a detector without anything to look for adds no branch to the plan
    if any((*policy.watched_hosts, *policy.bad_hosts)):
        parts += watched_hosts(ready("hosts"), policy, session)
    if any((*policy.watched_services, *policy.bad_services)):
        parts += watched_services(ready("services"), policy, session)
    if policy.exfil_enabled:
        parts.append(exfil(ready("flows"), policy, session))
    if policy.idle_enabled:
        parts.append(idle_tcp(ready("tcp"), policy, session))
    if policy.p2p_enabled:
        parts.append(p2p_connections(ready("flows"), policy, session))
    if processes is not None:
        parts += watched_processes(processes.join(clock_rows, "capture_id"), policy, session)
    return reduce(DataFrame.unionByName, parts)


def merge(hits: DataFrame, session: Session = Session(), keep: int | None = C.MAX_FINDINGS) -> DataFrame:
    """The finding log: one row per (capture, dedupe key).

    The first occurrence fixes identity, the last one the changing fields; the
    newest key comes first (``first_order`` descending).  ``keep=None`` keeps all.
    """
    when = "struct(as_of_us, ord)"
    fixed = "struct(id, kind, severity, subject, first_us, confidence, pivot_kind, pivot_value)"
    merged = hits.groupBy("capture_id", "dedupe_key").agg(*[F.expr(e) for e in (
        f"min_by({fixed}, {when}) AS f", f"max_by(struct(last_us, detail, summary, mode), {when}) AS m",
        "count(1) AS update_count", f"min({when}) AS first_order",
    )])
    repeat = "finding" if session.offline else "updated"
    log = merged.selectExpr(
        "capture_id", "dedupe_key", "f.*", "m.*", "update_count",
        f"CASE WHEN update_count > 1 THEN '{repeat}' ELSE '{session.status}' END AS status", "first_order",
    )
    if keep is None:
        return log
    newest = Window.partitionBy("capture_id").orderBy(F.col("first_order").desc())
    return log.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= keep)


def batch_findings(totals: DataFrame, tables: dict[str, DataFrame], policy: Policy, offline: bool = True,
                   top_n: int | None = None, as_of_us: str | None = None) -> DataFrame:
    """Findings of finished captures; there is no process data in this path."""
    session = Session() if offline else Session.live()
    return merge(occurrences(totals, tables, policy, session, as_of_us, None, top_n), session)



"""The registered queries as plain SQL over the driver's tables, packet by packet.

Written without the engine's shortcuts (no rollup, no binary addresses), so a
match says something.
"""

from __future__ import annotations

RAW = """
e AS (
  SELECT event_id, ts, user_id AS u, event_type AS et, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         60 + CAST(round(value * 100) AS BIGINT) % 1400 AS len
  FROM events),
p0 AS (
  SELECT event_id, ts, et, u, k, len,
         CASE k % 8 WHEN 6 THEN concat('fd00::', CAST(u % 256 + 1 AS STRING)) WHEN 7 THEN '127.0.0.1'
                    ELSE concat('10.0.', CAST(u // 256 AS STRING), '.', CAST(u % 256 AS STRING)) END AS loc,
         CASE k % 8 WHEN 0 THEN '8.8.8.8' WHEN 1 THEN '1.1.1.1' WHEN 2 THEN '93.184.216.34'
                    WHEN 3 THEN '35.223.238.178' WHEN 4 THEN '210.140.92.187'
                    WHEN 5 THEN '10.0.200.1' WHEN 6 THEN '2606:4700::2' ELSE '127.0.0.1' END AS rem,
         CASE WHEN k % 16 = 5 THEN 'arp' WHEN k % 16 = 13 THEN 'icmp' WHEN k % 8 = 0 THEN 'udp' ELSE 'tcp' END AS proto,
         CASE k % 16 WHEN 0 THEN 53 WHEN 8 THEN 443 WHEN 1 THEN 853 WHEN 9 THEN 853 WHEN 4 THEN 80 WHEN 12 THEN 80
                     WHEN 6 THEN 6881 WHEN 14 THEN 6881 WHEN 7 THEN 9050 WHEN 15 THEN 9050 ELSE 443 END AS svc_port,
         49152 + CAST(u % 16384 AS INT) AS cli_port, et IN ('view', 'purchase') AS inb
  FROM e),
p AS (
  SELECT CASE WHEN u % 3 = 0 THEN 'file:main' ELSE concat('file:part', CAST(u % 6 AS STRING)) END AS capture_id, event_id AS seq, epoch_us(ts) AS us, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
         CASE WHEN inb THEN rem ELSE loc END AS src, CASE WHEN inb THEN loc ELSE rem END AS dst,
         CASE WHEN proto IN ('tcp', 'udp') THEN CASE WHEN inb THEN svc_port ELSE cli_port END END AS sp,
         CASE WHEN proto IN ('tcp', 'udp') THEN CASE WHEN inb THEN cli_port ELSE svc_port END END AS dp,
         proto,
         CASE WHEN proto = 'tcp' THEN CASE et WHEN 'signup' THEN 2 WHEN 'view' THEN 18 WHEN 'purchase' THEN 24
              WHEN 'click' THEN 16 ELSE CASE WHEN event_id % 2 = 0 THEN 4 ELSE 17 END END END AS flags,
         len, CASE WHEN proto = 'tcp' AND et = 'purchase' THEN len - 54 ELSE 0 END AS pay,
         CASE WHEN proto = 'tcp' AND NOT inb AND svc_port = 443 THEN concat('h', CAST(k % 5 AS STRING), '.example.com') END AS sni,
         CASE WHEN proto = 'arp' THEN 1 + event_id % 2 END AS arp_op,
         event_id % 97 <> 0 AS decoded
  FROM p0)"""


def ip_key(x: str) -> str:
    """Text that sorts like the address: IPv4 before IPv6, numeric inside."""
    left, right = f"string_split(split_part({x}, '::', 1), ':')", f"string_split(split_part({x}, '::', 2), ':')"
    def groups(side: str) -> str:
        return f"[lpad(g, 4, '0') for g in {side} if g <> '']"
    v4 = "'4' || " + " || ".join(f"lpad(split_part({x}, '.', {i}), 3, '0')" for i in range(1, 5))
    fill = f"repeat('0000', 8 - len({groups(left)}) - len({groups(right)}))"
    v6 = f"'6' || array_to_string({groups(left)}, '') || {fill} || array_to_string({groups(right)}, '')"
    return f"CASE WHEN {x} LIKE '%:%' THEN {v6} ELSE {v4} END"


def near(x: str) -> str:
    return f"({x} LIKE '10.%' OR {x} LIKE '127.%' OR {x} LIKE '192.168.%' OR {x} LIKE 'fd00:%')"


PROTO_RANK = "CASE proto WHEN 'tcp' THEN 1 WHEN 'udp' THEN 2 WHEN 'icmp' THEN 3 WHEN 'icmpv6' THEN 4 WHEN 'arp' THEN 5 ELSE 6 END"

LOCALS = """
own AS (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN 'file:main' ELSE concat('file:part', CAST(user_id % 6 AS STRING)) END AS capture_id, concat('10.0.', CAST(user_id // 256 AS STRING), '.', CAST(user_id % 256 AS STRING)) AS ip
        FROM events WHERE user_id // 6 % 4 = 0)"""


def d_cte(local: bool = False) -> str:
    """Decoded packets with direction, service and orientation."""
    if local:
        sl, dl = "(capture_id, src) IN (SELECT (capture_id, ip) FROM own)", "(capture_id, dst) IN (SELECT (capture_id, ip) FROM own)"
        way = "WHEN sl AND dl THEN 'loopback' WHEN sl THEN 'outbound' WHEN dl THEN 'inbound' ELSE 'unknown' END"
    else:
        sl, dl = near("src"), near("dst")
        way = "WHEN sl AND NOT dl THEN 'outbound' WHEN dl AND NOT sl THEN 'inbound' ELSE 'unknown' END"
    return f"""
d0 AS (SELECT *, {ip_key('src')} AS sk, {ip_key('dst')} AS dk, {sl} AS sl, {dl} AS dl FROM p WHERE decoded),
d1 AS (SELECT *, CASE WHEN src LIKE '127.%' AND dst LIKE '127.%' THEN 'loopback' {way} AS dir,
         CASE WHEN sl AND NOT dl THEN FALSE WHEN dl AND NOT sl THEN TRUE
              WHEN sk <> dk THEN sk > dk ELSE coalesce(sp, -1) > coalesce(dp, -1) END AS swap FROM d0),
d2 AS (SELECT *, CASE WHEN dir = 'outbound' THEN coalesce(dp, sp) WHEN dir = 'inbound' THEN coalesce(sp, dp)
              WHEN sp <= 1024 AND dp > 1024 THEN sp WHEN dp <= 1024 AND sp > 1024 THEN dp ELSE least(sp, dp) END AS vp FROM d1),
d3 AS (SELECT *,
         CASE WHEN proto = 'arp' THEN CASE arp_op WHEN 1 THEN 'arp-request' WHEN 2 THEN 'arp-reply' ELSE 'arp' END
              WHEN proto = 'icmp' THEN 'icmp' END AS psvc,
         CASE WHEN proto = 'tcp' THEN CASE vp WHEN 80 THEN 'http' WHEN 443 THEN 'https' WHEN 853 THEN 'dns-over-tls' WHEN 53 THEN 'dns' END
              WHEN proto = 'udp' THEN CASE vp WHEN 53 THEN 'dns' WHEN 443 THEN 'quic' END END AS tsvc FROM d2),
d AS (SELECT *, coalesce(psvc, tsvc, 'unknown') AS service,
         CASE WHEN psvc IS NULL AND tsvc IS NULL THEN 0 WHEN dir = 'unknown' THEN 1
              WHEN dir = 'loopback' AND psvc IS NULL THEN 0 ELSE 2 END AS conf,
         CASE WHEN swap THEN dst ELSE src END AS a, CASE WHEN swap THEN src ELSE dst END AS b,
         CASE WHEN swap THEN dk ELSE sk END AS ak, CASE WHEN swap THEN sk ELSE dk END AS bk,
         CASE WHEN swap THEN dp ELSE sp END AS ap, CASE WHEN swap THEN sp ELSE dp END AS bp,
         CASE WHEN flags & 4 <> 0 THEN 'RST' WHEN flags & 1 <> 0 THEN 'FIN' WHEN flags & 2 <> 0 AND flags & 16 = 0 THEN 'INIT'
              WHEN flags & 2 <> 0 THEN 'SYN_ACK' WHEN flags IS NOT NULL THEN 'ESTABLISHED' END AS cls FROM d3)"""


COUNTS = """CAST(count(*) AS BIGINT) AS packets, CAST(sum(len) AS BIGINT) AS bytes,
  CAST(count(*) FILTER (WHERE dir = 'inbound') AS BIGINT) AS packets_in,
  CAST(count(*) FILTER (WHERE dir = 'outbound') AS BIGINT) AS packets_out,
  CAST(coalesce(sum(len) FILTER (WHERE dir = 'inbound'), 0) AS BIGINT) AS bytes_in,
  CAST(coalesce(sum(len) FILTER (WHERE dir = 'outbound'), 0) AS BIGINT) AS bytes_out"""
SEEN = "arg_min(us, seq) AS first_us, arg_max(us, seq) AS last_us"


def f_cte(by: str = "") -> str:
    return f"""
f AS (SELECT capture_id, {by} a, b, ak, bk, ap, bp, proto, {COUNTS}, {SEEN},
        arg_min(sni, seq) FILTER (WHERE sni IS NOT NULL) AS sni,
        CAST(count(cls) AS BIGINT) AS tcp_packets,
        CAST(coalesce(sum(len) FILTER (WHERE cls IS NOT NULL), 0) AS BIGINT) AS tcp_bytes,
        CAST(coalesce(sum(pay) FILTER (WHERE cls IS NOT NULL), 0) AS BIGINT) AS tcp_payload_bytes,
        CAST(count(*) FILTER (WHERE flags & 2 <> 0) AS BIGINT) AS syn_count,
        CAST(count(*) FILTER (WHERE flags & 1 <> 0) AS BIGINT) AS fin_count,
        CAST(count(*) FILTER (WHERE flags & 4 <> 0) AS BIGINT) AS rst_count,
        arg_max(us, seq) FILTER (WHERE pay > 0) AS pay_us,
        arg_max(cls, seq) FILTER (WHERE cls IS NOT NULL) AS last_cls,
        arg_max(cls, seq) FILTER (WHERE cls <> 'INIT') AS other_cls,
        arg_max(src || ':' || CAST(sp AS STRING), seq) FILTER (WHERE cls = 'INIT') AS initiator
      FROM d GROUP BY capture_id, {by} a, b, ak, bk, ap, bp, proto),
fs AS (SELECT *, CASE WHEN last_cls <> 'INIT' THEN last_cls WHEN other_cls IN ('RST', 'FIN') THEN other_cls
                      WHEN last_cls IS NOT NULL THEN 'INIT' END AS state FROM f)"""


H_CTE = f"""
hx AS (SELECT capture_id, src AS host, sk AS hk, seq, us, len, sec, 'outbound' AS dir, NULL AS hsni FROM d
       UNION ALL SELECT capture_id, dst, dk, seq, us, len, sec, 'inbound', CASE WHEN src <> dst THEN sni END FROM d),
h AS (SELECT capture_id, host, hk, {COUNTS}, {SEEN}, arg_min(hsni, seq) FILTER (WHERE hsni IS NOT NULL) AS sni
      FROM hx GROUP BY capture_id, host, hk)"""
S_CTE = f"""
s AS (SELECT capture_id, service, proto, {COUNTS}, max(conf) AS conf FROM d GROUP BY capture_id, service, proto)"""
TOT = """
tot AS (SELECT capture_id, CAST(count(*) AS BIGINT) AS packets, CAST(sum(len) AS BIGINT) AS bytes,
               arg_min(us, seq) AS started_us, arg_max(us, seq) AS ended_us FROM p GROUP BY capture_id)"""
T_CTE = """
px AS (SELECT *, max(sec) OVER (PARTITION BY capture_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS tick FROM p),
pd AS (SELECT px.*, d.dir FROM px LEFT JOIN d ON px.seq = d.seq),
t0 AS (SELECT capture_id, tick, CAST(count(*) AS BIGINT) AS packets, CAST(sum(len) AS BIGINT) AS bytes,
         CAST(coalesce(sum(len) FILTER (WHERE dir = 'inbound'), 0) AS BIGINT) AS bytes_in,
         CAST(coalesce(sum(len) FILTER (WHERE dir = 'outbound'), 0) AS BIGINT) AS bytes_out,
         arg_min(us, seq) AS fus, arg_max(us, seq) AS lus FROM pd GROUP BY capture_id, tick),
t AS (SELECT capture_id, tick, row_number() OVER w AS sequence, packets, bytes, bytes_in, bytes_out,
        coalesce(lead(fus) OVER w, lus) AS last_packet_us, coalesce(lead(tick) OVER w - tick - 1, 0) AS gap
      FROM t0 WINDOW w AS (PARTITION BY capture_id ORDER BY tick))"""
SES = """
ses AS (SELECT *, CASE WHEN a || '|' || lpad(CAST(ap AS STRING), 5, '0') IS NULL THEN NULL ELSE (a > b OR (a = b AND ap > bp)) END AS flip
        FROM fs WHERE tcp_packets > 0),
tcp AS (SELECT capture_id, CASE WHEN flip THEN b ELSE a END AS ea, CASE WHEN flip THEN bp ELSE ap END AS eap,
          CASE WHEN flip THEN a ELSE b END AS eb, CASE WHEN flip THEN ap ELSE bp END AS ebp,
          CASE WHEN flip THEN bk ELSE ak END AS eak, CASE WHEN flip THEN ak ELSE bk END AS ebk, state, syn_count, fin_count, rst_count,
          tcp_packets AS packets, tcp_bytes AS bytes, tcp_payload_bytes AS payload_bytes, initiator, first_us, last_us,
          pay_us AS last_payload_us FROM ses)"""

FLOW_ORDER = f"bytes DESC, packets DESC, ak, bk, ap NULLS FIRST, bp NULLS FIRST, {PROTO_RANK}"
TCP_ORDER = "bytes DESC, packets DESC, eak, eap, ebk, ebp"
CONF = "CASE conf WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END"
FLOW_OUT = """capture_id, a AS a_ip, b AS b_ip, CAST(ap AS BIGINT) AS a_port, CAST(bp AS BIGINT) AS b_port, proto, packets, bytes,
  packets_in, packets_out, bytes_in, bytes_out, first_us, last_us, sni"""
HOST_OUT = "capture_id, host, packets, bytes, packets_in, packets_out, bytes_in, bytes_out, first_us, last_us, sni"
TCP_OUT = """capture_id, ea AS endpoint_a_ip, CAST(eap AS BIGINT) AS endpoint_a_port, eb AS endpoint_b_ip,
  CAST(ebp AS BIGINT) AS endpoint_b_port, state, syn_count, fin_count, rst_count, packets, bytes, payload_bytes, initiator,
  first_us, last_us, last_payload_us"""
TCP_ROW_OUT = """capture_id, ea AS endpoint_a_address, CAST(eap AS BIGINT) AS endpoint_a_port, eb AS endpoint_b_address,
  CAST(ebp AS BIGINT) AS endpoint_b_port, state, syn_count, fin_count, rst_count, packets, bytes, first_us, last_us"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join([RAW, *ctes]) + "\n"


def flows(local: bool = False) -> list[str]:
    return ([LOCALS] if local else []) + [d_cte(local), f_cte()]


def ranked(cte: str, order: str, n: int | None, out: str, part: str = "capture_id") -> str:
    keep = f" WHERE rank <= {n}" if n else ""
    return f"SELECT rank, {out} FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rank FROM {cte}){keep}"


# display rows of flows
C_CTE = f"""
cd AS (SELECT *, {near('a')} AS an, {near('b')} AS bn FROM f),
ce AS (SELECT *, CASE WHEN a LIKE '127.%' AND b LIKE '127.%' THEN 'loopback' WHEN an AND bn THEN 'loopback'
         WHEN bn AND NOT an THEN 'inbound' WHEN bytes_out >= bytes_in THEN 'outbound' ELSE 'inbound' END AS direction FROM cd),
cf AS (SELECT *, CASE WHEN direction = 'outbound' THEN coalesce(bp, ap) WHEN direction = 'inbound' THEN coalesce(ap, bp)
         WHEN ap <= 1024 AND bp > 1024 THEN ap WHEN bp <= 1024 AND ap > 1024 THEN bp ELSE least(ap, bp) END AS vp FROM ce),
c AS (SELECT *, coalesce(CASE WHEN proto IN ('arp', 'icmp') THEN proto
           WHEN proto = 'tcp' THEN CASE vp WHEN 80 THEN 'http' WHEN 443 THEN 'https' WHEN 853 THEN 'dns-over-tls' WHEN 53 THEN 'dns' END
           WHEN proto = 'udp' THEN CASE vp WHEN 53 THEN 'dns' WHEN 443 THEN 'quic' END END, 'unknown') AS service_name,
         CASE coalesce(bp, ap, 0) WHEN 443 THEN 'https' WHEN 53 THEN 'dns' ELSE 'unknown' END AS short_name FROM cf)"""


def row_out(service: str = "service_name") -> str:
    return f"""capture_id, a AS source_address, CAST(coalesce(ap, 0) AS BIGINT) AS source_port, b AS destination_address,
  CAST(coalesce(bp, 0) AS BIGINT) AS destination_port, proto AS protocol, {service} AS service_name, direction, packets, bytes,
  coalesce(sni, '') AS sni"""


def search(q: str) -> str:
    cols = ("a", "b", "service_name", "proto", "coalesce(sni, '')")
    return "(" + " OR ".join(f"contains(lower({c}), '{q.lower()}')" for c in cols) + ")"


COUNTRY = """CASE WHEN x.ip LIKE '8.8.8.%' THEN 'US' WHEN x.ip LIKE '35.%' THEN 'US' WHEN x.ip LIKE '93.184.216.%' THEN 'GB'
  WHEN x.ip LIKE '210.%' THEN 'JP' WHEN x.ip LIKE '2606:4700:%' THEN 'CA' END"""
G_CTE = f"""
ips AS (SELECT DISTINCT src AS ip FROM d UNION SELECT DISTINCT dst FROM d),
g0 AS (SELECT ip, {COUNTRY} AS cc,
         CASE WHEN ip LIKE '8.8.8.%' THEN 15169 WHEN ip LIKE '35.%' THEN 396982 WHEN ip LIKE '93.184.216.%' THEN 15133
              WHEN ip LIKE '2606:4700:%' THEN 13335 ELSE 0 END AS asn FROM ips x),
g1 AS (SELECT *, CASE WHEN ip LIKE '127.%' THEN 'loopback' WHEN {near('ip')} THEN 'local' WHEN cc IS NOT NULL THEN 'country' ELSE 'unknown' END AS kind,
         CASE cc WHEN 'US' THEN 'United States' WHEN 'GB' THEN 'GB' WHEN 'JP' THEN 'Japan' WHEN 'CA' THEN 'Canada' END AS cname,
         CASE asn WHEN 15169 THEN 'Google' WHEN 396982 THEN 'Google Cloud' WHEN 13335 THEN 'Cloudflare' ELSE '' END AS org FROM g0),
g AS (SELECT ip, kind, asn, org,
        CASE kind WHEN 'loopback' THEN 'LO' WHEN 'local' THEN 'LOCAL' WHEN 'country' THEN cc ELSE 'ZZ' END AS code,
        CASE kind WHEN 'loopback' THEN 'Loopback' WHEN 'local' THEN 'Local' WHEN 'country' THEN cname ELSE 'Unknown' END AS name,
        CASE kind WHEN 'loopback' THEN 'Loopback' WHEN 'local' THEN 'Local' WHEN 'country' THEN cc || ' · ' || cname ELSE 'Unknown' END AS label,
        CASE WHEN asn = 0 THEN '' WHEN org = '' THEN 'AS' || CAST(asn AS STRING) ELSE 'AS' || CAST(asn AS STRING) || ' · ' || org END AS asn_label
      FROM g1)"""

PTR = """
ptr AS (SELECT CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 8 WHEN 0 THEN '8.8.8.8' WHEN 1 THEN '1.1.1.1'
          WHEN 2 THEN '93.184.216.34' WHEN 3 THEN '35.223.238.178' WHEN 4 THEN '210.140.92.187' WHEN 5 THEN '10.0.200.1'
          WHEN 6 THEN '2606:4700::2' ELSE '127.0.0.1' END AS ip,
        CASE WHEN event_id % 4 <> 0 THEN 'host' || CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 8 AS STRING) || '.example.net' END AS hostname,
        epoch_us(ts) AS ous FROM events)"""


def ptr_query(probes: str, extra: str) -> str:
    return f"""SELECT {extra} q.ip, q.as_of_us, r.hostname FROM ({probes}) q LEFT JOIN (
  SELECT z.ip, z.as_of_us, arg_max(ptr.hostname, ous) AS hostname_any, max(ous) AS ous,
         (list(ptr.hostname ORDER BY ous DESC))[1] AS hostname
  FROM (SELECT DISTINCT ip, as_of_us FROM ({probes})) z JOIN ptr ON ptr.ip = z.ip AND ous <= z.as_of_us AND z.as_of_us - ous < 300000000
  WHERE NOT {near('z.ip')} GROUP BY z.ip, z.as_of_us) r ON q.ip = r.ip AND q.as_of_us = r.as_of_us"""


SOCK = """
sock AS (SELECT CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 8 = 0 THEN 'udp' ELSE 'tcp' END AS proto,
           49152 + CAST(user_id % 16384 AS INT) AS port, epoch_us(ts) AS ous,
           CASE WHEN event_id % 6 <> 0 THEN CASE user_id % 4 WHEN 0 THEN 'firefox' WHEN 1 THEN 'Clash for Windows' WHEN 2 THEN 'sshd' ELSE 'Transmission' END END AS name,
           CASE WHEN event_id % 6 <> 0 THEN user_id END AS pid, CASE WHEN user_id % 3 = 0 THEN 'file:main' ELSE concat('file:part', CAST(user_id % 6 AS STRING)) END AS capture_id FROM events)"""


def process_cte(source: str) -> str:
    """Process of each row of ``source`` (flow columns): candidates in order, latest answer of each."""
    key = "capture_id, a, b, ap, bp, proto"
    ckey = ", ".join(f"c.{k}" for k in key.split(", "))
    return f"""
fl AS (SELECT *, CASE WHEN bytes_out >= bytes_in THEN [ap, bp] ELSE [bp, ap] END AS o FROM {source}),
fc AS (SELECT *, [x for x in o if x IS NOT NULL AND x < 1024 AND x <> 0] AS lo, [x for x in o if x IS NOT NULL AND x >= 1024] AS hi FROM fl),
cand AS (SELECT {key}, last_us, unnest(list_concat(hi, lo)) AS port,
           generate_subscripts(list_concat(hi, lo), 1) AS pos FROM fc WHERE proto IN ('tcp', 'udp')),
ans AS (SELECT {ckey}, c.pos, max(ous) AS ous, (list(s.name ORDER BY ous DESC))[1] AS name, (list(s.pid ORDER BY ous DESC))[1] AS pid
        FROM cand c JOIN sock s ON s.capture_id = c.capture_id AND s.proto = c.proto AND s.port = c.port AND ous <= c.last_us AND c.last_us - ous < 60000000
        GROUP BY {ckey}, c.pos),
best AS (SELECT {key}, arg_min(name, pos) AS name, arg_min(pid, pos) AS pid FROM ans WHERE name IS NOT NULL GROUP BY {key}),
pr AS (SELECT x.*, coalesce(best.name, '') AS process_name, coalesce(best.pid, 0) AS process_pid FROM {source} x LEFT JOIN best
       ON x.capture_id = best.capture_id AND x.a = best.a AND x.b = best.b AND x.ap = best.ap AND x.bp = best.bp AND x.proto = best.proto)"""


NOW = 1_735_689_600_000_000


def finding(kind: str, severity: str, subject: str, summary: str, detail: str, first: str, last: str, conf: str, key: str,
            tag: str, pivot: str, value: str, now: str = "ended_us", cols: str = "") -> str:
    return f"""SELECT {cols} capture_id, {tag} || '-' || CAST({now} // 1000000 AS STRING) AS id, '{kind}' AS kind, 'offline' AS mode,
  'finding' AS status, '{severity}' AS severity, {subject} AS subject, '{summary}' AS summary, {detail} AS detail,
  {first} AS first_us, {last} AS last_us, {conf} AS confidence, {key} AS dedupe_key, {pivot} AS pivot_kind, {value} AS pivot_value"""


def with_now(table: str) -> str:
    return f"(SELECT x.*, tot.ended_us FROM {table} x JOIN tot ON x.capture_id = tot.capture_id)"


def s_threshold(cols: str = "") -> str:
    return finding("DataThresholdExceeded", "warning", "'Offline capture'", "Data threshold exceeded (offline finding)",
                   "'Observed ' || CAST(bytes AS STRING) || ' bytes (threshold 1000).'", "ended_us", "ended_us",
                   "CAST(0.9 AS DOUBLE)", "'DataThresholdExceeded|1000'", "'threshold'", "'none'", "''", cols=cols) + " FROM tot WHERE bytes >= 1000"


def s_hosts(src: str, cols: str = "") -> str:
    sni = "coalesce(sni, '')"
    watched = finding("WatchedEntityTransmitted", "info", "host", "Watched host (offline finding)",
                      f"host || ' transmitted ' || CAST(bytes AS STRING) || ' bytes' || CASE WHEN {sni} = '' THEN '' ELSE ' (sni=' || sni || ')' END || '.'",
                      "ended_us", "ended_us", "CAST(0.85 AS DOUBLE)", "'WatchedEntityTransmitted|host|' || host", "'watch-host-' || host",
                      f"CASE WHEN {sni} = '' THEN 'host' ELSE 'sni' END", f"CASE WHEN {sni} = '' THEN host ELSE sni END", cols=cols)
    bad = finding("KnownBadHostTransmitted", "error", "host", "Known-bad host (offline finding)",
                  "host || ' matched a known-bad entry (' || CAST(bytes AS STRING) || ' bytes).'", "ended_us", "ended_us",
                  "CAST(0.9 AS DOUBLE)", "'KnownBadHostTransmitted|host|' || host", "'bad-host-' || host", "'host'", "host", cols=cols)
    return f"""{watched} FROM {with_now(src)} WHERE contains(host, '8.8.8') OR contains({sni}, '8.8.8') OR contains(host, 'h1.example') OR contains(lower({sni}), 'h1.example')
UNION ALL {bad} FROM {with_now(src)} WHERE contains(host, '210.140.92.187') OR contains({sni}, '210.140.92.187')"""


def s_services(src: str, cols: str = "") -> str:
    watched = finding("WatchedEntityTransmitted", "info", "service", "Watched service (offline finding)",
                      "'Service `' || service || '` transmitted ' || CAST(bytes AS STRING) || ' bytes.'", "ended_us", "ended_us",
                      "CAST(0.8 AS DOUBLE)", "'WatchedEntityTransmitted|service|' || service", "'watch-svc-' || service", "'service'", "service", cols=cols)
    bad = finding("KnownBadHostTransmitted", "error", "service", "Known-bad service (offline finding)",
                  "'Service `' || service || '` matched a known-bad entry (' || CAST(bytes AS STRING) || ' bytes).'", "ended_us", "ended_us",
                  "CAST(0.85 AS DOUBLE)", "'KnownBadHostTransmitted|service|' || service", "'bad-svc-' || service", "'service'", "service", cols=cols)
    return f"{watched} FROM {with_now(src)} WHERE contains(service, 'dns') UNION ALL {bad} FROM {with_now(src)} WHERE contains(service, 'http')"


def s_exfil(src: str, cols: str = "") -> str:
    ratio = "printf('%.1f', CAST(bytes_out AS DOUBLE) / greatest(bytes_in, 1))"
    return finding("UnidirectionalLargeTransfer", "warning", "b", "Unidirectional large transfer (possible exfil)",
                   f"'Outbound ' || CAST(bytes_out AS STRING) || ' bytes vs inbound ' || CAST(bytes_in AS STRING) || ' (ratio ' || "
                   f"{ratio} || 'x, min 2000, ratio≥2). peer=' || b || ' sni/service≈' || coalesce(sni, 'unknown')",
                   "first_us", "last_us", "CAST(0.8 AS DOUBLE)", "'UnidirectionalLargeTransfer|' || b || '|' || CAST(coalesce(bp, 0) AS STRING)",
                   "'exfil-' || b", "'host'", "b", cols=cols) + f" FROM {with_now(src)} WHERE bytes_out >= 2000 AND bytes_out / greatest(bytes_in, 1) >= 2.0"


def s_idle(src: str, cols: str = "") -> str:
    age = "greatest(ended_us // 1000000 - first_us // 1000000, 0)"
    quiet = "greatest(ended_us // 1000000 - coalesce(last_payload_us, first_us) // 1000000, 0)"
    ea, eb = "ea || ':' || CAST(eap AS STRING)", "eb || ':' || CAST(ebp AS STRING)"
    return finding("LongIdleTcpConnection", "info", f"{ea} || ' ↔ ' || {eb}", "Long-lived idle TCP connection",
                   f"'Established age=' || CAST({age} AS STRING) || 's silence=' || CAST({quiet} AS STRING) || 's total_bytes=' || CAST(bytes AS STRING) || "
                   "' payload_bytes=' || CAST(payload_bytes AS STRING) || ' (min_age=86400s silence≥600s max_bytes=65536)'",
                   "first_us", "last_us", "CAST(0.75 AS DOUBLE)", f"'LongIdleTcpConnection|' || {ea} || '-' || {eb}", f"'idle-' || {ea}",
                   "'host'", "eb", cols=cols) + f" FROM {with_now(src)} WHERE state = 'ESTABLISHED' AND bytes <= 65536 AND {age} >= 86400 AND {quiet} >= 600"


def s_p2p(src: str, cols: str = "") -> str:
    sp, dp, sni = "coalesce(ap, 0)", "coalesce(bp, 0)", "coalesce(sni, '')"
    ports = "(1080,1081,3128,8118,8123,8888,9050,9051,9150,9222,7890,7891,10808,8080,8081,8082,6881,6882,6883,6884,6885,6886,6887,6888,6889,51413,6771,6969)"
    return finding("UnauthorizedP2pOrProxy", "warning", "b", "Unauthorized P2P or proxy traffic",
                   f"'Heuristic match sport=' || CAST({sp} AS STRING) || ' dport=' || CAST({dp} AS STRING) || ' sni=' || {sni} || ' peer=' || b || ' bytes=' || CAST(bytes AS STRING)",
                   "first_us", "last_us", "CAST(0.55 AS DOUBLE)", f"'UnauthorizedP2pOrProxy|port|' || CAST({dp} AS STRING) || '|' || b",
                   f"'p2p-' || CAST({dp} AS STRING) || '-' || b", f"CASE WHEN {sni} = '' THEN 'host' ELSE 'sni' END",
                   f"CASE WHEN {sni} = '' THEN b ELSE sni END", cols=cols) + (
        f" FROM {with_now(src)} WHERE ({sp} IN {ports} OR {dp} IN {ports})"
        f" AND NOT contains('port:' || CAST({sp} AS STRING), 'port:9050') AND NOT contains('port:' || CAST({dp} AS STRING), 'port:9050')")


def s_processes(src: str, cols: str = "") -> str:
    name = "process_name"

    def one(kind: str, severity: str, summary: str, detail: str, conf: str, tag: str, test: str) -> str:
        return finding(kind, severity, name, summary, f"'Process `' || {name} || '` {detail}", "ended_us", "ended_us", f"CAST({conf} AS DOUBLE)",
                       f"'{kind}|process|' || {name}", f"'{tag}-' || {name}", "'process'", name, cols=cols) + f" FROM {with_now(src)} WHERE {test}"

    return " UNION ALL ".join([
        one("WatchedEntityTransmitted", "info", "Watched process (offline finding)", "transmitted ' || CAST(bytes AS STRING) || ' bytes.'",
            "0.8", "watch-proc", f"{name} = 'firefox'"),
        one("KnownBadHostTransmitted", "error", "Known-bad process (offline finding)",
            "matched a known-bad entry (' || CAST(bytes AS STRING) || ' bytes).'", "0.85", "bad-proc", f"{name} = 'sshd'"),
        one("UnauthorizedP2pOrProxy", "warning", "Unauthorized P2P or proxy process",
            "matched built-in P2P/proxy heuristics (' || CAST(bytes AS STRING) || ' bytes).'", "0.85", "p2p-proc",
            f"{name} IN ('Clash for Windows', 'Transmission')"),
    ])


def all_hits(pool: int | None) -> list[str]:
    """CTEs ending in ``hits``: every detector's rows with a global evaluation order ``o``."""
    cut = f" WHERE rk <= {pool}" if pool else ""
    rf = f"rf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY {FLOW_ORDER}) AS rk FROM f){cut})"
    rh = f"rh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY bytes DESC, packets DESC, hk) AS rk FROM h){cut})"
    rs = f"rs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY bytes DESC, packets DESC, service, {PROTO_RANK}) AS rk FROM s){cut})"
    rt = f"rt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY {TCP_ORDER}) AS rk FROM tcp){cut})"
    parts = [
        s_threshold("0 AS det, 0 AS rk,"), s_hosts("rh", "1 AS det, rk,"), s_services("rs", "2 AS det, rk,"),
        s_exfil("rf", "3 AS det, rk,"), s_idle("rt", "4 AS det, rk,"), s_p2p("rf", "5 AS det, rk,"),
    ]
    named = []
    if pool is None:
        # a finished capture's batch report has no process data
        parts.append(s_processes("pr", "6 AS det, rk,"))
        named = [SOCK, process_cte("rf")]
    hits = "hits AS (SELECT *, CAST(det AS BIGINT) * 1000000000 + rk AS o FROM (" + " UNION ALL ".join(parts) + "))"
    log = """lg AS (SELECT capture_id, dedupe_key, arg_min(id, o) AS id, arg_min(kind, o) AS kind, 'offline' AS mode, 'finding' AS status,
  arg_min(severity, o) AS severity, arg_min(subject, o) AS subject, arg_max(summary, o) AS summary, arg_max(detail, o) AS detail,
  arg_min(first_us, o) AS first_us, arg_max(last_us, o) AS last_us, arg_min(confidence, o) AS confidence,
  arg_min(pivot_kind, o) AS pivot_kind, arg_min(pivot_value, o) AS pivot_value, CAST(count(*) AS BIGINT) AS update_count, min(o) AS fo
  FROM hits GROUP BY capture_id, dedupe_key)"""
    return [d_cte(), f_cte(), H_CTE, S_CTE, TOT, SES, rf, *named, rh, rs, rt, hits, log]


FINDING_OUT = """capture_id, id, kind, mode, status, severity, subject, summary, detail, first_us, last_us, confidence, dedupe_key,
  pivot_kind, pivot_value"""

TICK_D = [d_cte(), "px AS (SELECT *, max(sec) OVER (PARTITION BY capture_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS tick FROM p)",
          "dt AS (SELECT d.*, px.tick FROM d JOIN px ON d.seq = px.seq)"]

COMPRESSED = """
sp AS (SELECT capture_id, min(tick) AS t0, max(tick) AS t1, least(max(tick) - min(tick) + 1, 160) AS n FROM t GROUP BY capture_id),
bk AS (SELECT t.capture_id, ((tick - t0) * (n - 1)) // greatest(t1 - t0, 1) AS point, sum(bytes_in) AS bi, sum(bytes_out) AS bo
       FROM t JOIN sp ON t.capture_id = sp.capture_id GROUP BY ALL),
ax AS (SELECT capture_id, t0, t1, n, unnest(range(n)) AS point FROM sp),
tl AS (SELECT ax.capture_id, ax.point, CASE WHEN ax.point = n - 1 THEN t1 ELSE t0 + ((t1 - t0) * ax.point) // greatest(n - 1, 1) END AS second,
         CAST(coalesce(bi, 0) AS BIGINT) AS bytes_in, CAST(coalesce(bo, 0) AS BIGINT) AS bytes_out
       FROM ax LEFT JOIN bk ON ax.capture_id = bk.capture_id AND ax.point = bk.point)"""


def oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    q["top_connections"] = with_(*flows()) + ranked("f", FLOW_ORDER, 10, FLOW_OUT)
    q["flow_table"] = with_(*flows()) + f"SELECT {FLOW_OUT} FROM f"
    q["flow_tcp_stats"] = with_(*flows()) + """SELECT capture_id, a AS a_ip, b AS b_ip, CAST(ap AS BIGINT) AS a_port, CAST(bp AS BIGINT) AS b_port,
      proto, state AS tcp_state, tcp_packets, tcp_bytes, tcp_payload_bytes, syn_count, fin_count, rst_count FROM fs"""
    q["flow_table_local_set"] = with_(*flows(True)) + f"SELECT {FLOW_OUT} FROM f"
    q["top_hosts"] = with_(d_cte(), H_CTE) + ranked("h", "bytes DESC, packets DESC, hk", 10, HOST_OUT)
    q["host_table"] = with_(d_cte(), H_CTE) + f"SELECT {HOST_OUT} FROM h"
    q["top_services"] = with_(d_cte(), S_CTE) + ranked(
        "s", f"bytes DESC, packets DESC, service, {PROTO_RANK}", 10,
        f"capture_id, service, proto, packets, bytes, packets_in, packets_out, bytes_in, bytes_out, {CONF} AS confidence")
    q["tcp_sessions"] = with_(*flows(), SES) + f"SELECT {TCP_OUT} FROM tcp"
    q["top_tcp_sessions"] = with_(*flows(), SES) + ranked("tcp", TCP_ORDER, 25, TCP_OUT)
    q["session_totals"] = with_(TOT) + "SELECT * FROM tot"
    q["capture_quality"] = with_() + f"""SELECT capture_id, CAST(count(*) AS BIGINT) AS packets_seen, CAST(sum(len) AS BIGINT) AS bytes_seen,
      CAST(count(*) FILTER (WHERE decoded) AS BIGINT) AS packets_decoded, CAST(count(*) FILTER (WHERE NOT decoded) AS BIGINT) AS packets_failed,
      arg_max(us, seq) AS last_packet_us, CAST(0 AS BIGINT) AS packets_dropped, {NOW} - arg_max(us, seq) AS last_packet_age_us FROM p GROUP BY capture_id"""
    mix = "SELECT capture_id, dir AS direction, CAST(count(*) AS BIGINT) AS packets, CAST(sum(len) AS BIGINT) AS bytes FROM d GROUP BY capture_id, dir"
    q["direction_mix"] = with_(d_cte()) + mix
    q["direction_mix_local_set"] = with_(LOCALS, d_cte(True)) + mix
    q["service_labels"] = with_(d_cte()) + f"SELECT proto, dir AS direction, service, {CONF} AS confidence, CAST(count(*) AS BIGINT) AS packets FROM d GROUP BY ALL"
    q["ip_scopes"] = with_(d_cte()) + f"""SELECT ip, CASE WHEN ip LIKE '127.%' THEN 'loopback' WHEN {near('ip')} THEN 'private' ELSE 'public' END AS scope,
      {near('ip')} AS local_side, NOT {near('ip')} AS named FROM (SELECT src AS ip FROM d UNION SELECT dst FROM d)"""
    q["tcp_flag_mix"] = with_(d_cte()) + "SELECT capture_id, " + ", ".join(
        f"CAST(count(*) FILTER (WHERE flags & {m} <> 0) AS BIGINT) AS {n}" for n, m in (("fin", 1), ("syn", 2), ("rst", 4), ("psh", 8), ("ack", 16))
    ) + " FROM d WHERE flags IS NOT NULL GROUP BY capture_id"
    tot = """SELECT capture_id, CAST(count(*) AS BIGINT) AS packets, CAST(sum(len) AS BIGINT) AS bytes, arg_min(us, seq) AS started_us,
      arg_max(us, seq) AS ended_us FROM p WHERE """
    q["filtered_totals"] = with_() + tot + """((decoded AND proto = 'tcp' AND (sp = 443 OR dp = 443)) OR (decoded AND (src LIKE '8.8.8.%' OR dst LIKE '8.8.8.%')))
      AND NOT (decoded AND (src = '10.0.0.1' OR dst = '10.0.0.1')) GROUP BY capture_id"""
    q["control_traffic_excluded"] = with_() + tot + """NOT (decoded AND proto = 'tcp' AND (src IN ('127.0.0.1', '::1') OR dst IN ('127.0.0.1', '::1'))
      AND coalesce(sp = 9050 OR dp = 9050, FALSE)) GROUP BY capture_id"""
    # ticks
    q["tick_totals"] = with_(d_cte(), T_CTE) + "SELECT capture_id, tick, sequence, packets, bytes, bytes_in, bytes_out, last_packet_us FROM t"
    q["tick_gaps"] = with_(d_cte(), T_CTE) + "SELECT capture_id, tick AS after_tick, gap AS seconds FROM t WHERE gap > 0"
    q["tick_gap_fill"] = with_(d_cte(), T_CTE) + """SELECT capture_id, s - s % 3600 AS hour_start, CAST(count(*) AS BIGINT) AS ticks,
      CAST(count(*) FILTER (WHERE z) AS BIGINT) AS zero_ticks, CAST(sum(bytes) AS BIGINT) AS bytes FROM (
        SELECT capture_id, tick AS s, FALSE AS z, bytes FROM t UNION ALL
        SELECT capture_id, unnest(range(tick + 1, tick + gap + 1)), TRUE, 0 FROM t WHERE gap > 0) GROUP BY ALL"""
    tf = f_cte("tick,").replace("FROM d GROUP", "FROM dt GROUP")
    q["tick_connections"] = with_(*TICK_D, tf) + ranked("fs", FLOW_ORDER, None, f"tick, {FLOW_OUT}, state AS tcp_state", "capture_id, tick")
    th = H_CTE.replace("FROM d", "FROM dt").replace("seq, us, len, sec,", "seq, us, len, tick,").replace("hk, " + COUNTS[:10], "hk, tick, " + COUNTS[:10]).replace(
        "GROUP BY capture_id, host, hk", "GROUP BY capture_id, host, hk, tick")
    q["tick_hosts"] = with_(*TICK_D, th) + ranked("h", "bytes DESC, packets DESC, hk", None, f"tick, {HOST_OUT}", "capture_id, tick")
    ts = S_CTE.replace("FROM d ", "FROM dt ").replace("capture_id, service, proto", "capture_id, tick, service, proto")
    q["tick_services"] = with_(*TICK_D, ts) + ranked("s", f"bytes DESC, packets DESC, service, {PROTO_RANK}", None,
                                                     f"capture_id, tick, service, proto, packets, bytes, {CONF} AS confidence", "capture_id, tick")
    q["rolling_ticks"] = with_(d_cte(), T_CTE) + "SELECT capture_id, tick, packets, bytes, bytes_in, bytes_out FROM t QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY tick DESC) <= 30"
    q["window_totals"] = with_(d_cte(), T_CTE) + """SELECT capture_id, CAST(count(*) AS BIGINT) AS ticks, CAST(sum(bytes_in) AS BIGINT) AS window_bytes_in,
      CAST(sum(bytes_out) AS BIGINT) AS window_bytes_out FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY tick DESC) <= 30) GROUP BY capture_id"""
    q["timeline_live"] = with_(d_cte(), T_CTE) + """SELECT capture_id, tick AS second, bytes_in, bytes_out FROM t
      UNION ALL SELECT capture_id, tick + gap, 0, 0 FROM t WHERE gap > 0"""
    q["timeline_compressed"] = with_(d_cte(), T_CTE, COMPRESSED) + "SELECT * FROM tl"
    q["timeline_peak"] = with_(d_cte(), T_CTE, COMPRESSED) + "SELECT capture_id, max(greatest(bytes_in, bytes_out)) AS peak FROM tl GROUP BY capture_id"
    # rows and filters
    rows = with_(*flows(), C_CTE)
    q["connection_rows"] = rows + f"SELECT {row_out()} FROM c"
    q["connection_rows_short_service"] = rows + f"SELECT {row_out('short_name')} FROM c"
    q["session_directions"] = rows + "SELECT capture_id, direction, CAST(count(*) AS BIGINT) AS flows, CAST(sum(bytes) AS BIGINT) AS bytes FROM c GROUP BY ALL"
    q["inspect_connections"] = rows + ranked("(SELECT * FROM c WHERE service_name LIKE '%http%' AND proto LIKE '%tcp%' AND contains(a, '10.0.0'))",
                                             FLOW_ORDER, 10, row_out())
    q["inspect_pool"] = rows + f"""SELECT rank, {row_out('short_name')} FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY {FLOW_ORDER}) AS rank FROM c)
      WHERE rank <= 100 AND proto = 'tcp' AND short_name = 'https' QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY rank) <= 10)"""
    q["inspect_search"] = rows + f"SELECT {row_out()} FROM c WHERE {search('h2.example')}"
    q["inspect_tcp"] = with_(*flows(), SES) + f"""SELECT {TCP_ROW_OUT} FROM tcp WHERE (contains(ea || ':' || CAST(eap AS STRING), '1.1.1.1:85') OR
      contains(eb || ':' || CAST(ebp AS STRING), '1.1.1.1:85')) AND (contains(CAST(eap AS STRING), '491') OR contains(CAST(ebp AS STRING), '491')) AND state = 'ESTABLISHED'"""
    label = "ea || ':' || CAST(eap AS STRING) || ' ↔ ' || eb || ':' || CAST(ebp AS STRING)"
    q["inspect_tcp_search"] = with_(*flows(), SES) + f"""SELECT {TCP_ROW_OUT} FROM tcp WHERE (contains(lower({label}), 'fin') OR contains(lower(state), 'fin'))
      AND contains({label}, '2606') AND contains({label}, '6881')"""
    summary = """SELECT capture_id, CAST(count(*) AS BIGINT) AS total_rows, CAST(count(*) FILTER (WHERE v) AS BIGINT) AS visible_rows,
      CAST(coalesce(sum(packets) FILTER (WHERE v), 0) AS BIGINT) AS total_packets, CAST(coalesce(sum(bytes) FILTER (WHERE v), 0) AS BIGINT) AS total_bytes"""
    q["inspect_summary"] = rows + f"{summary} FROM (SELECT *, {search('8.8.8.8')} AS v FROM c) GROUP BY capture_id"
    q["tcp_summary"] = with_(*flows(), SES) + f"{summary} FROM (SELECT *, contains(lower({label}), 'rst') OR contains(lower(state), 'rst') AS v FROM tcp) GROUP BY capture_id"
    q["pivot_host"] = rows + f"SELECT {row_out()} FROM c WHERE {search('1.1.1.1')}"
    q["pivot_sni"] = rows + f"SELECT {row_out()} FROM c WHERE contains(coalesce(sni, ''), 'h3.example.com')"
    q["country_filter"] = rows + f"SELECT {row_out()} FROM c WHERE a LIKE '210.%' OR b LIKE '210.%'"
    q["focus_order"] = rows + f"""SELECT row_number() OVER (PARTITION BY capture_id ORDER BY CASE WHEN contains(a, '210.140') OR contains(b, '210.140') THEN 0 ELSE 1 END, rank) AS focus_rank,
      rank, a AS source_address, b AS destination_address, bytes FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY {FLOW_ORDER}) AS rank FROM c) WHERE rank <= 100"""
    q["service_share"] = with_(d_cte(), S_CTE) + f"""SELECT rank, service, proto, bytes, bytes / sum(bytes) OVER (PARTITION BY capture_id) AS share FROM (
      SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY bytes DESC, packets DESC, service, {PROTO_RANK}) AS rank FROM s) WHERE rank <= 10"""
    # enrichment
    q["country_lookup"] = with_(d_cte(), G_CTE) + "SELECT ip, code AS country_code, name AS country_name, kind AS country_kind, label AS country_label FROM g"
    q["asn_lookup"] = with_(d_cte(), G_CTE) + "SELECT ip, CAST(asn AS BIGINT) AS asn_number, org AS asn_organization, asn_label FROM g"
    q["top_remote_hosts"] = with_(LOCALS, d_cte(), H_CTE, G_CTE) + ranked(
        "(SELECT h.*, g.label FROM h JOIN g ON h.host = g.ip WHERE g.kind NOT IN ('local', 'loopback') AND (h.capture_id, h.host) NOT IN (SELECT (capture_id, ip) FROM own))",
        "bytes DESC, packets DESC, hk", 10, "capture_id, host, packets, bytes, label AS country_label")
    order = f"row_number() OVER (PARTITION BY capture_id ORDER BY {FLOW_ORDER})"
    q["top_regions"] = with_(*flows(), G_CTE) + f"""
      , fr AS (SELECT f.*, g.code, g.label, g.asn, g.org, g.asn_label, {order} AS fo FROM f JOIN g ON f.b = g.ip),
      reg AS (SELECT capture_id, code, label, CAST(sum(bytes) AS BIGINT) AS bytes,
        arg_max(asn, bytes * 1000000 + fo) FILTER (WHERE asn <> 0) AS asn, arg_max(org, bytes * 1000000 + fo) FILTER (WHERE asn <> 0) AS org,
        arg_max(asn_label, bytes * 1000000 + fo) FILTER (WHERE asn <> 0) AS asn_label
        FROM fr WHERE b IN (SELECT ip FROM g WHERE kind = 'country') GROUP BY capture_id, code, label)
      SELECT capture_id, code AS country_code, label AS country_label, bytes, bytes / sum(bytes) OVER (PARTITION BY capture_id) AS ratio,
        CAST(coalesce(asn, 0) AS BIGINT) AS asn_number, coalesce(org, '') AS asn_organization, coalesce(asn_label, '') AS asn_label,
        row_number() OVER (PARTITION BY capture_id ORDER BY bytes DESC, code) AS rank FROM reg"""
    q["remote_asn"] = with_(*flows(True), G_CTE) + """SELECT z.capture_id, z.a AS a_ip, CAST(z.ap AS BIGINT) AS a_port, z.b AS b_ip, CAST(z.bp AS BIGINT) AS b_port,
      z.proto, z.r AS remote_ip, g.asn_label FROM (SELECT *, CASE WHEN (capture_id, b) IN (SELECT (capture_id, ip) FROM own) AND (capture_id, a) NOT IN (SELECT (capture_id, ip) FROM own) THEN a ELSE b END AS r FROM f) z
      JOIN g ON z.r = g.ip"""
    q["ptr_enrichment"] = with_(d_cte(), H_CTE, PTR) + ptr_query("SELECT capture_id, host AS ip, last_us AS as_of_us FROM h", "q.capture_id,")
    q["ptr_enrichment_flows"] = with_(*flows(), PTR) + ptr_query("SELECT DISTINCT capture_id, b AS ip, last_us AS as_of_us FROM f", "q.capture_id,")
    q["process_attribution"] = with_(*flows(), SOCK, process_cte("f")) + """SELECT capture_id, a AS a_ip, b AS b_ip, CAST(ap AS BIGINT) AS a_port,
      CAST(bp AS BIGINT) AS b_port, proto, process_name, process_pid, process_name AS process_bundle,
      CASE WHEN process_name = '' THEN '—' WHEN process_pid = 0 THEN process_name ELSE process_name || ' · ' || CAST(process_pid AS STRING) END AS process_label FROM pr"""
    q["process_bytes"] = with_(*flows(), SOCK, process_cte("f")) + """SELECT capture_id, a AS a_ip, b AS b_ip, CAST(ap AS BIGINT) AS a_port,
      CAST(bp AS BIGINT) AS b_port, proto, process_name, packets, bytes FROM pr WHERE process_name <> ''"""
    q["display_names"] = with_(d_cte(), H_CTE, G_CTE) + """SELECT capture_id, host, coalesce(sni, host) || CASE kind WHEN 'country' THEN ' · ' || code
      WHEN 'local' THEN ' · LOCAL' ELSE '' END AS display_name, CASE kind WHEN 'country' THEN code WHEN 'local' THEN 'LOCAL' ELSE '' END AS owner_code
      FROM h JOIN g ON h.host = g.ip"""
    # detectors
    q["signals_threshold"] = with_(TOT) + s_threshold()
    q["signals_watch_hosts"] = with_(d_cte(), H_CTE, TOT) + s_hosts("h")
    q["signals_watch_services"] = with_(d_cte(), S_CTE, TOT) + s_services("s")
    q["signals_watch_processes"] = with_(*flows(), TOT, SOCK, process_cte("f")) + s_processes("pr")
    q["signals_exfil"] = with_(*flows(), TOT) + s_exfil("f")
    q["signals_idle_tcp"] = with_(*flows(), SES, TOT) + s_idle("tcp")
    q["signals_p2p"] = with_(*flows(), TOT) + s_p2p("f")
    q["findings_merged"] = with_(*all_hits(None)) + f"SELECT {FINDING_OUT}, update_count FROM lg"
    q["findings_batch"] = with_(*all_hits(50)) + f"SELECT * FROM (SELECT row_number() OVER (PARTITION BY capture_id ORDER BY fo DESC) AS position, {FINDING_OUT}, update_count FROM lg) WHERE position <= 30"
    match = f"""CASE lg.pivot_kind WHEN 'sni' THEN contains(coalesce(c.sni, ''), lg.pivot_value) WHEN 'service' THEN contains(c.service_name, lg.pivot_value)
      WHEN 'process' THEN contains(c.process_name, lg.pivot_value)
      ELSE (contains(c.a, lg.pivot_value) OR contains(c.b, lg.pivot_value) OR contains(c.service_name, lg.pivot_value) OR contains(c.proto, lg.pivot_value)
            OR contains(coalesce(c.sni, ''), lg.pivot_value)) END"""
    q["finding_evidence"] = with_(*all_hits(None), C_CTE) + f"""
      , cp AS (SELECT c.*, pr.process_name FROM c JOIN pr ON c.capture_id = pr.capture_id AND c.a = pr.a AND c.b = pr.b AND c.proto = pr.proto
               AND c.ap IS NOT DISTINCT FROM pr.ap AND c.bp IS NOT DISTINCT FROM pr.bp)
      SELECT pivot_kind, pivot_value, process_name, {row_out()} FROM (
        SELECT lg.pivot_kind, lg.pivot_value, c.* FROM (SELECT DISTINCT capture_id, pivot_kind, pivot_value FROM lg) lg JOIN cp c
        ON lg.capture_id = c.capture_id AND lg.pivot_value <> '' AND {match}) z"""
    q["nearest_timeline_point"] = with_(*all_hits(None), T_CTE, COMPRESSED) + """SELECT m.capture_id, m.dedupe_key, m.second,
      arg_min(tl.second, abs(tl.second - m.second) * 1000 + point) AS point_second
      FROM (SELECT capture_id, dedupe_key, last_us // 1000000 AS second FROM lg) m JOIN tl ON m.capture_id = tl.capture_id GROUP BY ALL"""
    # export
    sev = "CASE severity WHEN 'info' THEN {} WHEN 'warning' THEN {} WHEN 'error' THEN {} END"
    q["cef_signal_lines"] = with_(*all_hits(None)) + f"""SELECT dedupe_key, '<' || CAST(128 + {sev.format(6, 4, 3)} AS STRING) || '>1 2025-01-01T00:00:00.123Z spark tracequilt - - CEF:0|tracequilt|tracequilt|0.1.0|'
      || kind || '|' || summary || '|' || CAST({sev.format(3, 6, 8)} AS STRING) || '|rt=1735689600123 cat=signal externalId=' || id || ' msg=' || replace(summary || ' — ' || detail, '=', '\\=')
      || ' cs1=' || subject || ' cs1Label=Subject cs2=offline cs2Label=Mode cs3=finding cs3Label=Status cs4=' || kind || ' cs4Label=SignalKind'
      || CASE WHEN pivot_kind = 'none' THEN '' ELSE ' cs5=' || pivot_kind || ' cs5Label=PivotKind cs6=' || pivot_value || ' cs6Label=PivotValue '
           || CASE pivot_kind WHEN 'host' THEN 'dst=' || pivot_value WHEN 'sni' THEN 'request=' || pivot_value
             WHEN 'process' THEN 'sproc=' || pivot_value || ' sourceProcessName=' || pivot_value ELSE 'app=' || pivot_value END END
      || ' cfp1=' || printf('%.2f', confidence) || ' cfp1Label=Confidence outcome=finding' AS value FROM (SELECT DISTINCT ON (capture_id, id) * FROM lg ORDER BY fo DESC)"""
    def nested(name: str, row: str, source: str, order: str) -> str:
        """Top three rows of ``source`` per capture as JSON text."""
        return f"""{name} AS (SELECT capture_id, string_agg('{{"rank":' || CAST(rank AS STRING) || {row} || '}}', ',' ORDER BY rank) AS body FROM (
          SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY {order}) AS rank FROM {source}) WHERE rank <= 3 GROUP BY capture_id)"""

    def member(key: str, value: str, text: bool = True) -> str:
        return f"""',"{key}":' || """ + (f"""'"' || {value} || '"'""" if text else f"CAST({value} AS STRING)")

    placed = [member("country_label", "g.label"), member("asn_label", "g.asn_label")]
    host_row = " || ".join([member("host", "host"), member("bytes", "bytes", False), *placed]).replace("g.", "")
    flow_row = " || ".join([member("a_ip", "a"), member("b_ip", "b"), member("bytes", "bytes", False), *placed]).replace("g.", "")
    lists = [
        nested("nh", host_row, "(SELECT h.*, g.label, g.asn_label FROM h JOIN g ON h.host = g.ip)", "bytes DESC, packets DESC, hk"),
        nested("nf", flow_row, "(SELECT f.*, g.label, g.asn_label FROM f JOIN g ON f.b = g.ip)", FLOW_ORDER),
        nested("ns", member("service", "service") + " || " + member("bytes", "bytes", False), "s", f"bytes DESC, packets DESC, service, {PROTO_RANK}"),
        nested("nl", member("dedupe_key", "dedupe_key") + " || " + member("severity", "severity"), "lg", "fo DESC"),
    ]
    q["report_rows"] = with_(*all_hits(3), T_CTE, G_CTE, *lists) + """SELECT tot.capture_id, '{"capture_id":"' || tot.capture_id || '","packets":' || CAST(tot.packets AS STRING)
      || ',"bytes":' || CAST(tot.bytes AS STRING) || ',"ticks":' || CAST(n.ticks AS STRING) || ',"gaps":' || CAST(n.gaps AS STRING) || ',"silent_seconds":' || CAST(n.silent AS STRING)
      || ',"top_hosts":[' || nh.body || '],"top_connections":[' || nf.body || '],"top_services":[' || ns.body || '],"findings":[' || nl.body || ']}' AS document
      FROM tot JOIN (SELECT capture_id, count(*) AS ticks, count(*) FILTER (WHERE gap > 0) AS gaps, CAST(sum(gap) AS BIGINT) AS silent FROM t GROUP BY capture_id) n
        ON tot.capture_id = n.capture_id JOIN nh ON nh.capture_id = tot.capture_id JOIN nf ON nf.capture_id = tot.capture_id
        JOIN ns ON ns.capture_id = tot.capture_id JOIN nl ON nl.capture_id = tot.capture_id"""
    q["severity_map"] = with_(*all_hits(None)) + f"SELECT DISTINCT severity, CAST({sev.format(3, 6, 8)} AS BIGINT) AS cef_severity, CAST(128 + {sev.format(6, 4, 3)} AS BIGINT) AS priority FROM hits"
    q["escaped_texts"] = """SELECT page_id, md5(replace(replace(replace(replace(html, '\\', '\\\\'), '=', '\\='), chr(10), '\\n'), chr(13), '')) AS value_md5,
      md5(replace(replace(replace(replace(url, '\\', '\\\\'), '|', '\\|'), chr(10), ' '), chr(13), ' ')) AS header_md5 FROM pages"""
    # recurrences, written as recursive SQL
    q["live_cooldown"] = with_(*TICK_D).replace("WITH ", "WITH RECURSIVE ", 1) + """
      , hx AS (SELECT capture_id, tick, host, coalesce(arg_min(hsni, seq) FILTER (WHERE hsni IS NOT NULL), '') AS sni FROM (
           SELECT capture_id, tick, seq, src AS host, NULL AS hsni FROM dt UNION ALL
           SELECT capture_id, tick, seq, dst, CASE WHEN src <> dst THEN sni END FROM dt) GROUP BY capture_id, tick, host),
      fl AS (SELECT capture_id, tick, a, b, ap, bp, proto FROM dt GROUP BY ALL),
      occ AS (SELECT capture_id, 'WatchedEntityTransmitted|host|' || host AS k, 'entity' AS c, 20 AS w, tick FROM hx
                WHERE contains(host, '8.8.8') OR contains(lower(sni), 'h1.example')
              UNION SELECT capture_id, 'KnownBadHostTransmitted|host|' || host, 'entity', 20, tick FROM hx WHERE contains(host, '210.140.92.187')
              UNION SELECT capture_id, 'UnauthorizedP2pOrProxy|port|' || CAST(coalesce(bp, 0) AS STRING) || '|' || b, 'dpi', 60, tick FROM fl
                WHERE (bp BETWEEN 6881 AND 6889 OR ap BETWEEN 6881 AND 6889 OR bp = 9050 OR ap = 9050)
                  AND coalesce(bp, 0) NOT BETWEEN 9050 AND 9050 AND coalesce(ap, 0) <> 9050),
      num AS (SELECT *, row_number() OVER (PARTITION BY capture_id, k ORDER BY tick) AS n FROM occ),
      step AS (SELECT capture_id, k, c, w, tick, n, TRUE AS emitted, tick AS last_tick FROM num WHERE n = 1
               UNION ALL SELECT num.capture_id, num.k, num.c, num.w, num.tick, num.n, num.tick - s.last_tick >= num.w,
                 CASE WHEN num.tick - s.last_tick >= num.w THEN num.tick ELSE s.last_tick END
               FROM step s JOIN num ON num.capture_id = s.capture_id AND num.k = s.k AND num.n = s.n + 1)
      SELECT capture_id, k AS dedupe_key, c AS cooldown, tick * 1000000 AS as_of_us, emitted FROM step"""
    gate = with_(*TICK_D).replace("WITH ", "WITH RECURSIVE ", 1) + """
      , tf AS (SELECT capture_id, tick, a, b, ap, bp, proto, count(*) AS packets, sum(len) AS bytes, coalesce(sum(len) FILTER (WHERE dir = 'inbound'), 0) AS bytes_in,
                 coalesce(sum(len) FILTER (WHERE dir = 'outbound'), 0) AS bytes_out, arg_min(sni, seq) FILTER (WHERE sni IS NOT NULL) AS sni FROM dt GROUP BY ALL),
      ru AS (SELECT capture_id, tick, a, b, ap, bp, proto, sum(packets) OVER w AS packets, sum(bytes) OVER w AS bytes, sum(bytes_in) OVER w AS bytes_in,
               sum(bytes_out) OVER w AS bytes_out, first_value(sni IGNORE NULLS) OVER w AS sni
             FROM tf WINDOW w AS (PARTITION BY capture_id, a, b, ap, bp, proto ORDER BY tick ROWS UNBOUNDED PRECEDING)),
      nm AS (SELECT *, capture_id || '|' || a || '|' || b || '|' || coalesce(ap, -1) || '|' || coalesce(bp, -1) || '|' || proto AS k,
               row_number() OVER (PARTITION BY capture_id, a, b, ap, bp, proto ORDER BY tick) AS n FROM ru WHERE bytes >= 2000),
      st AS (SELECT k, n, TRUE AS sent, bytes AS lb, tick AS lt FROM nm WHERE n = 1
             UNION ALL SELECT nm.k, nm.n, nm.bytes - st.lb >= 4000 OR nm.tick - st.lt >= 86400,
               CASE WHEN nm.bytes - st.lb >= 4000 OR nm.tick - st.lt >= 86400 THEN nm.bytes ELSE st.lb END,
               CASE WHEN nm.bytes - st.lb >= 4000 OR nm.tick - st.lt >= 86400 THEN nm.tick ELSE st.lt END FROM st JOIN nm ON nm.k = st.k AND nm.n = st.n + 1),
      ex AS (SELECT capture_id, a, b, ap, bp, proto, tick, CAST(packets AS BIGINT) AS packets, CAST(bytes AS BIGINT) AS bytes,
               CAST(bytes_in AS BIGINT) AS bytes_in, CAST(bytes_out AS BIGINT) AS bytes_out, sni FROM nm JOIN st ON nm.k = st.k AND nm.n = st.n WHERE sent),
      cl AS (SELECT f.capture_id, f.a, f.b, f.ap, f.bp, f.proto, f.last + 86400 AS tick FROM (
               SELECT capture_id, a, b, ap, bp, proto, sum(len) AS bytes, max(tick) AS last FROM dt GROUP BY ALL) f
             JOIN (SELECT capture_id, max(tick) AS stop FROM px GROUP BY capture_id) e ON f.capture_id = e.capture_id
             WHERE f.bytes >= 2000 AND f.last + 86400 <= e.stop)"""
    gate_out = "capture_id, a AS a_ip, b AS b_ip, CAST(ap AS BIGINT) AS a_port, CAST(bp AS BIGINT) AS b_port, proto, tick"
    q["export_gate"] = gate + f"SELECT {gate_out}, packets, bytes, bytes_in, bytes_out, sni, 'active' AS event FROM ex"
    q["closed_flows"] = gate + f"SELECT {gate_out}, 'closed' AS event FROM cl"
    q["cef_flow_lines"] = gate + """
      , ev AS (SELECT capture_id, tick, 'active' AS event, 'update' AS act, a, b, ap, bp, proto, packets, bytes_in, bytes_out, sni FROM ex
               UNION ALL SELECT capture_id, tick, 'closed', 'end', a, b, ap, bp, proto, 0, 0, 0, NULL FROM cl)
      SELECT capture_id, tick, '<134>1 ' || strftime(make_timestamp(tick * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') || ' spark tracequilt - - CEF:0|tracequilt|tracequilt|0.1.0|flow:' || act
      || '|Network flow ' || act || '|0|rt=' || CAST(tick * 1000 AS STRING) || ' cat=traffic src=' || a || ' dst=' || b
      || CASE WHEN ap > 0 THEN ' spt=' || CAST(ap AS STRING) ELSE '' END || CASE WHEN bp > 0 THEN ' dpt=' || CAST(bp AS STRING) ELSE '' END
      || ' proto=' || proto || ' in=' || CAST(bytes_in AS STRING) || ' out=' || CAST(bytes_out AS STRING) || ' cn1=' || CAST(packets AS STRING) || ' cn1Label=Packets act=' || act
      || CASE WHEN sni IS NOT NULL THEN ' request=' || sni || ' destinationDnsDomain=' || sni ELSE '' END || ' cs2=session cs2Label=Direction msg=flow ' || event || ' ' || a || ':' || CAST(coalesce(ap, 0) AS STRING)
      || ' -> ' || b || ':' || CAST(coalesce(bp, 0) AS STRING) || ' out\\=' || CAST(bytes_out AS STRING) || ' in\\=' || CAST(bytes_in AS STRING) || ' pkts\\=' || CAST(packets AS STRING) AS value
      FROM ev"""
    # decode: a ClientHello replaces the payload of packets that carry a name
    pay = "CASE WHEN NOT decoded THEN 0 WHEN sni IS NOT NULL THEN 61 + length(sni) ELSE pay END"
    pay = f"CAST({pay} AS BIGINT)"
    seen = "CASE WHEN decoded THEN {} END"
    q["decode_frames"] = with_() + f"""SELECT seq, us AS ts_us, {seen.format('src')} AS src_ip, {seen.format('dst')} AS dst_ip, CAST({seen.format('sp')} AS BIGINT) AS src_port,
      CAST({seen.format('dp')} AS BIGINT) AS dst_port, {seen.format('proto')} AS proto, CAST({seen.format('flags')} AS BIGINT) AS tcp_flags, len AS packet_len, {pay} AS payload_len,
      {seen.format('sni')} AS sni, CAST({seen.format('arp_op')} AS BIGINT) AS arp_op, decoded FROM p"""
    link = """CASE WHEN proto = 'arp' THEN CASE seq % 3 WHEN 0 THEN 1 WHEN 1 THEN 113 ELSE 276 END
      ELSE CASE seq % 7 WHEN 0 THEN 1 WHEN 1 THEN 101 WHEN 2 THEN CASE WHEN src LIKE '%:%' THEN 229 ELSE 228 END WHEN 3 THEN 0 WHEN 4 THEN 108 WHEN 5 THEN 113 ELSE 276 END END"""
    q["decode_link_types"] = with_() + f"""SELECT CAST({link} AS BIGINT) AS link_type, CAST(count(*) AS BIGINT) AS frames, CAST(count(*) FILTER (WHERE decoded) AS BIGINT) AS decoded_frames FROM p GROUP BY 1"""
    q["mixed_link_types"] = with_() + f"SELECT capture_id, CAST(count(DISTINCT {link}) AS BIGINT) AS link_types, count(DISTINCT {link}) > 1 AS mixed FROM p GROUP BY capture_id"
    q["sni_from_frames"] = with_() + "SELECT sni, CAST(count(*) AS BIGINT) AS hellos FROM p WHERE decoded AND sni IS NOT NULL GROUP BY sni"
    q["decoded_top_connections"] = q["top_connections"]
    q["pcap_round_trip"] = with_() + f"""SELECT {seen.format('proto')} AS proto, decoded, CAST(count(*) AS BIGINT) AS packets, CAST(sum(len) AS BIGINT) AS bytes, min(us) AS first_us,
      max(us) AS last_us, CAST(sum({pay}) AS BIGINT) AS payload_bytes, CAST(count({seen.format('sni')}) AS BIGINT) AS hellos FROM p GROUP BY 1, 2"""
    # streams: every packet in its own second, late ones and the last second included
    q["stream_running_totals"] = with_() + """SELECT capture_id, CAST(count(*) AS BIGINT) AS packets, CAST(sum(len) AS BIGINT) AS bytes, max(us) AS last_packet_us
      FROM p GROUP BY capture_id"""
    q["stream_running_services"] = with_(d_cte()) + "SELECT capture_id, service, proto, CAST(count(*) AS BIGINT) AS packets, CAST(sum(len) AS BIGINT) AS bytes FROM d GROUP BY ALL"
    q["stream_ticks"] = with_(d_cte()) + """SELECT p.capture_id, CAST(count(DISTINCT p.sec) AS BIGINT) AS ticks, CAST(count(*) AS BIGINT) AS packets, CAST(sum(p.len) AS BIGINT) AS bytes,
      CAST(coalesce(sum(p.len) FILTER (WHERE dir = 'inbound'), 0) AS BIGINT) AS bytes_in, CAST(coalesce(sum(p.len) FILTER (WHERE dir = 'outbound'), 0) AS BIGINT) AS bytes_out
      FROM p LEFT JOIN d ON p.seq = d.seq GROUP BY p.capture_id"""
    # streams that must end where the batch tables are
    for name, table in (("stream_cooldown", "live_cooldown"), ("stream_idle_ticks", "tick_gap_fill"), ("stream_flow_table", "flow_table"),
                        ("stream_host_table", "host_table"), ("stream_top_connections", "top_connections"), ("stream_names", "ptr_enrichment"),
                        ("stream_late_countries", "country_lookup")):
        q[name] = q[table]
    q["stream_export_gate"] = f"SELECT * EXCLUDE (sni) FROM ({q['export_gate']})"
    q["stream_fold_late"] = f"SELECT capture_id, tick, packets, bytes FROM ({q['tick_totals']})"
    q["host_rows"] = with_(d_cte(), H_CTE, G_CTE) + """SELECT h.capture_id, h.host, h.packets, h.bytes, g.label AS country_label, '' AS hostname, g.org AS asn_organization,
      g.asn_label, coalesce(h.sni, '') AS sni, CAST(g.asn AS BIGINT) AS asn_number FROM h JOIN g ON g.ip = h.host"""
    q["service_rows"] = with_(d_cte(), S_CTE) + "SELECT capture_id, service AS name, proto AS transport, packets, bytes FROM s"
    q["watch_table_hosts"] = with_(d_cte(), H_CTE) + """, pat AS (SELECT DISTINCT lower(trim(x)) AS p FROM (SELECT unnest(['8.8.8', 'H1.example', '210.140.92.187']) AS x
        UNION ALL SELECT 'Order-' || CAST(o_orderkey AS STRING) || '.invalid' FROM orders UNION ALL SELECT ' 10.0.' || CAST(s_suppkey % 256 AS STRING) || '.' FROM supplier))
      SELECT h.capture_id, h.host, CAST(count(DISTINCT p) AS BIGINT) AS n_patterns, string_agg(DISTINCT p, '|' ORDER BY p) AS patterns
      FROM h JOIN pat ON contains(h.host, p) OR contains(lower(coalesce(h.sni, '')), p) GROUP BY h.capture_id, h.host"""
    return q

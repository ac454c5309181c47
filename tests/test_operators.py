"""Edge rows, brute-force comparisons and order independence."""

import ipaddress
import random

import pytest
from helpers import packets

from tracequilt import constants as C, schema
from tracequilt.functions import cef, clock, ip, text
from tracequilt.operators import aggregates as agg, classify, enrich, export, findings as fnd, gates, inspect as ins, patterns, ranking, ticks
from tracequilt.operators.rollup import rollup

SEC = 1_000_000


def local(spark, *ips):
    return spark.createDataFrame([("c", i) for i in ips], "capture_id string, ip string")


def flows_of(spark, rows, own=None, offline=True):
    return agg.flows(agg.classified(rollup(packets(spark, rows)), own, offline))


def test_addresses(spark):
    samples = ["1.2.3.4", "::", "::1", "fe80::1", "2606:4700::2", "1:0:0:2:0:0:0:3", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "0:0:1::",
               "fd00::1:0:0:2", "255.255.255.255", "224.0.0.9", "169.254.1.1", "172.31.0.1", "172.32.0.1", "ff02::fb", "0.0.0.0"]
    rng = random.Random(1)
    samples += [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(20)]
    samples += [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & ~(0xFFFFFFFF << 32 * rng.randrange(4)))) for _ in range(20)]
    frame = spark.createDataFrame([(s,) for s in samples], "t string").selectExpr("t", f"{ip.from_text('t')} AS b")
    rows = frame.selectExpr("t", "b", f"{ip.to_text('b')} AS back", f"{ip.scope('b')} AS scope").collect()
    for r in rows:
        want = ipaddress.ip_address(r.t)
        assert bytes(r.b) == want.packed
        shown = f"::ffff:{want.ipv4_mapped}" if want.version == 6 and want.ipv4_mapped else str(want)
        assert r.back == shown
    scopes = {r.t: r.scope for r in rows}
    assert [scopes[s] for s in ("::", "::1", "fe80::1", "2606:4700::2", "255.255.255.255", "224.0.0.9", "169.254.1.1", "172.31.0.1", "172.32.0.1", "ff02::fb", "0.0.0.0")] == [
        "unspecified", "loopback", "link_local", "public", "broadcast", "multicast", "link_local", "private", "public", "multicast", "unspecified"]
    junk = spark.createDataFrame([("bad",), ("1.2.3.256",), ("1.2.3",), ("1:2",), ("",)], "t string")
    assert junk.selectExpr(f"{ip.from_text('t')} AS b").where("b IS NOT NULL").count() == 0


def test_reverse_path_merges(spark):
    rows = [dict(src_ip="10.77.4.25", dst_ip="8.8.8.8", src_port=50123, dst_port=53, packet_len=60),
            dict(src_ip="8.8.8.8", dst_ip="10.77.4.25", src_port=53, dst_port=50123, packet_len=120)]
    (flow,) = flows_of(spark, rows, local(spark, "10.77.4.25"), offline=False).collect()
    assert (flow.bytes, flow.bytes_out, flow.bytes_in, flow.a_port) == (180, 60, 120, 50123)
    (flow,) = flows_of(spark, [dict(src_ip="8.8.8.8", dst_ip="192.168.1.10", src_port=53, dst_port=53000)]).collect()
    assert (bytes(flow.a_bin), flow.a_port) == (ipaddress.ip_address("192.168.1.10").packed, 53000)


def test_canonical_order_without_a_local_side(spark):
    rows = [dict(src_ip="9.9.9.9", dst_ip="8.8.8.8", src_port=2, dst_port=1), dict(src_ip="8.8.8.8", dst_ip="9.9.9.9", src_port=1, dst_port=2),
            dict(src_ip="2001:db8::1", dst_ip="8.8.8.8", src_port=2, dst_port=1), dict(src_ip="10.0.0.1", dst_ip="10.0.0.1", src_port=9, dst_port=3)]
    got = flows_of(spark, rows).selectExpr(f"{ip.to_text('a_bin')} AS a", "a_port", "packets").collect()
    assert sorted(map(tuple, got)) == [("10.0.0.1", 3, 1), ("8.8.8.8", 1, 1), ("8.8.8.8", 1, 2)]


def test_directions(spark):
    pairs = [("127.0.0.1", "127.0.0.2"), ("0.0.0.0", "8.8.8.8"), ("10.0.0.1", "8.8.8.8"), ("8.8.8.8", "10.0.0.1"), ("10.0.0.1", "10.0.0.2"), ("1.1.1.1", "8.8.8.8")]
    rows = [dict(src_ip=a, dst_ip=b) for a, b in pairs]

    def got(own, offline):
        table = agg.classified(rollup(packets(spark, rows)), own, offline).select("first_seq", "direction").collect()
        return [r.direction for r in sorted(table)]

    assert got(None, True) == ["loopback", "unknown", "outbound", "inbound", "unknown", "unknown"]
    assert got(None, False) == ["loopback", "unknown"] + ["unknown"] * 4
    assert got(local(spark, "10.0.0.1", "1.1.1.1"), False) == ["loopback", "unknown", "outbound", "inbound", "outbound", "outbound"]


def test_service_choice(spark):
    cases = [("tcp", 50000, 443, "outbound", None), ("tcp", 443, 50000, "inbound", None), ("udp", 443, 50000, "inbound", None), ("tcp", 22, 50000, "unknown", None),
             ("tcp", 25, 22, "loopback", None), ("udp", 5353, 5353, "unknown", None), ("tcp", 50000, 60000, "outbound", None), ("arp", None, None, "unknown", 1),
             ("arp", None, None, "outbound", 9), ("icmp", None, None, "loopback", None), ("other", None, None, "outbound", None), ("tcp", 1024, 8080, "unknown", None)]
    frame = spark.createDataFrame(cases, "proto string, src_port int, dst_port int, direction string, arp_op int")
    got = classify.with_service(frame).selectExpr("service", f"{classify.confidence_label()} AS c").collect()
    assert [tuple(r) for r in got] == [
        ("https", "high"), ("https", "high"), ("quic", "high"), ("ssh", "medium"), ("ssh", "low"), ("mdns", "medium"), ("unknown", "low"), ("arp-request", "medium"),
        ("arp", "high"), ("icmp", "high"), ("unknown", "low"), ("unknown", "low")]


def test_self_addressed_host_counts_twice(spark):
    rows = [dict(src_ip="10.0.0.1", dst_ip="10.0.0.1", src_port=1, dst_port=2, packet_len=100, proto="tcp", tcp_flags=16, sni="x.org")]
    (host,) = agg.hosts(agg.classified(rollup(packets(spark, rows)))).collect()
    assert (host.packets, host.bytes, host.sni) == (2, 200, None)


def test_rank_ties(spark):
    table = spark.createDataFrame([("c", "a", "tcp", 10, 2), ("c", "b", "tcp", 30, 1), ("c", "c", "tcp", 30, 5), ("c", "c", "udp", 30, 5)],
                                  "capture_id string, service string, proto string, bytes bigint, packets bigint")
    top = ranking.rank_by_traffic(table, "services", 3).orderBy("rank").collect()
    assert [(r.service, r.proto) for r in top] == [("c", "tcp"), ("c", "udp"), ("b", "tcp")]
    assert [r.service for r in ranking.rank_by_traffic(table, "services").collect()] == ["c", "c", "b", "a"]
    assert [ranking.normalize_top_n(n) for n in (0, 7, 500)] == [10, 7, 100]


def fold_state(flags):
    state = "ESTABLISHED"
    for f in flags:
        if f & 4:
            state = "RST"
        elif f & 1:
            state = "FIN"
        elif f & 2 and not f & 16:
            state = state if state in ("RST", "FIN") else "INIT"
        elif f & 2:
            state = "SYN_ACK"
        else:
            state = "ESTABLISHED"
    return state


def test_tcp_state_equals_a_fold_in_arrival_order(spark):
    rng = random.Random(5)
    rows, want, seq = [], {}, 0
    for session in range(150):
        flags = [rng.choice([2, 18, 16, 24, 17, 20, 4, 1, 0, 3, 6]) for _ in range(rng.randint(1, 7))]
        want[1000 + session] = (fold_state(flags), sum(f & 2 > 0 for f in flags), sum(f & 1 for f in flags), sum(f & 4 > 0 for f in flags))
        for f in flags:
            back = rng.random() < 0.5
            ends = [("9.9.9.9", 80), ("10.0.0.1", 1000 + session)]
            (a, ap), (b, bp) = ends if back else ends[::-1]
            rows.append(dict(seq=seq, ts_us=rng.randint(0, 10**9), src_ip=a, dst_ip=b, src_port=ap, dst_port=bp, proto="tcp", tcp_flags=f))
            seq += 1
    rng.shuffle(rows)
    got = agg.tcp_sessions(flows_of(spark, rows)).collect()
    assert {r.endpoint_a_port: (r.state, r.syn_count, r.fin_count, r.rst_count) for r in got} == want


def test_tcp_key_uses_text_order(spark):
    rows = [dict(src_ip="9.9.9.9", dst_ip="10.0.0.1", src_port=80, dst_port=5, proto="tcp", tcp_flags=2)]
    session = agg.tcp_sessions(flows_of(spark, rows)).first()
    assert (session.endpoint_a_ip, session.initiator) == ("10.0.0.1", "9.9.9.9:80")


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_late_packets_fold_into_the_open_tick(spark, block):
    rng = random.Random(block)
    seconds = [5, 3, 6] + [rng.randint(0, 40) for _ in range(60)]
    rows = [dict(seq=i, ts_us=s * SEC + 1, src_ip="1.1.1.1", dst_ip="2.2.2.2") for i, s in enumerate(seconds)]
    table = ticks.assign_ticks(packets(spark, rows).repartition(3), block_seqs=block).orderBy("seq").collect()
    peak, want = 0, []
    for s in seconds:
        peak = max(peak, s)
        want.append(peak)
    assert [r.tick for r in table] == want
    assert ticks.assign_ticks(packets(spark, rows), late="event_time").where(f"seq = 1 AND tick = {seconds[1]}").count() == 1


def tick_frame(spark, rows):
    return spark.createDataFrame([("c", *r) for r in rows], "capture_id string, tick bigint, packets bigint, bytes bigint, bytes_in bigint, bytes_out bigint, gap_seconds bigint")


def test_timelines(spark):
    short = tick_frame(spark, [(10, 1, 5, 2, 3, 3), (14, 1, 7, 4, 3, 0)])
    points = ticks.timeline_compressed(short).orderBy("point").collect()
    assert [(p.second, p.bytes_in) for p in points] == [(10, 2), (11, 0), (12, 0), (13, 0), (14, 4)]
    assert sorted((p.second, p.bytes_in) for p in ticks.timeline_live(short).collect()) == [(10, 2), (13, 0), (14, 4)]
    assert sorted((r.tick, r.filled) for r in ticks.fill_gaps(short).collect()) == [(10, False), (11, True), (12, True), (13, True), (14, False)]
    wide = ticks.fill_gaps(tick_frame(spark, [(5, 1, 1, 1, 1, 200_000), (200_006, 1, 1, 1, 1, 0)]))
    assert [tuple(r) for r in wide.selectExpr("count(1)", "count(distinct tick)", "min(tick)", "max(tick)").collect()] == [(200_002, 200_002, 5, 200_006)]
    long = ticks.timeline_compressed(tick_frame(spark, [(60 * i, 1, 3, 1, 2, 59) for i in range(241)])).orderBy("point").collect()
    assert (len(long), long[0].second, long[-1].second, sum(p.bytes_in for p in long), sum(p.bytes_out for p in long)) == (160, 0, 14400, 241, 482)
    assert ticks.last_ticks(short, 1).first().tick == 14 and ticks.timeline_peak(ticks.timeline_compressed(short)).first().peak == 4


def test_results_do_not_depend_on_row_order(spark):
    rng = random.Random(3)
    rows = [dict(seq=i, ts_us=rng.randint(0, 10**8), src_ip=f"10.0.0.{rng.randint(1, 4)}", dst_ip="8.8.8.8", src_port=5, dst_port=443, proto="tcp",
                 tcp_flags=rng.choice([2, 16, 17]), sni=rng.choice([None, "a.org", "b.org"])) for i in range(80)]
    one = sorted(map(str, flows_of(spark, rows).collect()))
    rng.shuffle(rows)
    assert one == sorted(map(str, agg.flows(agg.classified(rollup(packets(spark, rows).repartition(7)))).collect()))


def test_range_lookup_equals_brute_force(spark):
    nets = ["1.0.0.0/8", "2.0.0.0/7", "8.8.8.0/24", "8.8.9.0/25", "9.0.0.0/30", "64.0.0.0/3", "2001:db8::/32", "2600::/12", "2a00:1450:4000::/37", "fc::/16"]
    blocks = enrich.geo_blocks(spark.createDataFrame(
        [(str(n.network_address), str(n.broadcast_address), str(n), None) for n in map(ipaddress.ip_network, nets)], "start_ip string, end_ip string, code string, name string"))
    rng = random.Random(2)
    asked = ["8.8.8.8", "8.8.9.127", "8.8.9.128", "3.255.255.255", "95.255.255.255", "10.0.0.1", "127.0.0.1", "2001:db8::5", "260f::1", "2610::1", "2a00:1450:4001::1"]
    asked += [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(60)]
    frame = spark.createDataFrame([(a,) for a in asked], "t string").selectExpr("t", f"{ip.from_text('t')} AS ip_bin")
    got = {r.t: r.country_code for r in enrich.add_country(frame, "ip_bin", blocks).collect()}
    for a in asked:
        address = ipaddress.ip_address(a)
        hit = [n for n in nets if address.version == ipaddress.ip_network(n).version and address in ipaddress.ip_network(n)]
        want = "LO" if address.is_loopback else "LOCAL" if a.startswith("10.") else hit[0] if hit else "ZZ"
        assert got[a] == want, a


def test_names_live_by_the_latest_record(spark):
    records = spark.createDataFrame([("8.8.8.8", "dns.google.", 0), ("8.8.8.8", None, 400 * SEC), ("9.9.9.9", "9.9.9.9", 0), ("10.0.0.1", "inside", 0)],
                                    "ip string, hostname string, observed_us bigint")
    asked = [("8.8.8.8", 0), ("8.8.8.8", 299), ("8.8.8.8", 300), ("8.8.8.8", 399), ("8.8.8.8", 401), ("9.9.9.9", 1), ("10.0.0.1", 1)]
    frame = spark.createDataFrame([(i, a, s * SEC) for i, (a, s) in enumerate(asked)], "n int, t string, as_of_us bigint").selectExpr("n", f"{ip.from_text('t')} AS ip_bin", "as_of_us")
    got = enrich.resolve_names(frame, records).orderBy("n").collect()
    assert [r.hostname for r in got] == ["dns.google", "dns.google", None, None, None, None, None]


def test_process_candidates(spark):
    rows = [dict(src_ip="8.8.8.8", dst_ip="9.9.9.9", src_port=443, dst_port=50000, proto="tcp", tcp_flags=16)]
    flows = flows_of(spark, rows).selectExpr("*", f"{10 * SEC} AS as_of_us")
    sockets = spark.createDataFrame([("c", 443, "tcp", 1, "nginx", "/usr/nginx", 9 * SEC), ("c", 50000, "tcp", 2, "Foo", "/Applications/Foo.app/Contents/MacOS/Foo", 5 * SEC)],
                                    "capture_id string, port int, proto string, pid int, name string, path string, observed_us bigint")
    got = enrich.attribute_processes(flows, sockets).first()
    assert (got.process_name, got.process_pid, got.process_bundle) == ("Foo", 2, "Foo")
    newer = sockets.union(spark.createDataFrame([("c", 50000, "tcp", None, None, None, 6 * SEC)], sockets.schema))
    assert enrich.attribute_processes(flows, newer).first().process_name == "nginx"
    owned = flows_of(spark, rows, local(spark, "8.8.8.8"), False).selectExpr("*", f"{10 * SEC} AS as_of_us")
    assert enrich.attribute_processes(owned, sockets).first().process_name == "nginx"
    paths = spark.createDataFrame([("/A/Foo.app/Contents/x",), ("/A/Bar.app",), ("/usr/bin/x",), (None,)], "p string")
    assert [r[0] for r in paths.selectExpr(text.bundle_name("p")).collect()] == ["Foo", "Bar", "", ""]


def test_regions_and_remote_hosts(spark):
    blocks = enrich.geo_blocks(spark.createDataFrame([("8.0.0.0", "8.255.255.255", "US", "United States"), ("9.0.0.0", "9.255.255.255", "JP", "Japan")], "start_ip string, end_ip string, code string, name string"))
    asns = enrich.geo_blocks(spark.createDataFrame([("8.8.8.0", "8.8.8.255", 15169, "Google")], "start_ip string, end_ip string, asn int, organization string"))
    rows = [dict(src_ip="10.0.0.1", dst_ip="8.8.8.8", packet_len=100), dict(src_ip="10.0.0.1", dst_ip="9.9.9.9", packet_len=100), dict(src_ip="10.0.0.1", dst_ip="10.0.0.2", packet_len=9800)]
    flows = flows_of(spark, rows)
    regions = enrich.top_regions(flows, blocks, asns, 5).orderBy("rank").collect()
    assert [(r.country_code, r.ratio, r.asn_label) for r in regions] == [("JP", 0.5, ""), ("US", 0.5, "AS15169 · Google")]
    hosts = agg.hosts(agg.classified(rollup(packets(spark, rows))))
    assert enrich.remote_hosts(hosts, blocks, local(spark, "9.9.9.9")).count() == 1


def table_of(spark, rows, policy, session=fnd.Session(), **kw):
    tables = agg.capture_tables(packets(spark, rows))
    return fnd.merge(fnd.occurrences(tables["totals"], tables, policy, session, **kw), session, keep=None)


def test_detectors(spark):
    rows = [dict(ts_us=0, src_ip="10.0.0.1", dst_ip="8.8.8.8", src_port=5000, dst_port=9050, proto="tcp", tcp_flags=16, packet_len=9000),
            dict(ts_us=1, src_ip="8.8.8.8", dst_ip="10.0.0.1", src_port=9050, dst_port=5000, proto="tcp", tcp_flags=16, packet_len=4000),
            dict(ts_us=2, src_ip="10.0.0.1", dst_ip="9.9.9.9", src_port=5001, dst_port=443, proto="tcp", tcp_flags=16, packet_len=70, sni="x.torproject.org"),
            dict(ts_us=90_000 * SEC, src_ip="10.0.0.1", dst_ip="7.7.7.7", src_port=1, dst_port=2)]
    policy = fnd.Policy(data_threshold_bytes=13_000, exfil_min_bytes=9000, exfil_ratio=2.25, idle_min_age_seconds=3600, idle_max_bytes=13_000)
    got = {r.dedupe_key: r for r in table_of(spark, rows, policy).collect()}
    assert sorted(got) == ["DataThresholdExceeded|13000", "LongIdleTcpConnection|10.0.0.1:5000-8.8.8.8:9050", "LongIdleTcpConnection|10.0.0.1:5001-9.9.9.9:443",
                           "UnauthorizedP2pOrProxy|port|443|9.9.9.9", "UnauthorizedP2pOrProxy|port|9050|8.8.8.8", "UnidirectionalLargeTransfer|8.8.8.8|9050"]
    assert "ratio 2.2x, min 9000, ratio≥2.25)" in got["UnidirectionalLargeTransfer|8.8.8.8|9050"].detail
    assert got["UnauthorizedP2pOrProxy|port|443|9.9.9.9"].confidence == 0.6
    assert got["UnauthorizedP2pOrProxy|port|443|9.9.9.9"].pivot_value == "x.torproject.org"
    off = fnd.Policy(data_threshold_bytes=0, exfil_enabled=False, idle_enabled=False, p2p_allow=("port:9050", "sni:x"))
    assert table_of(spark, rows, off).count() == 0


def test_watch_list_and_merge(spark):
    assert fnd.parse_patterns([" sni:a ", "service:dns", "process: x ", "host:h", "1.2", "Service:y", " "]) == {"host": ("a", "h", "1.2", "Service:y"), "service": ("dns",), "process": ("x",)}
    rows = [dict(src_ip="10.0.0.1", dst_ip="8.8.8.8", src_port=5, dst_port=53), dict(src_ip="10.0.0.1", dst_ip="8.8.8.8", src_port=5, dst_port=53, proto="tcp", tcp_flags=16)]
    policy = fnd.Policy.of(watched=["8.8.8.8", "service:DNS", ""], data_threshold_bytes=-5)
    got = {r.dedupe_key: r for r in table_of(spark, rows, policy).collect()}
    assert got["WatchedEntityTransmitted|service|dns"].update_count == 2 and got["WatchedEntityTransmitted|host|8.8.8.8"].status == "finding"
    live = {r.dedupe_key: r.status for r in table_of(spark, rows, policy, fnd.Session.live()).collect()}
    assert live == {"WatchedEntityTransmitted|service|dns": "updated", "WatchedEntityTransmitted|host|8.8.8.8": "active"}


def greedy(times, wait):
    last, out = None, []
    for t in times:
        fresh = last is None or t - last >= wait
        out.append(fresh)
        last = t if fresh else last
    return out


def test_cooldown_equals_greedy(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for key in range(30):
        kind = rng.choice(sorted(C.COOLDOWN_SECONDS))
        times = sorted(rng.sample(range(400 * SEC), 80))
        rows += [("c", f"k{key}", kind, t) for t in times]
        want |= {(f"k{key}", t): e for t, e in zip(times, greedy(times, C.COOLDOWN_SECONDS[kind] * SEC))}
    frame = spark.createDataFrame(rows, "capture_id string, dedupe_key string, cooldown string, as_of_us bigint").repartition(5)
    assert {(r.dedupe_key, r.as_of_us): r.emitted for r in gates.cooldown(frame.union(frame)).collect()} == want


def gate_fold(rows, least, delta, interval):
    sent, out = None, []
    for tick, total in rows:
        if total < least:
            continue
        if sent is None or total - sent[1] >= delta or tick - sent[0] >= interval:
            sent = (tick, total)
            out.append(tick)
    return out


def test_export_gate_equals_fold(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for flow in range(20):
        port = None if flow % 5 == 0 else flow
        total, series = 0, []
        for tick in sorted(rng.sample(range(600), 60)):
            total += rng.randint(1, 900)
            series.append((tick, total))
        key = bytes([10, 0, 0, flow])
        rows += [("c", bytearray(key), bytearray(b"\x08\x08\x08\x08"), port, port, "tcp", t, 1, b, 0, b) for t, b in series]
        want[key] = gate_fold(series, 3000, 5000, 90)
    frame = spark.createDataFrame(rows, "capture_id string, a_bin binary, b_bin binary, a_port int, b_port int, proto string, tick bigint, packets bigint, bytes bigint, bytes_in bigint, bytes_out bigint")
    frame = frame.selectExpr("*", "CAST(NULL AS STRING) AS sni")
    out = gates.export_gate(frame.repartition(3), 3000, 5000, 90, start_on_first=True).collect()
    got = {}
    for r in sorted(out, key=lambda r: r.tick):
        assert r.event == ("active" if bytes(r.a_bin) in got else "start")
        got.setdefault(bytes(r.a_bin), []).append(r.tick)
    assert got == {k: v for k, v in want.items() if v}


def test_pivots_filters_and_evidence(spark):
    rows = [dict(src_ip="10.0.0.1", dst_ip=f"1.1.1.{i}", src_port=5000 + i, dst_port=443, proto="tcp", tcp_flags=16, sni=f"h{i}.example.com") for i in (1, 10, 2)]
    shown = ins.connection_rows(flows_of(spark, rows))
    assert ins.apply_pivot(shown, "peer", "1.1.1.1").count() == 2 and ins.apply_pivot(shown, "sni", "H2.").count() == 1
    assert ins.apply_pivot(shown, "odd-kind", "https").count() == 3 and ins.apply_pivot(shown, "dst", "1.1.1.2").count() == 1
    assert shown.where(ins.connection_filter(service="HTTPS", sni=" ")).count() == 3
    with pytest.raises(ValueError):
        ins.connection_filter(nope="x")
    log = spark.createDataFrame([("c", "k1", "host", "1.1.1.1"), ("c", "k2", "sni", "H2.example.com"), ("c", "k3", "none", ""), ("c", "k4", "service", "nothing")],
                                "capture_id string, dedupe_key string, pivot_kind string, pivot_value string")
    log = log.unionByName(log.selectExpr("capture_id", "concat(dedupe_key, 'b') AS dedupe_key", "pivot_kind", "pivot_value"))
    got = sorted((r.pivot_kind, r.destination_address) for r in ins.evidence(log, shown).collect())
    assert got == [("host", "1.1.1.1"), ("host", "1.1.1.10"), ("sni", "1.1.1.2")]
    summary = ins.summarize(shown, ins.search_filter("1.1.1.1")).first()
    assert (summary.total_rows, summary.visible_rows) == (3, 2)


def test_exclude_endpoint(spark):
    rows = [dict(src_ip="127.0.0.1", dst_ip="127.0.0.1", src_port=5, dst_port=50051, proto="tcp"), dict(src_ip="127.0.0.1", dst_ip="127.0.0.1", src_port=5, dst_port=50051),
            dict(src_ip="10.0.0.1", dst_ip="8.8.8.8", src_port=5, dst_port=50051, proto="tcp"), dict(decoded=False)]
    table = packets(spark, rows)
    assert [table.where(ins.exclude_endpoint(a, p)).count() for a, p in (("0.0.0.0", 50051), ("::", 50051), ("10.0.0.1", 50051), ("0.0.0.0", 0))] == [3, 3, 3, 4]


def test_nearest_point_prefers_the_earlier_on_a_tie(spark):
    axis = spark.createDataFrame([("c", s) for s in (0, 10, 20)], "capture_id string, second bigint")
    marks = spark.createDataFrame([("c", f"k{s}", s) for s in (-5, 4, 5, 6, 15, 99)], "capture_id string, dedupe_key string, second bigint")
    got = {r.second: r.point_second for r in ins.nearest_point(marks, axis).collect()}
    assert got == {-5: 0, 4: 0, 5: 0, 6: 10, 15: 10, 99: 20}


def test_cef_and_clock(spark):
    frame = spark.createDataFrame([("a\\b=c|d\ne\rf", 1_735_689_600_123_456, -1)], "v string, us bigint, neg bigint")
    row = frame.selectExpr(f"{cef.escape_value('v')} AS value", f"{cef.escape_header('v')} AS header", f"{clock.rfc3339_millis('us')} AS t",
                           f"{clock.second_of('neg')} AS s", f"{clock.rfc3339_millis('neg')} AS before", f"{clock.micros_of('2', '-5')} AS clamped").first()
    assert tuple(row) == ("a\\\\b\\=c|d\\nef", "a\\\\b=c\\|d e f", "2025-01-01T00:00:00.123Z", -1, "1969-12-31T23:59:59.999Z", 2_000_000)
    flow = spark.createDataFrame([("c", "closed", bytearray(b"\x0a\0\0\1"), None, bytearray(b"\x08\x08\x08\x08"), 53, "udp", "Inbound")],
                                 "capture_id string, event string, a_bin binary, a_port int, b_bin binary, b_port int, proto string, direction string")
    line = export.flow_lines(flow, "1000000L", export.Exporter("v|x", "p", "1", "host", " ")).first().value
    assert line == ("<134>1 1970-01-01T00:00:01.000Z host traffic-monitor - - CEF:0|v\\|x|p|1|flow:end|Network flow end|0|rt=1000 cat=traffic src=10.0.0.1 dst=8.8.8.8 dpt=53"
                    " proto=udp in=0 out=0 cn1=0 cn1Label=Packets act=end cs2=Inbound cs2Label=Direction deviceDirection=0 msg=flow closed 10.0.0.1:0 -> 8.8.8.8:53 out\\=0 in\\=0 pkts\\=0")
    labels = spark.createDataFrame([("US · United States",), ("Local",), ("Long label here",), ("",), ("x",)], "v string")
    assert [r[0] for r in labels.selectExpr(text.owner_code("v")).collect()] == ["US", "LOCAL", "LONG", "", ""]


def test_report_and_line_sinks(spark, tmp_path):
    tables = agg.capture_tables(packets(spark, [dict(src_ip="10.0.0.1", dst_ip="8.8.8.8", src_port=5, dst_port=53)]))
    top = ranking.rank_by_traffic(tables["services"], "services", 5)
    export.write_report(export.report_tables(tables["totals"], tables["totals"], tables["totals"], {"services": top}, tables["totals"]), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "services")).first().service == "dns"
    export.write_lines(export.flow_lines(tables["flows"], "0L"), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 1


def test_ratio_is_printed_like_the_exact_double(spark):
    rng = random.Random(4)
    pairs = [(403, 20), (81, 4), (83, 4), (1, 8), (5, 100), (199, 100), (999_999_999_999, 7), (25, 100), (75, 100), (7, 7), (0, 3)]
    pairs += [(rng.randint(0, 10**9), rng.randint(1, 10**5)) for _ in range(300)] + [(2 * rng.randint(0, 999) + 1, 4) for _ in range(100)]
    got = spark.createDataFrame(pairs, "n bigint, d bigint").selectExpr("n", "d", f"{fnd.one_decimal('n', 'd')} AS t").collect()
    assert [(r.n, r.d, r.t) for r in got if r.t != f"{r.n / r.d:.1f}"] == []


def test_flows_close_after_silence_while_the_capture_goes_on(spark):
    flow = "capture_id string, a_bin binary, b_bin binary, a_port int, b_port int, proto string, tick bigint, bytes bigint"
    a, b = bytearray([10, 0, 0, 1]), bytearray([8, 8, 8, 8])
    rows = [
        ("c", a, b, 1, 2, "tcp", 10, 500), ("c", a, b, 1, 2, "tcp", 20, 1500),  # closes at 20 + 60
        ("c", a, b, 1, None, "udp", 10, 900),  # never exported
        ("c", a, b, 3, 4, "tcp", 90, 5000),  # still seen
        ("d", a, b, 1, 2, "tcp", 20, 9000),  # its capture ends first
    ]
    ends = spark.createDataFrame([("c", 100), ("d", 70)], "capture_id string, end_tick bigint")
    got = gates.closed_flows(spark.createDataFrame(rows, flow), ends, 60, 1000).collect()
    assert [(r.capture_id, r.a_port, r.tick, r.event) for r in got] == [("c", 1, 80, "closed")]


def test_ticks_of_a_long_capture_in_linear_time(spark):
    """A hundred thousand seconds in one capture, every seventh packet late by more than a block of seconds."""
    rows = spark.range(100_000).selectExpr(
        "'long' AS capture_id", "id AS seq", "CASE WHEN id % 7 = 3 THEN greatest(id - 5000, 0) ELSE id END * 1000000L AS ts_us", "60L AS packet_len", "'1.1.1.1' AS src_ip",
        "'2.2.2.2' AS dst_ip", "0 AS payload_len",
    )
    table = ticks.tick_table(ticks.assign_ticks(schema.conform_packets(rows), block_seqs=1 << 12))
    got = [(r.tick, r.packets, r.sequence, r.gap_seconds) for r in table.orderBy("tick").collect()]
    want, peak = {}, -1
    for i in range(100_000):
        peak = max(peak, max(i - 5000, 0) if i % 7 == 3 else i)
        want[peak] = want.get(peak, 0) + 1
    seconds = sorted(want)
    nexts = [*seconds[1:], seconds[-1] + 1]
    assert got == [(s, want[s], i + 1, n - s - 1) for i, (s, n) in enumerate(zip(seconds, nexts))]


def test_pattern_tables_equal_a_direct_search(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", "Ab.Example", "xéy"]), "".join(rng.choice("abé.") for _ in range(rng.randint(0, 9)))) for i in range(200)]
    listed = [None, "  ", " AB ", "ab", "é.", "example", "b.b"] + ["".join(rng.choice("abé.") for _ in range(3)) for _ in range(30)]
    table = spark.createDataFrame(rows, "id long, one string, two string").repartition(3)
    want = {}
    for i, *texts in rows:
        hits = sorted({p.strip().lower() for p in listed if p and p.strip() and any(p.strip().lower() in (t or "").lower() for t in texts)})
        if hits:
            want[i] = hits
    for limit in (1 << 20, 20):  # one block, and a pass for every few patterns
        found = patterns.watched(table, {"one": "one", "two": "two"}, patterns.pattern_table(spark.createDataFrame([(p,) for p in listed], "pattern string")), limit)
        assert {r.id: r.patterns for r in found.collect()} == want and found.columns == [*table.columns, "patterns"]
    assert patterns.watched(table, {"one": "one"}, patterns.pattern_table(spark.createDataFrame([], "pattern string"))).count() == 0

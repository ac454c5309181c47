"""Streams give what batch gives."""

import random
import time

from helpers import packets
from test_operators import SEC, gate_fold, greedy
from pyspark.sql import functions as F

from tracequilt import constants as C
from tracequilt.operators import aggregates as agg, findings as fnd, ticks
from tracequilt.operators.rollup import rollup
from tracequilt.sources import pcap
from tracequilt.streaming import jobs, stateful


def as_stream(spark, table, path, files=3):
    """Write a table as ``files`` files that a stream reads one per batch, in time order."""
    names = table.columns
    key = next(n for n in ("ts_us", "as_of_us", "tick", "first_seq") if n in names)
    rows = table.orderBy(key).collect()
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size:(i + 1) * size], table.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream, tmp, mode="append"):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(f"t{random.randrange(1 << 40)}").option(
        "checkpointLocation", f"{tmp}/{random.randrange(1 << 40)}").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(query.name)


def sample(spark):
    rng = random.Random(11)
    rows = [dict(seq=i, ts_us=(i + 300) * SEC // 3, src_ip="10.0.0.1", dst_ip=rng.choice(["8.8.8.8", "9.9.9.9"]), src_port=rng.choice([1, 2]), dst_port=443, proto="tcp",
                 tcp_flags=rng.choice([2, 16, 17]), packet_len=rng.randint(60, 900), decoded=i % 10 != 0) for i in range(200)]
    return packets(spark, rows)


def test_published_ticks_give_the_batch_tables(spark, tmp_path):
    table = sample(spark)
    # a last packet far ahead lets the watermark close everything before it
    end = packets(spark, [dict(seq=999, ts_us=10_000 * SEC, src_ip="10.0.0.1", dst_ip="8.8.8.8")])
    stream = as_stream(spark, table.union(end), str(tmp_path / "in"))
    seen = []
    jobs.publish_tables(jobs.stream_tick_rows(stream), str(tmp_path / "ticks"), str(tmp_path / "ck"), on_batch=lambda df, n: seen.append(n)).awaitTermination()
    got = jobs.session_tables(spark, str(tmp_path / "ticks"), offline=True)
    want = agg.capture_tables(table)
    for name in ("totals", "flows", "hosts", "services", "tcp"):
        assert sorted(map(str, got[name].collect())) == sorted(map(str, want[name].select(*got[name].columns).collect())), name
    assert len(seen) >= 3


def test_tick_stream_equals_batch_ticks(spark, tmp_path):
    table = sample(spark)
    end = packets(spark, [dict(seq=999, ts_us=10_000 * SEC, src_ip="10.0.0.1", dst_ip="8.8.8.8")])
    out = drain(jobs.stream_ticks(as_stream(spark, table.union(end), str(tmp_path / "in")), offline=True), tmp_path)
    want = ticks.tick_table(ticks.assign_ticks(table)).select(*out.columns)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    totals = drain(jobs.running_totals(as_stream(spark, table, str(tmp_path / "again"))), tmp_path, "complete").first()
    assert totals.packets == 200


def shuffled_stream(spark, rows, schema, path, at, span, end, files=3):
    """Rows as files, out of order inside and between them by at most ``span`` (of the column ``at``), and a clock row."""
    rng = random.Random(len(rows))
    rows = sorted(rows, key=lambda r: r[at] + rng.randrange(span))
    size = -(-len(rows) // files)
    for part in [rows[i * size:(i + 1) * size] for i in range(files)] + [[end]]:
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # a source takes files by the second in which they were written
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_cooldown_state(spark, tmp_path):
    stateful.use_rocksdb(spark)
    rng = random.Random(4)
    rows, want = [], {}
    for key in ("a", "b"):
        times = sorted(rng.sample(range(300 * SEC), 40))
        rows += [("c", key, "entity", t) for t in times + times[:3]]
        want |= {(key, t): e for t, e in zip(times, greedy(times, C.COOLDOWN_SECONDS["entity"] * SEC))}
    columns = "capture_id string, dedupe_key string, cooldown string, as_of_us bigint"
    for name, expire in (("in", None), ("forget", 100)):
        stream = shuffled_stream(spark, rows, columns, str(tmp_path / name), 3, 30 * SEC, ("", "", "dpi", 9000 * SEC))
        out = [r for r in drain(stateful.cooldown(stream, "60 seconds", expire), tmp_path).collect() if r.capture_id]
        assert {(r.dedupe_key, r.as_of_us): r.emitted for r in out} == want and len(out) == len(want)


GATE = "capture_id string, flow string, tick bigint, packets bigint, bytes bigint, bytes_in bigint, bytes_out bigint"


def test_export_gate_state(spark, tmp_path):
    stateful.use_rocksdb(spark)
    rng = random.Random(6)
    rows, want = [], {}
    for flow in ("a", "b", "small"):
        total, series = 0, []
        for tick in sorted(rng.sample(range(1, 500), 30)):
            sent = rng.randint(2, 900) if flow != "small" else 2
            total += sent
            series.append((tick, total))
            rows += [("c", flow, tick, 1, sent - 1, 0, sent - 1), ("c", flow, tick, 0, 1, 1, 0)]  # two parts of one tick
        want[flow] = gate_fold(series, 2000, 3000, 100)
    stream = shuffled_stream(spark, rows, GATE, str(tmp_path / "in"), 2, 50, ("", "", 9000, 0, 0, 0, 0))
    out = drain(stateful.export_gate(stream, 2000, 3000, 100, delay="100 seconds"), tmp_path)
    got = {}
    for r in sorted(out.where("capture_id <> ''").collect(), key=lambda r: r.tick):
        got.setdefault(r.flow, []).append(r.tick)
    assert got == {k: v for k, v in want.items() if v}


def test_flows_close_after_silence(spark, tmp_path):
    stateful.use_rocksdb(spark)
    rows = [("c", "a", t, 1, 1000, 0, 1000) for t in (1, 2, 3, 200, 201)] + [("c", "b", t, 1, 10, 0, 10) for t in (1, 300)]
    stream = shuffled_stream(spark, rows, GATE, str(tmp_path / "in"), 2, 2, ("", "", 9000, 0, 0, 0, 0))
    out = drain(stateful.export_gate(stream, 1500, 10_000, 1000, close_after_seconds=50, delay="10 seconds"), tmp_path)
    assert sorted((r.flow, r.tick, r.event, r.bytes) for r in out.where("capture_id <> ''").collect()) == [
        ("a", 2, "active", 2000), ("a", 53, "closed", 3000), ("a", 201, "active", 2000), ("a", 251, "closed", 2000)]


def test_fold_late_state(spark, tmp_path):
    stateful.use_rocksdb(spark)
    rng = random.Random(12)
    table = packets(spark, [dict(seq=i, ts_us=(i // 4 + rng.choice([0, 0, -3])) * SEC + 3 * SEC, src_ip="1.1.1.1", dst_ip="2.2.2.2") for i in range(120)])
    runs = stateful.arrival_runs(table.coalesce(1).sortWithinPartitions("seq"))
    rows, end = [tuple(r) for r in runs.collect()], ("", 10 ** 8, 0, 0, 0)
    stream = shuffled_stream(spark, rows, runs.schema, str(tmp_path / "in"), 1, 30, end)
    out = drain(stateful.fold_late(stream, 60), tmp_path).where("capture_id <> ''").groupBy("tick").agg(F.sum("packets"), F.sum("bytes"))
    want = ticks.tick_table(ticks.assign_ticks(table)).select("tick", "packets", "bytes")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_idle_ticks_on_the_watermark(spark, tmp_path):
    stateful.use_rocksdb(spark)
    columns = "capture_id string, second bigint, packets bigint, bytes bigint, bytes_in bigint, bytes_out bigint"
    rows = [("c", s, 1, 10 * s, s, 0) for s in (5, 6, 6, 30_000, 30_002)] + [("d", s, 2, 7, 0, 7) for s in (29_990, 29_999)]
    stream = shuffled_stream(spark, rows, columns, str(tmp_path / "in"), 1, 5, ("", 30_010, 0, 0, 0, 0))
    out = {(r.capture_id, r.tick): (r.packets, r.bytes, r.filled) for r in drain(stateful.idle_ticks(stream, delay="5 seconds"), tmp_path).collect()}
    assert out["c", 6] == (2, 120, False) and out["c", 7] == (0, 0, True) and out["d", 29_999] == (2, 7, False)
    assert {c: [t for k, t in out if k == c] for c in "cd"} == {"c": list(range(5, 30_005)), "d": list(range(29_990, 30_005))}


def test_idle_ticks_on_the_clock_without_input(spark, tmp_path):
    """No packet after the first batch, yet the seconds go on closing."""
    stateful.use_rocksdb(spark)
    now = int(time.time())
    columns = "capture_id string, second bigint, packets bigint, bytes bigint, bytes_in bigint, bytes_out bigint"
    spark.createDataFrame([("c", now - 2, 1, 10, 0, 10), ("c", now - 4, 1, 20, 0, 20)], columns).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(columns).parquet(str(tmp_path / "in"))
    query = stateful.idle_ticks(stream, clock="processing").writeStream.format("memory").queryName("live").option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.table("live").where("filled").count() < 5:
            time.sleep(1)
    finally:
        query.stop()
    rows = sorted((r.tick, r.packets, r.filled) for r in spark.table("live").collect())
    assert rows[:4] == [(now - 4, 1, False), (now - 3, 0, True), (now - 2, 1, False), (now - 1, 0, True)]
    assert [t for t, _, _ in rows] == list(range(now - 4, now - 4 + len(rows))) and len(rows) >= 7


def test_cache_answers_as_of_an_instant(spark, tmp_path):
    stateful.use_rocksdb(spark)
    rng = random.Random(9)
    seen = [(f"k{rng.randrange(3)}", rng.randrange(400) * SEC, None, f"v{i}") for i in range(80)]
    seen = list({(k, t): (k, t, i, v) for k, t, i, v in seen}.values())
    asks = [(f"k{rng.randrange(4)}", rng.randrange(500) * SEC, f"q{i}", None) for i in range(120)]
    stream = shuffled_stream(spark, seen + asks, "key string, at bigint, id string, value string", str(tmp_path / "in"), 1, 40 * SEC, ("", 99_999 * SEC, None, None))
    got = {r.id: r.value for r in drain(stateful.latest_within(stream, 60, "80 seconds"), tmp_path).collect()}
    want = {}
    for key, at, i, _ in asks:
        before = [(t, v) for k, t, _, v in seen if k == key and t <= at and at - t < 60 * SEC]
        want[i] = max(before)[1] if before else None
    assert got == want


def test_running_tables_and_ranking(spark, tmp_path):
    stateful.use_rocksdb(spark)
    table = sample(spark)
    base = str(tmp_path / "flows")
    jobs.publish_changes(jobs.running_flows(as_stream(spark, table, str(tmp_path / "in")), offline=True), base, str(tmp_path / "ck")).awaitTermination()
    flows, want = jobs.last_published(spark, base, ["capture_id", *agg.FLOW_KEY]), agg.capture_tables(table)
    columns = want["flows"].columns
    assert sorted(map(str, flows.select(*columns).collect())) == sorted(map(str, want["flows"].collect()))
    jobs.publish_changes(jobs.running_sessions(as_stream(spark, table, str(tmp_path / "again")), offline=True), str(tmp_path / "tcp"), str(tmp_path / "ck2")).awaitTermination()
    keys = ["capture_id", "endpoint_a_ip", "endpoint_a_port", "endpoint_b_ip", "endpoint_b_port"]
    tcp = jobs.last_published(spark, str(tmp_path / "tcp"), keys).select(*want["tcp"].columns)
    assert sorted(map(str, tcp.collect())) == sorted(map(str, want["tcp"].collect()))
    changes = spark.readStream.schema(spark.read.parquet(base).schema).option("maxFilesPerTrigger", 1).parquet(base)
    ranked = drain(stateful.running_top(changes, 3, parts=2), tmp_path).collect()
    last = max(r.version for r in ranked)
    got = [(r.key, r.bytes, r.packets) for r in sorted(ranked, key=lambda r: r.rank) if r.version == last]
    rows = [(r.key, r.bytes, r.packets) for r in flows.collect()]
    assert got == sorted(rows, key=lambda r: (-r[1], -r[2], r[0]))[:3] and last > 1


def test_late_enrichment_is_published_again(spark, tmp_path):
    dim, stream_dir, base = str(tmp_path / "dim"), str(tmp_path / "in"), str(tmp_path / "out")
    for i, keys in enumerate((["a", "b"], ["b", "c"], ["d", None])):
        spark.createDataFrame([(k,) for k in keys], "k string").coalesce(1).write.mode("append").parquet(stream_dir)
        time.sleep(1.1)
    spark.createDataFrame([("b", "B")], "key string, name string").write.parquet(dim)
    stream = spark.readStream.schema("k string").option("maxFilesPerTrigger", 1).parquet(stream_dir)

    def learn(n):
        if n == 2:
            spark.createDataFrame([("a", "A"), ("d", "D")], "key string, name string").write.mode("append").parquet(dim)

    def enrich(rows):
        return rows.join(spark.read.parquet(dim), F.col("k") == F.col("key"), "left").select("k", "name")

    jobs.republish(stream, ["k"], enrich, base, str(tmp_path / "ck"), before=learn).awaitTermination()
    sent = [sorted(map(str, (tuple(r) for r in spark.read.parquet(f"{base}/changes/batch={n}").collect()))) for n in range(3)]
    assert sent == [["('a', None)", "('b', 'B')"], ["('c', None)"], ["('a', 'A')", "('d', 'D')", "(None, None)"]]
    final = {r.k: r.name for r in jobs.last_published(spark, f"{base}/changes", ["k"]).collect()}
    assert final == {"a": "A", "b": "B", "c": None, "d": "D", None: None}


def test_capture_folder_stream_and_signals(spark, tmp_path):
    from test_capture_files import GOLDEN, write_pcap

    write_pcap(str(tmp_path / "a.pcap"), GOLDEN)
    write_pcap(str(tmp_path / "b.pcap"), GOLDEN[2:])
    pcap.register(spark)
    frames = drain(spark.readStream.format("pcap").load(str(tmp_path)), tmp_path / "ck")
    assert frames.groupBy("capture_id").count().count() == 2 and frames.count() == 4
    hits = jobs.detector_hits(rollup(ticks.assign_ticks(sample(spark)), ("tick",)), fnd.Policy.of(watched=["8.8.8.8", "service:https"]))
    stream = as_stream(spark, hits, str(tmp_path / "hits"))
    once = drain(jobs.stream_signals(stream), tmp_path / "ck")
    assert once.count() == hits.select("id").distinct().count() > 0

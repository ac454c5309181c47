"""Streaming jobs: ticks, running tables, findings and export lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import clock, ip
from ..operators import aggregates as agg, classify, findings as fnd, ticks
from ..operators.rollup import packet_rows, rollup

WATERMARK = "10 seconds"


def with_event_time(packets: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Event time and watermark for a packet stream."""
    return packets.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", delay)


def stream_ticks(packets: DataFrame, local_addresses: DataFrame | None = None, offline: bool = False,
                 delay: str | None = WATERMARK) -> DataFrame:
    """One-second tumbling ticks on packet time.

    Without a ``delay`` every packet counts in its second however late it is, and
    ticks are published again when they change (update or complete mode): state is
    one row per second of each capture.  With one a tick is emitted once, when the
    watermark passes it (append mode); packets later than that are dropped and
    counted by Spark (``numRowsDroppedByWatermark``), and the last ticks wait for
    packets that never come when the input is finite.
    """
    sided = ticks.with_direction(packets, local_addresses, offline)
    timed = sided.withColumn("ts", F.timestamp_micros("ts_us")) if delay is None else with_event_time(sided, delay)

    def way_sum(way: str) -> str:
        return f"sum(CASE WHEN direction = '{way}' THEN packet_len ELSE 0 END) AS bytes_{'in' if way == 'inbound' else 'out'}"

    return (
        timed.groupBy("capture_id", F.window("ts", "1 second"))
        .agg(*[F.expr(a) for a in ("count(1) AS packets", "sum(packet_len) AS bytes", way_sum("inbound"), way_sum("outbound"))])
        .selectExpr("capture_id", "unix_seconds(window.start) AS tick", "packets", "bytes", "bytes_in", "bytes_out")
    )


def stream_tick_rows(packets: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Per-second rollup of a stream: closed ticks at directed 5-tuple grain (append mode).

    The grain feeds every session table, so downstream batches never see packets.
    """
    second = "unix_seconds(window.start)"
    timed = with_event_time(packets, delay).withColumn("window", F.window("ts", "1 second"))
    return rollup(timed, by=("window",)).selectExpr("*", f"{second} AS tick").drop("window")


def running_totals(packets: DataFrame) -> DataFrame:
    """Cumulative totals per capture, re-published on every batch (update or complete mode)."""
    return packets.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("packet_len").alias("bytes"), F.max("ts_us").alias("last_packet_us")
    )


def running_services(packets: DataFrame, local_addresses: DataFrame | None = None, offline: bool = False) -> DataFrame:
    """Cumulative service counters, re-published on every batch (update or complete mode)."""
    sided = ticks.with_direction(packets, local_addresses, offline).where("decoded")
    rows = classify.with_service(sided)
    return rows.groupBy("capture_id", "service", "proto").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("packet_len").alias("bytes")
    )


def running_flows(packets: DataFrame, local_addresses: DataFrame | None = None, offline: bool = False) -> DataFrame:
    """Flows as they stand after each micro-batch, those that changed (update mode): one aggregate, one state row a flow.

    ``tick`` is the second of a flow's last packet and ``key`` its text key, which sorts like the ranking's.
    """
    rows = agg.classified(packet_rows(packets), local_addresses, offline)
    return _ticked(agg.flows(rows), flow_text())


def running_hosts(packets: DataFrame, local_addresses: DataFrame | None = None, offline: bool = False) -> DataFrame:
    """Hosts as they stand after each micro-batch, those that changed (update mode)."""
    return _ticked(agg.hosts(agg.classified(packet_rows(packets), local_addresses, offline)), f"concat({_sortable('host_bin')})")


def running_sessions(packets: DataFrame, local_addresses: DataFrame | None = None, offline: bool = False) -> DataFrame:
    """TCP sessions as they stand after each micro-batch, those that changed (update mode)."""
    return agg.tcp_sessions(agg.flows(agg.classified(packet_rows(packets), local_addresses, offline)))


def _ticked(rows: DataFrame, key: str) -> DataFrame:
    return rows.selectExpr("*", f"{clock.second_of('last_us')} AS tick", f"{key} AS key")


def _sortable(address: str) -> str:
    return f"lpad(CAST(length({address}) AS STRING), 2, '0'), hex({address})"


def flow_text() -> str:
    """A flow's key as text that sorts as flows do."""
    ports = ", ".join(f"lpad(CAST(coalesce({p} + 1, 0) AS STRING), 6, '0')" for p in ("a_port", "b_port"))
    return f"concat({_sortable('a_bin')}, {_sortable('b_bin')}, {ports}, lpad(CAST({classify.proto_rank()} AS STRING), 3, '0'))"


def publish_changes(rows: DataFrame, base: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write what changed in each micro-batch (update mode) under ``base``; a batch run again replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={batch_id}")

    return (
        rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()
    )


def last_published(spark: SparkSession, base: str, keys: list[str]) -> DataFrame:
    """The newest row of every key that :func:`publish_changes` or :func:`republish` wrote."""
    rows = spark.read.parquet(base)
    kept = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.expr(f"max_by(struct({', '.join(kept)}), batch)").alias("_row"))
    return newest.select(*keys, "_row.*")


def republish(rows: DataFrame, keys: list[str], enrich: Callable[[DataFrame], DataFrame], base: str, checkpoint: str,
              trigger: dict | None = None, before: Callable[[int], None] | None = None) -> StreamingQuery:
    """Enriched rows that are published again when a dimension has learnt something new.

    Every micro-batch enriches the keys it brings and all known ones with the
    dimension as it is then (``enrich`` reads it anew), compares them with what
    was published last and writes those that differ to ``base/changes``. What was
    published last is a table with one row per key under ``base/known``, one version
    per batch: a batch that is run again reads the version before it, so nothing
    is lost or published twice. Null keys are keys of their own. ``before`` is called with the number of
    each batch first.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if before is not None:
            before(batch_id)
        fresh, known = batch.select(*keys), None
        if batch_id:
            known = spark.read.parquet(f"{base}/known/version={batch_id - 1}")
            fresh = fresh.union(known.select(*keys))
        found = enrich(fresh.distinct())
        values = [c for c in found.columns if c not in keys]
        found.write.mode("overwrite").parquet(f"{base}/known/version={batch_id}")
        now = spark.read.schema(found.schema).parquet(f"{base}/known/version={batch_id}")
        changed = now
        if known is not None:
            old = known.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.struct(*values).alias("_old"), F.lit(True).alias("_known"))
            same = None
            for k in keys:
                test = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
                same = test if same is None else same & test
            changed = now.join(old, same, "left").where(F.col("_known").isNull() | ~F.struct(*values).eqNullSafe(F.col("_old"))).select(*now.columns)
        changed.write.mode("overwrite").parquet(f"{base}/changes/batch={batch_id}")

    return (
        rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()
    )


def second_sums(packets: DataFrame, local_addresses: DataFrame | None = None, offline: bool = False) -> DataFrame:
    """Partial sums per (capture, second), made in the scan task from each Arrow chunk; input of :func:`stateful.idle_ticks`."""
    sided = ticks.with_direction(packets, local_addresses, offline)
    slim = sided.selectExpr(
        "capture_id", f"{clock.second_of('ts_us')} AS second", "1L AS packets", "packet_len AS bytes",
        "CASE WHEN direction = 'inbound' THEN packet_len ELSE 0L END AS bytes_in", "CASE WHEN direction = 'outbound' THEN packet_len ELSE 0L END AS bytes_out",
    )

    def add(frames):
        for frame in frames:
            yield frame.groupby(["capture_id", "second"], as_index=False).sum()

    return slim.mapInPandas(add, slim.schema)


def with_clock(sums: DataFrame, beats: DataFrame) -> DataFrame:
    """Sums per second together with clock rows ``beats(capture_id, second)``, which count no packet."""
    return sums.unionByName(beats.selectExpr("capture_id", "second", *[f"0L AS {c}" for c in ("packets", "bytes", "bytes_in", "bytes_out")]))


def publish_tables(tick_rows: DataFrame, base: str, checkpoint: str, offline: bool = False,
                   local_addresses: DataFrame | None = None,
                   on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append closed ticks at rollup grain to a table; session tables are views over it.

    Each micro-batch is one idempotent write (its folder is named by the batch
    id and overwritten on retry).  ``on_batch`` is the observer hook.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={batch_id}")
        if on_batch is not None:
            on_batch(batch.sparkSession.read.parquet(f"{base}/batch={batch_id}"), batch_id)

    return (
        tick_rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(write).trigger(availableNow=True).start()
    )


def session_tables(spark: SparkSession, base: str, local_addresses: DataFrame | None = None,
                   offline: bool = False) -> dict[str, DataFrame]:
    """Session tables from published ticks: the same operators as in batch."""
    rolled = spark.read.parquet(base)
    rows = agg.classified(rolled, local_addresses, offline)
    flow_rows = agg.flows(rows)
    return {
        "totals": agg.totals_of(rolled), "flows": flow_rows, "tcp": agg.tcp_sessions(flow_rows),
        "hosts": agg.hosts(rows), "services": agg.services(rows),
    }


def stream_signals(hits: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each finding once: duplicates by (capture, id) inside the watermark are dropped."""
    timed = hits.withColumn("ts", F.timestamp_micros("as_of_us")).withWatermark("ts", delay)
    return timed.dropDuplicatesWithinWatermark(["capture_id", "id"]).drop("ts")


def detector_hits(tick_rows: DataFrame, policy: fnd.Policy, session: fnd.Session | None = None,
                  local_addresses: DataFrame | None = None) -> DataFrame:
    """Watch-list and peer-to-peer hits of closed ticks, evaluated inside a batch or ``foreachBatch``."""
    session = session or fnd.Session.live()
    rows = agg.classified(tick_rows, local_addresses, session.offline)
    stamp = f"tick * {clock.MICROS} AS as_of_us"
    hosts = agg.hosts(rows, ("tick",)).selectExpr("*", stamp)
    flows = agg.flows(rows, ("tick",)).selectExpr("*", stamp)
    services = agg.services(rows, ("tick",)).selectExpr("*", stamp)
    parts = [
        *fnd.watched_hosts(hosts, policy, session), *fnd.watched_services(services, policy, session),
        fnd.exfil(flows, policy, session), fnd.p2p_connections(flows, policy, session),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("ord")

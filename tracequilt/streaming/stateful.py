"""Stateful operators on ``transformWithState`` (RocksDB state store).

Rows may come late and out of order: they wait in state until the watermark has
passed their instant, then an event-time timer hands them on in order. A call to
the state store costs as much as thousands of rows, so rows wait in the Arrow
chunks they came in, one entry each, and many keys share a group: state is dealt by
a hash of the key into ``PARTS``. Input is taken one chunk at a time; a task's
memory follows the rows of one group that the watermark has passed.

Only rows move the watermark. A capture that falls silent is carried on by clock
rows (:func:`tracequilt.streaming.jobs.with_clock`) or, on processing time, by
timers that need no input at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import constants as C

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000
#: Rows of one output frame.
FRAME = 10_000
#: Groups that keys share.
PARTS = 256


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def timed(rows: DataFrame, micros: str, delay: str) -> DataFrame:
    """Add ``ts`` from an expression in microseconds, with a watermark.

    A stream's first watermark is the epoch, so instants must lie after it.
    """
    return rows.withColumn("ts", F.expr(f"timestamp_micros({micros})")).withWatermark("ts", delay)


def _pack(frame: pd.DataFrame) -> bytes:
    batch, sink = pa.RecordBatch.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(held)).read_pandas()


def _framed(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Output rows as frames of bounded length."""
    while chunk := list(islice(rows, FRAME)):
        yield pd.DataFrame(chunk, columns=columns)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Add ``part``, the group that holds the state of a key."""
    return rows.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int"))


class InOrder(StatefulProcessor):
    """Base: rows wait in chunks and are settled in the order of their instants.

    A subclass keeps ``fields`` of a chunk, gives every row's instant in
    microseconds (``instants``) and settles the due rows of all keys of a group
    (``settle``), which come in the order of their arrival.
    """

    fields: list[str] = []
    #: Milliseconds that a second stays open after its end.
    grace = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the earliest second and the number of a chunk
        self.waiting = handle.getMapState("waiting", "second bigint, number bigint", "rows binary")
        self.chunks = handle.getValueState("chunks", "n bigint")

    def instants(self, frame: pd.DataFrame) -> pd.Series:
        raise NotImplementedError

    def settle(self, key: tuple, due: pd.DataFrame, now_ms: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def clock(self, timer_values) -> int:
        return timer_values.getCurrentWatermarkInMs()

    def hold(self, rows: Iterator[pd.DataFrame]) -> int | None:
        """Store chunks; the earliest second among them."""
        number = self.chunks.get()[0] if self.chunks.exists() else 0
        lowest = None
        for frame in rows:
            if len(frame):
                second = int(self.instants(frame).min()) // SECOND
                self.waiting.updateValue((second, number), (_pack(frame[self.fields]),))
                lowest, number = second if lowest is None else min(lowest, second), number + 1
        if lowest is not None:
            self.chunks.update((number,))
        return lowest

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        lowest = self.hold(rows)
        if lowest is not None:
            self.wake((lowest + 1) * 1000)
        yield from ()

    def due(self, now_ms: int) -> tuple[pd.DataFrame | None, int | None]:
        """Take the rows whose second is over out of state; also the earliest second that still waits."""
        end = (now_ms - self.grace) // 1000
        found, later = [], []
        for second, number in sorted((tuple(k) for k in self.waiting.keys()), key=lambda k: k[1]):
            if second >= end:
                later.append(second)
                continue
            frame = _unpack(self.waiting.getValue((second, number))[0])
            seconds = self.instants(frame) // SECOND
            over = seconds < end
            found.append(frame[over])
            self.waiting.removeKey((second, number))
            if not over.all():
                rest = int(seconds[~over].min())
                self.waiting.updateValue((rest, number), (_pack(frame[~over]),))
                later.append(rest)
        return pd.concat(found, ignore_index=True) if found else None, min(later, default=None)

    def wake(self, at_ms: int) -> None:
        self.handle.registerTimer(at_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.clock(timerValues)
        due, later = self.due(now)
        if due is not None:
            yield from self.settle(key, due, now)
        if later is not None:
            self.wake((later + 1) * 1000)
        yield from self.expire(key, now)

    def expire(self, key: tuple, now_ms: int) -> Iterator[pd.DataFrame]:
        """What a timer does apart from settling rows."""
        yield from ()

    def close(self) -> None:
        pass


class Keyed(InOrder):
    """Base: a group's keys each have a small state (``held``), a tuple of ``state`` columns; all are stored as one chunk."""

    keys: list[str] = []
    state: list[str] = []
    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.store = handle.getValueState("held", "rows binary")

    def load(self) -> dict[tuple, tuple]:
        if not self.store.exists():
            return {}
        n = len(self.keys)
        return {row[:n]: row[n:] for row in _unpack(self.store.get()[0]).itertuples(index=False, name=None)}

    def save(self, held: dict[tuple, tuple]) -> None:
        if held:
            self.store.update((_pack(pd.DataFrame([(*k, *v) for k, v in held.items()], columns=[*self.keys, *self.state])),))
        elif self.store.exists():
            self.store.clear()

    def ordered(self, due: pd.DataFrame) -> Iterator[tuple[tuple, int, tuple]]:
        """Key, instant and values of each due row in order."""
        raise NotImplementedError

    def settle_row(self, held: dict[tuple, tuple], key: tuple, at: int, value: tuple) -> list[tuple]:
        raise NotImplementedError

    def ends_ms(self, held: tuple) -> int | None:
        """When the watermark may forget a key's state."""
        return None

    def ended(self, key: tuple, held: tuple) -> list[tuple]:
        return []

    def settle(self, key, due, now_ms):
        held = self.load()
        yield from _framed((line for row in self.ordered(due) for line in self.settle_row(held, *row)), self.columns)
        self.save(held)

    def expire(self, key, now_ms):
        if self.ends_ms((0,) * len(self.state)) is None:
            return
        held, out, following = self.load(), [], None
        for name, value in list(held.items()):
            end = self.ends_ms(value)
            if end <= now_ms:
                out += self.ended(name, held.pop(name))
            else:
                following = end if following is None else min(following, end)
        if out:
            yield from _framed(iter(out), self.columns)
        self.save(held)
        if following is not None:
            self.wake(following)


def _rows(frame: pd.DataFrame, columns: list[str]) -> Iterator[tuple]:
    return zip(*[frame[c].tolist() for c in columns])


class Cooldown(Keyed):
    """Emit an occurrence unless its key was emitted less than its cooldown before."""

    keys, state = ["capture_id", "dedupe_key"], ["us"]
    fields = ["capture_id", "dedupe_key", "cooldown", "as_of_us"]
    columns = [*fields, "emitted"]

    def __init__(self, expire_ms: int | None) -> None:
        self.expire_ms = expire_ms

    def instants(self, frame):
        return frame["as_of_us"]

    def ordered(self, due):
        last = due.drop_duplicates([*self.keys, "as_of_us"], keep="last").sort_values("as_of_us", kind="stable")
        for capture, name, kind, at in _rows(last, self.fields):
            yield (capture, name), at, (kind,)

    def settle_row(self, held, key, at, value):
        fresh = key not in held or at - held[key][0] >= C.COOLDOWN_SECONDS[value[0]] * SECOND
        if fresh:
            held[key] = (at,)
        return [(*key, value[0], at, fresh)]

    def ends_ms(self, held):
        return None if self.expire_ms is None else held[0] // 1000 + self.expire_ms


def cooldown(occurrences: DataFrame, delay: str = "10 seconds", expire_seconds: int | None = None) -> DataFrame:
    """Streaming form of :func:`tracequilt.operators.gates.cooldown`.

    ``occurrences`` may be out of order by ``delay``. ``expire_seconds`` forgets
    silent keys; it must exceed the longest cooldown.
    """
    if expire_seconds is not None and expire_seconds <= max(C.COOLDOWN_SECONDS.values()):
        raise ValueError("expire_seconds must exceed the longest cooldown")
    rows = timed(occurrences.select("capture_id", "dedupe_key", "cooldown", "as_of_us"), "as_of_us", delay)
    return dealt(rows, "capture_id", "dedupe_key").groupBy("part").transformWithStateInPandas(
        Cooldown(None if expire_seconds is None else expire_seconds * 1000), outputMode="Append", timeMode="EventTime",
        outputStructType="capture_id string, dedupe_key string, cooldown string, as_of_us bigint, emitted boolean",
    )


class ExportGate(Keyed):
    """Running totals per flow; export when first, grown or due, and close after silence."""

    keys, counts = ["capture_id", "flow"], ["packets", "bytes", "bytes_in", "bytes_out"]
    state = [*counts, "sent", "last_bytes", "last_tick", "seen"]
    fields = [*keys, "tick", *counts]
    columns = [*fields, "event"]

    def __init__(self, min_bytes: int, delta_bytes: int, interval_seconds: int, close_after: int) -> None:
        self.min_bytes, self.delta = min_bytes, delta_bytes
        self.interval, self.close_after = max(interval_seconds, 1), close_after

    def instants(self, frame):
        return frame["tick"] * SECOND

    def ordered(self, due):
        whole = due.groupby([*self.keys, "tick"], as_index=False, dropna=False, sort=False)[self.counts].sum()
        for capture, flow, tick, *counts in _rows(whole.sort_values("tick", kind="stable"), self.fields):
            yield (capture, flow), tick, tuple(counts)

    def settle_row(self, held, key, at, value):
        lines = []
        *totals, sent, last_bytes, last_tick, seen = held.get(key, (0, 0, 0, 0, False, 0, 0, at))
        if self.close_after and sent and at - seen > self.close_after:
            # rows settle after the silence that closed the flow was passed over in one go
            lines.append((*key, seen + self.close_after, *totals, "closed"))
            totals, sent, last_bytes, last_tick = (0, 0, 0, 0), False, 0, 0
        totals = [a + b for a, b in zip(totals, value)]
        if totals[1] >= self.min_bytes and (not sent or totals[1] - last_bytes >= self.delta or at - last_tick >= self.interval):
            sent, last_bytes, last_tick = True, totals[1], at
            lines.append((*key, at, *totals, "active"))
        held[key] = (*totals, sent, last_bytes, last_tick, at)
        return lines

    def ends_ms(self, held):
        return (held[-1] + self.close_after + 1) * 1000 if self.close_after else None

    def ended(self, key, held):
        """The flow has left the visible set: report the end once and forget it."""
        *totals, sent, _, _, seen = held
        return [(*key, seen + self.close_after, *totals, "closed")] if sent else []


def export_gate(tick_flows: DataFrame, min_bytes: int = C.FLOW_EXPORT_MIN_BYTES, delta_bytes: int = C.FLOW_EXPORT_DELTA_BYTES,
                interval_seconds: int = C.FLOW_EXPORT_INTERVAL_SECONDS, close_after_seconds: int = 0, delay: str = "10 seconds") -> DataFrame:
    """Streaming export gate over per-tick flow counters, out of order by at most ``delay``.

    ``tick_flows`` needs ``capture_id, flow`` (any text key), ``tick`` and the
    four counters; several rows of one flow and tick add up.
    ``close_after_seconds`` > 0 adds ``closed`` events at the tick at which a flow
    has been silent so long; a flow that comes back starts anew.
    """
    rows = timed(tick_flows.select("capture_id", "flow", "tick", "packets", "bytes", "bytes_in", "bytes_out"), f"tick * {SECOND}", delay)
    return dealt(rows, "capture_id", "flow").groupBy("part").transformWithStateInPandas(
        ExportGate(min_bytes, delta_bytes, interval_seconds, close_after_seconds), outputMode="Append", timeMode="EventTime",
        outputStructType="capture_id string, flow string, tick bigint, packets bigint, bytes bigint, bytes_in bigint, bytes_out bigint, event string",
    )


class FoldLate(InOrder):
    """Open second per capture; a late row counts in the open one. The instant is the sequence number."""

    fields = ["first_seq", "second", "packets", "bytes"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "tick bigint")

    def instants(self, frame):
        return (frame["first_seq"] + 1) * 1000

    def settle(self, key, due, now_ms):
        rows = due.drop_duplicates("first_seq", keep="last").sort_values("first_seq")
        ticks = np.maximum.accumulate(rows["second"].to_numpy())
        if self.open.exists():
            ticks = np.maximum(ticks, self.open.get()[0])
        self.open.update((int(ticks[-1]),))
        sums = rows[["packets", "bytes"]].groupby(ticks).sum().rename_axis("tick").reset_index()
        for start in range(0, len(sums), FRAME):
            yield sums[start:start + FRAME].assign(capture_id=key[0])[["capture_id", "tick", "packets", "bytes"]]


def fold_late(runs: DataFrame, late_seqs: int = 10_000) -> DataFrame:
    """Ticks that never drop late packets.

    ``runs(capture_id, first_seq, second, packets, bytes)`` are runs of packets
    of one second (one row per packet is the finest run); they may arrive out of
    order by up to ``late_seqs`` sequence numbers, which the watermark counts as
    milliseconds. Output rows are partial sums per (capture, tick): add them up
    downstream. The reduction to runs happens before the shuffle, so a capture's
    packets do not pass through one task.
    """
    return (
        timed(runs.select("capture_id", "first_seq", "second", "packets", "bytes"), "(first_seq + 1) * 1000", f"{late_seqs} milliseconds")
        .groupBy("capture_id")
        .transformWithStateInPandas(
            FoldLate(), outputMode="Append", timeMode="EventTime", outputStructType="capture_id string, tick bigint, packets bigint, bytes bigint",
        )
    )


def arrival_runs(batch: DataFrame, run_seqs: int = 4096) -> DataFrame:
    """Packets of a stream to runs for :func:`fold_late`.

    Neighbours of one capture and second with consecutive sequence numbers merge
    while still in the scan task, in the order the source yields them.  Sources
    whose numbers are not dense (byte offsets) give one run per packet.
    """

    def collapse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            changed = (frame["capture_id"] != frame["capture_id"].shift()) | (frame["second"] != frame["second"].shift())
            # a run must not hide a packet of another partition between its own
            changed |= frame["seq"] - frame["seq"].shift() != 1
            changed |= frame["seq"] // run_seqs != frame["seq"].shift() // run_seqs
            run = changed.cumsum()
            grouped = frame.groupby(run)
            yield pd.DataFrame({
                "capture_id": grouped["capture_id"].first(), "first_seq": grouped["seq"].min(),
                "second": grouped["second"].first(), "packets": grouped["seq"].size(), "bytes": grouped["packet_len"].sum(),
            })

    slim = batch.select(
        "capture_id", "seq", F.expr("(ts_us - pmod(ts_us, 1000000)) div 1000000").alias("second"), "packet_len"
    )
    return slim.mapInPandas(collapse, "capture_id string, first_seq bigint, second bigint, packets bigint, bytes bigint")


class IdleTicks(InOrder):
    """Closes seconds as the clock passes them, those without packets too.

    The clock is the watermark (``event``) or the machine's (``processing``). A
    timer stands at the end of the next second to close, whether or not anything
    comes in; when it fires, all seconds up to the clock are closed in order.
    """

    counts = ["packets", "bytes", "bytes_in", "bytes_out"]
    fields = ["second", *counts]
    columns = ["capture_id", "tick", *counts, "filled"]

    def __init__(self, clock: str, grace_ms: int) -> None:
        self.processing, self.grace = clock == "processing", grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.next = handle.getValueState("next", "tick bigint")

    def clock(self, timer_values):
        return timer_values.getCurrentProcessingTimeInMs() if self.processing else timer_values.getCurrentWatermarkInMs()

    def instants(self, frame):
        return frame["second"] * SECOND

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        opened = self.next.get()[0] if self.next.exists() else None

        def real():
            for frame in rows:
                sums = frame[frame["packets"] > 0].groupby("second", as_index=False)[self.counts].sum()
                # what is late for a closed second counts in the open one
                yield sums if opened is None else sums.assign(second=sums["second"].clip(lower=opened))

        lowest = self.hold(real())
        if opened is None and lowest is not None:
            # until a second is closed, an earlier one may still come and be the first
            self.wake((lowest + 1) * 1000 + self.grace)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.clock(timerValues)
        due, later = self.due(now)
        sums = None if due is None else due.groupby("second")[self.counts].sum()
        if self.next.exists():
            first = self.next.get()[0]
        elif sums is not None or later is not None:
            first = later if sums is None else int(sums.index[0])
        else:
            return
        end = (now - self.grace) // 1000  # seconds before this one are over
        for start in range(first, end, FRAME):
            ticks = np.arange(start, min(start + FRAME, end))
            frame = pd.DataFrame(np.zeros((len(ticks), 4), np.int64), columns=self.counts)
            filled = np.ones(len(ticks), bool)
            if sums is not None:
                low, high = np.searchsorted(sums.index.to_numpy(), (ticks[0], ticks[-1] + 1))
                at = sums.index.to_numpy()[low:high] - start
                frame.iloc[at] = sums.iloc[low:high].to_numpy()
                filled[at] = False
            yield frame.assign(capture_id=key[0], tick=ticks, filled=filled)[self.columns]
        following = max(first, end)
        self.next.update((following,))
        self.wake((following + 1) * 1000 + self.grace)


def idle_ticks(second_sums: DataFrame, clock: str = "event", delay: str = "10 seconds", grace_ms: int = 0) -> DataFrame:
    """One row per second of every capture from its first packet on, silent seconds included (``filled``).

    ``second_sums(capture_id, second, packets, bytes, bytes_in, bytes_out)`` are
    partial sums (:func:`tracequilt.streaming.jobs.second_sums`); rows with no
    packets only move the clock. On ``event`` time a second closes when the
    watermark passes it; on ``processing`` time when it has been over for
    ``grace_ms`` on the machine's clock, with or without input (use a
    processing-time trigger).
    """
    if clock not in ("event", "processing"):
        raise ValueError("clock must be 'event' or 'processing'")
    rows = second_sums.select("capture_id", "second", "packets", "bytes", "bytes_in", "bytes_out")
    rows = timed(rows, f"second * {SECOND}", delay) if clock == "event" else rows
    return rows.groupBy("capture_id").transformWithStateInPandas(
        IdleTicks(clock, grace_ms), outputMode="Append", timeMode="EventTime" if clock == "event" else "ProcessingTime",
        outputStructType="capture_id string, tick bigint, packets bigint, bytes bigint, bytes_in bigint, bytes_out bigint, filled boolean",
    )


class AsOf(Keyed):
    """Answers questions with the latest observation before them, for each key and time slot."""

    keys, state = ["key", "slot"], ["at", "value"]
    fields = ["key", "slot", "at", "number", "id", "value"]
    columns = ["id", "value"]

    def __init__(self, ttl_us: int) -> None:
        self.ttl = ttl_us

    def instants(self, frame):
        return frame["at"]

    def ordered(self, due):
        # observations (number 0 and below) come before the questions of the same instant
        last = due.drop_duplicates([*self.keys, "at", "number"], keep="last").sort_values(["at", "number"], kind="stable")
        for key, slot, at, _, row, value in _rows(last, self.fields):
            yield (key, slot), at, (row, value)

    def settle_row(self, held, key, at, value):
        row, seen = value
        if row is None:
            held[key] = (at, seen)
            return []
        last = held.get(key)
        return [(row, last[1] if last is not None and at - last[0] < self.ttl else None)]

    def ends_ms(self, held):
        return (held[0] + self.ttl) // 1000 + 1


def latest_within(events: DataFrame, ttl_seconds: int, delay: str = "10 seconds") -> DataFrame:
    """Streaming form of :func:`tracequilt.operators.lookup.latest_within`, a cache with a time to live.

    ``events(key, at, id, value)`` are observations (null ``id``) and questions
    (unique ``id``) in one stream, out of order by at most ``delay``. A question
    gets the latest observation of its key not after it and younger than the TTL.
    Keys are cut into slots of one TTL, an observation being filed under its own
    and the next, so a hot key is spread over its slots and a slot's state ends
    with its TTL. Gives ``id, value``.
    """
    ttl = ttl_seconds * SECOND
    slots = f"explode(CASE WHEN id IS NULL THEN array(at div {ttl}, at div {ttl} + 1) ELSE array(at div {ttl}) END) AS slot"
    rows = timed(events.select("key", "at", "id", "value"), "at", delay)
    numbered = rows.selectExpr("*", slots, "CASE WHEN id IS NULL THEN 0L ELSE 1L + (xxhash64(id) & 9223372036854775806L) END AS number")
    return dealt(numbered, "key", "slot").groupBy("part").transformWithStateInPandas(
        AsOf(ttl), outputMode="Append", timeMode="EventTime", outputStructType="id string, value string",
    )


class PartRank(StatefulProcessor):
    """The best ``k`` rows of one part of a capture's keys, kept as keys' counters grow."""

    def __init__(self, k: int) -> None:
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getMapState("best", "key string", "bytes bigint, packets bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = {k[0]: tuple(v) for k, v in self.best.iterator()}
        before = dict(held)
        for frame in rows:
            for name, size, packets in zip(*[frame[c].tolist() for c in ("key", "bytes", "packets")]):
                if name not in held or held[name] < (size, packets):
                    held[name] = (size, packets)
            # counters only grow, so what is not among the best now cannot be without a new row
            held = dict(sorted(held.items(), key=lambda e: (-e[1][0], -e[1][1], e[0]))[: self.k])
        changed = [(*key, name, *held[name]) for name in held if before.get(name) != held[name]]
        for name in before.keys() - held.keys():
            self.best.removeKey((name,))
        for _, _, name, *value in changed:
            self.best.updateValue((name,), tuple(value))
        if changed:
            yield pd.DataFrame(changed, columns=["capture_id", "part", "key", "bytes", "packets"])

    def close(self) -> None:
        pass


class WholeRank(StatefulProcessor):
    """The best ``k`` of a capture from the changes of its parts; published whole when it changes."""

    def __init__(self, k: int) -> None:
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getMapState("best", "key string", "bytes bigint, packets bigint")
        self.version = handle.getValueState("version", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = {k[0]: tuple(v) for k, v in self.best.iterator()}
        before = dict(held)
        for frame in rows:
            for name, size, packets in zip(*[frame[c].tolist() for c in ("key", "bytes", "packets")]):
                held[name] = max(held.get(name, (0, 0)), (size, packets))
            held = dict(sorted(held.items(), key=lambda e: (-e[1][0], -e[1][1], e[0]))[: self.k])
        if held == before:
            return
        for name in before.keys() - held.keys():
            self.best.removeKey((name,))
        for name, value in held.items():
            self.best.updateValue((name,), value)
        version = self.version.get()[0] + 1 if self.version.exists() else 1
        self.version.update((version,))
        rows = [(key[0], version, n + 1, name, *value) for n, (name, value) in enumerate(held.items())]
        yield pd.DataFrame(rows, columns=["capture_id", "version", "rank", "key", "bytes", "packets"])

    def close(self) -> None:
        pass


def running_top(changes: DataFrame, k: int, parts: int = 32) -> DataFrame:
    """Every capture's ``k`` keys with most bytes, then packets, then first by ``key``; published whenever they change.

    ``changes(capture_id, key, bytes, packets)`` are the running counters of keys
    that have changed; counters never fall. Each part of the keys (by hash) holds
    its own best ``k`` in state, and only changes among those go on to the
    capture's ranking, so no task sees all keys of a capture. The last
    ``version`` of a capture is its ranking.
    """
    dealt = changes.select("capture_id", F.expr(f"pmod(xxhash64(key), {parts})").cast("int").alias("part"), "key", "bytes", "packets")
    partial = dealt.groupBy("capture_id", "part").transformWithStateInPandas(
        PartRank(k), outputMode="Append", timeMode="None", outputStructType="capture_id string, part int, key string, bytes bigint, packets bigint",
    )
    return partial.groupBy("capture_id").transformWithStateInPandas(
        WholeRank(k), outputMode="Append", timeMode="None",
        outputStructType="capture_id string, version bigint, rank bigint, key string, bytes bigint, packets bigint",
    )

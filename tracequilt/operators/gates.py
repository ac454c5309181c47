"""Recurrences: "since the last emission".

Not a window function: whether a row is emitted depends on which earlier rows
were.  Rows are hash-partitioned by key and sorted; each task then streams over
its sorted rows and carries one small state across Arrow batches.  No group is
ever collected.  Callers reduce to one row per key and second (or tick) first,
so even the hottest key contributes no more rows than the capture has seconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as C


def _runs(frame: pd.DataFrame, keys: list[str]) -> list[tuple[tuple, slice]]:
    """Consecutive slices with equal keys."""
    changed = np.zeros(len(frame), dtype=bool)
    if len(frame):
        changed[0] = True
    for key in keys:
        column = frame[key].to_numpy()
        changed[1:] |= column[1:] != column[:-1]
    starts = np.flatnonzero(changed).tolist()
    ends = [*starts[1:], len(frame)]
    return [(tuple(frame[k].iloc[s] for k in keys), slice(s, e)) for s, e in zip(starts, ends)]


def cooldown(occurrences: DataFrame, at: str = "as_of_us") -> DataFrame:
    """Mark the occurrences that a live session would emit.

    An occurrence is emitted unless its key was emitted less than the cooldown
    of its class before.  Input: ``capture_id, dedupe_key, cooldown, <at>``.
    One instant counts once per key.  Output adds ``emitted``.
    """
    keys = ["capture_id", "dedupe_key"]
    wait = F.lit(None).cast("bigint")
    for name, seconds in C.COOLDOWN_SECONDS.items():
        wait = F.when(F.col("cooldown") == name, F.lit(seconds * 1_000_000)).otherwise(wait)
    rows = (
        occurrences.select(*keys, "cooldown", F.col(at).cast("bigint").alias(at), wait.alias("wait_us"))
        .dropDuplicates([*keys, at])
        .repartition(*keys)
        .sortWithinPartitions(*keys, at)
    )

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for frame in batches:
            emitted = np.zeros(len(frame), dtype=bool)
            times, waits = frame[at].to_numpy(), frame["wait_us"].to_numpy()
            for key, span in _runs(frame, keys):
                if key != current:
                    current, last = key, None
                row, pause = span.start, int(waits[span.start])
                # jump from emission to emission, not from row to row
                while row < span.stop:
                    if last is not None:
                        row = span.start + int(np.searchsorted(times[span], last + pause, side="left"))
                        if row >= span.stop:
                            break
                    emitted[row] = True
                    last = int(times[row])
                    row += 1
            frame["emitted"] = emitted
            yield frame.drop(columns="wait_us")

    out = f"capture_id string, dedupe_key string, cooldown string, {at} bigint, emitted boolean"
    return rows.mapInPandas(mark, out)


FLOW_KEY = ["capture_id", "a_bin", "b_bin", "a_port", "b_port", "proto"]


def running_flows(tick_flows: DataFrame) -> DataFrame:
    """Per-tick flow rows to running session totals at each tick with traffic."""
    order = (
        Window.partitionBy(*FLOW_KEY).orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return tick_flows.select(
        *FLOW_KEY, "tick",
        *[F.sum(c).over(order).alias(c) for c in ("packets", "bytes", "bytes_in", "bytes_out")],
        F.first("sni", ignorenulls=True).over(order).alias("sni"),
    )


def export_gate(running: DataFrame, min_bytes: int = C.FLOW_EXPORT_MIN_BYTES,
                delta_bytes: int = C.FLOW_EXPORT_DELTA_BYTES,
                interval_seconds: int = C.FLOW_EXPORT_INTERVAL_SECONDS,
                start_on_first: bool = False) -> DataFrame:
    """Flow updates worth exporting: large enough, and first, grown, or due.

    ``running`` has one row per flow and tick with running totals
    (:func:`running_flows`).  Output rows are the exported updates; ``event`` is
    ``active`` (or ``start`` for the first one when asked for).
    """
    interval = max(interval_seconds, 1)
    flow = F.xxhash64(*FLOW_KEY)
    # Rows under the minimum never export and never change state.
    rows = (
        running.where(F.col("bytes") >= min_bytes)
        .withColumn("_h", flow)
        .repartition(*FLOW_KEY)
        .sortWithinPartitions("_h", *FLOW_KEY, "tick")
    )
    group = ["_h", *FLOW_KEY]

    def gate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last_bytes, last_tick = None, 0, 0
        for frame in batches:
            # missing ports compare unequal to themselves, so give them a number
            keyed = frame.assign(a_port=frame["a_port"].fillna(-1), b_port=frame["b_port"].fillna(-1))
            total, tick = frame["bytes"].to_numpy(), frame["tick"].to_numpy()
            keep = np.zeros(len(frame), dtype=bool)
            first = np.zeros(len(frame), dtype=bool)
            for key, span in _runs(keyed, group):
                at = span.start
                if key != current:
                    current, last_bytes, last_tick = key, int(total[at]), int(tick[at])
                    keep[at] = first[at] = True
                    at += 1
                while at < span.stop:
                    # running totals and ticks only grow, so the next export is a binary search away
                    grown = np.searchsorted(total[at:span.stop], last_bytes + delta_bytes, side="left")
                    due = np.searchsorted(tick[at:span.stop], last_tick + interval, side="left")
                    at += int(min(grown, due))
                    if at >= span.stop:
                        break
                    keep[at] = True
                    last_bytes, last_tick = int(total[at]), int(tick[at])
                    at += 1
            event = np.where(first & start_on_first, "start", "active")
            yield frame.assign(event=event)[keep].drop(columns="_h")

    out = (
        "capture_id string, a_bin binary, b_bin binary, a_port int, b_port int, proto string, tick bigint,"
        " packets bigint, bytes bigint, bytes_in bigint, bytes_out bigint, sni string, event string"
    )
    return rows.select(
        "_h", *FLOW_KEY, "tick", "packets", "bytes", "bytes_in", "bytes_out", "sni"
    ).mapInPandas(gate, out)


def closed_flows(running: DataFrame, ends: DataFrame, visible_seconds: int, min_bytes: int = C.FLOW_EXPORT_MIN_BYTES) -> DataFrame:
    """Flows that were exported and have left the visible set: no packet for ``visible_seconds``.

    A flow is exported once it reaches ``min_bytes``; it closes at the tick at
    which it has been silent long enough, if its capture lasts till then.
    ``ends(capture_id, end_tick)`` has every capture's last tick.
    """
    last = running.groupBy(*FLOW_KEY).agg(F.max("bytes").alias("_bytes"), (F.max("tick") + visible_seconds).alias("tick"))
    return (
        last.where(F.col("_bytes") >= min_bytes).join(ends, "capture_id").where("tick <= end_tick")
        .select(*FLOW_KEY, "tick", F.lit("closed").alias("event"))
    )


def new_signals(findings: DataFrame) -> DataFrame:
    """Each finding once per capture: by id, else by kind, subject and summary.

    Of several findings with one id the log's newest is kept, as it comes first.
    """
    named = "CASE WHEN coalesce(id, '') <> '' THEN id ELSE concat_ws('|', kind, subject, summary) END"
    row = f"struct({', '.join(findings.columns)})"
    return (
        findings.groupBy("capture_id", F.expr(named).alias("_key"))
        .agg(F.expr(f"max_by({row}, struct(first_order, dedupe_key))").alias("_row"))
        .select("_row.*")
    )

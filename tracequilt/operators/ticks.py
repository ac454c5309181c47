"""One-second ticks, gaps and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import constants as C
from ..functions import clock
from . import classify

BLOCK_SEQS = 1 << 20
# Seconds of a capture that are scanned in one sorted group; blocks are combined by one row each.
BLOCK_SECONDS = 1 << 12


def assign_ticks(packets: DataFrame, late: str = "fold", block_seqs: int = BLOCK_SEQS) -> DataFrame:
    """Add ``tick``, the second a packet is counted in.

    ``late='fold'``: a packet older than the open second counts in the open one,
    i.e. the running maximum of the second in arrival order.  A small table says
    for every second at which sequence number it opened and at which a later one
    did.  A packet that came before the latter counts in its own second.  Only
    late packets look for the second that was open, among the opened ones.  All
    of this reads three columns; the packets themselves then meet the late ones in
    one equi-join on (capture, seq), which Spark broadcasts when few are late.

    ``late='event_time'``: the packet's own second; no shuffle at all.
    """
    second = F.expr(clock.second_of("ts_us"))
    if late == "event_time":
        return packets.withColumn("tick", second)
    if late != "fold":
        raise ValueError("late must be 'fold' or 'event_time'")
    timed = packets.select("capture_id", "seq", second.alias("_sec"))
    opened = _closing(timed.groupBy(F.col("capture_id").alias("_of"), F.col("_sec").alias("_second")).agg(F.min("seq").alias("_opens")))
    stragglers = (
        timed.join(opened.where("_closes IS NOT NULL"), (F.col("capture_id") == F.col("_of")) & (F.col("_sec") == F.col("_second")))
        .where("seq >= _closes").select("capture_id", "seq")
    )
    # A second that was passed over before its first packet came never opened.
    openers = opened.where("_closes IS NULL OR _opens < _closes").select(F.col("_of").alias("capture_id"), F.col("_opens").alias("seq"), F.col("_second").alias("_sec"))
    late_ones = _fold(stragglers, openers, block_seqs).select(F.col("capture_id").alias("_of"), F.col("seq").alias("_at"), F.col("tick").alias("_open"))
    found = packets.join(late_ones, (F.col("capture_id") == F.col("_of")) & (F.col("seq") == F.col("_at")), "left")
    return found.select(*packets.columns, F.coalesce("_open", second).alias("tick"))


def _closing(opened: DataFrame) -> DataFrame:
    """Add ``_closes``, the lowest opening of any later second: a suffix minimum in two levels.

    Inside a block of seconds the frame runs backwards, so every row adds one
    value to it; what follows the block is the minimum over one row per block.
    """
    blocked = opened.withColumn("_span", F.expr(f"_second div {BLOCK_SECONDS}"))
    inside = Window.partitionBy("_of", "_span").orderBy(F.col("_second").desc()).rowsBetween(Window.unboundedPreceding, -1)
    beyond = Window.partitionBy("_capture").orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        blocked.groupBy(F.col("_of").alias("_capture"), F.col("_span").alias("_at")).agg(F.min("_opens").alias("_least"))
        .withColumn("_after", F.min("_least").over(beyond)).where("_after IS NOT NULL")
    )
    scanned = blocked.withColumn("_inside", F.min("_opens").over(inside))
    return scanned.join(spans, (F.col("_of") == F.col("_capture")) & (F.col("_span") == F.col("_at")), "left").select(
        "_of", "_second", "_opens", F.least("_inside", "_after").alias("_closes")
    )


def _fold(stragglers: DataFrame, openers: DataFrame, block_seqs: int) -> DataFrame:
    """Late packets with the latest second opened before them, found within blocks of sequence numbers."""
    block = F.expr(f"seq div {block_seqs}").alias("_block")
    marks = openers.select("*", block)
    carried = marks.groupBy("capture_id", "_block").agg(F.max("_sec").alias("_peak"))
    stream = stragglers.select("*", block, F.lit(True).alias("_asks")).unionByName(
        marks.select("*", F.lit(False).alias("_asks")), allowMissingColumns=True
    ).unionByName(
        # what was open at the start of a block: the peak of the blocks before it, filed under each block that asks
        _open_at_start(stragglers.select("capture_id", block).distinct(), carried, block_seqs), allowMissingColumns=True
    )
    running = Window.partitionBy("capture_id", "_block").orderBy("seq", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stream.withColumn("tick", F.max("_sec").over(running)).where("_asks").select(*stragglers.columns, "tick")


def _open_at_start(asking: DataFrame, peaks: DataFrame, block_seqs: int) -> DataFrame:
    """One row per asking block at its first sequence number: the second open there.  Blocks are few thousand rows."""
    both = peaks.select("*", F.lit(False).alias("_ask")).unionByName(asking.select("*", F.lit(True).alias("_ask")), allowMissingColumns=True)
    before = Window.partitionBy("capture_id").orderBy("_block").rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("_sec", F.max("_peak").over(before)).where("_ask").select(
        "capture_id", F.expr(f"_block * {block_seqs}").alias("seq"), "_sec", "_block", F.lit(False).alias("_asks")
    )


def with_direction(packets: DataFrame, local_addresses: DataFrame | None = None, offline: bool = True) -> DataFrame:
    """Per-packet direction, for sums that need no flow key; null when undecodable."""
    sides = classify.with_local_sides(packets, local_addresses)
    return sides.selectExpr(*packets.columns, f"CASE WHEN decoded THEN {classify.direction(offline)} END AS direction")


def tick_table(ticked: DataFrame, local_addresses: DataFrame | None = None, offline: bool = True) -> DataFrame:
    """One row per (capture, tick): totals over all frames, in/out bytes over decoded ones,
    sequence number, closing packet time and the silent seconds that follow."""
    def way_sum(way: str) -> str:
        return f"sum(CASE WHEN direction = '{way}' THEN packet_len ELSE 0 END)"

    per_tick = with_direction(ticked, local_addresses, offline).groupBy("capture_id", "tick").agg(
        *[F.expr(a) for a in (
            "count(1) AS packets", "sum(packet_len) AS bytes",
            f"{way_sum('inbound')} AS bytes_in", f"{way_sum('outbound')} AS bytes_out",
            "min_by(ts_us, seq) AS _first_us", "max_by(ts_us, seq) AS _last_us",
        )]
    )
    # Numbers and neighbours come from blocks of seconds and, across blocks, from one row per block.
    blocked = per_tick.withColumn("_span", F.expr(f"tick div {BLOCK_SECONDS}"))
    inside = Window.partitionBy("capture_id", "_span").orderBy("tick")
    across = Window.partitionBy("_capture").orderBy("_at")
    spans = (
        blocked.groupBy(F.col("capture_id").alias("_capture"), F.col("_span").alias("_at"))
        .agg(F.count(F.lit(1)).alias("_ticks"), F.min(F.struct("tick", "_first_us")).alias("_head"))
        .select("_capture", "_at", (F.sum("_ticks").over(across) - F.col("_ticks")).alias("_before"), F.lead("_head").over(across).alias("_head"))
    )
    numbered = blocked.select(
        "*", F.row_number().over(inside).alias("_n"), F.lead(F.struct("tick", "_first_us")).over(inside).alias("_here")
    ).join(spans, (F.col("capture_id") == F.col("_capture")) & (F.col("_span") == F.col("_at"))).withColumn("_next", F.coalesce("_here", "_head"))
    return numbered.select(
        "capture_id", "tick",
        (F.col("_before") + F.col("_n")).cast("bigint").alias("sequence"),
        "packets", "bytes", "bytes_in", "bytes_out",
        # a tick is closed by the packet that opens the next one
        F.coalesce("_next._first_us", "_last_us").alias("last_packet_us"),
        F.coalesce(F.col("_next.tick") - F.col("tick") - 1, F.lit(0)).alias("gap_seconds"),
    )


def gaps(ticks: DataFrame) -> DataFrame:
    """Silent stretches: the tick before and the number of seconds."""
    return ticks.where(F.col("gap_seconds") > 0).select(
        "capture_id", F.col("tick").alias("after_tick"), F.col("gap_seconds").alias("seconds")
    )


def fill_gaps(ticks: DataFrame) -> DataFrame:
    """Ticks plus one zero tick per silent second, as a live capture shows them.

    A gap is cut into hours first and each hour into seconds, so that no row ever
    holds more than a few thousand numbers per step however long the silence.
    """
    zero = F.lit(0).cast("bigint")
    silent = (
        ticks.where(F.col("gap_seconds") > 0)
        .selectExpr("capture_id", "tick + 1 AS _from", "tick + gap_seconds AS _to")
        # a day first: even a gap of ten thousand years is under four million of them
        .selectExpr("*", "explode(sequence(_from, _to, 86400L)) AS _day")
        .selectExpr("*", "explode(sequence(_day, least(_day + 86399L, _to), 3600L)) AS _hour")
        .selectExpr("capture_id", "explode(sequence(_hour, least(_hour + 3599L, _day + 86399L, _to))) AS tick")
        .select("capture_id", "tick", *[zero.alias(c) for c in ("packets", "bytes", "bytes_in", "bytes_out")], F.lit(True).alias("filled"))
    )
    real = ticks.select(
        "capture_id", "tick", "packets", "bytes", "bytes_in", "bytes_out", F.lit(False).alias("filled")
    )
    return real.unionByName(silent)


def last_ticks(ticks: DataFrame, count: int | None = C.LIVE_TICK_WINDOW) -> DataFrame:
    """The most recent ``count`` ticks of each capture; all of them for ``None`` (offline)."""
    if count is None:
        return ticks
    newest = Window.partitionBy("capture_id").orderBy(F.col("tick").desc())
    return ticks.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= count).drop("_n")


def window_totals(ticks: DataFrame, count: int | None = C.LIVE_TICK_WINDOW) -> DataFrame:
    """In and out bytes over the retained ticks."""
    return last_ticks(ticks, count).groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("ticks"),
        F.sum("bytes_in").alias("window_bytes_in"),
        F.sum("bytes_out").alias("window_bytes_out"),
    )


def timeline_live(ticks: DataFrame) -> DataFrame:
    """Tick points, plus a zero point at the last silent second of each gap."""
    points = ticks.select("capture_id", F.col("tick").alias("second"), "bytes_in", "bytes_out")
    zero = F.lit(0).cast("bigint")
    ends = ticks.where(F.col("gap_seconds") > 0).select(
        "capture_id", (F.col("tick") + F.col("gap_seconds")).alias("second"),
        zero.alias("bytes_in"), zero.alias("bytes_out"),
    )
    return points.unionByName(ends)


def timeline_compressed(ticks: DataFrame, points: int = C.TIMELINE_POINTS) -> DataFrame:
    """At most ``points`` points over each capture's span; sums are preserved."""
    whole = Window.partitionBy("capture_id")
    spanned = ticks.select(
        "capture_id", "tick", "bytes_in", "bytes_out", F.min("tick").over(whole).alias("_from"), F.max("tick").over(whole).alias("_to")
    ).withColumn("_n", F.least(F.col("_to") - F.col("_from") + 1, F.lit(points).cast("bigint")))
    flat = "(_n <= 1 OR _to <= _from)"
    bucket = f"CASE WHEN {flat} THEN 0L ELSE ((tick - _from) * (_n - 1)) div greatest(_to - _from, 1L) END"
    sums = spanned.groupBy("capture_id", "_from", "_to", "_n", F.expr(bucket).alias("point")).agg(
        F.sum("bytes_in").alias("_in"), F.sum("bytes_out").alias("_out")
    )
    # The axis comes from the same rows: each point fills up to the next one with traffic; the first tick is point 0.
    order = Window.partitionBy("capture_id").orderBy("point")
    axis = sums.withColumn("_next", F.coalesce(F.lead("point").over(order), F.col("_n"))).selectExpr(
        "*", "explode(sequence(point, _next - 1)) AS at"
    )
    second = (
        f"CASE WHEN {flat} THEN _from WHEN at = _n - 1 THEN _to"
        f" ELSE _from + ((_to - _from) * at) div greatest(_n - 1, 1L) END"
    )
    return axis.selectExpr(
        "capture_id", "at AS point", f"{second} AS second",
        "CASE WHEN at = point THEN _in ELSE 0L END AS bytes_in", "CASE WHEN at = point THEN _out ELSE 0L END AS bytes_out",
    )


def timeline_peak(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("capture_id").agg(F.max(F.greatest("bytes_in", "bytes_out")).alias("peak"))

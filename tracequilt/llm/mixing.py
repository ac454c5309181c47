"""Mixing sources to target weights by Pfair scheduling.

Every source is a queue of blocks of like size. Block i of a source with weight w
out of W may be sent from slot floor(i * W / w) on and must be sent before slot
ceil((i + 1) * W / w); earliest deadline first over these windows keeps every
source within less than one block of its share at every slot. The windows repeat
after W slots, so one period is scheduled, over the weights alone, and every
block finds its slot by arithmetic. When a source runs dry the others go on with
their weights among themselves.

Columns and SQL functions only on the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from heapq import heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequilt.llm.common import shuffle_partitions

#: Characters in a block.
BLOCK_CHARS = 65_536
#: What weights are shares of: the length of a period and the finest share.
TOTAL_WEIGHT = 1000


@dataclass(frozen=True)
class Phase:
    """Slots of one source while the same sources are left: blocks ``first <= i < last`` from slot ``start`` on."""

    first: int
    last: int
    weight: int
    period: int
    start: int
    slots: tuple[int, ...]


def one_period(weights: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period: earliest deadline first among the released, ties by name."""
    period = sum(weights.values())
    sent: dict[str, list[int]] = {s: [] for s in weights}
    released: dict[int, list[str]] = {0: list(weights)}
    due: list[tuple[int, str]] = []
    for slot in range(period):
        for source in released.pop(slot, ()):
            heappush(due, (-(-(len(sent[source]) + 1) * period // weights[source]), source))
        source = heappop(due)[1]
        sent[source].append(slot)
        i, w = len(sent[source]), weights[source]
        if i < w:
            released.setdefault(max(slot + 1, i * period // w), []).append(source)
    return sent


def schedule(weights: dict[str, int], blocks: dict[str, int]) -> tuple[dict[str, list[Phase]], int]:
    """Phases of every source with blocks, and the number of slots: as many phases as sources at most."""
    sent = dict.fromkeys(blocks, 0)
    plan: dict[str, list[Phase]] = {s: [] for s in blocks}
    start = 0
    while active := {s: weights[s] for s in sorted(blocks) if sent[s] < blocks[s]}:
        period = sum(active.values())
        table = one_period(active)
        place = lambda s, i: i // active[s] * period + table[s][i % active[s]]  # noqa: B023, E731
        slots = min(place(s, blocks[s] - sent[s] - 1) for s in active) + 1
        for s, w in active.items():
            n = slots // period * w + sum(t < slots % period for t in table[s])
            plan[s].append(Phase(sent[s], sent[s] + n, w, period, start, tuple(table[s])))
            sent[s] += n
        start += slots
    return plan, start


def temperature_weights(docs: DataFrame, total: int = TOTAL_WEIGHT) -> dict[str, int]:
    """Weights that follow the square root of each source's characters, in parts of about ``total``.

    Sources too small for half a part are not listed; mix() with ``share`` gives
    them a weight in classes. At most ``2 * total`` sources are listed, so what
    reaches the driver is bounded by the parameter.
    """
    sized = docs.where("source IS NOT NULL").groupBy("source").agg(F.sqrt(F.sum(_size())).alias("root"))
    whole = sized.agg(F.sum("root")).first()[0]
    if whole is None:
        return {}
    rows = sized.select(F.col("source").cast("string").alias("source"), F.round(F.lit(total) * F.col("root") / F.lit(whole)).cast("int").alias("w"))
    return {r["source"]: r["w"] for r in rows.where("w >= 1").collect()}


def _size():
    """Characters of a text; an empty or null one counts as one, so that it has a place."""
    return F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("long")


def mix(docs: DataFrame, weights: dict[str, int], block_chars: int = BLOCK_CHARS, seed: int = 0, carry: tuple[str, ...] = (), share: int | None = None) -> DataFrame:
    """doc_id, source, ``block``, ``slot`` and ``at`` of every row, and the columns in ``carry``.

    Sorting by (slot, at) gives the mixture. Within its source a row stands in
    the order of a digest of its id and the seed; ``block`` counts the source's blocks
    of ``block_chars`` characters, ``at`` is the row's place in its block; a text
    longer than a block takes up the blocks that follow. Rows of no source or of
    one without a positive weight come after all others, as one queue. Repeated
    rows each have a place; rows with one id are in order of size, of equal size
    in any order. Without rows there is no schedule and the result is empty.

    With ``share`` every source is in the schedule: the weights are parts of about
    ``share`` that follow square roots of characters, and sources without one form
    classes of like size (within a factor of sqrt(2) in characters). A class has
    the weight of its sources together, one part at least, and sends a block of
    each of its sources in turn until they run dry: Pfair at equal weights.

    A source's running total is made in two steps, within ranges of the digest and
    over these ranges, so a source with most rows is spread like any other.
    """
    good = {s: w for s, w in weights.items() if w > 0}
    digits = max(2, len(f"{4 * shuffle_partitions(docs.sparkSession):x}"))
    known = F.col("source").cast("string").isin(sorted(good)) if good else F.lit(False)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.struct(*carry, F.lit(0).alias("_zero")).alias("_carried"), _size().alias("_size"),
    ).withColumn("_key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    # The sources with a weight are named by it; all others share the name null, kept apart by a flag.
    small = F.col("source").isNotNull() if share else F.lit(False)
    queue = F.when(known, F.concat(F.lit("s"), "source")).when(small, F.concat(F.lit("t"), "source")).otherwise(F.lit(""))
    rows = rows.withColumn("_queue", queue)
    rows = rows.withColumn("_range", F.substring("_key", 1, digits))
    sums = rows.groupBy("_queue", "_range").agg(F.sum("_size").alias("_sum"))
    before = sums.select(
        F.col("_queue").alias("_q"), F.col("_range").alias("_r"), "_sum",
        (F.sum("_sum").over(Window.partitionBy("_queue").orderBy("_range")) - F.col("_sum")).alias("_before"),
    )
    within = Window.partitionBy("_queue", "_range").orderBy("_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("_inside", F.coalesce(F.sum("_size").over(within), F.lit(0)))
        .join(before, (F.col("_queue") == F.col("_q")) & (F.col("_range") == F.col("_r")))
        .withColumn("_start", F.col("_before") + F.col("_inside"))
    )
    # Blocks up to the end of a source's last text; one row per weighted source, and one for the rest.
    sized = sums.groupBy("_queue").agg(F.sum("_sum").alias("n"))
    totals = {r["_queue"]: r["n"] for r in sized.where("_queue NOT LIKE 't%'").collect()}
    blocks = {"s" + s: -(-totals["s" + s] // block_chars) for s in good if totals.get("s" + s)}
    parts = {"s" + s: w for s, w in good.items()}
    others = sized.where("_queue LIKE 't%'").select("_queue", "n", F.expr(f"(n + {block_chars - 1}L) div {block_chars}L").alias("_n"), F.expr("concat('g', int(2 * log2(n)))").alias("_class"))
    # Two classes for each doubling of a source's characters: at most 126.
    classes = others.groupBy("_class").agg(F.sum(F.sqrt("n")).alias("root"), F.sum("_n").alias("n")).collect() if share else []
    whole = sum(math.sqrt(totals["s" + s]) for s in good if totals.get("s" + s)) + sum(r["root"] for r in classes)
    for r in classes:
        blocks[r["_class"]], parts[r["_class"]] = r["n"], max(1, round(share * r["root"] / whole))
    placed = placed.withColumn("block", F.expr(f"_start div {block_chars}L"))
    if classes:
        turns = _turns(others, digits)
        placed = placed.join(turns, (F.col("_queue") == F.col("_q3")) & (F.col("block") == F.col("_i")), "left")
        placed = placed.withColumn("_line", F.coalesce("_class", "_queue")).withColumn("_place", F.coalesce("_turn", "block"))
    else:
        placed = placed.withColumn("_line", F.col("_queue")).withColumn("_place", F.col("block"))
    plan, slots = schedule(parts, blocks)
    phases = [(s, [(p.first, p.last, p.weight, p.period, p.start, list(p.slots)) for p in ps]) for s, ps in plan.items()]
    phases.append(("", [(0, 1 << 62, 1, 1, slots, [0])]))
    # Bounded by the weights: sources times the length of a period.
    table = docs.sparkSession.createDataFrame(
        phases, "_q2 string, phases array<struct<first: long, last: long, weight: long, period: long, start: long, slots: array<int>>>"
    )
    found = (
        placed.join(F.broadcast(table), F.col("_line") == F.col("_q2"))
        .withColumn("p", F.expr("filter(phases, p -> p.first <= _place AND _place < p.last)[0]"))
    )
    slot = F.expr("p.start + (_place - p.first) div p.weight * p.period + p.slots[int((_place - p.first) % p.weight)]")
    return found.select(
        "doc_id", "source", "block", slot.cast("long").alias("slot"), (F.col("_start") - F.col("block") * block_chars).alias("at"),
        *([F.col("_carried")] if carry else []),
    )


def _turns(sources: DataFrame, digits: int) -> DataFrame:
    """``_turn`` of every block ``_i`` of every small source ``_q3`` in its class: first blocks first, by a digest of the source.

    Counted within ranges of the digest and over these ranges, so no class is one task's.
    """
    each = sources.select(F.col("_queue").alias("_q3"), "_class", F.md5("_queue").alias("_d"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_i"))
    each = each.withColumn("_part", F.substring("_d", 1, digits))
    counts = each.groupBy("_class", "_i", "_part").agg(F.count("*").alias("_c"))
    over = Window.partitionBy("_class").orderBy("_i", "_part")
    before = counts.select(F.col("_class").alias("_k"), F.col("_i").alias("_j"), F.col("_part").alias("_p"), (F.sum("_c").over(over) - F.col("_c")).alias("_earlier"))
    inside = F.row_number().over(Window.partitionBy("_class", "_i", "_part").orderBy("_d", "_q3"))
    return (
        each.withColumn("_inside", inside)
        .join(before, (F.col("_class") == F.col("_k")) & (F.col("_i") == F.col("_j")) & (F.col("_part") == F.col("_p")))
        .select("_q3", "_i", "_class", (F.col("_earlier") + F.col("_inside") - 1).alias("_turn"))
    )


def mixed(docs: DataFrame, weights: dict[str, int], block_chars: int = BLOCK_CHARS, seed: int = 0, share: int | None = None) -> DataFrame:
    """All rows and columns in the order of the mixture: ranges of slots in partition order, sorted inside."""
    others = tuple(c for c in docs.columns)
    rows = mix(docs, weights, block_chars, seed, others, share)
    ordered = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "slot", "at").sortWithinPartitions("slot", "at")
    return ordered.select(*[F.col("_carried")[c].alias(c) for c in docs.columns])


def oracle(total: int = TOTAL_WEIGHT, block_chars: int = BLOCK_CHARS, seed: int = 0) -> str:
    """The mixture under temperature weights as DuckDB SQL, slot by slot instead of by periods."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, greatest(coalesce(length(text), 0), 1) AS size, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
roots AS (SELECT source, sqrt(sum(size)) AS root FROM d WHERE source IS NOT NULL GROUP BY source),
w AS (
  SELECT * FROM (SELECT source, CAST(round({total} * root / (SELECT sum(root) FROM roots)) AS BIGINT) AS weight FROM roots) WHERE weight >= 1),
starts AS (
  SELECT d.doc_id, d.source, w.source AS queue,
    CAST(coalesce(sum(size) OVER (PARTITION BY w.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d LEFT JOIN w ON w.source = d.source),
q AS (
  SELECT w.source, weight, CAST(ceil(sum(size) / {block_chars}.0) AS BIGINT) AS n FROM w JOIN d ON d.source = w.source GROUP BY ALL),
lists AS (SELECT list(source ORDER BY source) AS s, list(weight ORDER BY source) AS w, list(n ORDER BY source) AS n FROM q),
turns AS (
  SELECT 0 AS slot, NULL::BIGINT AS pick, list_transform(n, lambda x: CAST(0 AS BIGINT)) AS sent,
    list_transform(n, lambda x: CAST(0 AS BIGINT)) AS since, 0 AS began FROM lists
  UNION ALL
  SELECT slot + 1, pick, next, CASE WHEN next[pick] = n[pick] THEN next ELSE since END, CASE WHEN next[pick] = n[pick] THEN slot + 1 ELSE began END
  FROM (
    SELECT *, list_transform(range(1, len(sent) + 1), lambda i: sent[i] + CASE WHEN i = pick THEN 1 ELSE 0 END) AS next
    FROM (
      SELECT t.slot, t.sent, t.since, t.began, l.n,
        list_sort(list_transform(
          list_filter(range(1, len(l.n) + 1), lambda i: sent[i] < l.n[i] AND ((sent[i] - since[i]) * whole) // l.w[i] <= slot - began),
          lambda i: {{'deadline': ((sent[i] - since[i] + 1) * whole + l.w[i] - 1) // l.w[i], 'i': i}}))[1].i AS pick
      FROM (SELECT turns.*, list_sum(list_transform(range(1, len(lists.n) + 1),
              lambda i: CASE WHEN sent[i] < lists.n[i] THEN lists.w[i] ELSE 0 END)) AS whole FROM turns, lists) t, lists l
      WHERE t.slot < list_sum(l.n)))),
sent AS (
  SELECT s[pick] AS source, slot - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS block
  FROM turns, lists WHERE pick IS NOT NULL)
SELECT doc_id, starts.source, start // {block_chars} AS block,
  CAST(CASE WHEN queue IS NULL THEN coalesce((SELECT max(slot) + 1 FROM sent), 0) + start // {block_chars} ELSE sent.slot END AS BIGINT) AS slot,
  start % {block_chars} AS "at"
FROM starts LEFT JOIN sent ON sent.source = queue AND sent.block = start // {block_chars}"""

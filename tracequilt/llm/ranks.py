"""Positions inside groups without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequilt.runtime import materialize


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Add ``name``: each row's place (from 0) in its group, in the given order.

    Rows are dealt in ranges of (group, order), so a group that holds a third of
    all rows lies in many ranges. A row's place is its place in its range plus
    the rows of its group in earlier ranges, of which there is one count per group
    and range. The last item of ``order`` should tell all rows apart; the result
    is written, so places stay as they are when tasks run again. ``group`` may be
    empty: then the whole table is one group.
    """
    keys = [F.col(c) for c in group]
    ranged = materialize(rows.repartitionByRange(*[k.asc_nulls_first() for k in keys], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    at = Window.partitionBy(*group, "_range").orderBy(*order)
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group]
    before = Window.partitionBy(*[f"_of_{c}" for c in group]).orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        ranged.groupBy(*[k.alias(f"_of_{c}") for k, c in zip(keys, group)], F.col("_range").alias("_in")).agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    )
    on = F.col("_range") == F.col("_in")
    for c in same:
        on &= c
    placed = ranged.withColumn(name, F.row_number().over(at) - 1).join(counts, on)
    return placed.select(*rows.columns, (F.col(name) + F.col("_before")).cast("long").alias(name))


#: Rows of one key, at least, that are met by broadcast; and the most keys that can be.
FEW, MOST_KEYS = 100, 100_000


def join_unique(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Left join of ``rows`` to a table with one row per key, where one key may hold most rows.

    A key is heavy above ``FEW`` rows and above a share of 1 in ``MOST_KEYS`` of all
    rows, so at most ``MOST_KEYS`` keys are heavy whatever the data: these alone are
    broadcast. All other rows meet the table by a shuffle, in which no key exceeds that share.
    """
    more = [c for c in table.columns if c not in on]
    total = rows.count()
    heavy = rows.groupBy(*on).count().where(F.col("count") > max(FEW, total // MOST_KEYS)).select(*on)
    held = heavy.join(table, on, "left").select(*[F.col(c).alias(f"_k_{c}") for c in on], *[F.col(c).alias(f"_v_{c}") for c in more], F.lit(True).alias("_held"))
    same = None
    for c in on:
        same = F.col(c) == F.col(f"_k_{c}") if same is None else same & (F.col(c) == F.col(f"_k_{c}"))
    met = rows.join(F.broadcast(held), same, "left")
    done = met.where("_held").select(*rows.columns, *[F.col(f"_v_{c}").alias(c) for c in more])
    rest = met.where("_held IS NULL").select(*rows.columns)
    return done.unionByName(rest.join(table, on, "left").select(*rows.columns, *more))

"""Ranking by traffic.

With a limit the rank is a window top-k, which Spark plans as WindowGroupLimit:
each task keeps k rows per capture before the shuffle, so one giant capture is
no bottleneck.  Without a limit rows are only ordered (a range-partitioned sort).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as C
from ..functions import any_of, ip, text
from .classify import proto_rank


def connection_key() -> list[str]:
    return [*ip.order_key("a_bin"), *ip.order_key("b_bin"), "a_port", "b_port", proto_rank()]


def host_key() -> list[str]:
    return ip.order_key("host_bin")


def service_key() -> list[str]:
    return ["service", proto_rank()]


def tcp_key() -> list[str]:
    return [*ip.order_key("endpoint_a_bin"), "endpoint_a_port", *ip.order_key("endpoint_b_bin"), "endpoint_b_port"]


KEYS = {"flows": connection_key, "hosts": host_key, "services": service_key, "tcp": tcp_key}


def traffic_order(kind: str) -> list[Column]:
    """Bytes desc, packets desc, then the key; a missing port sorts first (Spark's default)."""
    return [F.col("bytes").desc(), F.col("packets").desc(), *[F.expr(k) for k in KEYS[kind]()]]


def rank_by_traffic(df: DataFrame, kind: str, limit: int | None = None, by: tuple[str, ...] = (),
                    numbered: bool = False) -> DataFrame:
    """Bytes desc, packets desc, then key; at most ``limit`` rows per capture with a ``rank``.

    ``numbered`` adds the rank without a limit; use it where a group is bounded,
    such as one second of one capture.
    """
    if limit is None and not numbered:
        return df.orderBy("capture_id", *by, *traffic_order(kind))
    window = Window.partitionBy("capture_id", *by).orderBy(*traffic_order(kind))
    ranked = df.withColumn("rank", F.row_number().over(window))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def normalize_top_n(top_n: int | None) -> int:
    """0 or nothing means the default; at most the maximum."""
    if top_n is not None and top_n < 0:
        raise ValueError("top_n must not be negative")
    return min(top_n, C.TOP_N_MAX) if top_n else C.TOP_N_DEFAULT


def take(ranked: DataFrame, top_n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """First ``top_n`` rows of each capture in rank order, renumbered (after a filter on a pool)."""
    window = Window.partitionBy("capture_id", *by).orderBy("rank")
    return (
        ranked.withColumn("_rank", F.row_number().over(window))
        .where(F.col("_rank") <= top_n)
        .drop("rank")
        .withColumnRenamed("_rank", "rank")
    )


def focus_reorder(ranked: DataFrame, focus: str, columns: list[str]) -> DataFrame:
    """Rows that mention the focus text first, otherwise in rank order."""
    token = focus.strip()
    if not token:
        return ranked.orderBy("capture_id", "rank")
    hit = F.expr(any_of([text.folded_contains(column, token) for column in columns]))
    window = Window.partitionBy("capture_id").orderBy(F.col("_hit").desc(), "rank")
    return (
        ranked.withColumn("_hit", hit)
        .withColumn("focus_rank", F.row_number().over(window))
        .drop("_hit")
    )


def byte_share(ranked: DataFrame) -> DataFrame:
    """Share of the listed bytes, per capture."""
    whole = F.sum("bytes").over(Window.partitionBy("capture_id"))
    return ranked.withColumn("share", F.when(whole > 0, F.col("bytes") / whole).otherwise(F.lit(0.0)))

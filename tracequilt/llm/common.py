"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes between words, as a regular-expression class body that Java, Python and RE2 read alike.
BLANKS = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_text(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` alone (a null text is empty), so that no extra column can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"), *more)


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending values that cut a whole-number column into ranges of like size.

    Ties go to one range, so the number of rows in a range is bounded only as far
    as one value's rows are; the bounds themselves are as many as partitions.
    """
    if parts < 2:
        return []
    steps = [i / parts for i in range(1, parts)]
    found = df.select(F.percentile_approx(column, steps, 100 * parts).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def range_of(column: str, bounds: list[int]) -> Column:
    """Number of bounds that are at most the value; null goes to range 0."""
    if not bounds:
        return F.lit(0)
    cuts = "array(" + ",".join(f"{b}L" for b in bounds) + ")"
    # Binary search in plain SQL: the ranges are few, the rows many.
    return F.expr(f"coalesce(int(size(filter({cuts}, b -> b <= {column}))), 0)")

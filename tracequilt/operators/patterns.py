"""Watch lists as tables: which names contain a pattern of a list of any length.

Lists in the policy become conditions inside the scan, which suits a few dozen
entries. Here the list is a table: the distinct names are cut into substrings of
exactly the lengths that patterns have and joined with the patterns by equality, so
a name costs its length times these few lengths and not the list's. Names are
distinct before, so rows are never searched; neither names nor patterns pass
through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import ascii_lower, or_empty
from ..runtime import materialize

#: Most bytes of pieces that one row of the search holds at a time; a long name gives several rows.
BLOCK_BYTES = 1 << 20


def pattern_table(patterns: DataFrame, column: str = "pattern") -> DataFrame:
    """Distinct non-blank patterns, trimmed and folded as list entries of a policy are."""
    return patterns.selectExpr(f"{ascii_lower(f'trim({or_empty(column)})')} AS pattern").where("pattern <> ''").distinct()


def matches(names: DataFrame, patterns: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``name`` (folded) and ``pattern`` of every pair in which the name contains the pattern.

    ``names`` has one column ``name``; null and empty names contain nothing.
    ``patterns`` is the result of :func:`pattern_table`.
    """
    folded = names.selectExpr(f"{ascii_lower(or_empty('name'))} AS name").where("name <> ''").distinct()
    lengths = patterns.agg(F.collect_set(F.length("pattern")).alias("_lengths"))
    starts = (
        folded.crossJoin(F.broadcast(lengths)).selectExpr("name", "explode(_lengths) AS _len").where("_len <= length(name)")
        .selectExpr("name", "_len", "length(name) - _len + 1 AS _starts", f"greatest(1, CAST({block_bytes} div _len AS INT)) AS _step")
        .selectExpr("*", "explode(sequence(1, _starts, _step)) AS _from")
    )
    pieces = starts.selectExpr(
        "name", "explode(array_distinct(transform(sequence(_from, least(_from + _step - 1, _starts)), i -> substring(name, i, _len)))) AS pattern",
    )
    return pieces.join(patterns, "pattern").select("name", "pattern").distinct()


def watched(rows: DataFrame, texts: dict[str, str], patterns: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows with ``patterns``, the ascending patterns that any of their texts contains; rows without one go.

    ``texts`` names SQL expressions of a row's texts. The search sees their
    distinct values; what is joined back to the rows is one row per distinct text that matches.
    """
    named = rows
    for name, expression in texts.items():
        named = named.withColumn(f"_{name}", F.expr(ascii_lower(or_empty(expression))))
    columns = [f"_{name}" for name in texts]
    names = named.select(F.explode(F.array(*columns)).alias("name"))
    hits = matches(names, patterns, block_bytes).groupBy("name").agg(F.collect_set("pattern").alias("found"))
    hits = materialize(hits, "watched")
    for column in columns:
        named = named.join(hits.select(F.col("name").alias(f"{column}_key"), F.col("found").alias(f"{column}_found")), F.col(column) == F.col(f"{column}_key"), "left")
    every = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(F.col(f"{c}_found"), F.array().cast("array<string>")) for c in columns]))))
    return named.select(*rows.columns, every.alias("patterns")).where(F.size("patterns") > 0)

"""Range lookup of addresses and as-of lookup of observations.

Both keep the asking rows as they are: the rows appear once in the plan, nothing
is joined back to itself, and no pairs of candidates are produced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import octets
from ..runtime import computed

# Blocks that span more fine buckets than this are filed under coarse buckets.
WIDE = 256


def _prefixes(ip: str) -> tuple[str, str]:
    """Fine and coarse bucket: /16 and /8 for IPv4, /32 and /16 for IPv6."""
    v4 = f"length({ip}) = 4"
    fine = f"CASE WHEN {v4} THEN {octets.be_int(ip, 0, 2)} ELSE {octets.be_int(ip, 0, 4)} END"
    coarse = f"CASE WHEN {v4} THEN {octets.be_int(ip, 0, 1)} ELSE {octets.be_int(ip, 0, 2)} END"
    return fine, coarse


def range_lookup(rows: DataFrame, ip_column: str, blocks: DataFrame, name: str) -> DataFrame:
    """Add ``name``, the struct of the block that holds ``ip_column`` (null outside all).

    ``blocks(start_bin, end_bin, ...)`` must not overlap, so a row matches at most
    one.  Blocks are filed under address-prefix buckets, narrow ones under fine
    and wide ones under coarse buckets (non-overlap allows few of those); each
    kind is one left equi-join with a residual range test over the few blocks
    of a bucket.  No hint: Spark broadcasts the blocks when small, which leaves
    the rows where they are, else it sort-merges and splits skewed buckets.
    """
    payload = ", ".join(c for c in blocks.columns if c not in ("start_bin", "end_bin"))
    (lo_fine, lo_coarse), (hi_fine, hi_coarse) = _prefixes("start_bin"), _prefixes("end_bin")
    spread = blocks.selectExpr(
        "start_bin", "end_bin", f"struct({payload}) AS _block", "length(start_bin) AS _family",
        f"{lo_fine} AS _lf", f"{hi_fine} AS _hf", f"{lo_coarse} AS _lc", f"{hi_coarse} AS _hc",
    )
    found = computed(rows, _family=f"length({ip_column})", _fine=_prefixes(ip_column)[0], _coarse=_prefixes(ip_column)[1])
    for level, span, test in (("_fine", "_lf, _hf", f"_hf - _lf < {WIDE}"), ("_coarse", "_lc, _hc", f"_hf - _lf >= {WIDE}")):
        filed = spread.where(test).selectExpr(
            f"start_bin AS {level}_s", f"end_bin AS {level}_e", f"_block AS {level}_b", f"_family AS {level}_f",
            f"explode(sequence({span})) AS {level}_k",
        )
        on = f"_family = {level}_f AND {level} = {level}_k AND {ip_column} BETWEEN {level}_s AND {level}_e"
        found = found.join(filed, F.expr(on), "left").drop(*[f"{level}_{c}" for c in "sefk"])
    return found.selectExpr(*rows.columns, f"coalesce(_fine_b, _coarse_b) AS {name}")


def latest_within(rows: DataFrame, observations: DataFrame, keys: list[str], ttl_seconds: int,
                  value: str, name: str, at: str = "as_of_us") -> DataFrame:
    """Add ``name``, the latest observation of ``keys`` not after ``at`` and younger than the TTL.

    An as-of join in linear work.  Time is cut into TTL-long slots and an
    observation is filed under its own and the next one; rows and observations
    of a (key, slot) form one time-ordered stream in which each row takes the
    last observation before it.  A hot key is spread over its slots; rows
    without a key cannot match and are spread by hash.
    """
    ttl = ttl_seconds * 1_000_000
    keyed = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    spread = f"-1 - pmod(xxhash64({', '.join(rows.columns)}), 4096)"
    asked = rows.selectExpr(
        "*", f"CASE WHEN {keyed} THEN {at} div {ttl} ELSE {spread} END AS _slot", f"{at} AS _t", "1 AS _asks",
    )
    filed = observations.selectExpr(
        *keys, f"named_struct('at', observed_us, 'value', {value}) AS _seen", "observed_us AS _t", "0 AS _asks",
        f"explode(array(observed_us div {ttl}, observed_us div {ttl} + 1)) AS _slot",
    )
    stream = asked.unionByName(filed, allowMissingColumns=True)
    # observations of the same instant come first
    order = Window.partitionBy(*keys, "_slot").orderBy("_t", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        stream.withColumn("_last", F.last("_seen", ignorenulls=True).over(order))
        .where("_asks = 1")
        .selectExpr(*rows.columns, f"CASE WHEN {at} - _last.at < {ttl} THEN _last.value END AS {name}")
    )

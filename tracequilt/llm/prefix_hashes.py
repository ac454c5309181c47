"""Document fingerprints from prefix polynomial hashes.

One pass over a text gives, for two prime moduli, the hash of every prefix. From
these arrays any two spans are compared in constant time, and the longest common
extension of two places is found by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequilt.llm.common import keyed_text, range_bounds, range_of, shuffle_partitions

#: The two largest primes under 2 ** 31: products of residues and running sums fit 64 bits.
MODULI = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_597_334_677)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(which: int, n: int) -> np.ndarray:
    """``BASES[which] ** i`` modulo ``MODULI[which]`` for i up to ``n``; kept and doubled as needed."""
    have = _powers[which]
    while len(have) <= n:
        step = np.uint64(pow(BASES[which], len(have), MODULI[which]))
        have = np.concatenate((have, have * step % np.uint64(MODULI[which])))
    _powers[which] = have
    return have


def points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


class PrefixHashes:
    """Hashes of all prefixes of one sequence of code points."""

    def __init__(self, codes: np.ndarray) -> None:
        self.n = len(codes)
        self.sums = []
        for which, modulus in enumerate(MODULI):
            terms = (codes.astype(np.uint64) + np.uint64(1)) * powers(which, self.n)[: self.n] % np.uint64(modulus)
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms) % np.uint64(modulus))))

    def fingerprint(self) -> str:
        """Length and both hashes of the whole, in hex."""
        return f"{self.n:x}-" + "".join(f"{int(s[-1]):08x}" for s in self.sums)

    def same(self, at: int, other: PrefixHashes, there: int, length: int) -> bool:
        """Whether ``length`` points from ``at`` here equal those from ``there`` in the other."""
        for which, modulus in enumerate(MODULI):
            a, b = self.sums[which], other.sums[which]
            x, y = int(a[at + length]) - int(a[at]), int(b[there + length]) - int(b[there])
            # A span's sum carries the power of its place; the earlier one is moved up to the later one's.
            if at < there:
                x *= int(powers(which, there - at)[there - at])
            elif there < at:
                y *= int(powers(which, at - there)[at - there])
            if (x - y) % modulus:
                return False
        return True

    def extension(self, at: int, other: PrefixHashes, there: int) -> int:
        """Length of the longest common extension to the right of both places."""
        low, high = 0, min(self.n - at, other.n - there)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(at + low, other, there + low, middle - low):
                low = middle
            else:
                high = middle - 1
        return low

    def back_extension(self, end: int, other: PrefixHashes, there: int) -> int:
        """Length of the longest common extension to the left of both places."""
        low, high = 0, min(end, there)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(end - middle, other, there - middle, middle - low):
                low = middle
            else:
                high = middle - 1
        return low

    def likeness(self, other: PrefixHashes) -> float:
        """Share of the longer text in the common beginning and the common end: 1 for equal texts, both empty included."""
        longer, shorter = max(self.n, other.n), min(self.n, other.n)
        if not longer:
            return 1.0
        head = self.extension(0, other, 0)
        return (head + min(self.back_extension(self.n, other, other.n), shorter - head)) / longer


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_text(text: str, after: str) -> str:
    """The text with its last quarter replaced by the beginning of the next one."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + after[:quarter]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (part, extra, doc_id, text): each row against the one after it in its part."""
    held = None
    for batch in batches:
        rows = []
        for part, extra, key, text in zip(batch["part"].to_pylist(), batch["extra"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"]):
            here = (part, key, text.as_py())
            hashes = PrefixHashes(points(here[2]))
            if held is not None and held[0][0] == part:
                (_, before, old), old_hashes = held
                edited = edited_text(old, here[2])
                edited_hashes = PrefixHashes(points(edited))
                rows.append((
                    before, len(old), hashlib.sha256(edited.encode()).hexdigest(), old_hashes.fingerprint(), edited_hashes.fingerprint(),
                    old_hashes.likeness(edited_hashes), old_hashes.likeness(hashes),
                ))
            held = None if extra else (here, hashes)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [field.split()[0] for field in RESULT.split(", ")]
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; see ``RESULT``.

    The next document is the one with the next larger doc_id, after the last the
    first; rows without id come before all others and rows with the same id are
    in order of their text. A single document is its own next. Null text is
    empty; extra columns are ignored; an empty table gives no rows.

    Rows are dealt by ranges of doc_id. The first row of each range also goes to
    the end of the range before it, so that no task needs another's rows.
    """
    keyed = keyed_text(docs)
    parts = shuffle_partitions(docs.sparkSession)
    bounds = range_bounds(keyed.select("doc_id"), "doc_id", parts)
    ranged = keyed.withColumn("part", range_of("doc_id", bounds))
    # One thin row per range reaches the driver.
    found = ranged.groupBy("part").agg(F.min("doc_id").alias("least"), F.bool_or(F.isnull("doc_id")).alias("no_id")).orderBy("part").collect()
    firsts = [(r["part"], None if r["no_id"] else r["least"]) for r in found]
    if not firsts:
        return keyed.mapInArrow(_compare_nothing, RESULT)
    to = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    spark = docs.sparkSession
    target = F.broadcast(spark.createDataFrame([(a, b) for a, b in to], "first long, part int"))
    copies = (
        keyed.join(target, keyed.doc_id.eqNullSafe(F.col("first")))
        .groupBy("part", "first").agg(F.min("text").alias("text"))
        .select(F.col("first").alias("doc_id"), "text", "part", F.lit(True).alias("extra"))
    )
    return (
        ranged.withColumn("extra", F.lit(False)).unionByName(copies)
        .repartition(parts, "part")
        .sortWithinPartitions("part", "extra", F.asc_nulls_first("doc_id"), "text")
        .mapInArrow(_compare, RESULT)
    )


def _compare_nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _ in batches:
        pass
    yield from ()

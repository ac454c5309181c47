"""SimHash fingerprints linked by covering locality-sensitive hashing.

Every bit position gets a vector of ``radius + 1`` bits; each non-zero vector v
of that length makes a mask of the positions whose vector has an odd product
with v. Two fingerprints that differ in at most ``radius`` positions leave some v
orthogonal to all of these positions, so in that mask's table they have equal
masked bits: no pair within the radius is missed. Linking runs on distinct
fingerprints, so any number of exact copies is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequilt.llm.common import keyed_text, text_of
from tracequilt.llm.components import connected_components
from tracequilt.runtime import materialize

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Fingerprints of one bucket that are compared in one go; larger buckets are split by further masks.
BUCKET = 1024
#: What bytes.split() without an argument cuts at is exactly 0x20 and 0x09-0x0D.
LOWER = bytes(range(256)).lower()


def simhash(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one text; 0 if it has no word."""
    found = text.encode().translate(LOWER).split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in found]).tolist()  # one past the blank after each word
        starts = [0, *ends]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[s : e - 1], seed) for s, e in zip(starts, ends[words - 1 :])]
    raw = np.array(hashes, np.dtype("<u8"))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(raw), 1 << 16):  # bit columns of a bounded number of hashes at a time
        ones += np.unpackbits(raw[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(raw), bitorder="little").view(np.dtype("<u8"))[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long) and ``key`` (a hash of id and text) of every row.

    Null text is empty; empty text has fingerprint 0; null ids and repeated rows stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((simhash(t.as_py(), words, seed) for t in batch["text"]), np.uint64, batch.num_rows)
            yield pa.record_batch({"doc_id": batch["doc_id"], "key": batch["key"], "fp": bits.view(np.int64)})

    return keyed_text(docs).withColumn("key", _key("doc_id", "text")).mapInArrow(run, "doc_id long, key long, fp long")


def _key(doc_id, text):
    return F.xxhash64(doc_id, text)


def covering_masks(radius: int, positions: list[int], seed: int) -> list[int]:
    """``2 ** (radius + 1) - 1`` masks over the given bit positions, as unsigned numbers.

    Position vectors are dealt so that each value occurs about equally often,
    which makes all masks about half as long as the positions.
    """
    size = 1 << (radius + 1)
    vectors = np.random.default_rng(seed).permutation(np.arange(len(positions)) % size)
    return [sum(1 << p for p, m in zip(positions, vectors.tolist()) if (m & v).bit_count() & 1) for v in range(1, size)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _link_bucket(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one bucket: at most one link less than fingerprints."""
    links, rest = [], fps
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                links += [(int(x), int(y)) for y in rest[near]]
                front += list(rest[near])
                rest = rest[~near]
    return links


def _scan(radius: int, limit: int):
    """Over rows sorted by (path, key): links of every bucket, or the rows of a bucket over the limit.

    A bucket that outgrows the limit is passed on while it streams by, so a task
    holds at most ``limit`` fingerprints and one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, over = np.zeros(0, np.uint64), None, False
        for batch in batches:
            path, key = batch["path"].to_numpy(), batch["key"].to_numpy()
            fp = batch["fp"].to_numpy().view(np.uint64)
            if not len(fp):
                continue
            new = np.flatnonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1])) + 1
            edges = np.concatenate(([0], new, [len(fp)]))
            sizes = np.diff(edges)
            links, passed = [], []
            # Single rows inside the batch can have no partner; only the first and last run may go on elsewhere.
            runs = np.flatnonzero(sizes > 1).tolist()
            for r in sorted({0, len(sizes) - 1, *runs}):
                a, b = int(edges[r]), int(edges[r + 1])
                here = (int(path[a]), int(key[a]))
                if here != at:
                    links += _link_bucket(held, radius) if len(held) > 1 else []
                    held, at, over = np.zeros(0, np.uint64), here, False
                if over:
                    passed.append((here, fp[a:b]))
                    continue
                held = np.concatenate((held, fp[a:b]))
                if len(held) > limit:
                    passed.append((here, held))
                    held, over = np.zeros(0, np.uint64), True
            yield _out(links, passed)
        yield _out(_link_bucket(held, radius) if len(held) > 1 else [], [])

    return run


def _out(links: list, passed: list) -> pa.RecordBatch:
    pair = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    more = [f for _, f in passed]
    path = [np.full(len(f), p, np.int64) for (p, _), f in passed]
    key = [np.full(len(f), k, np.int64) for (_, k), f in passed]
    join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    rest = join([f.view(np.int64) for f in more])
    none = pa.nulls(len(rest), pa.int64())
    return pa.record_batch({
        "u": pa.concat_arrays([pa.array(pair[:, 0]), none]), "v": pa.concat_arrays([pa.array(pair[:, 1]), none]),
        "path": pa.concat_arrays([pa.nulls(len(pair), pa.int64()), pa.array(join(path))]),
        "key": pa.concat_arrays([pa.nulls(len(pair), pa.int64()), pa.array(join(key))]),
        "fp": pa.concat_arrays([pa.nulls(len(pair), pa.int64()), pa.array(rest)]),
    })


LINKS = "u long, v long, path long, key long, fp long"


def _tables(radius: int, depth: int) -> list[tuple[int, int, list[int], int]]:
    """(path, parent path, positions left to differ, mask) of every table of one depth.

    A deeper table splits a bucket of its parent: its members agree on the
    parent's mask, so only the other positions are masked anew.
    """
    level = [(0, 0, list(range(64)), 0)]
    for d in range(depth):
        level = [
            (path * (1 << (radius + 1)) + i + 1, path, [p for p in left if not mask >> p & 1], mask)
            for path, _, left, _ in level
            for i, mask in enumerate(covering_masks(radius, left, seed=1 + path + 1009 * d))
        ]
    return level


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``u`` and ``v``: links that connect the same fingerprints as all pairs within the radius do.

    ``distinct`` has one row per fingerprint in ``fp``. Buckets above ``bucket``
    go through the masks of the next depth, as tables of their own. After three
    depths about eight positions are left, so a bucket has at most a few hundred
    members: there the limit no longer applies and the result is always whole.
    """
    found, rows = None, distinct.select("fp", F.lit(0).cast("long").alias("path"))
    for depth in (1, 2, 3):
        by_parent: dict[int, list[tuple[int, int]]] = {}
        for path, parent, _, mask in _tables(radius, depth):
            by_parent.setdefault(parent, []).append((path, mask))
        masks = rows.sparkSession.createDataFrame(
            [(parent, [(p, _signed(m)) for p, m in tables]) for parent, tables in by_parent.items()],
            "path long, tables array<struct<path: long, mask: long>>",
        )
        # The mask tables' size follows from the radius alone (31 masks at depth 1, 31 ** 3 at depth 3).
        spread = (
            rows.join(F.broadcast(masks), "path")
            .select("fp", *(["key"] if depth > 1 else []), F.explode("tables").alias("t"))
            .select("fp", F.col("t.path").alias("path"),
                    F.expr("xxhash64(key, fp & t.mask)" if depth > 1 else "fp & t.mask").alias("key"))
        )
        dealt = spread.repartition("path", "key").sortWithinPartitions("path", "key")
        out = materialize(dealt.mapInArrow(_scan(radius, bucket if depth < 3 else 1 << 62), LINKS), "simhash")
        part = out.where("u IS NOT NULL").select("u", "v")
        found = part if found is None else found.union(part)
        rows = out.where("fp IS NOT NULL").select("fp", "path", "key")
        if rows.isEmpty():
            break
    return found


def _grouped(docs: DataFrame, radius: int, words: int, seed: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and the component of every distinct one: fp, first_id, root."""
    marked = materialize(fingerprints(docs, words, seed), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = connected_components(links(distinct, radius, bucket))
    return marked, distinct.join(found, distinct.fp == found.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    component_id is the smallest doc_id that a chain of links reaches, the row's
    own included; links join fingerprints with at most ``radius`` differing bits.
    Rows without an id take part: their component is the smallest id reached,
    null if there is none. Repeated rows give repeated results, an empty table
    none; columns other than doc_id and text are ignored.
    """
    marked, grouped = _grouped(docs, radius, words, seed, bucket)
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = grouped.join(least, "root").select("fp", "component_id")
    return marked.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """One row of each component, that with the smallest doc_id; all columns stay.

    A row without id is kept only if its component has none with one. Of rows
    alike in id and text one stays.
    """
    marked, grouped = _grouped(docs, radius, words, seed, bucket)
    # Rows are counted down to one per fingerprint before components meet.
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "key")).alias("first")
    kept = (
        marked.groupBy("fp").agg(first).join(grouped.select("fp", "root"), "fp")
        .groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("_key"))
    )
    keyed = docs.withColumn("_own", _key(F.col("doc_id").cast("long"), text_of("text")))
    return keyed.join(kept, F.col("_own") == F.col("_key"), "left_semi").dropDuplicates(["_own"]).select(*docs.columns)

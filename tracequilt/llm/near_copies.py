"""Near copies of one corpus: SimHash candidates, each held to the exact Jaccard similarity of word shingles.

Fingerprints have 128 bits, of the set of five-word shingles. At a similarity of
0.8 about 15 bits in a hundred differ, too many for one covering radius, so
covering masks are made for four sets of bits, each wide enough that a bucket
of unlike documents has a few members, however many documents there are.

A bucket streams by in a fixed random order of fingerprints; its first ``LEADERS``
members meet all later ones. Every fingerprint has ``PARITY`` bits of its shingles
from the first reading on, and only pairs that may be as similar as asked are
checked on the shingles themselves: the parities of two sets differ in at most as
many bits as the sets in members, so no similar pair is left out, and pairs near by
chance, whose number grows faster than the documents', go before a text is read again.

A large group would come out as the square of its rows, so pairs come out in three
passes. First each member is paired with its near leaders if the bucket has a
``FEW`` of them, otherwise with the nearest; such a crowded member and its near
leaders are listed too, and all pairs are checked. Then those of the list that
still have a near one under another root are found, without their pairs. Last, these
alone come by with their parities, and the pairs come out whose ends have different
roots and may be similar. Members beyond the leaders are on the list in both passes;
those that the checked links have not brought together with most of their bucket
then meet all of the bucket, in a join, under the same two tests; so no pair of a
large bucket is left out.

Null text is empty; texts without words have one fingerprint and are one group.
Texts of any length are read whole. Rows alike in id and text count once, rows
without id go if their group has one with an id. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequilt.llm.common import keyed_text, text_of
from tracequilt.llm.components import connected_components
from tracequilt.llm.ranks import join_unique
from tracequilt.llm.simhash import LOWER, SEED
from tracequilt.runtime import materialize

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Share of differing bits, rounded up, that the masks of a set of bits are to cover: the mean at a similarity of 0.8.
COVERED = 0.15
#: Differing bits of 128 up to which a pair is checked: four standard deviations above the mean at a similarity of 0.8.
NEAR = 36
#: Members of a bucket that are compared with all later ones while it streams by.
LEADERS = 96
#: Near leaders of a member up to which it is paired with all of them at once.
FEW = 4
#: Parts in which the members of a bucket meet those that no link has brought to them, if it has more than so many.
SALTS, SALTED = 16, 1024
#: Classes of shingles whose counts are kept as odd or even.
PARITY = 1024
#: Rows of keys that go to all tasks at once to find their texts, some 40 MB there, and readings of the texts at most.
KEYS, READINGS = 1 << 19, 8


def shingles(text: str, words: int = SHINGLE_WORDS) -> set[bytes]:
    """Digests of the distinct shingles; a shorter text is one shingle, a text without words has none."""
    found = text.encode().translate(LOWER).split()
    if not found:
        return set()
    line = b" ".join(found)
    if len(found) <= words:
        return {xxhash.xxh3_128_digest(line, SEED)}
    ends = np.cumsum([len(w) + 1 for w in found]).tolist()
    digest = xxhash.xxh3_128_digest
    return {digest(line[s : e - 1], SEED) for s, e in zip([0, *ends], ends[words - 1 :])}


def fingerprint(found: set[bytes]) -> np.ndarray:
    """Two signed longs of the shingles; zeros if there are none."""
    raw = np.frombuffer(b"".join(found), np.uint8).reshape(-1, 16)
    ones = np.zeros(128, np.int64)
    for i in range(0, len(raw), 1 << 15):
        ones += np.unpackbits(raw[i : i + (1 << 15)], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(raw)).view("<i8")


def _key(doc_id, text) -> list:
    """128 bits of a row's id and text."""
    return [F.xxhash64(doc_id, text).alias("key"), F.xxhash64(F.lit(1), text, doc_id).alias("key2")]


def _marked(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, sizes, odd = [], [], []
            for text in batch["text"]:
                found = shingles(text.as_py(), words)
                bits.append(fingerprint(found))
                sizes.append(len(found))
                odd.append(parity(_longs(found)))
            bits = np.array(bits, np.int64).reshape(-1, 2)
            own = {c: batch[c] for c in ("doc_id", "key", "key2")} | {"a": pa.array(bits[:, 0].copy()), "b": pa.array(bits[:, 1].copy())}
            yield pa.record_batch(own | {"n": pa.array(sizes, pa.int64()), "parity": pa.array(odd, pa.list_(pa.int64()))})

    rows = keyed_text(docs).select("*", *_key("doc_id", "text"))
    return rows.mapInArrow(run, "doc_id long, key long, key2 long, a long, b long, n long, parity array<long>").withColumn("node", F.xxhash64("a", "b"))


def masks_over(radius: int, positions: list[int], seed: int) -> list[int]:
    """Covering masks over bit positions.

    Every position gets one of the ``2 ** (radius + 1) - 1`` vectors other than zero,
    drawn from all of them: vectors of a smaller space would leave masks without any bit.
    """
    size = 1 << (radius + 1)
    vectors = np.resize(np.random.default_rng(seed).permutation(np.arange(1, size)), len(positions)).tolist()
    return [sum(1 << p for p, m in zip(positions, vectors) if (m & v).bit_count() & 1) for v in range(1, size)]


def tables(documents: int) -> list[tuple[int, int]]:
    """The masks of both longs of a fingerprint, one pair for each table.

    A mask keeps half the bits of its set. Sets have 32 bits up to some 250,000
    documents and two more for each doubling, so buckets by chance keep their
    size while the tables grow about as the fourth root of the documents.
    """
    width = min(64, max(32, 2 * (max(documents, 1).bit_length() - 2)))
    radius, signed = math.ceil(COVERED * width), lambda m: m - (1 << 64) if m >> 63 else m
    bits = np.concatenate([np.random.default_rng(i).permutation(128) for i in range(2)]).tolist()
    masks = [m for i in range(4) for m in masks_over(radius - i // 2, bits[i * width : (i + 1) * width], seed=i)]
    return [(signed(m & (1 << 64) - 1), signed(m >> 64)) for m in masks]


def _longs(found: set[bytes]) -> np.ndarray:
    """Half of each shingle's digest."""
    return np.frombuffer(b"".join(found), "<i8")[::2].copy()


def parity(found: np.ndarray) -> np.ndarray:
    """One bit for each class of shingles: 1 if the set has an odd number of them. Signed longs."""
    return np.packbits(np.bincount(found.view(np.uint64) % np.uint64(PARITY), minlength=PARITY) & 1).view("<i8")


def _most_apart(similarity: float) -> float:
    """Members in one set alone, as a share of both sizes, up to which two sets can be that similar."""
    return (1 - similarity) / (1 + similarity) + 1e-9


def _may_be_similar(similarity: float) -> Column:
    """Of rows with ``n, parity, _n, _parity``: sizes and parities allow two sets to be that similar."""
    odd = "aggregate(zip_with(parity, _parity, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"
    return F.expr(f"greatest({odd}, abs(n - _n)) <= {_most_apart(similarity)!r}D * (n + _n)")


def _pairs(kind: str, similarity: float):
    """Over rows sorted by bucket: near pairs of a member with a leader before it, and the members beyond the leaders.

    ``nearest``: all near leaders of a member that has a few, of others the nearest; these and their near leaders
    come out among the members too. ``open``: not the pairs but their members, of pairs with different roots.
    ``all``: every pair with different roots that parities and sizes allow to be similar.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, count, lead = None, 0, None
        for batch in batches:
            bucket = batch["bucket"].to_numpy()
            if not len(bucket):
                continue
            own = [batch[c].to_numpy()[:, None] for c in ("a", "b", "root", "n") if c in batch.schema.names]
            if kind == "all":
                own.append(batch["parity"].flatten().to_numpy().reshape(len(bucket), -1))
            own = np.concatenate(own, axis=1).view(np.uint64)
            if at != bucket[0]:
                count, lead = 0, own[:0]
            held, rows = len(lead), np.concatenate((lead, own))
            edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            sizes = np.diff(np.append(edges, len(bucket)))
            place, base = np.arange(len(bucket)) - np.repeat(edges, sizes), np.repeat(edges + held, sizes)
            place[: sizes[0]] += count
            base[: sizes[0]] = 0
            left, right, apart = [], [], []
            hit = np.zeros(len(rows), bool)
            ask = np.flatnonzero(place > 0)
            for t in range(LEADERS):
                ask = ask[place[ask] > t]
                if not len(ask):
                    break
                distance = np.bitwise_count(rows[ask + held, :2] ^ rows[base[ask] + t, :2]).sum(1, dtype=np.int64)
                near = np.flatnonzero(distance <= NEAR)
                who, other, distance = ask[near], base[ask[near]] + t, distance[near]
                if kind == "nearest":
                    left.append(who + held)
                    right.append(other)
                    apart.append(distance)
                    continue
                good = rows[who + held, 2] != rows[other, 2]
                if kind == "all":
                    x, y = rows[who + held, 3:], rows[other, 3:]
                    n, m = x[:, 0].astype(np.int64), y[:, 0].astype(np.int64)
                    odd = np.bitwise_count(x[:, 1:] ^ y[:, 1:]).sum(1, dtype=np.int64)
                    good &= np.maximum(odd, abs(n - m)) <= _most_apart(similarity) * (n + m)
                    left.append(who[good] + held)
                    right.append(other[good])
                    apart.append(distance[good])
                hit[who[good] + held] = hit[other[good]] = True
            join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
            i, j, far, signed = join(left), join(right), join(apart), rows.view(np.int64)
            if kind == "nearest":
                crowded = (np.bincount(i, minlength=len(rows)) > FEW)[i]
                hit[i[crowded]] = hit[j[crowded]] = True
                order = np.lexsort((far, i))
                first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
                out = np.union1d(first, np.flatnonzero(~crowded))
                i, j, far = i[out], j[out], far[out]
            rest = np.flatnonzero(place >= LEADERS) + held
            lone = rest if kind == "all" else np.union1d(rest, np.flatnonzero(hit))
            none, blank = pa.nulls(len(i), pa.int64()), pa.nulls(len(lone), pa.int64())
            of = bucket[lone - held] if kind == "all" else np.zeros(len(lone), np.int64)
            yield pa.record_batch({
                "bucket": pa.concat_arrays([none, pa.array(of)]),
                "a": pa.array(np.concatenate((signed[i, 0], signed[lone, 0]))), "b": pa.array(np.concatenate((signed[i, 1], signed[lone, 1]))),
                "c": pa.concat_arrays([pa.array(signed[j, 0]), blank]), "d": pa.concat_arrays([pa.array(signed[j, 1]), blank]),
                "apart": pa.concat_arrays([pa.array(far), blank]),
            })
            at, count = bucket[-1], int(place[-1]) + 1
            lead = rows[base[-1] : base[-1] + min(count, LEADERS)].copy()

    return run


def candidates(rows: DataFrame, made: list[tuple[int, int]], kind: str = "nearest", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Near pairs ``u, v, apart`` (a member, a leader, differing bits), one row each; and ``bucket, node, a, b`` of members beyond the leaders.

    ``rows`` has ``a, b``, for the kinds but ``nearest`` also ``root``, for ``all`` also ``n`` and ``parity``; ``made`` are
    the masks. For ``open`` there are no pairs: the second table has their members too. For ``nearest`` it has crowded
    members and their near leaders too. Both have all in bucket 0.
    """
    more = {"nearest": [], "open": ["root"], "all": ["root", "n", "parity"]}[kind]
    spread = rows.select("a", "b", *more, F.explode(F.sequence(F.lit(0), F.lit(len(made) - 1))).alias("i"))
    # rows are dealt out with the number of the mask: it takes less room than the bucket, which is worked out again there
    kept = [F.col(c).bitwiseAND(F.array(*[F.lit(m[k]).cast("long") for m in made])[F.col("i")]) for k, c in enumerate("ab")]
    bucket = F.xxhash64("i", *kept)
    dealt = spread.repartition(bucket).select(bucket.alias("bucket"), "a", "b", *more).sortWithinPartitions("bucket", F.xxhash64("b", "a"))
    out = dealt.mapInArrow(_pairs(kind, similarity), "bucket long, a long, b long, c long, d long, apart long")
    out = out if kind == "open" else materialize(out, "buckets")
    pairs = out.where("c IS NOT NULL").select(F.xxhash64("a", "b").alias("u"), F.xxhash64("c", "d").alias("v"), "apart").where("u <> v")
    rest = out.where("c IS NULL").select("bucket", F.xxhash64("a", "b").alias("node"), "a", "b")
    return pairs.groupBy("u", "v").agg(F.min("apart").alias("apart")), rest


def strangers(rest: DataFrame, roots: DataFrame, sets: DataFrame | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """Near pairs, like those of :func:`candidates`, of members beyond the leaders that are not yet joined.

    Most members of a large bucket belong to one component; only those outside of it meet the bucket's members.
    With ``sets`` only pairs come out that parities and sizes allow to be similar.
    """
    known = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    placed = rest.join(known, F.col("node") == F.col("_node"), "left").select("bucket", "node", "a", "b", F.coalesce("_root", "node").alias("root"))
    if sets is not None:
        placed = placed.join(sets.select("node", "n", "parity"), "node")
    placed = materialize(placed, "placed")
    most = placed.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.sum("count").alias("size"))
    placed = join_unique(placed, materialize(most, "most"), ["bucket"])
    parts = f"CASE WHEN size > {SALTED} THEN {SALTS} ELSE 1 END"
    own = [c for c in placed.columns if c not in ("most", "size")]
    asking = placed.where("root <> most").selectExpr(*[f"{c} AS _{c}" for c in own], f"explode(sequence(0, {parts} - 1)) AS _salt")
    apart, good = "CAST(bit_count(a ^ _a) + bit_count(b ^ _b) AS LONG)", F.lit(True)
    if sets is not None:
        good = _may_be_similar(similarity)
    met = placed.withColumn("salt", F.expr(f"int(pmod(xxhash64(node), {parts}))")).join(
        asking, F.expr(f"bucket = _bucket AND salt = _salt AND root <> _root AND {apart} <= {NEAR}") & good)
    return met.select(F.greatest("node", "_node").alias("u"), F.least("node", "_node").alias("v"), F.expr(apart).alias("apart")).groupBy("u", "v").agg(F.min("apart").alias("apart"))


def _sets(docs: DataFrame, near: DataFrame, met: DataFrame, words: int) -> DataFrame:
    """``node`` and ``shingles`` of the fingerprints in the pairs; ``met`` has the keys of their rows.

    Texts are filtered where they are read, so that only those asked for move. Keys
    beyond ``KEYS`` take further readings, beyond ``READINGS`` of them a join.
    """
    ends = near.select(F.col("u").alias("node")).union(near.select("v")).distinct()
    wanted = materialize(met.select("node", "own", "own2").join(ends, "node", "left_semi"), "wanted")
    texts, same = keyed_text(docs).select("*", *_key("doc_id", "text")), F.expr("key = own AND key2 = own2")
    parts = max(1, -(-wanted.count() // KEYS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch["text"]):
                found = pa.array([_longs(shingles(text.as_py(), words))], pa.list_(pa.int64()))
                yield pa.record_batch({"node": batch["node"].slice(i, 1), "shingles": found})

    if parts > READINGS:
        rows = texts.join(wanted, same)
    else:
        rows = reduce(DataFrame.union, [texts.join(F.broadcast(wanted.where(f"pmod(own2, {parts}) = {i}")), same) for i in range(parts)])
    rows = rows.dropDuplicates(["node"]).select("node", "text")
    return materialize(rows.mapInArrow(run, "node long, shingles array<long>"), "shingles")


def links(docs: DataFrame, distinct: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE_WORDS) -> DataFrame:
    """``node`` and ``root`` of every fingerprint that a chain of links joins to another."""
    made = tables(distinct.count())
    near, rest = candidates(distinct, made)
    near = materialize(near, "pairs")
    rows = distinct.select("node", "a", "b", "n", "parity", F.col("first.key").alias("own"), F.col("first.key2").alias("own2"))
    ends = near.select(F.col("u").alias("node")).union(near.select("v")).union(rest.select("node")).distinct()
    met = materialize(rows.join(ends, "node", "left_semi"), "met")
    roots = connected_components(near.select("u", "v").limit(0))
    if met.isEmpty():
        return roots
    first, second = (met.select(F.col("node").alias(c), F.col("n").alias(f"{x}n"), F.col("parity").alias(f"{x}parity")) for c, x in (("u", ""), ("v", "_")))
    likely = near.join(first, "u").join(second, "v").where(_may_be_similar(similarity)).select("u", "v", "apart")
    roots = _linked(docs, materialize(likely, "pairs"), met, roots, similarity, words)
    if rest.isEmpty():
        return roots
    known = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    crowd = met.join(rest.select("node").distinct(), "node", "left_semi").join(known, F.col("node") == F.col("_node"), "left")
    rooted = materialize(crowd.select("node", "a", "b", "n", "parity", F.coalesce("_root", "node").alias("root")), "crowd")
    unsettled = candidates(rooted, made, "open")[1].select("node").distinct()
    rooted = materialize(rooted.join(unsettled, "node", "left_semi"), "unsettled")
    near, rest = candidates(rooted, made, "all", similarity)
    roots = _linked(docs, materialize(near, "pairs"), met, roots, similarity, words)
    if not rest.isEmpty():
        near = materialize(strangers(rest, roots, rooted, similarity), "pairs")
        roots = _linked(docs, near, met, roots, similarity, words)
    return roots


def _linked(docs: DataFrame, near: DataFrame, met: DataFrame, roots: DataFrame, similarity: float, words: int) -> DataFrame:
    """:func:`_checked` with the shingles of these pairs alone."""
    return roots if near.isEmpty() else _checked(near, _sets(docs, near, met, words), roots, similarity)


def _checked(left: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """The components that the true links among the candidates make of those so far.

    Candidates are checked nearest first, in rounds of 1, 8, 64 ... of a node;
    those whose ends are joined by then need no check. All others get one.
    """
    common, most = F.size(F.array_intersect("x", "y")), 1
    while not left.isEmpty():
        ranked = materialize(left.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("apart", "v"))), "ranked")
        both = (
            ranked.where(F.col("rank") <= most)
            .join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), "u")
            .join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("y")), "v")
        )
        true = materialize(both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("u", "v"), "true")
        # a component so far is a star on its root, so only the new links are left to contract
        roots = connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(true))
        first, second = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "uv")
        rest = ranked.where(F.col("rank") > most).join(first, "u", "left").join(second, "v", "left")
        left = materialize(rest.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v", "apart"), "pairs")
        most *= 8
    return roots


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each group of near copies, that with the smallest doc_id; all columns stay.

    Rows whose 128 bits are equal are one group. A row without id is kept only if
    its group has none with one. Of rows alike in id and text one stays.
    """
    marked = materialize(_marked(docs, words), "marked")
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "key", "key2", "n", "parity")).alias("first")
    own = F.struct("first.no_id", "first.doc_id", "first.key", "first.key2").alias("first")
    distinct = materialize(marked.groupBy("node", "a", "b").agg(first).select("node", "a", "b", own, "first.n", "first.parity"), "distinct")
    roots = links(docs, distinct, similarity, words).withColumnRenamed("node", "_node")
    kept = (
        distinct.join(roots, F.col("node") == F.col("_node"), "left").groupBy(F.coalesce("root", "node").alias("root"))
        .agg(F.min("first").alias("first")).select(F.col("first.key").alias("_key"), F.col("first.key2").alias("_key2"))
    )
    own = [k.alias(name) for k, name in zip(_key(F.col("doc_id").cast("long"), text_of("text")), ("_own", "_own2"))]
    keyed = docs.select("*", *own).join(kept, (F.col("_own") == F.col("_key")) & (F.col("_own2") == F.col("_key2")), "left_semi")
    return keyed.dropDuplicates(["_own", "_own2"]).select(*docs.columns)

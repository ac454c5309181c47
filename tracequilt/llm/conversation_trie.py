"""Prefix trie of conversations, from whole sequences and their weights.

Turns get their place in a conversation in ranges of rows, so that one
conversation may hold any share of them. A prefix is known by 128 bits: the
exclusive or, over its turns, of hashes of place and content; it adds up over
blocks of turns, so no conversation is one sorted group either.

Identical conversations collapse to one weighted sequence, represented by its
smallest conversation, with the list of those that end there. Sequences that are
proper prefixes of another drop out by an anti-join of their keys with the keys of
all parents; what is left are the leaves. Prefixes are then aggregated with their
weights over distinct sequences alone, and sums over subtrees come from a suffix
scan along each sequence: a node is counted on the path of its smallest
conversation, from where every ancestor on that path takes it.

Rows without conv_id belong to no conversation. Null role or text is empty. Turns
without a number come first; rows alike in number are ordered by a hash of
their content, so repeated rows are repeated turns. An empty table gives no rows.
Texts may be of any length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequilt.llm.ranks import join_unique, numbered
from tracequilt.runtime import materialize

#: Turns of one conversation that are scanned in one sorted group.
BLOCK = 256
#: Ids of one chunk of an end list.
CHUNK = 4096
KEY = ["depth", "a", "b"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """Stored: ``conv``, ``at`` (place from 0), ``x, y`` (128-bit hash of role and text) and ``bytes`` of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("x"), F.xxhash64(F.lit(1), text, role).alias("y"),
        F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"),
    )
    placed = numbered(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("x"), F.col("y"), F.col("row")], "at")
    return materialize(placed.select("conv", "at", "x", "y", "bytes"), "turns")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences of the conversations themselves: ``conv, at, x, y, bytes`` with ``n``, and ``conv, n`` of every conversation."""
    sizes = materialize(turns.groupBy("conv").agg((F.max("at") + 1).alias("n")), "sizes")
    return _with_sizes(turns, sizes), sizes


def with_shared_head(turns: DataFrame, group: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """Every conversation c rebuilt: the first h turns of conversation ``c - c % group``, then its own after its first h.

    h is the unsigned checksum of c in decimal, modulo ``longest``. A missing first
    conversation gives no turns, a short one all it has.
    """
    sizes = materialize(turns.groupBy(F.col("conv").alias("c")).agg((F.max("at") + 1).alias("own")), "sizes")
    plan = sizes.selectExpr("*", f"crc32(CAST(CAST(c AS string) AS binary)) % {longest} AS h", f"c - c % {group} AS head")
    plan = plan.join(sizes.selectExpr("c AS _head", "own AS _theirs"), F.col("head") == F.col("_head"), "left")
    plan = materialize(plan.selectExpr("c", "own", "h", "head", "least(h, coalesce(_theirs, 0L)) AS k").selectExpr("*", "k + greatest(own - h, 0L) AS n"), "plans")
    # Own turns: a plan stands once per block of its turns, so a conversation with very many is met in many tasks.
    spread = plan.where("own > h").selectExpr("c", "h", "k", "n", f"explode(sequence(h div {BLOCK}, (own - 1) div {BLOCK})) AS _part")
    own = turns.join(spread, (F.col("conv") == F.col("c")) & (F.expr(f"at div {BLOCK}") == F.col("_part"))).where("at >= h")
    # Heads: at most longest - 1 turns of a conversation go to at most group + group - 1 others.
    heads = turns.where(f"at < {longest - 1}").join(plan.where("k > 0").select("c", "head", "k", "n"), F.expr("conv = head AND at < k"))
    columns = ["x", "y", "bytes", "n"]
    rebuilt = own.selectExpr("c AS conv", "at - h + k AS at", *columns).union(heads.selectExpr("c AS conv", "at", *columns))
    return rebuilt, plan.selectExpr("c AS conv", "n")


def _with_sizes(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    spread = sizes.selectExpr("conv AS _conv", "n", f"explode(sequence(0L, (n - 1) div {BLOCK})) AS _part")
    return turns.join(spread, (F.col("conv") == F.col("_conv")) & (F.expr(f"at div {BLOCK}") == F.col("_part"))).drop("_conv", "_part")


def prefixes(sequences: DataFrame) -> DataFrame:
    """Stored: ``conv, depth, n, bytes`` (of the last text), the prefix's key ``a, b`` and its parent's ``up_a, up_b``."""
    lanes = sequences.select(
        "conv", "at", "n", "bytes", F.xxhash64("at", "x").alias("x"), F.xxhash64("y", "at").alias("y"), F.expr(f"at div {BLOCK}").alias("block")
    )
    inside = Window.partitionBy("conv", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("_conv").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        lanes.groupBy(F.col("conv").alias("_conv"), F.col("block").alias("_block")).agg(F.bit_xor("x").alias("_x"), F.bit_xor("y").alias("_y"))
        .select("_conv", "_block", F.bit_xor("_x").over(before).alias("_x"), F.bit_xor("_y").over(before).alias("_y")).where("_block > 0")
    )
    run = lanes.select("*", F.bit_xor("x").over(inside).alias("_a"), F.bit_xor("y").over(inside).alias("_b"))
    run = run.join(blocks, (F.col("conv") == F.col("_conv")) & (F.col("block") == F.col("_block")), "left")
    keyed = run.selectExpr("conv", "at + 1 AS depth", "n", "bytes", "_a ^ coalesce(_x, 0L) AS a", "_b ^ coalesce(_y, 0L) AS b", "x", "y")
    return materialize(keyed.selectExpr("conv", "depth", "n", "bytes", "a", "b", "a ^ x AS up_a", "b ^ y AS up_b"), "prefixes")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one key in rows sorted by key and id, as comma-joined pieces of an end list."""
    for batch in batches:
        depth, a, b, conv = (batch[c].to_pylist() for c in ("depth", "a", "b", "conv"))
        out, at = [], 0
        while at < len(conv):
            key, end = (depth[at], a[at], b[at]), at + 1
            while end < len(conv) and end - at < CHUNK and (depth[end], a[end], b[end]) == key:
                end += 1
            out.append((*key, conv[at], end - at, ",".join(map(str, conv[at:end]))))
            at = end
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out)], names=["depth", "a", "b", "first", "count", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key from its chunks in order; a list streams through one digest and is never held."""
    key, first, count, digest = None, None, 0, None
    for batch in batches:
        out = []
        for *at, begin, n, ids in zip(*(batch[c].to_pylist() for c in ("depth", "a", "b", "first", "count", "ids"))):
            if at != key:
                if key is not None:
                    out.append((*key, first, count, digest.hexdigest()))
                key, first, count, digest = at, begin, 0, hashlib.sha256()
            digest.update((("," if count else "") + ids).encode())
            count += n
        if out:
            yield _sequences(out)
    if key is not None:
        yield _sequences([(*key, first, count, digest.hexdigest())])


def _sequences(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c) for c in zip(*rows)], names=["depth", "a", "b", "conv", "weight", "ends_sha256"])


def collapse(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """Stored: one row per distinct whole sequence: its key, smallest ``conv``, ``weight`` and the digest of its end list.

    The list of a sequence that very many conversations share is put together
    in ranges of ids; only pieces of up to ``CHUNK`` ids pass the task that digests it.
    """
    whole = found.where("depth = n").select("conv", *KEY)
    ends = whole.union(sizes.where("n = 0").selectExpr("conv", "0L AS depth", "0L AS a", "0L AS b"))
    lists = ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(_chunks, "depth long, a long, b long, first long, count long, ids string")
    out = lists.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, "depth long, a long, b long, conv long, weight long, ends_sha256 string")
    return materialize(out, "sequences")


def trie(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """All nodes: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``found`` has the prefixes of all conversations (:func:`prefixes`), ``sizes`` every conversation and its number of turns.
    """
    whole = collapse(found, sizes)
    # Paths: the prefixes of each sequence's smallest conversation, and the root above them.
    spread = whole.selectExpr("conv AS _conv", "weight", f"explode(sequence(0L, greatest(depth - 1, 0L) div {BLOCK})) AS _part")
    columns = ["conv", "depth", "a", "b", "up_a", "up_b", "bytes", "weight"]
    paths = found.join(spread, (F.col("conv") == F.col("_conv")) & (F.expr(f"(depth - 1) div {BLOCK}") == F.col("_part"))).select(*columns)
    roots = whole.selectExpr("conv", "0L AS depth", "0L AS a", "0L AS b", "CAST(NULL AS long) AS up_a", "CAST(NULL AS long) AS up_b", "0L AS bytes", "weight")
    paths = materialize(paths.union(roots), "paths")
    nodes = materialize(
        paths.groupBy(*KEY).agg(
            F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b")
        ),
        "nodes",
    )
    children = materialize(
        nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children")),
        "children",
    )
    leaves = whole.join(children, KEY, "left_anti")
    # What each place of a path adds: a node on the path of its smallest conversation, a leaf at its end.
    added = nodes.selectExpr("conv_id AS _conv", "depth AS _depth", "(n_convs - 1) * bytes AS saved", "0L AS leaf").union(
        leaves.selectExpr("conv", "depth", "0L", "1L")
    ).groupBy("_conv", "_depth").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    steps = paths.join(added, F.expr("conv = _conv AND depth = _depth"), "left").selectExpr(
        "conv", *KEY, "coalesce(saved, 0L) AS saved", "coalesce(leaf, 0L) AS leaf", f"depth div {BLOCK} AS block"
    )
    below = _suffix_sums(steps).groupBy(*KEY).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    # A node's parent has the same smallest conversation, except where its path leaves another's.
    parents = _parents(nodes)
    out = nodes.join(below, KEY).join(children, KEY, "left").join(whole.select(*KEY, "ends_sha256"), KEY, "left")
    out = out.join(parents, F.expr("conv_id = _conv AND depth = _depth"), "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def _suffix_sums(steps: DataFrame) -> DataFrame:
    """``saved`` and ``leaf`` summed from each place to the end of its path, in two levels."""
    inside = Window.partitionBy("conv", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = Window.partitionBy("_conv").orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # Only paths over a block's length have a block with another one after it.
    blocks = (
        steps.groupBy(F.col("conv").alias("_conv"), F.col("block").alias("_block")).agg(F.sum("saved").alias("_saved"), F.sum("leaf").alias("_leaf"))
        .select("_conv", "_block", F.sum("_saved").over(beyond).alias("_saved"), F.sum("_leaf").over(beyond).alias("_leaf")).where("_saved IS NOT NULL")
    )
    run = steps.select("conv", *KEY, "block", F.sum("saved").over(inside).alias("saved"), F.sum("leaf").over(inside).alias("leaf"))
    return run.join(blocks, (F.col("conv") == F.col("_conv")) & (F.col("block") == F.col("_block")), "left").selectExpr(
        *KEY, "saved + coalesce(_saved, 0L) AS saved", "leaf + coalesce(_leaf, 0L) AS leaf"
    )


def _parents(nodes: DataFrame) -> DataFrame:
    """``_conv, _depth, parent_conv_id`` of every node but the root."""
    owners = nodes.selectExpr("conv_id AS _owner", "depth + 1 AS _below")
    linked = nodes.where("depth > 0").join(owners, F.expr("conv_id = _owner AND depth = _below"), "left")
    linked = materialize(linked.selectExpr("conv_id AS _conv", "depth AS _depth", "_owner", "depth - 1 AS depth", "up_a AS a", "up_b AS b"), "links")
    asked = linked.where("_owner IS NULL").select("_conv", "_depth", *KEY)
    found = join_unique(asked, nodes.select(*KEY, F.col("conv_id").alias("parent_conv_id")), KEY)
    return linked.where("_owner IS NOT NULL").selectExpr("_conv", "_depth", "_owner AS parent_conv_id").union(found.select("_conv", "_depth", "parent_conv_id"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt with shared heads (:func:`with_shared_head`)."""
    sequences, sizes = with_shared_head(turns_of(conversations))
    return trie(prefixes(sequences), sizes)


def plain_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    sequences, sizes = as_they_are(turns_of(conversations))
    return trie(prefixes(sequences), sizes)

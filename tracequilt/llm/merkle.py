"""Merkle manifest of a document table, and a climb from every row to the root by a recursive query.

A leaf is the digest of one row. Per source the leaves, ascending by doc_id, are
hashed three at a time, level by level, to the source's subroot; the subroots,
ordered by source, are hashed likewise to the root. A stored node row holds the
digests of its children and the link to its parent, so a row of the corpus proves
itself with the siblings on its way up, without any other row.

The levels are built by grouping on the place, two of them at a time: a stored
node has its grandchildren's digests next to its children's, so half as many rows
climb. A Spark recursive query then ascends: each step joins the rows to their
nodes, appends the siblings of two levels and folds the digest found through
both. Near the root all rows share one node; a node is stored in one copy per
``SHARE`` leaves below it and rows pick a copy by hash, so no join key has more
rows than that.

Nulls count as ``-``. Rows without doc_id come first; repeated rows have a place
and a proof each. An empty table has no root and gives no rows. Texts may be of
any length; columns other than the five hashed ones are ignored.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequilt.llm.ranks import numbered
from tracequilt.runtime import materialize

#: Children of a node, and the rows that a stored node of two levels takes in.
ARITY = 3
STEP = ARITY * ARITY
#: Leaves below a node for each stored copy of it.
SHARE = 256
#: Node numbers are level * SPAN + place.
SPAN = 1 << 44
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Tree number of the nodes over the subroots; sources count from 0.
TOP = -1


class Manifest(NamedTuple):
    """Stored tables: ``leaves`` with their place, ``nodes`` with children and parent, and the root's digest (None if empty)."""

    leaves: DataFrame
    nodes: DataFrame
    root: bytes | None


def digest_of(columns: list[Column]) -> Column:
    """SHA-256 over the fields, each ``-`` if null, else UTF-8 length, colon and value."""
    fields = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def _fold(kids: str) -> str:
    return f"unhex(sha2(lower(hex({kids})), 256))"


def leaves_of(docs: DataFrame, found: Column) -> DataFrame:
    """Stored: ``row`` (a number of its own), ``doc_id``, ``source``, ``leaf`` and ``found``, the leaf with ``found`` in place of the text."""
    plain = [F.col(c).cast("long") if c in ("doc_id", "n_chars") else F.col(c) for c in FIELDS]
    forged = [found if c == "text" else p for c, p in zip(FIELDS, plain)]
    return materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"), plain[0].alias("doc_id"), F.col("source").cast("string").alias("source"),
            digest_of(plain).alias("leaf"), digest_of(forged).alias("found"),
        ),
        "leaves",
    )


def _levels(base: DataFrame, widest: int) -> tuple[DataFrame | None, DataFrame]:
    """Node rows of every second level, and the row at the top of each tree.

    ``base`` has ``tree, at, width, digest, below``: place and number of nodes of the
    tree's lowest level, and the leaves below. ``widest`` is the largest width. A
    node has ``kids``, the digests of each child's children in a row, and ``digests``,
    the children's own; where no more than one family is left, it is that family: one
    child and no digests.
    """
    level, number, found, tops = base, 0, None, base.where("width = 1").select("tree", "digest", "below")
    family = f"aggregate(slice(items, {ARITY} * j + 1, {ARITY}), X'', (s, k) -> concat(s, k.digest))"
    while widest > 1:
        number, widest = number + 1, -(-widest // STEP)
        level = materialize(
            level.where("width > 1")
            .groupBy("tree", F.expr(f"at div {STEP}").alias("at"), "width")
            .agg(F.array_sort(F.collect_list(F.struct("at", "digest", "below"))).alias("items"))
            .selectExpr("tree", "at", "width", f"transform(sequence(0, (size(items) - 1) div {ARITY}), j -> {family}) AS kids", "aggregate(items, 0L, (s, k) -> s + k.below) AS below")
            .selectExpr("*", f"IF(width > {ARITY}, aggregate(kids, X'', (s, k) -> concat(s, {_fold('k')})), NULL) AS digests")
            .selectExpr("tree", "at", f"(width + {STEP - 1}) div {STEP} AS width", "kids", "digests", "below", _fold("coalesce(digests, kids[0])") + " AS digest", f"{number}L AS level"),
            "level",
        )
        found = level if found is None else found.union(level)
        tops = tops.union(level.where("width = 1").select("tree", "digest", "below"))
    return found, tops


def _up(tree: str, level: str, at: str) -> list[str]:
    """The parent link inside a tree: tree, node and the own place below it."""
    return [f"{tree} AS ptree", f"({level} + 1) * {SPAN} + {at} div {STEP} AS pnode", f"{at} % {STEP} AS place"]


def _copies(below: str) -> str:
    return f"({below} + {SHARE - 1}) div {SHARE}"


def build(docs: DataFrame, found: Column | None = None) -> Manifest:
    """The manifest of a document table; ``found`` is the text as it is met later (the same text if not given)."""
    leaves = leaves_of(docs, F.col("text") if found is None else found)
    placed = materialize(numbered(leaves, ["source"], [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")], "at"), "placed")
    sizes = placed.groupBy("source").agg((F.max("at") + 1).alias("width"))
    sources = materialize(numbered(sizes, [], [F.col("source").asc_nulls_first()], "tree"), "sources")
    n_sources, widest = sources.agg(F.count("*"), F.max("width")).first()
    if not n_sources:
        return Manifest(placed, leaves.sparkSession.createDataFrame([], "tree long"), None)
    # Every source's row in one copy per 4096 places, so that a source with most rows is met in many tasks.
    spread = sources.selectExpr("source AS _source", "tree", "width", "explode(sequence(0L, (width - 1) div 4096)) AS _part")
    placed = materialize(
        placed.join(spread, F.col("source").eqNullSafe(F.col("_source")) & (F.expr("at div 4096") == F.col("_part"))).drop("_source", "_part"), "placed"
    )
    nodes, tops = _levels(placed.selectExpr("tree", "at", "width", "leaf AS digest", "1L AS below"), widest)
    tops = materialize(tops, "subroots")
    over, peak = _levels(tops.selectExpr(f"{TOP}L AS tree", "tree AS at", f"{n_sources}L AS width", "digest", "below"), n_sources)
    root = bytes(peak.first()["digest"])
    # A source's topmost row (a node, or its only leaf) hangs under the tree of subroots.
    link = tops.selectExpr("tree AS _tree", "digest AS subroot", *_up(f"{TOP}L", "0L", "tree")) if n_sources > 1 else \
        tops.selectExpr("tree AS _tree", "digest AS subroot", "CAST(NULL AS long) AS ptree", "CAST(NULL AS long) AS pnode", "CAST(NULL AS long) AS place")
    rows = []
    if nodes is not None:
        keep = ("tree", f"level * {SPAN} + at AS node", "kids", "digests", "below")
        rows.append(nodes.where("width > 1").selectExpr(*keep, "CAST(NULL AS binary) AS subroot", *_up("tree", "level", "at"), _copies(f"bigint(pow({STEP}, level + 1))") + " AS pcopies"))
        rows.append(_with_parent_copies(nodes.where("width = 1").selectExpr(*keep).join(link, F.col("tree") == F.col("_tree")).drop("_tree"), over))
    if over is not None:
        inner = over.selectExpr("tree", f"level * {SPAN} + at AS node", "kids", "digests", "below", "CAST(NULL AS binary) AS subroot",
                                *_up("IF(width > 1, tree, NULL)", "level", "at"))
        rows.append(_with_parent_copies(inner, over))
    linked = None
    for part in rows:
        linked = part if linked is None else linked.unionByName(part)
    # Copies of a node inside a source follow from its level, as its children reckon them.
    own = f"IF(tree = {TOP}, {_copies('below')}, {_copies(f'bigint(pow({STEP}, node div {SPAN}))')})"
    if linked is not None:
        linked = materialize(linked.selectExpr("*", f"explode(sequence(0L, {own} - 1)) AS copy"), "nodes")
    inside = placed.where("width > 1").selectExpr("row", "doc_id", "leaf", "found", "CAST(NULL AS binary) AS subroot", *_up("tree", "0L", "at"), _copies(str(STEP)) + " AS pcopies")
    alone = placed.where("width = 1").select("row", "doc_id", "leaf", "found", "tree").join(link, F.col("tree") == F.col("_tree")).drop("tree", "_tree")
    return Manifest(materialize(inside.unionByName(_with_parent_copies(alone, over)), "linked"), linked, root)


def _with_parent_copies(rows: DataFrame, over: DataFrame | None) -> DataFrame:
    """Add ``pcopies``, for rows whose parent is in the tree of subroots."""
    if over is None:
        return rows.withColumn("pcopies", F.lit(1).cast("long"))
    sizes = over.selectExpr(f"level * {SPAN} + at AS _node", f"{_copies('below')} AS pcopies")
    return rows.join(sizes, F.expr("ptree IS NOT NULL AND pnode = _node"), "left").drop("_node")


def climb(manifest: Manifest) -> DataFrame:
    """Stored: one row per leaf and step: ``row, step``, the ``siblings`` passed, ``fold`` (digest found so far) and ``subroot`` where it is passed.

    Only a step's own siblings are kept in its row: what grows with the height is the number of rows, not their width.
    """
    spark, tag = manifest.leaves.sparkSession, uuid.uuid4().hex
    rows, limit = "spark.sql.cteRecursionRowLimit", spark.conf.get("spark.sql.cteRecursionRowLimit")
    manifest.leaves.createOrReplaceTempView(f"leaves_{tag}")
    manifest.nodes.createOrReplaceTempView(f"nodes_{tag}")
    spark.conf.set(rows, "-1")
    cut = lambda run, place: (f"substring({run}, 1, int({place}) * {DIGEST})", f"substring({run}, int({place}) * {DIGEST} + {DIGEST + 1})")
    (before, after), (left, right) = cut(f"n.kids[int(c.place div {ARITY})]", f"c.place % {ARITY}"), cut("n.digests", f"c.place div {ARITY}")
    lower = _fold(f"concat({before}, c.fold, {after})")
    fold = f"IF(n.digests IS NULL, {lower}, {_fold(f'concat({left}, {lower}, {right})')})"
    siblings = f"concat({before}, {after}, coalesce(concat({left}, {right}), X''))"
    pick = "pmod(xxhash64({row}), {copies})"
    try:
        steps = spark.sql(f"""
            WITH RECURSIVE climb(row, step, tree, node, copy, place, fold, siblings, subroot) AS (
                SELECT row, 0, ptree, pnode, {pick.format(row='row', copies='pcopies')}, place, found, X'', subroot FROM leaves_{tag}
                UNION ALL
                SELECT c.row, c.step + 1, n.ptree, n.pnode, {pick.format(row='c.row', copies='n.pcopies')}, n.place,
                       {fold}, {siblings}, n.subroot
                FROM climb c JOIN nodes_{tag} n ON c.tree = n.tree AND c.node = n.node AND c.copy = n.copy
            ) SELECT row, step, siblings, fold, subroot FROM climb""")
        return materialize(steps, "climb")
    finally:
        spark.conf.set(rows, limit)
        spark.catalog.dropTempView(f"leaves_{tag}")
        spark.catalog.dropTempView(f"nodes_{tag}")


def audit(docs: DataFrame, found: Column) -> DataFrame:
    """Each row's proof, and the root that follows from the text as it is found.

    ``doc_id, leaf, subroot, root, proof_sha256`` are those of the table as it
    is; ``folded_root`` starts from the leaf with ``found`` as its text and keeps
    the original siblings; ``verified`` says whether it is the root. All digests
    are lowercase hex.
    """
    manifest = build(docs, found)
    if manifest.root is None:
        return manifest.leaves.selectExpr(
            "doc_id", *[f"CAST(NULL AS string) AS {c}" for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], "CAST(NULL AS boolean) AS verified"
        )
    hexed = lambda c: F.lower(F.hex(c))
    leaves = manifest.leaves.select(F.col("row").alias("_row"), "doc_id", "leaf", "found", F.col("subroot").alias("_alone"))
    if manifest.nodes is None:  # one document: its leaf is the root
        out = leaves.select("doc_id", "leaf", F.lit(None).cast("binary").alias("subroot"), "_alone", F.sha2(F.lit("").cast("binary"), 256).alias("proof"), F.col("found").alias("folded"))
    else:
        # At most one row per level of the tree meets in a group.
        way = climb(manifest).groupBy("row").agg(
            F.array_sort(F.collect_list(F.struct("step", "siblings"))).alias("steps"), F.max_by("fold", "step").alias("folded"), F.max("subroot").alias("subroot"),
        )
        proof = F.sha2(F.array_join(F.transform("steps", lambda s: hexed(s["siblings"])), "").cast("binary"), 256)
        out = leaves.join(way, F.col("_row") == F.col("row")).select("doc_id", "leaf", "subroot", "_alone", proof.alias("proof"), "folded")
    root = F.lit(manifest.root.hex())
    return out.select(
        "doc_id", hexed("leaf").alias("leaf"), hexed(F.coalesce("subroot", "_alone", "leaf")).alias("subroot"), root.alias("root"),
        F.col("proof").alias("proof_sha256"), hexed("folded").alias("folded_root"), (hexed("folded") == root).alias("verified"),
    )


def without_line_ends() -> Column:
    """The registered query's damage: rows whose id has an even checksum lose the line ends of their text."""
    even = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))

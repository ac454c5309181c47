"""The manifest against a direct fold of the rows."""

import hashlib
import zlib

from corpus import awkward, table
from tracequilt.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, text, n):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, "en", n, text)))


def tree(nodes):
    """The top digest, and of each place the way up: (digests before, digests after) per level."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // 3 * 3 : a // 3 * 3 + 3]
            ways[i].append((run[: a % 3], run[a % 3 + 1 :]))
            at[i] = a // 3
        level = [h("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], ways


def expected(rows):
    """Rows of (doc_id, text, source, n_chars)."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[2], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    tops, plans = [], []
    for name in names:
        group = sorted(by_source[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r[0], r[2], r[1], r[3])))
        top, ways = tree([leaf(r[0], r[2], r[1], r[3]) for r in group])
        tops.append(top)
        plans.append((group, top, ways))
    root, over = tree(tops)
    out = []
    for (group, top, ways), above in zip(plans, over):
        for r, way in zip(group, ways):
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            fold, proof = leaf(r[0], r[2], text, r[3]), ""
            for before, after in way + above:
                fold, proof = h("".join(before) + fold + "".join(after)), proof + "".join(before + after)
            out.append((r[0], leaf(r[0], r[2], r[1], r[3]), top, root, h(proof), fold, fold == root))
    return sorted(map(str, out))


def run(docs):
    return sorted(str(tuple(r)) for r in merkle.audit(docs, merkle.without_line_ends()).collect())


def full(docs):
    return [(r.doc_id, r.text, r.source, r.n_chars) for r in docs.collect()]


def test_awkward_rows_sources_and_extra_columns(spark):
    rows = [(*r, f"src{i % 4}" if i % 7 else None) for i, r in enumerate(awkward(3000))] + [(50, "alone\nhere", "Zoë"), (51, "line\nline", "src0"), (52, "a\nb", "hot")]
    rows += [(100 + i, f"text {i}\n\nend {i % 5}", "hot") for i in range(90)]
    docs = table(spark, rows, extra=True)
    got = run(docs)
    assert got == expected(full(docs))
    assert any(", True)" in g for g in got) and any(", False)" in g for g in got)


def test_few_rows(spark):
    for rows in ([], [(1, "a\nb", "x")], [(i, "a\nb", "x") for i in range(4)], [(i, "a\nb", f"s{i}") for i in range(5)], [(None, None, None)] * 5):
        docs = table(spark, rows)
        assert run(docs) == (expected(full(docs)) if rows else [])


def test_many_leaves_share_the_upper_nodes(spark):
    rows = [(i, f"t{i}\n", "hot" if i % 3 else f"s{i % 21}") for i in range(2000)]
    docs = table(spark, rows).repartition(5)
    assert run(docs) == expected(full(docs))


def test_a_changed_row_is_found(spark):
    docs = table(spark, [(i, f"text {i}", "s") for i in range(10)])
    from pyspark.sql import functions as F

    out = merkle.audit(docs, F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text"))).collect()
    assert {r.doc_id for r in out if not r.verified} == {7}

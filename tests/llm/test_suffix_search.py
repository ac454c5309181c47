"""Benchmark passages against a direct search for windows."""

import hashlib
import random
import re

import numpy as np

from corpus import awkward, prose, table
from tracequilt.llm import suffix_search as ss

ITEMS = "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def expected(docs, items, window=10):
    windows = []
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        windows += [(item, tuple(w[i : i + size])) for i in range(len(w) - size + 1) if size]
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        at = {}
        for size in {len(x) for _, x in windows}:
            for i in range(len(w) - size + 1):
                at.setdefault(tuple(w[i : i + size]), []).append(i)
        for item, x in windows:
            for i in at.get(x, []):
                hit |= set(range(i, i + len(x)))
                found |= {item} - {None}
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(map(str, out))


def run(spark, docs, items, **how):
    df = spark.createDataFrame(items, ITEMS).selectExpr("*", "'x' AS row", "'y' AS spans")
    return sorted(str(tuple(r)) for r in ss.report(docs, df, **how).collect())


def sample():
    items = [(i, prose(900 + i, 25 + i)) for i in range(12)] + [(20, "Short one."), (21, "é"), (22, ""), (23, None), (24, "... !"), (None, prose(990, 30)), (3, prose(991, 40))]
    rng, rows = random.Random(5), awkward(4000)
    for i in range(60):
        text = prose(i, rng.randint(0, 200))
        if i % 3 == 0:
            w = rng.choice([t for _, t in items if t]).upper().split()
            a = rng.randrange(len(w))
            text += " | " + ", ".join(w[a : a + rng.choice([9, 10, 11, 30])]) + "; " + prose(i + 500, 20)
        rows.append((200 + i, text + (" SHORT, one" if i % 20 == 1 else "")))
    rows += [(400 + i, prose(905, 40)) for i in range(50)]  # a hot passage
    return rows, items


def test_hits_equal_a_direct_search(spark):
    rows, items = sample()
    docs = table(spark, rows, extra=True).repartition(3)
    want = expected([(r[0], r[1]) for r in rows], items)
    assert run(spark, docs, items) == want
    assert any(", True)" in w for w in want) and any(", False)" in w for w in want)
    # shards of a few hundred words: long documents in overlapping pieces; a benchmark in many passes
    assert run(spark, docs, items, shard=300) == want
    assert run(spark, docs, items, test_bytes=400) == want


def test_empty_tables(spark):
    rows, items = sample()
    assert run(spark, table(spark, []), items) == []
    assert run(spark, table(spark, rows[:20]), []) == expected([(r[0], r[1]) for r in rows[:20]], [])


def test_affected_documents_go(spark):
    rows, items = sample()
    left = ss.remove(table(spark, rows), spark.createDataFrame(items, ITEMS))
    want = sorted(str((d, t)) for (d, t), line in ((r[:2], expected([r[:2]], items)[0]) for r in rows) if ", False)" in line)
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == want and left.columns == table(spark, rows).columns


def test_longest_matches(spark):
    rows = [(1, "a b c d e x y"), (2, "q a b c d e f"), (3, "z"), (4, "a b c d e f")]
    items = [(7, "k a b c d e f g"), (8, "nothing"), (9, "Z")]
    for shard in (1 << 20, 3):
        got = ss.longest_matches(table(spark, rows), spark.createDataFrame(items, ITEMS), shard=shard).collect()
        assert sorted((r.item_id, r.words, r.item_start, r.doc_id, r.doc_start) for r in got) == [(7, 6, 1, 2, 1), (9, 1, 0, 3, 0)]


def test_suffix_array_order():
    rng = np.random.default_rng(3)
    for depth in (1, 2, 5, 64):
        ids = np.concatenate([np.append(rng.integers(1, 4, rng.integers(0, 60)), 0) for _ in range(20)]).astype(np.int64)
        order = ss.suffix_array(ids, depth)
        assert sorted(order.tolist()) == list(range(len(ids)))
        cut = lambda p: [*ids[p : p + depth].tolist()][: (ids[p : p + depth].tolist() + [0]).index(0) + 1]
        texts = [cut(p) for p in order]
        assert texts == sorted(texts)

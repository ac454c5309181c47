import random

import numpy as np
import pytest

import corpus
import corpus_pipeline
from tracequilt.llm import near_copies


def jaccard(x: str, y: str) -> float:
    sets = []
    for text in (x, y):
        words = text.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited(text: str, edits: int, seed: int) -> str:
    words = text.split(" ")
    for k, at in enumerate(random.Random(seed).sample(range(len(words)), edits)):
        words[at] = f"changed{seed}x{k}"
    return " ".join(words)


def copies(edits):
    """Pairs of a text and its copy with so many words changed; ids 2 * i and 2 * i + 1."""
    rows = []
    for i in range(60):
        base = corpus.prose(1000 + i, 300)
        rows += [(2 * i, base), (2 * i + 1, edited(base, edits, i))]
    return rows


@pytest.mark.parametrize("edits, low, high", [(6, 0.8, 0.87), (3, 0.87, 0.94), (2, 0.92, 0.96), (14, 0.5, 0.78)])
def test_stage_drops_copies_by_exact_similarity(spark, edits, low, high):
    rows = copies(edits)
    texts = dict(rows)
    similar = [jaccard(texts[2 * i], texts[2 * i + 1]) for i in range(60)]
    assert all(low < s < high for s in similar)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, corpus.table(spark, rows, extra=True), "").collect()}
    assert {2 * i for i in range(60)} <= kept
    gone = 120 - len(kept)
    assert gone == 0 if high < 0.8 else gone >= 59


def test_groups_ids_and_repeated_rows(spark):
    base = corpus.prose(1, 400)
    rows = [(i, edited(base, 4, i)) for i in range(10, 60)] + [(5, base), (5, base), (None, base), (None, None), (8, " "), (None, corpus.prose(2, 90))]
    docs = corpus.table(spark, rows, extra=True)
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "8", "None"]
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_large_buckets_lose_no_link(spark):
    """Eighty kinds of one text, too far apart to be copies yet near enough to share buckets, each with a close copy."""
    base, rows = corpus.prose(77, 300), []
    for i in range(80):
        kind = edited(base, 14, i)
        rows += [(2 * i, kind), (2 * i + 1, edited(kind, 1, 1000 + i))]
    texts = dict(rows)
    assert all(jaccard(texts[2 * i], texts[2 * i + 1]) >= 0.8 for i in range(80))
    assert all(jaccard(texts[0], texts[2 * i]) < 0.8 for i in range(1, 80))
    kept = sorted(r["doc_id"] for r in near_copies.keep_one(corpus.table(spark, rows)).collect())
    assert kept == [2 * i for i in range(80)]


def test_no_mask_is_empty_and_pairs_within_the_radius_meet():
    rng = random.Random(3)
    for radius, width in ((5, 32), (4, 32), (6, 40), (10, 64)):
        places = rng.sample(range(128), width)
        masks = near_copies.masks_over(radius, places, seed=1)
        assert len(set(masks)) == len(masks) == 2 ** (radius + 1) - 1 and all(masks)
        for _ in range(200):
            apart = sum(1 << p for p in rng.sample(places, radius))
            assert any(not m & apart for m in masks)


def test_strangers_meet_the_whole_bucket(spark):
    """Members beyond the leaders that are joined to no other meet every member; those joined to most do not meet each other."""
    rows = [(1, i, 0, 1 << i % 20) for i in range(60)]
    rest = spark.createDataFrame(rows, "bucket long, node long, a long, b long")
    roots = spark.createDataFrame([(i, 0) for i in range(57)], "node long, root long")
    got = {(r.u, r.v) for r in near_copies.strangers(rest, roots).collect()}
    want = {(max(i, j), min(i, j)) for i in (57, 58, 59) for j in range(60) if i != j}
    assert got == want


def test_parities_differ_in_at_most_as_many_bits_as_sets_in_members():
    rng = random.Random(5)
    for size, apart in ((0, 1), (1, 1), (150, 30), (1200, 900), (5000, 20)):
        pool = np.array([rng.getrandbits(63) for _ in range(size + apart)], np.int64)
        x, y = pool[:size], pool[apart // 2 :]
        bits = int(np.bitwise_count((near_copies.parity(x) ^ near_copies.parity(y)).view(np.uint64)).sum())
        assert bits <= len(set(x.tolist()) ^ set(y.tolist()))
        assert apart != 30 or bits > 20


def test_pairs_of_a_large_group_do_not_grow_as_its_square(spark, monkeypatch):
    """Four hundred kinds of one text, most too far apart to be copies yet near by fingerprint: few pairs are checked, no link is lost."""
    base, rows = corpus.prose(78, 150), [(0, corpus.prose(78, 150))]
    rows += [(i, edited(base, 1 + i % 8, i)) for i in range(1, 400)]
    texts, checked = dict(rows), []
    old = near_copies._checked
    monkeypatch.setattr(near_copies, "_checked", lambda left, *more: checked.append(left.count()) or old(left, *more))
    kept = {r["doc_id"] for r in near_copies.keep_one(corpus.table(spark, rows)).collect()}
    sets = {i: near_copies.shingles(t) for i, t in texts.items()}
    like = lambda x, y: len(sets[x] & sets[y]) / len(sets[x] | sets[y])
    group = {i: i for i in texts}
    for x in texts:
        for y in range(x):
            if like(x, y) >= 0.8 and group[x] != group[y]:
                old_root, new = max(group[x], group[y]), min(group[x], group[y])
                group = {k: new if g == old_root else g for k, g in group.items()}
    assert kept == set(group.values()) and 100 < len(kept) < 300
    assert sum(checked) < 30 * len(rows) < len(rows) * len(rows) // 10


def test_pairs_that_parities_rule_out_need_no_text(spark, monkeypatch):
    """Edited texts near by fingerprint but not similar: none is checked, so no text is read again."""
    rows, checked = copies(24), []
    old = near_copies._checked
    monkeypatch.setattr(near_copies, "_checked", lambda left, *more: checked.append(left.count()) or old(left, *more))
    marked = {i: near_copies.fingerprint(near_copies.shingles(t)).view(np.uint64) for i, t in rows}
    near = sum(int(np.bitwise_count(marked[2 * i] ^ marked[2 * i + 1]).sum()) <= near_copies.NEAR for i in range(60))
    assert near > 10
    assert near_copies.keep_one(corpus.table(spark, rows)).count() == len(rows)
    assert sum(checked) == 0


def test_members_with_few_near_leaders_meet_all_of_them_and_others_are_listed(spark):
    rng = random.Random(9)
    rows = []
    for size in (1, 2, 4, 9):
        base = rng.getrandbits(127)
        rows += [base ^ sum(1 << p for p in rng.sample(range(127), 8)) for _ in range(size)]
    halves = [tuple(int(x) for x in np.array([r & (1 << 64) - 1, r >> 64], np.uint64).view(np.int64)) for r in rows]
    table = spark.createDataFrame(halves, "a long, b long")
    keyed = [(r.a, r.b, r.node) for r in table.selectExpr("a", "b", "xxhash64(a, b) AS node", "xxhash64(b, a) AS o").orderBy("o").collect()]
    apart = lambda x, y: sum(((x[k] ^ y[k]) & (1 << 64) - 1).bit_count() for k in (0, 1))
    want, listed = {}, set()
    for k, x in enumerate(keyed):
        found = [(apart(x, y), j) for j, y in enumerate(keyed[:k]) if apart(x, y) <= near_copies.NEAR]
        if len(found) > near_copies.FEW:
            listed |= {x[2], *(keyed[j][2] for _, j in found)}
            found = [min(found)]
        want |= {(x[2], keyed[j][2]): d for d, j in found}
    near, rest = near_copies.candidates(table, [(0, 0)])
    assert {(r.u, r.v): r.apart for r in near.collect()} == want
    assert {r.node for r in rest.collect()} == listed and len(listed) == 9


@pytest.mark.parametrize("keys, readings", [(7, 1000), (7, 1)])
def test_more_keys_than_go_out_at_once(spark, monkeypatch, keys, readings):
    monkeypatch.setattr(near_copies, "KEYS", keys)
    monkeypatch.setattr(near_copies, "READINGS", readings)
    rows = copies(2)
    kept = {r["doc_id"] for r in near_copies.keep_one(corpus.table(spark, rows[:40])).collect()}
    assert kept == set(range(0, 40, 2))

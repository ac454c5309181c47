import itertools
import random

import numpy as np
import pytest
import xxhash

import corpus
from tracequilt.llm import components, simhash


def fingerprint(text: str | None) -> int:
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, pairs) -> dict:
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(fps, radius=4):
    values = np.array(fps, np.uint64)
    return [(fps[i], fps[j]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius).tolist()]


@pytest.mark.parametrize("extra", [False, True])
def test_components_equal_brute_force(spark, extra):
    rows = corpus.awkward(2000)
    for i in range(30):
        words = corpus.prose(100 + i // 6, 200).split(" ")
        words[i % 6 * 20] = "changed"
        rows.append((100 + i, " ".join(words)))
    fps = {i: fingerprint(r[1]) for i, r in enumerate(rows)}
    root = roots(set(fps.values()), near(sorted(set(fps.values()))))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[fps[i]]] = min(r[0], least.get(root[fps[i]], r[0]))
    want = sorted((str(r[0]), f"{fps[i]:016x}", str(least.get(root[fps[i]]))) for i, r in enumerate(rows))
    got = simhash.near_duplicates(corpus.table(spark, rows, extra)).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


def test_masks_cover_every_pair_in_the_radius():
    masks = simhash.covering_masks(4, list(range(64)), 1)
    assert len(masks) == 31
    rng = random.Random(3)
    for _ in range(3000):
        difference = sum(1 << p for p in rng.sample(range(64), rng.randint(0, 4)))
        assert any(difference & m == 0 for m in masks)


@pytest.mark.parametrize("bucket", [1024, 5, 1])
def test_split_buckets_lose_no_link(spark, bucket):
    rng = random.Random(1)
    fps = set()
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(90):
            x = base
            for p in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << p
            fps.add(x)
    fps = sorted(fps)
    found = simhash.links(spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long"), 4, bucket).collect()
    pairs = [(r["u"] % 2**64, r["v"] % 2**64) for r in found]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    assert roots(fps, pairs) == roots(fps, near(fps))


def test_connected_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    links = chain + star + [(7, 7), (5000, 4999), (4999, 5000)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    nodes = set(itertools.chain(*links))
    assert {n: got.get(n, n) for n in nodes} == roots(nodes, links)
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one_and_empty_table(spark):
    rows = [(3, corpus.prose(1, 90)), (1, corpus.prose(1, 90)), (1, corpus.prose(1, 90)), (2, corpus.prose(9, 90)), (None, corpus.prose(12, 90))]
    rows += [(None, corpus.prose(13, 90)), (None, corpus.prose(13, 90)), (None, corpus.prose(9, 90)), (None, None), (8, " ")]
    docs = corpus.table(spark, rows, extra=True)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([
        ("1", corpus.prose(1, 90)), ("2", corpus.prose(9, 90)), ("None", corpus.prose(12, 90)), ("None", corpus.prose(13, 90)), ("8", " ")])
    assert simhash.near_duplicates(corpus.table(spark, rows).limit(0)).count() == 0

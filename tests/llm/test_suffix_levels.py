import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus
from tracequilt.llm import suffix_levels as sl


def brute(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, *_), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((str(doc), len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows():
    base = corpus.prose(40, 400)
    made = corpus.awkward(1500)
    made += [(60 + i, corpus.prose(50 + i, 60) + base[30 * i : 30 * i + 500 - 7 * i] + corpus.prose(80 + i, 60)) for i in range(12)]
    made += [(90, "ab" * 900), (91, "ab" * 500 + "b"), (92, "é" * 400), (93, base[:300] + "X" + base[301:])]
    return made


@pytest.mark.parametrize(("batches", "group", "extra"), [(1, 4096, False), (2, 4096, True), (5, 2, False)])
def test_removal_equals_brute_force(spark, batches, group, extra):
    docs = corpus.table(spark, rows(), extra)
    got = sl.remove_repeats(sl.hash_batches(docs, batches), group=group).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows(), 200)


def test_levels_merge_geometrically(spark):
    index = sl.SuffixLevels()
    sizes = []
    for batch in sl.hash_batches(corpus.table(spark, rows()[:12]), 5):
        index.add(sl.keyed(batch))
        sizes.append(sorted(index.levels))
    assert sizes == [[0], [1], [0, 1], [2], [0, 2]]


def test_long_text_in_stretches(monkeypatch):
    data = corpus.prose(1, 900).encode()
    monkeypatch.setattr(sl, "STRETCH", 1000)
    h, first, count, away = sl.anchored(data)
    starts = [s for f, c in zip(first.tolist(), count.tolist()) for s in range(f, f + c)]
    assert starts == list(range(len(data) - 199)) and int(count.max()) < 256 and int(away.max()) < 256


def test_empty_table(spark):
    docs = corpus.table(spark, [(1, "a")])
    assert sl.remove_repeats(sl.hash_batches(docs.limit(0), 2)).count() == 0
    assert sl.remove_repeats([docs]).first()["n_removed"] == 0

import math
import random
from collections import defaultdict

import pytest

import corpus
from tracequilt.llm import mixing, queries


def sources(hot: int):
    """3000 sources of one or two short texts each, a hot one with so many, and a row of no source."""
    rows = [(i, "x" * 100, f"site{i}") for i in range(3000)] + [(3000 + i, "x" * 60, f"site{2 * i}") for i in range(1500)]
    return rows + [(10_000 + i, "y" * 90, "hot") for i in range(hot)] + [(-1, "z", None)]


@pytest.mark.parametrize("hot", [0, 2000])
def test_thousands_of_sources_all_have_their_share(spark, tmp_path, hot):
    rows = sources(hot)
    docs = corpus.table(spark, rows)
    weights = mixing.temperature_weights(docs)
    assert set(weights) == ({"hot"} if hot else set())
    got = mixing.mix(docs, weights, block_chars=100, share=1000).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    assert max(got, key=lambda r: r["slot"])["doc_id"] == -1
    total, at = defaultdict(int), {}
    for _, text, source in rows:
        total[source] += len(text)
    for r in got:
        assert at.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
    # At every slot each class and the hot source are within a block of their share, until the first runs dry.
    line = {s: "hot" if s == "hot" else int(2 * math.log2(n)) for s, n in total.items() if s}
    root, size = defaultdict(float), defaultdict(int)
    for s, k in line.items():
        root[k] += total[s] ** 0.5
        size[k] += -(-total[s] // 100)
    parts = {k: max(1, round(1000 * v / sum(root.values()))) for k, v in root.items()}
    sent, slot = defaultdict(int), 0
    while all(sent[k] < size[k] for k in parts):
        if slot in at:
            source, block = at[slot]
            sent[line[source]] += 1
            assert source == "hot" or block <= (sent[line[source]] - 1) // 100
        else:  # a block in which no row begins: its line is the one that is furthest behind
            sent[min(parts, key=lambda k: sent[k] - parts[k] / sum(parts.values()) * (slot + 1))] += 1
        slot += 1
        assert all(abs(sent[k] - w / sum(parts.values()) * slot) < 2 for k, w in parts.items())
    assert slot > 500
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op3_mixing(spark, str(tmp_path)).where("source <> 'hot'").collect()
    assert len({r["slot"] for r in rows}) == 3000


def test_blocks_of_a_class_take_turns(spark):
    rows = [(10 * s + i, "x" * 100, f"s{s}") for s in range(3000) for i in range(1 + s % 2)]
    docs = corpus.table(spark, rows)
    assert mixing.temperature_weights(docs) == {}
    got = sorted(mixing.mix(docs, {}, block_chars=100, share=1000).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in got] == list(range(len(rows)))
    # Two classes: 1500 sources of one block each, 1500 of two; the larger sources have sqrt(2) times the weight.
    parts = {0: round(1000 / (1 + 2**0.5)), 1: round(1000 * 2**0.5 / (1 + 2**0.5))}
    sent = {0: 0, 1: 0}
    for n, r in enumerate(got, 1):
        kind = int(r["source"][1:]) % 2
        assert r["block"] == sent[kind] // 1500
        sent[kind] += 1
        if max(sent[0] / 1500, sent[1] / 3000) < 1:
            assert all(abs(sent[k] - n * parts[k] / sum(parts.values())) < 1 for k in parts)


def test_one_period_is_earliest_deadline_first():
    rng = random.Random(7)
    for _ in range(60):
        weights = {f"s{i}": rng.randint(1, 30) for i in range(rng.randint(1, 12))}
        period, sent = sum(weights.values()), {s: [] for s in weights}
        for slot in range(period):
            due = [(-(-(len(sent[s]) + 1) * period // w), s) for s, w in weights.items() if len(sent[s]) < w and len(sent[s]) * period // w <= slot]
            sent[min(due)[1]].append(slot)
        assert mixing.one_period(weights) == sent

import random

import duckdb
import pytest

import corpus
from tracequilt.llm import mixing


def order(plan):
    at = {}
    for source, phases in plan.items():
        for p in phases:
            for i in range(p.first, p.last):
                j = i - p.first
                slot = p.start + j // p.weight * p.period + p.slots[j % p.weight]
                assert slot not in at
                at[slot] = (source, p)
    return at


@pytest.mark.parametrize("seed", range(12))
def test_less_than_one_block_from_the_share_at_every_slot(seed):
    rng = random.Random(seed)
    weights = {f"s{i}": rng.randint(1, 50) for i in range(rng.randint(1, 9))}
    blocks = {s: rng.randint(1, 300) for s in weights}
    plan, slots = mixing.schedule(weights, blocks)
    at = order(plan)
    assert sorted(at) == list(range(slots)) and slots == sum(blocks.values())
    start, sent = None, {}
    for slot in range(slots):
        source, phase = at[slot]
        if phase.start != start:
            start, sent = phase.start, {}
        sent[source] = sent.get(source, 0) + 1
        for s, phases in plan.items():
            for p in phases:
                if p.start == start:
                    assert abs(sent.get(s, 0) - p.weight / p.period * (slot + 1 - start)) < 1


def documents(n=300):
    rng = random.Random(2)
    rows = corpus.awkward(900) + [(1000 + i, corpus.prose(i, rng.randint(1, 90)), rng.choice(["a", "a", "b", "c'd", None])) for i in range(n)]
    return rows


def test_places_equal_sql_slot_by_slot(spark):
    docs = corpus.table(spark, documents(), extra=True)
    got = mixing.mix(docs, mixing.temperature_weights(docs, 40), block_chars=700)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas().convert_dtypes())
    want = con.sql(mixing.oracle(40, 700)).fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((tuple(r) for r in want), key=key)


def test_rows_without_a_weight_come_last_and_none_is_lost(spark):
    rows = documents(100)
    got = mixing.mix(corpus.table(spark, rows), {"a": 3, "b": 1, "missing": 5, "off": 0}, block_chars=300).collect()
    assert len(got) == len(rows)
    last = max(r["slot"] for r in got if r["source"] in ("a", "b"))
    assert all(r["slot"] > last for r in got if r["source"] not in ("a", "b"))


def test_mixed_keeps_rows_and_columns_in_order(spark):
    docs = corpus.table(spark, documents(100), extra=True)
    weights = {"a": 2, "b": 1}
    got = mixing.mixed(docs, weights, block_chars=300)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))
    place = {(r["doc_id"], r["source"]): (r["slot"], r["at"]) for r in mixing.mix(docs, weights, block_chars=300).collect() if (r["doc_id"] or 0) >= 1000}
    seen = [place[r["doc_id"], r["source"]] for r in got.collect() if (r["doc_id"] or 0) >= 1000]
    assert seen == sorted(seen)


def test_no_rows_and_no_weights(spark):
    docs = corpus.table(spark, [(1, "a", None), (2, None, None)])
    assert mixing.temperature_weights(docs) == {}
    assert mixing.mix(docs, {}).count() == 2
    assert mixing.mix(docs.limit(0), {"a": 1}).count() == 0

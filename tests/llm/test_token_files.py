import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import corpus
from test_packing import BYTES, whole
from tracequilt.llm import token_files
from tracequilt.llm.elias_fano import EliasFano


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=1500).map(sorted))
def test_elias_fano_round_trip(values):
    coded = EliasFano(EliasFano.encode(np.array(values, np.uint64)))
    assert coded.to_array().tolist() == values
    for i in random.Random(1).sample(range(len(values)), min(20, len(values))):
        assert coded.select(i) == values[i]


def test_select_over_many_samples_and_size():
    values = np.cumsum(np.random.default_rng(1).integers(0, 5000, 20_000)).astype(np.uint64)
    data = EliasFano.encode(values)
    coded = EliasFano(data)
    assert all(coded.select(i) == values[i] for i in range(0, 20_000, 37))
    assert len(data) < 20_000 * 2.2  # 64-bit numbers would take 8 bytes each
    with pytest.raises(IndexError):
        coded.select(20_000)


def test_shard_gives_single_documents():
    arrays = [np.arange(n, dtype=np.uint32) for n in (3, 0, 5)]
    shard = token_files.TokenShard(token_files.TokenShard.encode([None, -2, 7], arrays, 2))
    assert [shard.doc_id(i) for i in range(3)] == [None, -2, 7]
    assert [shard.document(i).tolist() for i in range(3)] == [a.tolist() for a in arrays]


@pytest.mark.parametrize(("extra", "shard"), [(False, 8_000_000), (True, 500)])
def test_round_trip_equals_brute_force(spark, extra, shard):
    rows = [r for r in corpus.awkward(4000)]
    got = token_files.round_trip(corpus.table(spark, rows, extra), BYTES, shard_tokens=shard).collect()
    encode = whole(BYTES)
    made = [(r[0], encode(r[1]) + [0]) for r in rows]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(k), len(i), crc(i)) for k, i in made)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))


def test_empty_table(spark):
    assert token_files.round_trip(corpus.table(spark, [(1, "a")]).limit(0), BYTES).count() == 0

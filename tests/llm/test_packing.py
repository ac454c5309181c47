import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus
from tracequilt.llm import packing
from tracequilt.llm.tokens import PieceEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def whole(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_pieces_encode_like_whole_texts(path):
    texts = [
        "", " ", "\n\n", "a  b", " a\n\n b \n", "x\t y", "it's I'll  we're", "é́ ñ İ Σς", "\u3000a\u00a0 b", "a\x1c b\x85 c\u200b d", "<|endoftext|> x",
        "tab\tand\r\nreturn", "1234 5678", "...!!! ???", corpus.prose(1, 500), "\U0001f600 \U0001f600", "a" * 500, "  \n x", "x \n", "x\n \ny",
    ]
    encode = whole(path)
    assert [x.tolist() for x in PieceEncoder(path).encode(texts)] == [encode(t) for t in texts]


def one_by_one(lengths, window):
    """Best-fit decreasing with every piece on its own."""
    left = []
    for length in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= length]
        if fits:
            left[min(fits)[1]] -= length
        else:
            left.append(window - length)
    return sorted(left)


@pytest.mark.parametrize("seed", range(8))
def test_histogram_packing_equals_one_by_one(seed):
    rng = random.Random(seed)
    window = rng.choice([7, 16, 50, 100])
    lengths = [rng.choice([rng.randint(1, window), window // 3 or 1]) for _ in range(rng.randint(0, 400))]
    counts = {x: lengths.count(x) for x in set(lengths)}
    used, seen = defaultdict(int), defaultdict(set)
    for lot in packing.best_fit_decreasing(counts, window):
        for rank in range(lot.first, lot.last):
            assert rank not in seen[lot.length]
            seen[lot.length].add(rank)
            place = rank - lot.first
            used[lot.sequence + place // lot.each] += lot.length
    assert {k: len(v) for k, v in seen.items()} == counts
    assert sorted(window - u for u in used.values()) == one_by_one(lengths, window)


@pytest.mark.parametrize("extra", [False, True])
def test_every_id_lies_in_one_piece(spark, extra):
    rows = corpus.awkward(6000)
    got = packing.pack_documents(corpus.table(spark, rows, extra), WORDS, window=256).collect()
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    want = []
    for doc, text, *_ in rows:
        ids = whole(WORDS)(text) + [1]
        want += [(str(doc), i, len(ids[i : i + 256]), zlib.crc32(np.array(ids[i : i + 256], "<u4").tobytes()), len(ids)) for i in range(0, len(ids), 256)]
    assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == sorted(want)
    assert sorted(256 - sum(length for _, length in parts) for parts in places.values()) == one_by_one([w[2] for w in want], 256)


def test_shards_are_packed_one_after_another(spark):
    rows = corpus.awkward(3000)
    docs = corpus.table(spark, rows, extra=True)
    got = packing.pack_in_order(packing.pieces(docs, WORDS, 256, shard=F.expr("int(coalesce(doc_id, 0) % 3 + 1)")), 256).collect()
    whole_cut = packing.pack_documents(docs, WORDS, window=256).collect()
    row = lambda r: (str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(row, got)) == sorted(map(row, whole_cut))
    assert all(r["sequence_id"] >> 32 == (r["doc_id"] or 0) % 3 + 1 or (r["doc_id"] or 0) < 0 for r in got)
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and sum(p[1] for p in parts) <= 256


def test_sequences_hold_the_ids(spark):
    rows = [(i, corpus.prose(i, 40 + 17 * i)) for i in range(20)]
    docs = corpus.table(spark, rows)
    got = packing.sequences(docs, WORDS, window=128, pad=9).collect()
    assert all(len(r["ids"]) == 128 and r["ids"][r["n_ids"] :] == [9] * (128 - r["n_ids"]) for r in got)
    assert sorted(i for r in got for i in r["ids"][: r["n_ids"]]) == sorted(i for _, t in rows for i in whole(WORDS)(t) + [1])


def test_empty_table(spark):
    docs = corpus.table(spark, [(1, "a")]).limit(0)
    assert packing.pack_documents(docs, WORDS).count() == 0
    assert packing.sequences(docs, WORDS).count() == 0

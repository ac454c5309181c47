import hashlib

import pytest
from hypothesis import given, settings, strategies as st

import corpus
from tracequilt.llm import prefix_hashes as ph


def common(a, b) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def likeness(a: str, b: str) -> float:
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    head = common(a, b)
    return 1.0 if not longer else (head + min(common(a[::-1], b[::-1]), shorter - head)) / longer


@settings(max_examples=150, deadline=None)
@given(st.text("ab\U0001f600", max_size=60), st.text("ab\U0001f600", max_size=60), st.integers(0, 60), st.integers(0, 60))
def test_spans_and_extensions(a, b, i, j):
    i, j = min(i, len(a)), min(j, len(b))
    x, y = ph.PrefixHashes(ph.points(a)), ph.PrefixHashes(ph.points(b))
    assert x.extension(i, y, j) == common(a[i:], b[j:])
    assert x.back_extension(i, y, j) == common(a[:i][::-1], b[:j][::-1])
    assert x.likeness(y) == likeness(a, b)
    assert (x.fingerprint() == y.fingerprint()) == (a == b)


@pytest.mark.parametrize("extra", [False, True])
def test_neighbours_equal_brute_force(spark, extra):
    rows = corpus.awkward(9000)
    got = ph.neighbour_fingerprints(corpus.table(spark, rows, extra)).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, (doc, text, *_) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        want.append((str(doc), len(text), hashlib.sha256(edited.encode()).hexdigest(), likeness(text, edited), likeness(text, after)))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got) == sorted(want)


def test_one_row_and_none(spark):
    row = ph.neighbour_fingerprints(corpus.table(spark, [(5, "abcdefgh")])).first()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert ph.neighbour_fingerprints(corpus.table(spark, [(5, "a")]).limit(0)).count() == 0

import random
import zlib
from collections import defaultdict

import numpy as np

import corpus
import corpus_pipeline
from test_packing import WORDS, whole
from tracequilt.llm import mixing, secret_scan
from tracequilt.runtime import scratch_path


def sample():
    rows = [(i, corpus.prose(i, 120), f"src{i % 4}") for i in range(40)]
    rows += [(100 + i, corpus.prose(i, 120), "copy") for i in range(10)]
    rows += [(200, "too short", "src1"), (201, "a b c d e " * 40, "src1"), (202, None, "src1"), (203, corpus.prose(300, 90) + f"\nThe secret: token = {'0f' * 20} stands in this line of text.", "src2")]
    return rows


def test_stages_take_effect_one_after_another(spark):
    docs = corpus.table(spark, sample())
    columns, made = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = scratch_path(spark, "stage")
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        made.append(docs)
        assert i == 4 or docs.columns == columns
    ids = [sorted(r["doc_id"] for r in m.select("doc_id").distinct().collect()) for m in made]
    assert ids[0] == [*range(40), *range(100, 110), 203]
    assert ids[1] == ids[2] == ids[3] == ids[4] == [*range(40), 203]
    texts = {r["doc_id"]: r["text"] for r in made[2].collect()}
    assert "[SECRET]" in texts[203] and not any(secret_scan.find_secrets(t) for t in texts.values())
    slots = {r["doc_id"]: (r["slot"], r["at"]) for r in mixing.mix(made[2], mixing.temperature_weights(made[2])).collect()}
    in_order = [slots[r["doc_id"]] for r in made[3].selectExpr("doc_id", "_metadata.file_name AS f", "_metadata.row_index AS i").orderBy("f", "i").collect()]
    assert in_order == sorted(in_order)
    # Sequences come in the order of the mixture's part files.
    files = {r["doc_id"]: r["f"] for r in made[3].selectExpr("doc_id", "_metadata.file_name AS f").collect()}
    packed = [files[r["doc_id"]] for r in made[4].orderBy("sequence_id", "offset").collect()]
    assert packed == sorted(packed) and len(set(packed)) > 1
    pieces = defaultdict(list)
    for r in made[4].collect():
        pieces[r["doc_id"]].append(r)
    for doc, text in texts.items():
        tokens = whole(WORDS)(text) + [1]
        for r in pieces[doc]:
            assert r["ids_crc32"] == zlib.crc32(np.array(tokens[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        assert sum(r["length"] for r in pieces[doc]) == len(tokens)


def test_run_over_the_given_table(spark, tmp_path):
    corpus.table(spark, sample()).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.select("doc_id").distinct().count() == 41
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "SimHash near-dedup", "secret scans", "mixing sources to target weights", "packing"]


def test_run_equals_a_direct_version(spark, tmp_path):
    """All stages in plain Python: known bad lines, exact similarity in chains, redaction, the tokenizer; then every id in exactly one place."""
    from test_near_copies import jaccard
    from test_quality_rules import brute

    def edited(text, edits, seed):
        """Other words inside the lines; their ends stay, as a line without one is no prose."""
        words = text.split(" ")
        inner = [i for i, w in enumerate(words) if "." not in w]
        for k, at in enumerate(random.Random(seed).sample(inner, edits)):
            words[at] = f"changed{seed}x{k}"
        return " ".join(words)

    bad = ["All rights reserved.", "Home | News | About | Contact"]
    rows = sample() + [(300 + i, edited(corpus.prose(i, 120), 1, i), "near") for i in range(12)] + [(320 + i, edited(corpus.prose(i, 120), 20, i), "far") for i in range(6)]
    rows += [(340 + i, corpus.prose(600 + i, 80) + "\n" + bad[i % 2], "src0") for i in range(4)] + [(350, corpus.prose(600, 80), "src3")]
    corpus.table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for doc, text, _ in rows:
        if not brute(text)[-1]:
            kept[doc] = "\n".join(line for line in text.split("\n") if line not in bad)
    group = {d: d for d in kept}
    for d in sorted(kept):
        for e in sorted(kept):
            if d < e and (kept[d] == kept[e] or jaccard(kept[d], kept[e]) >= 0.8):
                old, new = max(group[d], group[e]), min(group[d], group[e])
                group = {k: new if g == old else g for k, g in group.items()}
    want = {}
    for d in {g for g in group.values()}:
        text = secret_scan.redacted(kept[d], secret_scan.find_secrets(kept[d]), "[SECRET]")
        want[d] = whole(WORDS)(text) + [1]
    assert len(want) < len(kept) < len(rows)
    places, got = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert set(got) == set(want)
    for d, pieces in got.items():
        at = 0
        for start, length, crc, total in sorted(pieces):
            assert start == at and total == len(want[d]) and crc == zlib.crc32(np.array(want[d][start : start + length], "<u4").tobytes())
            at += length
        assert at == len(want[d])
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and at + length <= 2048
            at += length

import re

import duckdb
import pytest

import corpus
from tracequilt.llm import quality


def brute(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@pytest.mark.parametrize("extra", [False, True])
def test_counts_equal_brute_force(spark, extra):
    rows = corpus.awkward(700) + [(20, "a b c d e " * 12), (21, "x\ny\nx\nx " + corpus.prose(5, 30)), (22, "a b c d e a b c d e f")]
    got = quality.quality_verdicts(corpus.table(spark, rows, extra)).collect()
    have = sorted((r["doc_id"] or 0, *(r[n] for n in NAMES)) for r in got)
    assert have == sorted((r[0] or 0, *brute(r[1])) for r in rows)
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_verdicts_equal_sql(spark):
    rows = corpus.awkward(400) + [(30, "it's a | b | c | d\n" * 3 + corpus.prose(6, 40)), (31, corpus.prose(7, 60) + "\nAll rights reserved.")]
    docs = corpus.table(spark, rows)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.sql(quality.oracle()).fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in quality.quality_verdicts(docs).collect()), key=key) == sorted(want, key=key)


def test_cleaning_drops_failing_lines_and_keeps_columns(spark):
    good = corpus.prose(8, 120)
    rows = [
        (1, good), (2, good + "\nAll rights reserved.\nHome | News | About | Contact"), (3, "Home | News | About | More\n" * 20),
        (4, " ".join(f"w{i}%%%" for i in range(200)) + "."), (5, None),
    ]
    got = {r["doc_id"]: r for r in quality.clean(corpus.table(spark, rows, extra=True)).collect()}
    assert set(got) == {1, 2}
    assert got[2]["text"] == got[1]["text"] == good and got[2]["n_chars"] == len(good) and got[1]["key"] == "x"


def test_empty_table(spark):
    assert quality.quality_verdicts(corpus.table(spark, []).limit(0)).count() == 0
    assert quality.clean(corpus.table(spark, [(1, None)])).count() == 0

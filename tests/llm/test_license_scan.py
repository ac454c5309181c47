import re

import duckdb
import pytest

import corpus
from tracequilt.llm import license_scan as scan
from tracequilt.llm.license_texts import NOTICES, TEXTS

MIT = TEXTS[4][1]


def variants():
    return [
        (1, MIT), (2, "Copyright (c) 2020 Someone Else\n\n" + MIT.upper()), (3, re.sub(r"\s+", " ", MIT)), (4, MIT.replace(",", ";").replace(" ", "\n", 40)),
        (5, MIT + " and more"), (6, TEXTS[0][1].replace("Permission", "© 1999 X\n/* Permission")), (7, "text.\nReleased under the MIT licence!\nmore"),
        (8, "Licensed under CC BY-NC 4.0.\nlicensed under cc by-nc 4.0\nReleased under the MIT License."), (9, "Copyright 2001 by me\nAll rights reserved."),
    ]


@pytest.mark.parametrize("extra", [False, True])
def test_matches(spark, extra):
    rows = corpus.awkward(500) + [(20 + i, t) for i, t in variants()]
    got = {r["doc_id"]: r for r in scan.scan(corpus.table(spark, rows, extra)).collect()}
    assert [got[20 + i]["license_id"] for i in range(1, 10)] == ["MIT", "MIT", "MIT", "MIT", None, "0BSD", None, None, None]
    assert (got[27]["n_notices"], got[27]["notices"]) == (1, "MIT")
    assert (got[28]["n_notices"], got[28]["notices"]) == (3, "CC-BY-NC-4.0,MIT")
    assert got[29]["text_digest"] is None and got[4]["text_digest"] is None and got[5]["notices"] == ""


def test_rows_equal_sql(spark):
    docs = corpus.table(spark, corpus.awkward(500) + [(20 + i, t) for i, t in variants()])
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().convert_dtypes())
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in scan.scan(docs).collect()), key=key) == sorted(con.sql(scan.oracle()).fetchall(), key=key)


def test_every_known_text_finds_itself_and_none_clash(spark):
    known = TEXTS + NOTICES
    got = {r["doc_id"]: r["license_id"] for r in scan.scan(corpus.table(spark, [(i, t) for i, (_, t) in enumerate(known)])).collect()}
    assert got == {i: name for i, (name, _) in enumerate(known)}
    assert scan.scan(corpus.table(spark, [(1, "a")]).limit(0)).count() == 0

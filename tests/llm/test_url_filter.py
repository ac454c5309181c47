import random

import duckdb
import numpy as np
import pytest

from tracequilt.llm import url_filter as uf
from tracequilt.llm.queries import URL_RULES

URLS = [
    "http://a.com/x", "https://Example.COM/en/1", "https://www.example.com/en/1", "http://b.net/es/1?q#f", "http://b.net/fr/", "http://b.net/de/",
    "http://b.net/es", "http://notexample.com/en/", "no scheme", "", None, "x://y://z.net/es/", "http://c.com", "http://c.com?x=/en/", "http://d.net#/es/",
    "http://com/", "http://xcom/", "http://k.org/en/'quoted'", "http://b.net/es/1?q#f", "http://user@B.net:80/es/",
]


def pages(spark, urls, extra=False):
    rows = [(None if i == 5 else i, u, "<html>") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "'x' AS host", "'y' AS rule", "'z' AS listed", "1 AS a", "2 AS _shard") if extra else df


@pytest.mark.parametrize(("extra", "shard_keys"), [(False, 250_000), (True, 3)])
def test_verdicts_equal_sql(spark, extra, shard_keys):
    df = pages(spark, URLS, extra)
    con = duckdb.connect()
    con.register("pages", df.select("page_id", "url").toPandas().convert_dtypes())
    want = con.sql(uf.oracle(URL_RULES)).fetchall()
    got = uf.judge(df, URL_RULES, shard_keys=shard_keys).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_listed_keys_block_where_no_rule_fits(spark):
    listed = spark.createDataFrame([("b.net", "/de/"), ("a.com", "/x"), ("absent.org", "/")], "host string, path string")
    got = {r["page_id"]: (r["verdict"], r["listed"]) for r in uf.judge(pages(spark, URLS), URL_RULES, listed).collect()}
    assert got[0] == ("allow", True) and got[4] == ("block", True) and got[6] == ("allow", False)


@pytest.mark.parametrize("share", [0.0, 0.001, 0.2, 0.9, 1.0])
def test_cascade_is_exact_over_its_universe(share):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2**63, (2, 20_000), dtype=np.uint64)
    listed = rng.random(20_000) < share
    made = uf.Cascade.from_bytes(uf.Cascade.build(a, b, listed).to_bytes())
    assert (made.holds(a, b) == listed).all()
    assert len(made.to_bytes()) < 20_000


def test_passes_over_parts_of_the_cascades(spark):
    keyed = uf.split_url(pages(spark, [f"http://h{i}.net/es/{i % 7}" for i in range(60)]))
    listed = keyed.where("page_id % 3 = 0").select("host", "path")
    cascades = uf.build_cascades(keyed, listed, shard_keys=8)
    got = uf.probe(keyed, cascades, pass_bytes=1).collect()
    assert len(got) == 60 and all(r["listed"] == (int(r["host"][1:-4]) % 3 == 0) for r in got)


def test_empty_table(spark):
    assert uf.judge(pages(spark, URLS).limit(0), URL_RULES).count() == 0
    assert random.Random(1).random() < 1

"""Work is done once and in tasks, whatever the size of the tables."""

from pyspark.sql import DataFrame

from tracequilt.operators import inspect as ins, patterns


def test_patterns_stay_off_the_driver(spark, monkeypatch):
    def refuse(*a, **k):
        raise AssertionError("patterns on the driver")

    names = spark.createDataFrame([("x" * 40 + "Ab" + "y" * 40 + "ab",), ("b",), (None,)], "name string")
    listed = patterns.pattern_table(spark.createDataFrame([("AB",), ("y" * 40,), ("longer than any" * 9,), ("b",)], "pattern string"))
    with monkeypatch.context() as m:
        for name in ("toLocalIterator", "collect"):
            m.setattr(type(names), name, refuse)
        m.setattr(DataFrame, "toLocalIterator", refuse)
        found = [patterns.matches(names, listed, limit) for limit in (1 << 20, 8)]
    for one in found:
        assert sorted((len(r.name), len(r.pattern)) for r in one.collect()) == [(1, 1), (84, 1), (84, 2), (84, 40)]


def test_evidence_works_its_table_out_once(spark):
    seen = spark.sparkContext.accumulator(0)
    fields = sorted({*ins.FILTER_FIELDS.values()})
    columns = ", ".join(f"{c} string" for c in ("capture_id", *(f for f in fields if f != "capture_id")))

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    names = [c.split()[0] for c in columns.split(", ")]
    table = spark.createDataFrame([tuple("c" if n == "capture_id" else f"{n}{i}" for n in names) for i in range(10)], columns).coalesce(1).mapInPandas(count, columns)
    asked = spark.createDataFrame([("c", "search", "7")], "capture_id string, pivot_kind string, pivot_value string")
    assert ins.evidence(asked, table).count() == 1
    assert seen.value == 10

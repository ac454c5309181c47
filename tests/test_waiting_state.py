"""Rows wait in state by the chunk: calls to the state store do not follow the rows."""

import pandas as pd
import pytest

from tracequilt.plans import queries
from tracequilt.streaming import stateful

N = 5_000


class State:
    """Value or map state that counts its calls."""

    def __init__(self, handle):
        self.handle, self.rows, self.value = handle, {}, None

    def __getattribute__(self, name):
        if name in ("handle", "rows", "value"):
            return object.__getattribute__(self, name)
        self.handle.calls += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]

    def keys(self):
        return iter(list(self.rows))


class Handle:
    """A processor's handle; also the timer values, at an instant after all rows."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getMapState(self, *a, **k):
        return State(self)

    getValueState = getMapState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return 10 * N * 1000


def run(processor, key, frame):
    handle = Handle()
    processor.init(handle)
    list(processor.handleInputRows(key, iter([frame]), handle))
    out = [f for at in sorted(handle.timers) for f in processor.handleExpiredTimer(key, handle, at)]
    return pd.concat(out, ignore_index=True), handle.calls


@pytest.mark.parametrize("processor, key, columns, rows", [
    (lambda: stateful.Cooldown(None), (3,), ["capture_id", "dedupe_key", "cooldown", "as_of_us"], [("c", f"k{i % 7}", "entity", (i + 1) * 1_000_000) for i in range(N)]),
    (lambda: stateful.ExportGate(1, 1, 1, 0), (3,), ["capture_id", "flow", "tick", "packets", "bytes", "bytes_in", "bytes_out"], [("c", f"f{i % 7}", i + 1, 1, 10, 4, 6) for i in range(N)]),
    (stateful.FoldLate, ("c",), ["capture_id", "first_seq", "second", "packets", "bytes"], [("c", i, 100 + i // 2, 1, 10) for i in range(N)]),
    (lambda: stateful.IdleTicks("event", 0), ("c",), ["capture_id", "second", "packets", "bytes", "bytes_in", "bytes_out"], [("c", i + 1, 1, 10, 4, 6) for i in range(N)]),
    (lambda: stateful.AsOf(50_000_000), (3,), ["key", "slot", "at", "number", "id", "value"], [("k", 0, (i + 1) * 1_000_000, i % 2, f"q{i}" if i % 2 else None, None if i % 2 else f"v{i}") for i in range(N)]),
], ids=["cooldown", "export gate", "fold late", "idle ticks", "as of"])
def test_state_calls_do_not_follow_the_rows(processor, key, columns, rows):
    out, calls = run(processor(), key, pd.DataFrame(rows, columns=columns))
    assert calls < 100
    assert len(out) >= N // 2


def test_staged_events_have_as_many_files_as_their_rows_fill(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "FILE_ROWS", 50)
    spark.range(600).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "id % 40 AS user_id", "'view' AS event_type", "1.5D AS value",
        "concat('{\"k\": ', id % 16, '}') AS props",
    ).write.parquet(str(tmp_path / "events.parquet"))
    stream, sizes = queries._event_stream(spark, str(tmp_path)), []
    query = stream.writeStream.foreachBatch(lambda batch, n: sizes.append((batch.select("seq").rdd.getNumPartitions(), {r.seq % 3 for r in batch.select("seq").collect()}, batch.count()))).option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(s, n) for _, s, n in sizes] == [({0}, 200), ({1}, 200), ({2}, 200)]
    assert all(p > 1 for p, _, _ in sizes)


def test_state_partitions_and_staged_files_follow_the_rows(spark, tmp_path, monkeypatch):
    """A state partition costs the same in every micro-batch, with or without rows."""
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    queries._stateful(spark)
    monkeypatch.setattr(queries, "scratch_path", lambda spark, name: str(tmp_path / name))
    runs = spark.range(1, 601).selectExpr("concat('c', id % 3) AS capture_id", "id AS first_seq", "100 + id div 10 AS second", "1L AS packets", "id AS bytes")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        stream, parts = queries._staged(runs, "first_seq * 1000", 50_000, {"capture_id": "''", "first_seq": "{top} div 1000 + 100000", "second": "0", "packets": "0", "bytes": "0"})
        got = queries._drain(stateful.fold_late(stream, 1_000), "fold", parts=parts).where("capture_id <> ''").selectExpr("sum(packets)", "sum(bytes)").first()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "16"
        assert queries._state_parts(spark, 10 ** 9) == 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert tuple(got) == (600, 600 * 601 // 2)
    assert parts == spark.sparkContext.defaultParallelism == 4
    assert len([d for d in (tmp_path / "fold-state" / "state" / "0").iterdir() if d.name.isdigit()]) == parts
    assert len(list((tmp_path / "stream").glob("*.parquet"))) == 4

"""Exact byte ranges of very large pcap files.

A classic pcap file is a chain: record k+1 starts where k ends, and nothing in
the bytes marks a record.  To read one huge file in parallel:

1. Every chunk guesses its first record (a run of plausible headers) and walks
   the headers to the first record past its end.  One task per chunk.
2. A chunk is proven when its start is where the previous chunk ended.  The
   table of chunks (file size / chunk size rows of three numbers) is compared
   on the driver.
3. Disproven chunks are walked again from the proven start, in parallel over
   files, until all agree.

The result is exact whatever the payloads contain; wrong guesses cost time only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession

from . import capture_format as cf
from .pcap import list_captures, open_capture

CHUNK_BYTES = 256 << 20
_SCHEMA = "path string, chunk bigint, start bigint, end bigint"


def _walk_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        rows = []
        for r in frame.itertuples(index=False):
            with open_capture(r.path) as stream:
                header = cf.read_header(stream)
                start = int(r.start)
                if start < 0:
                    guess = cf.sync_point(stream, header, int(r.lo), int(r.hi), int(r.size))
                    # no record starts here as far as we can tell
                    start = int(r.hi) if guess is None else guess
                rows.append((r.path, r.chunk, start, cf.walk(stream, header, start, int(r.hi))))
        yield pd.DataFrame(rows, columns=["path", "chunk", "start", "end"])


def _run(spark: SparkSession, tasks: list[tuple]) -> list:
    frame = spark.createDataFrame(tasks, "path string, size bigint, chunk bigint, lo bigint, hi bigint, start bigint")
    return frame.repartition(max(1, len(tasks)), "path", "chunk").mapInPandas(_walk_chunks, _SCHEMA).collect()


def is_classic(path: str) -> bool:
    with open_capture(path) as stream:
        return cf.read_header(stream) is not None


def index_captures(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> list[tuple[str, int, int]]:
    """Verified (path, start, end) ranges of the classic pcap files larger than a chunk."""
    large = [(p, size) for p, size in list_captures(path) if size > chunk_bytes and is_classic(p)]
    if not large:
        return []
    bounds: dict[str, list[tuple[int, int]]] = {}
    tasks = []
    for name, size in large:
        cuts = list(range(0, size, chunk_bytes)) + [size]
        bounds[name] = list(zip(cuts, cuts[1:]))
        for i, (lo, hi) in enumerate(bounds[name]):
            tasks.append((name, size, i, lo, hi, cf.GLOBAL_HEADER if i == 0 else -1))
    known = {(r.path, r.chunk): (r.start, r.end) for r in _run(spark, tasks)}
    sizes = dict(large)
    while True:
        repair = []
        for name, chunks in bounds.items():
            for i in range(1, len(chunks)):
                proven = known[name, i - 1][1]
                if known[name, i][0] == proven:
                    continue
                if proven >= chunks[i][1]:
                    # the previous record spans this whole chunk
                    known[name, i] = (proven, proven)
                    continue
                repair.append((name, sizes[name], i, *chunks[i], proven))
                break
        if not repair:
            break
        known.update({(r.path, r.chunk): (r.start, r.end) for r in _run(spark, repair)})
    return [
        (name, *known[name, i])
        for name, chunks in bounds.items()
        for i in range(len(chunks))
        if known[name, i][0] < known[name, i][1]
    ]


def write_index(spark: SparkSession, path: str, index_path: str, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Store the ranges for ``spark.read.format('pcap').option('index', ...)``; returns their number."""
    ranges = index_captures(spark, path, chunk_bytes)
    spark.createDataFrame(ranges, "path string, start bigint, end bigint").coalesce(1).write.mode("overwrite").parquet(index_path)
    return len(ranges)

"""``spark.read.format("pcap")`` and ``df.write.format("pcap")``.

Reading: one partition per file, or per verified byte range when an index
(:mod:`capture_index`) is given.  ``seq`` is the record's byte offset: unique,
increasing in arrival order, and known without counting earlier records.
Writing: rows are range-partitioned by (capture, link type, seq), so a giant
capture becomes several files instead of one giant task.
"""

from __future__ import annotations

import io
import os
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .. import schema
from . import capture_format as cf

BATCH_ROWS = 8192
BATCH_BYTES = 16 << 20
ARROW = pa.schema(
    [
        ("capture_id", pa.string()), ("seq", pa.int64()), ("ts_us", pa.int64()), ("captured_len", pa.int64()),
        ("packet_len", pa.int64()), ("link_type", pa.int32()), ("data", pa.binary()),
    ]
)
#: a capture's suffix, with the number that size rotation appends (x.pcap1, x.pcap.002)
CAPTURE_NAME = re.compile(r"\.(pcap|pcapng|cap)(\.?[0-9]+)?$", re.IGNORECASE)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a local path or a URI."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def list_captures(path: str) -> list[tuple[str, int]]:
    """Capture files (path, size) of a file or, recursively, of a folder."""
    fs, inner = filesystem(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = fs.get_file_info(pafs.FileSelector(inner, recursive=True))
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted(
        (prefix + f.path, f.size)
        for f in found
        if f.type == pafs.FileType.File and CAPTURE_NAME.search(f.path)
        and "/_" not in f.path[len(inner):] and "/." not in f.path[len(inner):]
    )


def open_capture(path: str) -> io.BufferedReader:
    fs, inner = filesystem(path)
    return io.BufferedReader(fs.open_input_file(inner), 1 << 20)


@dataclass
class CaptureSplit(InputPartition):
    """A file, or a verified byte range of a classic pcap file."""

    path: str
    start: int | None = None
    end: int | None = None

    def __post_init__(self) -> None:
        super().__init__((self.path, self.start, self.end))


def read_split(split: CaptureSplit, capture_id: str | None, on_truncated: str) -> Iterator[pa.RecordBatch]:
    name = capture_id or f"file:{split.path}"
    with open_capture(split.path) as stream:
        header = cf.read_header(stream)
        if header is None:
            records = cf.pcapng_records(stream, on_truncated)
        else:
            records = cf.pcap_records(stream, header, split.start or cf.GLOBAL_HEADER, split.end, on_truncated)
        rows: list[cf.Record] = []
        held = 0
        for record in records:
            rows.append(record)
            held += record[2]
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield _batch(name, rows)
                rows, held = [], 0
        if rows:
            yield _batch(name, rows)


def _batch(name: str, rows: list[cf.Record]) -> pa.RecordBatch:
    seq, ts_us, captured, original, link, data = zip(*rows)
    columns = [
        pa.array([name] * len(rows), pa.string()), pa.array(seq, pa.int64()), pa.array(ts_us, pa.int64()),
        pa.array(captured, pa.int64()), pa.array(original, pa.int64()), pa.array(link, pa.int32()),
        pa.array(data, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW)


class PcapReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.capture_id = options.get("captureid") or options.get("captureId")
        self.on_truncated = options.get("ontruncated") or options.get("onTruncated") or "fail"
        self.index = options.get("index")

    def partitions(self) -> list[CaptureSplit]:
        ranges: dict[str, list[tuple[int, int]]] = {}
        if self.index:
            import pyarrow.parquet as pq

            fs, inner = filesystem(self.index)
            table = pq.read_table(inner, filesystem=fs).to_pydict()
            for path, start, end in zip(table["path"], table["start"], table["end"]):
                ranges.setdefault(path, []).append((start, end))
        splits = []
        for path, _ in list_captures(self.path):
            for start, end in ranges.get(path, [(None, None)]):
                splits.append(CaptureSplit(path, start, end))
        return splits

    def read(self, partition: CaptureSplit) -> Iterator[pa.RecordBatch]:
        return read_split(partition, self.capture_id, self.on_truncated)


class PcapStreamReader(DataSourceStreamReader):
    """New capture files of a folder, in any order of names and times.

    The offset is the set of files that are there, so a file that comes late
    under a smaller name or with an older time is read like any other. Files moved
    away leave the next offset, which keeps it as small as the folder. A file must
    be complete when it appears (write elsewhere, then rename).
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.on_truncated = options.get("ontruncated") or options.get("onTruncated") or "fail"

    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self) -> dict:
        return {"files": [path for path, _ in list_captures(self.path)]}

    def partitions(self, start: dict, end: dict) -> list[CaptureSplit]:
        read = set(start["files"])
        return [CaptureSplit(path) for path in end["files"] if path not in read]

    def read(self, partition: CaptureSplit) -> Iterator[pa.RecordBatch]:
        return read_split(partition, None, self.on_truncated)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class WrittenFiles(WriterCommitMessage):
    files: list[tuple[str, str]]


class PcapWriter(DataSourceWriter):
    """One file per run of equal (capture_id, link_type); temporary names until commit."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path = options["path"]
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator) -> WrittenFiles:
        fs, inner = filesystem(self.path)
        staging = posixpath.join(inner, f"_staging-{self.job}")
        fs.create_dir(staging, recursive=True)
        files, out, key = [], None, None
        try:
            for row in iterator:
                if (row.capture_id, row.link_type) != key:
                    if out is not None:
                        out.close()
                    key = (row.capture_id, row.link_type)
                    slug = re.sub(r"[^A-Za-z0-9.]+", "_", row.capture_id).strip("_")[-80:]
                    # a digest keeps captures apart whose names differ in other characters only
                    tag = uuid.uuid5(uuid.NAMESPACE_URL, row.capture_id).hex[:8]
                    name = f"{slug}-{tag}-{row.link_type}-{row.seq:020d}.pcap"
                    held = posixpath.join(staging, f"{uuid.uuid4().hex}.pcap")
                    files.append((held, posixpath.join(inner, name)))
                    out = io.BufferedWriter(fs.open_output_stream(held), 1 << 20)
                    out.write(cf.pcap_file_header(row.link_type))
                out.write(cf.pcap_record(row.ts_us, row.packet_len, bytes(row.data or b"")))
        finally:
            if out is not None:
                out.close()
        return WrittenFiles(files)

    def commit(self, messages: list[WrittenFiles | None]) -> None:
        fs, inner = filesystem(self.path)
        if self.overwrite:
            kept = {held for m in messages if m for held, _ in m.files}
            for info in fs.get_file_info(pafs.FileSelector(inner, recursive=False, allow_not_found=True)):
                if info.type == pafs.FileType.File and info.path.endswith(".pcap") and info.path not in kept:
                    fs.delete_file(info.path)
        fs.create_dir(inner, recursive=True)
        for message in messages:
            for held, final in message.files if message else []:
                fs.move(held, final)
        self._drop_staging()

    def abort(self, messages: list[WrittenFiles | None]) -> None:
        self._drop_staging()

    def _drop_staging(self) -> None:
        fs, inner = filesystem(self.path)
        staging = posixpath.join(inner, f"_staging-{self.job}")
        if fs.get_file_info(staging).type == pafs.FileType.Directory:
            fs.delete_dir(staging)


class PcapDataSource(DataSource):
    """Options: ``path``, ``captureId``, ``onTruncated`` (fail | stop), ``index``."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> StructType:
        return schema.FRAMES

    def reader(self, schema: StructType) -> PcapReader:
        return PcapReader(dict(self.options))

    def streamReader(self, schema: StructType) -> PcapStreamReader:
        return PcapStreamReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> PcapWriter:
        return PcapWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapDataSource)


def read_captures(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Frames of a capture file or folder (pcap and pcapng)."""
    register(spark)
    return spark.read.format("pcap").options(**options).load(path)


def write_captures(frames: DataFrame, path: str, mode: str = "append", allow_mixed: bool = True) -> None:
    """Write frames as classic pcap files, one or more per (capture, link type).

    Classic pcap has one link type per file, so a mixed capture is split by link
    type; ``allow_mixed=False`` refuses such captures instead.
    """
    register(frames.sparkSession)
    if not allow_mixed:
        # fails the job inside the writing tasks' input, without a driver-side loop
        mixed = frames.groupBy("capture_id").agg(F.count_distinct("link_type").alias("_n")).where("_n > 1")
        if mixed.limit(1).count():
            raise ValueError("a capture with mixed link types cannot be written as one classic pcap")
    order = ["capture_id", "link_type", "seq"]
    ordered = frames.select(*[f.name for f in schema.FRAMES.fields]).repartitionByRange(*order)
    ordered.sortWithinPartitions(*order).write.format("pcap").mode(mode).save(path)

"""Token-id files: one id array per shard, document boundaries and ids in Elias-Fano code.

Documents go to shards by ranges of doc_id, so shards in name order hold all
documents in ascending order. A shard is written by one task through a file of
its own name; the manifest names the files of the tasks that succeeded, so what a
lost executor left half-written is never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracequilt.llm.common import keyed_text, range_bounds, range_of, shuffle_partitions
from tracequilt.llm.elias_fano import EliasFano
from tracequilt.llm.tokens import encoder, slices
from tracequilt.runtime import materialize, scratch_path

MAGIC = b"TQIDS001"
#: magic, documents without id, first doc_id, width of a token id, ids in all
HEAD = struct.Struct("<8sQqQQ")
SHARD_TOKENS = 8_000_000


class TokenShard:
    """A shard in memory: ids of any document by select, without a table of offsets."""

    def __init__(self, data: bytes | memoryview) -> None:
        magic, self.no_id, self.first, width, self.n_tokens = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        view = memoryview(data)
        self.ends = EliasFano(view[HEAD.size :])
        self.keys = EliasFano(view[HEAD.size + self.ends.nbytes :])
        self.ids = np.frombuffer(data, f"<u{width}", self.n_tokens, HEAD.size + self.ends.nbytes + self.keys.nbytes)

    @staticmethod
    def encode(doc_ids: list[int | None], arrays: list[np.ndarray], width: int = 4) -> bytes:
        """``doc_ids`` ascending, those without id first."""
        known = np.array([d for d in doc_ids if d is not None], np.int64)
        first = int(known[0]) if len(known) else 0
        ends = np.cumsum([len(a) for a in arrays])
        steps = (known - first).view(np.uint64) if len(known) else np.zeros(0, np.uint64)
        return b"".join([
            HEAD.pack(MAGIC, len(doc_ids) - len(known), first, width, int(ends[-1]) if len(ends) else 0),
            EliasFano.encode(ends), EliasFano.encode(steps), *(a.astype(f"<u{width}").tobytes() for a in arrays),
        ])

    def __len__(self) -> int:
        return self.ends.n

    def offset(self, i: int) -> int:
        return self.ends.select(i - 1) if i else 0

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.offset(i) : self.ends.select(i)]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.no_id else self.first + self.keys.select(i - self.no_id)


def _encoded(docs: DataFrame, tokenizer: str, end: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for whole in batches:
            for batch in slices(whole, 512):
                ids = [np.append(a, np.uint32(end)).astype(f"<u{width}").tobytes() for a in encode(batch["text"].to_pylist())]
                yield pa.record_batch({"doc_id": batch["doc_id"], "part": batch["part"], "ids": pa.array(ids, pa.binary())})

    return docs.mapInArrow(run, "doc_id long, part int, ids binary")


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end: int = 0, shard_tokens: int = SHARD_TOKENS, width: int = 2
) -> DataFrame:
    """Writes all documents, closed by ``end``, under ``folder``; returns the manifest: part, sub, file, n_docs, n_tokens.

    Null text is empty (the end id alone); rows without id come first; rows with
    the same id stand side by side. ``width`` is the bytes of a stored id (2 holds
    vocabularies up to 65,536). A shard is closed at ``shard_tokens``, so a task
    holds one shard and one batch whatever a range holds.
    """
    parts = shuffle_partitions(docs.sparkSession)
    keyed = keyed_text(docs)
    bounds = range_bounds(keyed.select("doc_id"), "doc_id", parts)
    ranged = _encoded(keyed.withColumn("part", range_of("doc_id", bounds)), tokenizer, end, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        keys: list = []
        arrays: list[np.ndarray] = []
        at, sub, held = -1, 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            name = f"{at:07d}-{sub:05d}-{uuid.uuid4().hex}.ids"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(TokenShard.encode(keys, arrays, width))
            row = {"part": at, "sub": sub, "file": name, "n_docs": len(keys), "n_tokens": held}
            yield pa.RecordBatch.from_pylist([row], pa.schema([
                ("part", pa.int32()), ("sub", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        store.create_dir(root, recursive=True)
        for batch in batches:
            for part, key, raw in zip(batch["part"].to_pylist(), batch["doc_id"].to_pylist(), batch["ids"]):
                if keys and (part != at or held >= shard_tokens):
                    yield from close()
                    sub = sub + 1 if part == at else 0
                    keys, arrays, held = [], [], 0
                elif part != at:
                    sub = 0
                at = part
                keys.append(key)
                arrays.append(np.frombuffer(raw.as_buffer(), f"<u{width}").copy())
                held += len(arrays[-1])
        if keys:
            yield from close()

    dealt = ranged.repartition(parts, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"))
    return materialize(dealt.mapInArrow(run, "part int, sub int, file string, n_docs long, n_tokens long"), "manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files.

    The running total is over one thin row per file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                shard = TokenShard(content.as_buffer())
                ends = shard.ends.to_array().astype(np.int64)
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)[: len(ends)]
                crc = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                known = (shard.keys.to_array().view(np.int64) + shard.first).tolist()
                yield pa.record_batch({
                    "file": pa.array([path.rsplit("/", 1)[-1]] * len(ends)),
                    "doc_id": pa.array([None] * shard.no_id + known, pa.int64()), "within": pa.array(starts),
                    "n_tokens": pa.array(ends - starts), "ids_crc32": pa.array(crc, pa.int64()),
                })

    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    first = manifest.select(
        "file", (F.sum("n_tokens").over(Window.orderBy("part", "sub")) - F.col("n_tokens")).alias("first")
    )
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    rows = files.select("path", "content").mapInArrow(run, "file string, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(first, "file").select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes all documents to fresh files in the shared folder and reads them back."""
    folder = scratch_path(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, folder, tokenizer, end, shard_tokens)
    return read_token_files(docs.sparkSession, folder, manifest)

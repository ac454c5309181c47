"""Best-fit-decreasing packing of token documents into windows of fixed length.

Which window a piece goes to depends on the multiset of piece lengths alone: at
most ``window`` different lengths, however many documents there are. So the jobs
count pieces per length; best fit runs once over that histogram, moving whole
runs of equal windows at a time; and each piece finds its window by its rank
among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequilt.llm.common import keyed_text, shuffle_partitions
from tracequilt.llm.tokens import encoder, slices
from tracequilt.runtime import materialize

WINDOW = 2048
END = 1


def pieces(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, with_ids: bool = False, shard: Column | None = None
) -> DataFrame:
    """Every document's ids, closed by ``end``, cut into full windows and one rest.

    Returns doc_id, start, length, ids_crc32, doc_tokens, and the ids themselves
    (32-bit little-endian) if asked for; with ``shard`` (a whole number per
    document) that number as well. An empty or null text is the end id
    alone; null ids and repeated rows are documents like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for whole in batches:
            for batch in slices(whole, 512):
                out = {"doc": [], "start": [], "length": [], "crc": [], "total": [], "ids": []}
                for row, ids in enumerate(encode(batch["text"].to_pylist())):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for start in range(0, len(ids), window):
                        raw = ids[start : start + window].tobytes()
                        out["doc"].append(row)
                        out["start"].append(start)
                        out["length"].append(len(raw) // 4)
                        out["crc"].append(zlib.crc32(raw))
                        out["total"].append(len(ids))
                        if with_ids:
                            out["ids"].append(raw)
                made = {name: batch[name].take(pa.array(out["doc"], pa.int64())) for name in batch.schema.names if name != "text"}
                for name, key in (("start", "start"), ("length", "length"), ("ids_crc32", "crc"), ("doc_tokens", "total")):
                    made[name] = pa.array(out[key], pa.int64())
                if with_ids:
                    made["ids"] = pa.array(out["ids"], pa.binary())
                yield pa.record_batch(made)

    fields = ["doc_id long", *(["shard int"] if shard is not None else []), "start long", "length long", "ids_crc32 long", "doc_tokens long"]
    more = () if shard is None else (shard.cast("int").alias("shard"),)
    return keyed_text(docs, *more).mapInArrow(run, ", ".join(fields + ["ids binary"] * with_ids))


class CapacityTree:
    """A segment tree over remaining capacities that finds the tightest open one."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, capacity: int, is_open: bool) -> None:
        node = capacity + self.size
        self.any[node] = is_open
        while node > 1:
            node >>= 1
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity that is at least ``least``."""
        node = least + self.size
        if self.any[node]:
            return least
        while node > 1:
            if not node & 1 and self.any[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


@dataclass(frozen=True)
class Lot:
    """Pieces ``first <= rank < last`` of a length: ``each`` of them to a window, from ``sequence`` on, at ``offset``."""

    length: int
    first: int
    last: int
    sequence: int
    each: int
    offset: int


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> list[Lot]:
    """Best-fit decreasing over a histogram of piece lengths.

    Longest first, each piece goes to the open window with the least sufficient
    capacity, else to a new one. Once a window with capacity r takes a piece of
    length L <= r, it is the tightest for the next such piece while it fits, so a
    window takes floor(r / L) of them and is left with r mod L < r / 2. A run of
    equal windows is therefore touched at most log2(window) times, and a length
    makes at most three runs: the result has some 100,000 lots at most with
    windows of 2048, whatever the number of pieces.
    """
    tree = CapacityTree(window)
    runs: dict[int, list[tuple[int, int]]] = {}
    lots: list[Lot] = []
    sequences = 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            runs.setdefault(capacity, []).append((first, n))
            tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity = window
                first, n = sequences, -(-left // (window // length))
                sequences += n
            else:
                first, n = runs[capacity].pop()
                if not runs[capacity]:
                    tree.set(capacity, False)
            each = capacity // length
            full = min(n, left // each)
            if full:
                lots.append(Lot(length, rank, rank + full * each, first, each, window - capacity))
                put(capacity - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:
                lots.append(Lot(length, rank, rank + left, first + full, left, window - capacity))
                put(capacity - left * length, first + full, 1)
                full, left = full + 1, 0
            put(capacity, first + full, n - full)
    return lots


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (doc_id, start, length, ...); all columns stay.

    ``cut`` must be a stored table, as it is read twice. Ranks are counted per
    length and hash bucket, so a length that most pieces have is spread over all
    partitions. The driver gets one row per length. An empty table stays empty.
    """
    buckets = shuffle_partitions(cut.sparkSession)
    keyed = cut.withColumn("_bucket", F.expr(f"pmod(xxhash64(doc_id, start), {buckets})"))
    counted = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `window` rows
    if any(not 1 <= length <= window for length in counts):
        raise ValueError(f"pieces must have 1 to {window} ids")
    before = counted.select(
        F.col("length").alias("_length"), F.col("_bucket").alias("_in"),
        (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"),
    )
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start")
    ranked = (
        keyed.withColumn("_row", F.row_number().over(order))
        .join(before, (F.col("length") == F.col("_length")) & (F.col("_bucket") == F.col("_in")))
        .withColumn("_rank", F.col("_before") + F.col("_row") - 1)
        .select(*cut.columns, "_rank")
    )
    table = _place(best_fit_decreasing(counts, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = _assign(table, batch["length"].to_numpy(), batch["_rank"].to_numpy())
            made = {name: batch[name] for name in batch.schema.names if name != "_rank"}
            yield pa.record_batch(made | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def _place(lots: list[Lot]) -> np.ndarray:
    table = np.array([(x.length, x.first, x.sequence, x.each, x.offset) for x in lots], np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def _assign(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank."""
    # One sortable number of a length and a rank: ranks stay under 2 ** 48.
    keys = (table[:, 0] << 48) + table[:, 1]
    lot = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
    place, each = rank - lot[:, 1], np.maximum(lot[:, 3], 1)
    return lot[:, 2] + place // each, lot[:, 4] + place % each * length


def pack_in_order(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Like :func:`pack`, but each ``shard`` by itself, in the order of the shards.

    Sequences of a smaller shard come before those of a larger one, so the order
    of the documents lives on in the order of ``sequence_id``. A shard is one
    part file of documents, hence one task's thin rows here.
    """

    def run(group: pa.Table) -> pa.Table:
        length, start = group["length"].to_numpy(), group["start"].to_numpy()
        doc = group["doc_id"].combine_chunks().fill_null(-(1 << 63)).to_numpy()
        order = np.lexsort((start, doc, length))
        values, first, counts = np.unique(length[order], return_index=True, return_counts=True)
        rank = np.empty(len(length), np.int64)
        rank[order] = np.arange(len(length)) - np.repeat(first, counts)
        lots = best_fit_decreasing(dict(zip(values.tolist(), counts.tolist())), window)
        sequence, offset = _assign(_place(lots), length, rank)
        base = group["shard"][0].as_py() << 32
        kept = [n for n in group.column_names if n != "shard"]
        return pa.table({n: group[n] for n in kept} | {"sequence_id": pa.array(base + sequence), "offset": pa.array(offset)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name != "shard")
    return cut.groupBy("shard").applyInArrow(run, f"{fields}, sequence_id long, offset long")


def file_number(docs: DataFrame) -> Column:
    """The number of the part file that a document was read from; 0 where rows are from no file."""
    try:
        docs.select("_metadata.file_name")
    except AnalysisException:
        return F.lit(0)
    return F.coalesce(F.expr("try_cast(regexp_extract(_metadata.file_name, 'part-([0-9]+)', 1) AS INT)"), F.lit(0))


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """The piece table of all documents with its places; see :func:`pieces` and :func:`pack`."""
    return pack(materialize(pieces(docs, tokenizer, window, end), "pieces"), window)


def pack_files(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """The same for documents whose part files are in an order that the sequences are to keep."""
    return pack_in_order(pieces(docs, tokenizer, window, end, shard=file_number(docs)), window)


def sequences(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, pad: int = 0) -> DataFrame:
    """The packed windows themselves: ``sequence_id``, ``n_ids`` and ``ids`` padded to the window with ``pad``.

    A sequence is at most one window of ids, so the groups are bounded.
    """
    packed = pack(materialize(pieces(docs, tokenizer, window, end, with_ids=True), "pieces"), window)
    gathered = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_ids"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parts in batch["parts"].to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4")
                rows.append(np.concatenate((ids, np.full(window - len(ids), pad, np.uint32))).astype(np.int32))
            yield pa.record_batch({
                "sequence_id": batch["sequence_id"], "n_ids": batch["n_ids"], "ids": pa.array(rows, pa.list_(pa.int32())),
            })

    return gathered.mapInArrow(run, "sequence_id long, n_ids long, ids array<int>")

"""Removal of long repeated byte strings with a logarithmic family of suffix indexes.

A level is a sparse suffix array of many documents: every start of a string of
``length`` bytes belongs to the anchor of that string (the leftmost window of
least hash in it), and the starts of one anchor in a row make one entry. Equal
strings have the same anchor at the same place, so their entries meet when
entries are ordered by anchor, then by content. A new batch is ordered likewise
and merge-scanned against the levels; where a level of the same size class is
there, the scan's output is the next larger level, so an entry is rewritten as
many times as the logarithm of the number of batches.

Neighbours in the merged order decide nearly everything: entries of equal content
are repeats from end to end. Entries that share an anchor but not their content
overlap in part; their bytes are fetched and their suffixes sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequilt.llm.common import keyed_text
from tracequilt.llm.tokens import slices
from tracequilt.runtime import materialize

LENGTH = 200
#: Bytes of an anchor; the others of a string's bytes are places to choose from.
ANCHOR = 41
#: Starts that are anchored in one go: a longer text is read in overlapping stretches.
STRETCH = 1 << 19
#: Entries of one anchor whose suffixes are sorted in memory, some 350 bytes each; more go on as digests, sorted by Spark.
GROUP = 16_384
FACTOR = 0x9E3779B97F4A7C15 | 5
_UNIT = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(which: int, n: int) -> np.ndarray:
    """Powers of the factor (0) or of its inverse modulo 2 ** 64 (1), up to exponent n."""
    base = FACTOR if which == 0 else pow(FACTOR, -1, 1 << 64)
    while len(_powers[which]) <= n:
        have = _powers[which]
        _powers[which] = np.concatenate((have, have * np.uint64(pow(base, len(have), 1 << 64))))
    return _powers[which]


def anchored(data: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Entries of one text: anchor hash, first start, number of starts, and the anchor's distance from the first start."""
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    found = [_stretch(data[at : at + STRETCH + length - 1], at, length, anchor) for at in range(0, len(data) - length + 1, STRETCH)]
    return tuple(np.concatenate(c) for c in zip(*found))


def _stretch(data: bytes, at: int, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    codes = np.frombuffer(data, np.uint8)
    n, width = len(codes), length - anchor + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_UNIT[codes] * _power(0, n)[:n], out=sums[1:])
    grams = (sums[anchor:] - sums[:-anchor]) * _power(1, n)[: n - anchor + 1]
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0x94D049BB133111EB)
    grams ^= grams >> np.uint64(29)
    # The order of a hash's upper bits, then of place: a window's least is its leftmost. A stretch has under 2 ** 20 places.
    low = (grams & ~np.uint64((1 << 20) - 1)) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    place = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    count = np.diff(np.concatenate((first, [len(place)])))
    here = place[first]
    return grams[here].view(np.int64), first + at, count, here - first


#: h: anchor hash, g: content hash, key: document, place: first start, number of starts and anchor distance in one number;
#: done: the entry's own range is reported already. With ``b`` set a row is a report instead: bytes place to b of a document.
ENTRY = "h long, g long, key long, place long, done boolean, b long"


def _unpack(place):
    return place >> 16, place >> 8 & 255, place & 255


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a 64-bit key of both: rows alike in both share it, and their results."""
    return keyed_text(docs).withColumn("key", F.xxhash64("doc_id", "text"))


def entries(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """The entries of a batch, in runs sorted by anchor and content.

    Equal entries of one run are reported where they are and leave as one, so
    copies and periodic texts reach the shuffle as one row per run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for whole in batches:
            for batch in slices(whole, 1024):
                hs, gs, keys, places = [], [], [], []
                for key, text in zip(batch["key"].to_pylist(), batch["text"]):
                    data = text.as_py().encode()
                    h, first, count, away = anchored(data, length, anchor)
                    ends = (first + count + (length - 1)).tolist()
                    gs.append(np.fromiter((digest(data[a:b]) for a, b in zip(first.tolist(), ends)), np.uint64, len(h)).view(np.int64))
                    hs.append(h)
                    keys.append(np.full(len(h), key, np.int64))
                    places.append(first << 16 | count << 8 | away)
                yield _run(*(np.concatenate(x) for x in (hs, gs, keys, places)), length)

    return docs.select("key", "text").mapInArrow(run, ENTRY)


def _run(h, g, key, place, length: int) -> pa.RecordBatch:
    order = np.lexsort((g, h))
    h, g, key, place = h[order], g[order], key[order], place[order]
    equal = np.concatenate(([False], (h[1:] == h[:-1]) & (g[1:] == g[:-1]), [False])) if len(h) else np.zeros(1, bool)
    twice = equal[:-1] | equal[1:]
    leaves = ~equal[:-1]
    # The ranges of all repeated entries, united per document: they ascend with their starts.
    first, count, _ = _unpack(place[twice])
    owner, end = key[twice], first + count + (length - 1)
    by = np.lexsort((first, owner))
    owner, first, end = owner[by], first[by], end[by]
    opens = np.concatenate(([True], (owner[1:] != owner[:-1]) | (first[1:] > end[:-1]))) if len(by) else np.zeros(0, bool)
    closes = np.concatenate((opens[1:], [True])) if len(by) else opens
    owner, first, end = owner[opens], first[opens], end[closes]
    n, m = int(leaves.sum()), len(owner)
    return pa.record_batch({
        # A report goes where its document's key sends it.
        "h": np.concatenate((h[leaves], owner)), "g": np.concatenate((g[leaves], np.zeros(m, np.int64))),
        "key": np.concatenate((key[leaves], owner)), "place": np.concatenate((place[leaves], first)),
        "done": np.concatenate((twice[leaves], np.ones(m, bool))),
        "b": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(end)]),
    })


SCANNED = ENTRY + ", fresh boolean, lone boolean, beside boolean"


def _scan(keep: bool):
    """Over entries sorted by (h, g): what each is to the one before and the one after it.

    ``fresh``: the content occurs again and was not known to; ``lone``: it does
    not, but other content has its anchor; ``beside``: it occurs again and other
    content has its anchor. Nothing but one row is held, however often an entry occurs.
    """

    def judge(h, g, key, place, done, first: int, last: int) -> pa.RecordBatch:
        """Rows first..last; those just outside are there to compare with."""
        anchor = np.concatenate(([False], h[1:] == h[:-1], [False]))
        content = anchor & np.concatenate(([False], g[1:] == g[:-1], [False]))
        whole = content[:-1] | content[1:] | done
        lone = ~whole & (anchor[:-1] | anchor[1:])
        beside = whole & ((anchor[:-1] & ~content[:-1]) | (anchor[1:] & ~content[1:]))
        fresh = whole & ~done
        pick = np.zeros(len(h), bool)
        pick[first:last] = True
        if not keep:
            pick &= fresh | lone | beside
        made = dict(h=h, g=g, key=key, place=place, done=whole)
        flags = dict(fresh=fresh, lone=lone, beside=beside)
        n = int(pick.sum())
        return pa.record_batch({k: c[pick] for k, c in made.items()} | {"b": pa.nulls(n, pa.int64())} | {k: c[pick] for k, c in flags.items()})

    def passed(batch: pa.RecordBatch) -> pa.RecordBatch:
        no = pa.array(np.zeros(batch.num_rows, bool))
        return pa.record_batch({c: batch[c] for c in batch.schema.names} | {"fresh": no, "lone": no, "beside": no})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = None, 0  # at most two rows: the last one, and the one before it to compare with
        for batch in batches:
            # Reports come last in a partition and go through as they are.
            n = batch["b"].null_count
            if n < batch.num_rows:
                yield passed(batch.slice(n))
                batch = batch.slice(0, n)
            if not n:
                continue
            columns = [batch[name].to_numpy(zero_copy_only=False) for name in ("h", "g", "key", "place", "done")]
            if held is not None:
                columns = [np.concatenate((a, b)) for a, b in zip(held, columns)]
            n = len(columns[0])
            yield judge(*columns, seen, n - 1)
            held = [c[-2:] for c in columns]
            seen = len(held[0]) - 1
        if held is not None:
            yield judge(*held, seen, len(held[0]))

    return run


class SuffixLevels:
    """The family of levels: add batches, then ask which bytes repeat."""

    def __init__(self, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP) -> None:
        self.length, self.anchor, self.group = length, anchor, group
        self.levels: dict[int, DataFrame] = {}
        self.found: list[DataFrame] = []
        self.batches: list[DataFrame] = []

    def add(self, docs: DataFrame) -> None:
        """Takes in a batch of :func:`keyed` documents."""
        self.batches.append(docs)
        batch = entries(docs, self.length, self.anchor)
        above = [level for size, level in sorted(self.levels.items())]
        merged, size = [], 0
        while size in self.levels:
            merged.append(self.levels.pop(size))
            size += 1
        # Levels of the classes that are full become one with the batch, in the pass that looks for matches.
        level = self._pass([batch, *merged], keep=True)
        self.levels[size] = level.where("b IS NULL")
        self.found.append(level)
        for other in above[len(merged):]:
            self.found.append(self._pass([batch, other], keep=False))

    def _pass(self, tables: list[DataFrame], keep: bool) -> DataFrame:
        rows = reduce(DataFrame.unionByName, [t.select("h", "g", "key", "place", "done", "b") for t in tables])
        ordered = rows.repartition("h").sortWithinPartitions(F.asc_nulls_first("b"), "h", "g")
        return materialize(ordered.mapInArrow(_scan(keep), SCANNED), "suffix-level")

    def repeats(self) -> DataFrame:
        """key, a, b: byte ranges that are covered by repeated strings, overlapping and repeated ones included."""
        scanned = reduce(DataFrame.unionByName, self.found)
        whole = scanned.where("fresh").selectExpr(
            "key", "shiftright(place, 16) AS a", f"shiftright(place, 16) + (shiftright(place, 8) & 255L) + {self.length - 1}L AS b"
        )
        reported = scanned.where("b IS NOT NULL").select("key", F.col("place").alias("a"), "b")
        return whole.unionByName(reported).unionByName(self._overlaps(scanned.where("lone OR beside").select("h", "g", "key", "place", "lone")))

    def _overlaps(self, parts: DataFrame) -> DataFrame:
        """Ranges of entries that share an anchor with other content: the suffixes of each such group are sorted."""
        length = self.length
        docs = reduce(DataFrame.unionByName, self.batches)
        wanted = parts.distinct().groupBy("key").agg(F.collect_list(F.struct("h", "place", "lone")).alias("wanted"))

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, 256):
                    rows = []
                    for key, text, wanted in zip(batch["key"].to_pylist(), batch["text"], batch["wanted"].to_pylist()):
                        data = text.as_py().encode()
                        for w in wanted:
                            first, count, away = _unpack(w["place"])
                            rows.append((w["h"], key, first, w["lone"], data[first : first + count + length - 1], away))
                    columns = list(zip(*rows)) or [()] * 6
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["h", "key", "first", "lone", "data", "away"])

        pieces = docs.join(wanted, "key").select("key", "text", "wanted").mapInArrow(fetch, "h long, key long, first long, lone boolean, data binary, away long")
        sorted_pieces = pieces.repartition("h").sortWithinPartitions("h")
        out = materialize(sorted_pieces.mapInArrow(_sort_suffixes(length, self.group), "key long, a long, b long, digest binary, lone boolean"), "overlaps")
        ranges = out.where("digest IS NULL").select("key", "a", "b")
        large = out.where("digest IS NOT NULL").repartition("digest").sortWithinPartitions("digest")
        return ranges.unionByName(large.mapInArrow(_equal_neighbours, "key long, a long, b long"))


def _equal_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by digest: the ranges of lone pieces whose digest the row before or after has too."""
    held = None  # the last row, and whether the one before it had its digest
    for batch in batches:
        out = []
        for row in zip(*(batch[c].to_pylist() for c in ("digest", "lone", "key", "a", "b"))):
            same = held is not None and held[0][0] == row[0]
            if held is not None and held[0][1] and (held[1] or same):
                out.append(held[0][2:])
            held = (row, same)
        yield _ranges(out)
    yield _ranges([held[0][2:]] if held is not None and held[0][1] and held[1] else [])


def _ranges(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["key", "a", "b"])


def _sort_suffixes(length: int, limit: int):
    """Over pieces sorted by anchor: starts of lone pieces whose string is also in another piece.

    Small groups are sorted together, since strings of different anchors differ.
    A group over the limit is passed on as one digest per string while it streams by.
    """
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("digest", pa.binary()), ("lone", pa.bool_())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 5
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def suffix_sort(pieces: list[tuple]) -> list[tuple]:
        # Equal strings lie at the same distance from their anchor, so the array is sorted one distance at a time.
        same = [np.zeros(len(p[3]) - length + 1, np.int8) for p in pieces]
        by_distance: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            for start in range(len(same[i])):
                by_distance.setdefault(p[4] - start, []).append(i)
        for distance, members in by_distance.items():
            at = lambda i: pieces[i][4] - distance  # noqa: B023, E731
            order = sorted((pieces[i][3][at(i) : at(i) + length], i) for i in members)
            for (x, i), (y, j) in zip(order, order[1:]):
                if x == y:
                    same[i][at(i)] = same[j][at(j)] = 1
        out = []
        for (key, first, lone, _, _), mine in zip(pieces, same):
            if lone:
                edges = np.flatnonzero(np.diff(np.concatenate(([0], mine, [0]))))
                out += [(key, first + x, first + y - 1 + length, None, True) for x, y in edges.reshape(-1, 2).tolist()]
        return out

    def digests(pieces: list[tuple]) -> list[tuple]:
        return [
            (key, first + i, first + i + length, xxhash.xxh3_128_digest(data[i : i + length]), lone)
            for key, first, lone, data, _ in pieces for i in range(len(data) - length + 1)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []  # pieces of finished groups
        group: list[tuple] = []
        at, over = None, False
        for batch in batches:
            for h, key, first, lone, data, away in zip(*(batch[c].to_pylist() for c in ("h", "key", "first", "lone", "data", "away"))):
                if h != at:
                    if over and group:
                        yield table(digests(group))
                    ready += [] if over else group
                    group, at, over = [], h, False
                    if len(ready) >= 1024:
                        yield table(suffix_sort(ready))
                        ready = []
                group.append((key, first, lone, data, away))
                if len(group) > limit or over and len(group) >= 256:
                    yield table(digests(group))
                    group, over = [], True
            if over and group:
                yield table(digests(group))
                group = []
        ready += group
        if ready:
            yield table(suffix_sort(ready))

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def union_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by the ranges: those that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_ranges(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in runs)]
    starts = [*(a for a, _ in runs), len(data)]
    return b"".join(data[a:b] for a, b in zip(ends, starts))


def remove_repeats(batches: list[DataFrame], length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """What is left of every document without the bytes of repeated strings; see ``RESULT``.

    Every byte covered by a ``length``-byte string that also starts elsewhere in
    any batch, the same document included, is removed. Null text is empty; rows
    without id and repeated rows are documents like any other (a repeated row
    repeats all its strings); other columns are ignored; shorter texts stay whole.
    """
    index = SuffixLevels(length, anchor, group)
    batches = [keyed(b) for b in batches]
    for batch in batches:
        index.add(batch)
    ranges = index.repeats().groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in slices(whole, 512):
                out = []
                for key, text, ranges in zip(batch["doc_id"].to_pylist(), batch["text"], batch["ranges"].to_pylist()):
                    data = text.as_py().encode()
                    runs = union_ranges([(r["a"], r["b"]) for r in ranges or ()])
                    left = without_ranges(data, runs) if runs else data
                    out.append((key, len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
                columns = list(zip(*out)) or [()] * 5
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in RESULT.split(", ")])

    docs = reduce(DataFrame.unionByName, batches)
    return docs.join(ranges, "key", "left").select("doc_id", "text", "ranges").mapInArrow(run, RESULT)


def hash_batches(docs: DataFrame, n: int) -> list[DataFrame]:
    """All rows in ``n`` batches of like size, as if they had arrived one after another."""
    return [docs.where(F.expr(f"pmod(xxhash64(doc_id), {n}) = {i}")) for i in range(n)]

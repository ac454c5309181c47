"""Suffix arrays over the training documents, searched with every suffix of a benchmark.

Documents become runs of words; a task gathers them into shards of at most
``SHARD`` words and builds a suffix array over each, so nothing is shuffled. All
suffixes of all benchmark items are searched together in every shard, one word of
the search at a time: the range of array entries that share the words so far
narrows until it is empty, which gives the longest verbatim match of the suffix
and where it lies. Where it first spans a window, the range lists every occurrence
of that window in the shard.

A benchmark goes to the tasks in blocks of at most ``TEST_BYTES`` of text, one
pass over the documents for each, so what is broadcast does not grow with it.

Null text has no words. A document longer than a shard is cut into pieces that
overlap by the longest item, and its findings are joined in the task. Repeated rows
have a result each. An item without words finds nothing; one without item_id marks
words but is not listed; rows with the same item_id are one item. Empty tables
give no rows, or documents without findings. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequilt.llm.common import keyed_text
from tracequilt.runtime import materialize

WINDOW = 10
SHARD = 1 << 20
TEST_BYTES = 16 << 20
#: Places looked at in one go when the documents of a frequent window are listed.
SLICE = 1 << 20
#: A-Z to a-z; all bytes below 0x80 but digits and letters to blanks.
WORDS = bytes(ord(chr(b).lower()) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(128)) + bytes(range(128, 256))
#: Ends a document; words count from 1.
END = 0


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORDS).split()


class Numbers(dict):
    """Numbers words as they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes in the order of their first ``depth`` words, by doubling.

    Each round sorts only the places that still share a rank.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    rank, slots = np.empty(n, np.int64), np.arange(n)
    first = ids[order]
    new = np.concatenate(([True], first[1:] != first[:-1]))
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
    # The order behind the end of a document is of no use.
    left, reach = slots[~(new & np.concatenate((new[1:], [True]))) & (first != END)], 1
    while len(left) and reach < depth:
        at = order[left]
        beyond = at + reach
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)], -1)
        key = rank[at] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[left] = at
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = np.maximum.accumulate(np.where(new, left, 0))
        left, reach = left[~(new & np.concatenate((new[1:], [True])))], 2 * reach
    return order


def _bound(ids: np.ndarray, order: np.ndarray, ahead: int, lo: np.ndarray, hi: np.ndarray, word: np.ndarray) -> np.ndarray:
    """First entry of each range whose word ``ahead`` is not below ``word``."""
    lo, hi, last = lo.copy(), hi.copy(), len(order) - 1
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        below = open_ & (ids[np.minimum(order[np.minimum(mid, last)] + ahead, last)] < word)
        lo = np.where(below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)


def search(ids: np.ndarray, order: np.ndarray, test: np.ndarray, left: np.ndarray, window: np.ndarray):
    """Search all suffixes of ``test`` (words, with ``left`` words of the item from each on).

    Gives, per suffix, the length of its longest match and one place of it (the
    range's first entry), and the range of entries that share ``window`` words with
    it (empty where none do, or where window is 0).
    """
    m, n = len(test), len(order)
    longest, place = np.zeros(m, np.int64), np.zeros(m, np.int64)
    low, high = np.zeros(m, np.int64), np.zeros(m, np.int64)
    at, lo, hi, ahead = np.arange(m), np.zeros(m, np.int64), np.full(m, n), 0
    while len(at):
        word = test[at + ahead]
        lo, hi = _bound(ids, order, ahead, lo, hi, word), _bound(ids, order, ahead, lo, hi, word + 1)
        hit = (lo < hi) & (word > END)
        at, lo, hi = at[hit], lo[hit], hi[hit]
        ahead += 1
        longest[at], place[at] = ahead, order[lo]
        full = window[at] == ahead
        low[at[full]], high[at[full]] = lo[full], hi[full]
        more = left[at] > ahead
        at, lo, hi = at[more], lo[more], hi[more]
    return longest, place, low, high


class Tests:
    """Words of a block of benchmark items, as one run."""

    def __init__(self, items: list[tuple[int | None, str]], window: int) -> None:
        runs = [words_of(text or "") for _, text in items]
        sizes = np.array([len(r) for r in runs], np.int64)
        self.ids = [i for i, _ in items]
        self.words = [w for r in runs for w in r]
        self.item = np.repeat(np.arange(len(runs)), sizes)
        begins = np.cumsum(sizes) - sizes
        self.start = np.arange(len(self.words)) - begins[self.item] if len(self.words) else np.zeros(0, np.int64)
        whole = sizes[self.item] if len(self.words) else np.zeros(0, np.int64)
        self.left = whole - self.start
        size = np.minimum(whole, window)
        self.window = np.where(self.left >= size, size, 0)
        self.deepest = int(sizes.max(initial=1))


class Shard:
    """Documents, or pieces of one, with their suffix array."""

    def __init__(self, runs: list[np.ndarray], numbers: Numbers, depth: int) -> None:
        end = np.array([END], np.int64)
        self.sizes = np.array([len(r) for r in runs], np.int64)
        self.begins = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.ids = np.concatenate([x for r in runs for x in (r, end)])
        self.order = suffix_array(self.ids, depth)
        self.numbers = numbers

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, places, side="right") - 1

    def find(self, tests: Tests) -> tuple:
        known = self.numbers.get
        words = np.fromiter((known(w, -1) for w in tests.words), np.int64, len(tests.words))
        return search(self.ids, self.order, words, tests.left, tests.window)

    def hits(self, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
        """Marks of all words inside an occurrence, and distinct (document, item) pairs."""
        _, _, low, high = self.find(tests)
        found = np.flatnonzero(low < high)
        edge = np.zeros(len(self.ids) + 1, np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        # Equal windows share a range; mark it once and list its documents for each item.
        for a, b, size in {(int(low[i]), int(high[i]), int(tests.window[i])) for i in found}:
            places = self.order[a:b]
            np.add.at(edge, places, 1)
            np.add.at(edge, places + size, -1)
        for i in found:
            for a in range(int(low[i]), int(high[i]), SLICE):
                docs = np.unique(self.doc_of(self.order[a : min(a + SLICE, int(high[i]))]))
                pairs.append(np.column_stack((docs, np.full(len(docs), tests.item[i]))))
        return np.cumsum(edge[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0)


def _runs(mark: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mark.astype(np.int8), [0]))))
    return [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])]


def _long(run: np.ndarray, numbers: Numbers, tests: Tests, shard: int) -> tuple[np.ndarray, set[int]]:
    """Marks and items of one document above a shard's size, piece by piece."""
    mark, items = np.zeros(len(run), bool), set()
    for s in range(0, len(run), shard):
        piece = run[s : s + shard + tests.deepest]
        hit, pairs = Shard([piece], numbers, tests.deepest).hits(tests)
        mark[s : s + len(piece)] |= hit[:-1]
        items |= set(pairs[:, 1].tolist())
    return mark, items


SPANS = "array<struct<start: bigint, end: bigint>>"


def _find(shared, shard: int):
    """Over batches of ``row, doc_id, text``: number of words, spans that are hit and items, per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def out(rows: list[tuple]) -> pa.RecordBatch:
            row, doc, size, spans, items = zip(*rows)
            listed = [sorted({tests.ids[i] for i in found if tests.ids[i] is not None}) for found in items]
            return pa.record_batch({
                "row": pa.array(row, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "n_words": pa.array(size, pa.int64()),
                "spans": pa.array(spans, spans_type), "items": pa.array(listed, pa.list_(pa.int64())),
            })

        def flush(held: list[tuple], numbers: Numbers) -> pa.RecordBatch:
            built = Shard([r for _, _, r in held], numbers, tests.deepest)
            mark, pairs = built.hits(tests)
            touched = {}
            for d, i in pairs.tolist():
                touched.setdefault(d, []).append(i)
            rows = []
            for d, (row, doc, r) in enumerate(held):
                b = built.begins[d]
                rows.append((row, doc, len(r), _runs(mark[b : b + len(r)]) if d in touched else [], touched.get(d, [])))
            return out(rows)

        held, size, numbers = [], 0, Numbers()
        for batch in batches:
            for row, doc, text in zip(batch["row"], batch["doc_id"], batch["text"]):
                words = words_of(text.as_py())
                r = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                if len(r) > shard:
                    mark, items = _long(r, numbers, tests, shard)
                    yield out([(row.as_py(), doc.as_py(), len(r), _runs(mark), items)])
                    continue
                held.append((row.as_py(), doc.as_py(), r))
                size += len(r) + 1
                if size >= shard:
                    yield flush(held, numbers)
                    held, size, numbers = [], 0, Numbers()
        if held:
            yield flush(held, numbers)

    return run


def blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int | None, str]]]:
    """Items in lists of at most ``limit`` bytes of text each; one item may be longer."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    held, size = [], 0
    for item, text in rows.toLocalIterator():
        n = len(text.encode())
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += n
    if held:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, test_bytes: int = TEST_BYTES) -> DataFrame:
    """``row, doc_id, n_words, spans, items``: the words of every document that lie in an occurrence of a benchmark window.

    A window is ``window`` consecutive words of an item, or the whole of a shorter
    item. Spans are maximal, in words, end exclusive; ``items`` has the ids of all
    items with a window in the document, ascending. ``row`` numbers the rows.
    """
    spark = docs.sparkSession
    rows = keyed_text(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = f"row long, doc_id long, n_words long, spans {SPANS}, items array<long>"
    found, parts = None, blocks(benchmark, test_bytes)
    part, following = next(parts, []), next(parts, None)
    if following is None:
        return rows.mapInArrow(_find(spark.sparkContext.broadcast(Tests(part, window)), shard), schema)
    rows = materialize(rows, "documents")  # numbers of rows stay the same in all passes
    while part is not None:
        shared = spark.sparkContext.broadcast(Tests(part, window))
        passed = materialize(rows.mapInArrow(_find(shared, shard), schema), "hits")
        shared.destroy()
        found = passed if found is None else found.unionByName(passed)
        part, following = following, next(parts, None)
    return _joined(found)


def _joined(found: DataFrame) -> DataFrame:
    """Findings of several passes as one row per document: overlapping spans become one."""
    each = found.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = each.withColumn("opens", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    spans = opened.withColumn("run", F.sum("opens").over(upto)).groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    items = found.select("row", F.explode("items").alias("i")).groupBy("row").agg(F.array_sort(F.collect_set("i")).alias("items"))
    every = found.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.min("n_words").alias("n_words"))
    out = every.join(spans, "row", "left").join(items, "row", "left")
    return out.select("row", "doc_id", "n_words", F.coalesce("spans", F.expr(f"CAST(array() AS {SPANS})")).alias("spans"), F.coalesce("items", F.expr("CAST(array() AS array<long>)")).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document."""
    found = contamination(docs, benchmark, **how)
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents without a hit; all columns stay. Rows are told apart by 128 bits of id and text."""
    numbered = materialize(docs.withColumn("_row_of", F.monotonically_increasing_id()), "documents")
    plain = numbered.select(F.col("_row_of").alias("doc_id"), "text")
    dirty = contamination(plain, benchmark, **how).where("size(spans) > 0").select(F.col("doc_id").alias("_row_of"))
    return numbered.join(dirty, "_row_of", "left_anti").select(*docs.columns)


def longest_matches(docs: DataFrame, benchmark: DataFrame, shard: int = SHARD, test_bytes: int = TEST_BYTES) -> DataFrame:
    """Per item (its number in ``item``, ``item_id``): ``words`` of its longest verbatim match, ``item_start``, ``doc_id`` and ``doc_start`` of one such match.

    Of several the one with the smallest doc_id, start and item_start in that order counts; items without a word in the documents have no row.
    Documents longer than a shard are searched in pieces that overlap by the longest item.
    """
    spark = docs.sparkSession
    rows = keyed_text(docs)
    schema = "item long, item_id long, words long, item_start long, doc_id long, doc_start long"
    found, offset = None, 0
    for part in blocks(benchmark, test_bytes):
        shared = spark.sparkContext.broadcast(Tests(part, WINDOW))
        passed = materialize(rows.mapInArrow(_longest(shared, offset, shard), schema), "matches")
        shared.destroy()
        found, offset = passed if found is None else found.union(passed), offset + len(part)
    if found is None:
        return spark.createDataFrame([], schema)
    best = F.max_by(F.struct("words", "item_start", "doc_id", "doc_start"), F.struct("words", -F.col("doc_id"), -F.col("doc_start"), -F.col("item_start"))).alias("m")
    return found.groupBy("item", "item_id").agg(best).select("item", "item_id", "m.*")


def _longest(shared, offset: int, shard: int):
    """Over batches of ``doc_id, text``: each item's longest matches in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value

        def flush(held: list[tuple], numbers: Numbers) -> pa.RecordBatch:
            built = Shard([r for _, _, r in held], numbers, tests.deepest)
            longest, place, _, _ = built.find(tests)
            best = np.zeros(len(tests.ids), np.int64)
            np.maximum.at(best, tests.item, longest)
            out = []
            for i in np.flatnonzero((longest > 0) & (longest == best[tests.item])):
                # all places of this match: entries from the first one on that share its words
                word = built.ids[place[i] : place[i] + longest[i]]
                at = int(np.flatnonzero(built.order == place[i])[0])
                while at < len(built.order) and np.array_equal(built.ids[built.order[at] : built.order[at] + longest[i]], word):
                    p = int(built.order[at])
                    d = int(built.doc_of(np.array([p]))[0])
                    out.append((offset + int(tests.item[i]), tests.ids[tests.item[i]], int(longest[i]), int(tests.start[i]), held[d][0], held[d][1] + p - int(built.begins[d])))
                    at += 1
            best_of = {}
            for m in out:
                rank = (m[4] is None, m[4] or 0, m[5], m[3])
                if m[0] not in best_of or rank < best_of[m[0]][0]:
                    best_of[m[0]] = (rank, m)
            kept = [m for _, m in best_of.values()] or [(None,) * 6]
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*kept)], names=["item", "item_id", "words", "item_start", "doc_id", "doc_start"]).slice(0, len(best_of))

        held, size, numbers = [], 0, Numbers()
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                words = words_of(text.as_py())
                r = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                for s in range(0, len(r), shard):
                    piece = r[s : s + shard + tests.deepest]
                    held.append((doc.as_py(), s, piece))
                    size += len(piece) + 1
                    if size >= shard:
                        yield flush(held, numbers)
                        held, size = [], 0
                if not held:
                    numbers = Numbers()
        if held:
            yield flush(held, numbers)

    return run

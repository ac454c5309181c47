"""URL filters: longest rule wins, and a Bloom filter cascade for exact membership.

The cascade knows the whole universe of keys. Level 1 is a Bloom filter of the
listed keys; level 2 one of the keys that level 1 passes wrongly; level 3 one of
the listed keys that level 2 passes wrongly; and so on until no key is wrong. For
any key of the universe the first level without it tells whether it is listed, so
rows are judged by bits alone: no join with the list.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequilt.runtime import computed, materialize

#: (verdict, host, path)
Rule = tuple[str, str, str]
#: Keys of one cascade: larger universes are cut into more of them.
SHARD_KEYS = 250_000
#: Bytes of cascades that one pass over the rows gets; more cascades take more passes.
PASS_BYTES = 64 << 20
HEAD = struct.Struct("<II")


def _mixed(x: np.ndarray, level: int) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bloom:
    """A Bloom filter over two 64-bit hashes per key; every level uses them differently."""

    def __init__(self, level: int, hashes: int, bits: np.ndarray) -> None:
        self.level, self.hashes, self.bits = level, hashes, bits

    @classmethod
    def build(cls, level: int, a: np.ndarray, b: np.ndarray, wrong: float) -> Bloom:
        size = max(64, math.ceil(-len(a) * math.log(wrong) / math.log(2) ** 2))
        made = cls(level, max(1, round(-math.log2(wrong))), np.zeros(-(-size // 8), np.uint8))
        flags = np.zeros(8 * len(made.bits), np.uint8)
        for place in made._places(a, b):
            flags[place] = 1
        made.bits = np.packbits(flags, bitorder="little")
        return made

    def _places(self, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        x, y = _mixed(a, self.level), _mixed(b, self.level) | np.uint64(1)
        for i in range(self.hashes):
            yield ((x + np.uint64(i) * y) % np.uint64(8 * len(self.bits))).astype(np.int64)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for place in self._places(a, b):
            out &= (self.bits[place >> 3] >> (place & 7) & 1).astype(bool)
        return out


class Cascade:
    """Exact membership for the keys it was built over."""

    def __init__(self, levels: list[Bloom]) -> None:
        self.levels = levels

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, listed: np.ndarray) -> Cascade:
        """``a`` and ``b`` are the hashes of distinct keys, ``listed`` says which are listed."""
        inside, outside = (a[listed], b[listed]), (a[~listed], b[~listed])
        levels: list[Bloom] = []
        # The first filter lets as many through as the later halvings handle best.
        wrong = min(0.5, math.sqrt(0.5) * len(inside[0]) / max(1, len(outside[0])))
        while len(inside[0]):
            if len(levels) > 200:
                raise ValueError("two keys have the same hashes")
            level = Bloom.build(len(levels), *inside, wrong)
            levels.append(level)
            passed = level.holds(*outside)
            inside, outside = (outside[0][passed], outside[1][passed]), inside
            wrong = 0.5
        return cls(levels)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether keys are listed; right for every key of the universe."""
        out = np.zeros(len(a), bool)
        left = np.arange(len(a))
        for i, level in enumerate(self.levels):
            passed = level.holds(a[left], b[left])
            out[left[~passed]] = i % 2 == 1
            left = left[passed]
        out[left] = len(self.levels) % 2 == 1
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(HEAD.pack(x.hashes, len(x.bits)) + x.bits.tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> Cascade:
        levels, at = [], 4
        for i in range(struct.unpack_from("<I", data)[0]):
            hashes, size = HEAD.unpack_from(data, at)
            at += HEAD.size
            levels.append(Bloom(i, hashes, np.frombuffer(data, np.uint8, size, at)))
            at += size
        return cls(levels)


def split_url(pages: DataFrame) -> DataFrame:
    """page_id, host, path: what stands after the first ``://`` up to ``/``, ``?``, ``#``; then up to ``?``, ``#``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    part = lambda i: F.regexp_extract(url, "://([^/?#]*)([^?#]*)", i)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.select(F.col("page_id"), F.translate(part(1), upper, lower).alias("host"), part(2).alias("path"))


def longest_rule(rules: list[Rule], result: int | None = None) -> str:
    """SQL, alike in Spark and DuckDB: the longest fitting rule as ``host`` + ``path``, or its verdict; null if none fits.

    Of rules of one length the one with the longer host wins, then the smaller.
    """
    cases = []
    for rule in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1], r[2])):
        verdict, host, path = (x.replace("'", "''") for x in rule)
        value = verdict if result == 0 else host + path
        # concat with a dot in front makes the host itself end in the rule's host too
        cases.append(f"WHEN right(concat('.', host), {len(rule[1]) + 1}) = '.{host}' AND left(path, {len(rule[2])}) = '{path}' THEN '{value}'")
    return "CASE " + " ".join(cases) + " END" if cases else "CAST(NULL AS STRING)"


def build_cascades(universe: DataFrame, listed: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``shard``, ``shards``, ``cascade`` (bytes) over all keys (host, path) of the universe and the list.

    Keys are distinct before they are dealt to shards by hash, so shards are even.
    """
    keys = universe.select("host", "path", F.lit(False).alias("on")).unionByName(listed.select("host", "path", F.lit(True).alias("on")))
    distinct = materialize(
        keys.groupBy("host", "path").agg(F.max("on").alias("on")).select(*_hashes(), "on"), "url-keys"
    )
    shards = -(-distinct.count() // shard_keys) or 1

    def build(group: pd.DataFrame) -> pd.DataFrame:
        made = Cascade.build(group["a"].to_numpy().view(np.uint64), group["b"].to_numpy().view(np.uint64), group["on"].to_numpy(bool))
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "shards": [shards], "cascade": [made.to_bytes()]})

    sharded = distinct.withColumn("shard", _shard(shards))
    return materialize(sharded.groupBy("shard").applyInPandas(build, "shard int, shards int, cascade binary"), "cascades")


def _hashes():
    """Two hashes of a key with nothing in common but the key."""
    return F.xxhash64("host", "path").alias("a"), F.xxhash64(F.lit(1), "path", "host").alias("b")


def _shard(shards: int):
    return F.pmod(F.shiftright("a", 7), F.lit(shards)).cast("int")


def probe(keyed: DataFrame, cascades: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Adds ``listed`` to rows with host and path; right for keys of the cascades' universe.

    The cascades are sent to all tasks as far as ``pass_bytes`` reaches; what is
    larger takes further passes, each over the rows of its own shards, so neither
    a task nor the driver ever holds more. Rows are not shuffled.
    """
    sizes = cascades.select("shard", "shards", F.length("cascade").alias("size")).orderBy("shard").collect()  # one number per shard
    shards = sizes[0]["shards"] if sizes else 1
    passes: list[list[int]] = [[]]
    held = 0
    for row in sizes:
        if passes[-1] and held + row["size"] > pass_bytes:
            passes.append([])
            held = 0
        passes[-1].append(row["shard"])
        held += row["size"]
    rows = keyed.select("*", *_hashes()).withColumn("_shard", _shard(shards))
    names = keyed.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema) + ", listed boolean"
    out = None
    for some in passes:
        filters = {r["shard"]: r["cascade"] for r in cascades.where(F.col("shard").between(some[0], some[-1])).collect()} if some else {}
        sent = keyed.sparkSession.sparkContext.broadcast(filters)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            made: dict[int, Cascade] = {}
            for batch in batches:
                a, b = (batch[c].to_numpy().view(np.uint64) for c in ("a", "b"))
                shard = batch["_shard"].to_numpy()
                listed = np.zeros(len(a), bool)
                for s in np.unique(shard).tolist():
                    if s not in made:
                        made[s] = Cascade.from_bytes(sent.value.get(s, b"\0\0\0\0"))
                    mine = np.flatnonzero(shard == s)
                    listed[mine] = made[s].holds(a[mine], b[mine])
                yield pa.record_batch({n: batch[n] for n in names} | {"listed": pa.array(listed)})

        part = rows.where(F.col("_shard").between(some[0], some[-1])) if some and len(passes) > 1 else rows
        judged = part.mapInArrow(run, fields)
        out = judged if out is None else out.unionByName(judged)
    return out


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame | None = None, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """page_id, host, path, rule, verdict and ``listed`` of every row.

    The longest fitting rule decides. Where none fits, a key (host and path) on
    the list is blocked and any other allowed. The list holds the corpus's keys
    that a rule blocks and those of ``listed`` (host, path); the cascade is built
    over all keys of the corpus, so its answers are exact for each of them. A
    null url or one without ``://`` has an empty host and path and is judged as
    that key. Null ids and repeated rows stay; other columns are ignored; without
    rows the result is empty. Hashes are 128 bits together.
    """
    keyed = computed(split_url(pages), rule=longest_rule(rules), by_rule=longest_rule(rules, 0))
    blocked = keyed.where("by_rule = 'block'").select("host", "path")
    cascades = build_cascades(keyed, blocked if listed is None else blocked.unionByName(listed.select("host", "path")), shard_keys)
    found = probe(keyed, cascades)
    verdict = F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")


def oracle(rules: list[Rule]) -> str:
    """The verdicts as DuckDB SQL, with a plain lookup in place of the cascade."""
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
k AS (
  SELECT page_id, translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '://([^/?#]*)([^?#]*)', 2) AS path FROM u),
r AS (SELECT *, {longest_rule(rules)} AS rule, {longest_rule(rules, 0)} AS by_rule FROM k),
j AS (SELECT *, (host, path) IN (SELECT (host, path) FROM r WHERE by_rule = 'block') AS listed FROM r)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM j"""

"""The trie against a direct one in plain Python."""

import hashlib
import random
import zlib

from tracequilt.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string"


def trie_of(sequences):
    """Rows of every node from conv -> list of (role, text)."""
    members, ends = {}, {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
        ends.setdefault(tuple(turns), []).append(conv)
    out = []
    for node, convs in members.items():
        under = [m for m in members if m[: len(node)] == node]
        kids = [m for m in under if len(m) == len(node) + 1]
        leaves = [m for m in under if not any(o[: len(m)] == m and len(o) == len(m) + 1 for o in members)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in under if m)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), len(leaves), saved, digest))
    return sorted(map(str, out))


def plain(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v, key=lambda r: (r[0] is not None, r[0] or 0))] for c, v in convs.items()}


def rebuilt(rows):
    convs, out = plain(rows), {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


def sample(seed, convs):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(convs * 2), convs):
        for t in range(rng.randint(1, 9)):
            rows.append((c, None if t == 0 and c % 7 == 0 else t, rng.choice(["user", None]), rng.choice(["hé", "a b", "", None, f"text {c % 3}"])))
    return rows


def test_rebuilt_trie(spark):
    rows = sample(1, 60) + [(None, 1, "user", "lost")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("key", "a", "b", "at", "n", "conv", "depth", "x"):
        df = df.selectExpr("*", f"'z' AS {name}")
    assert got(ct.rebuilt_trie(df)) == trie_of(rebuilt(rows))


def test_one_conversation_with_most_turns_and_many_alike(spark):
    rows = [(7, t, "user", f"t{t % 11}") for t in range(1200)] + [(8, t, "user", f"t{t % 11}") for t in range(700)]
    rows += [(c, t, "user", f"first {c % 2}") for c in range(100, 700) for t in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    sequences = plain(rows)
    # direct counting, as the brute force above compares all pairs of nodes
    short = {c: v for c, v in sequences.items() if c >= 100}
    out = ct.plain_trie(df).collect()
    deep = {(r.conv_id, r.depth): r for r in out}
    assert len(out) == 1 + 1200 + 4
    assert (deep[7, 0].n_convs, deep[7, 0].n_children, deep[7, 0].n_leaves, deep[7, 0].parent_conv_id) == (602, 3, 3, None)
    assert [deep[7, d].n_convs for d in (1, 700, 701, 1200)] == [2, 2, 1, 1]
    assert deep[7, 300].saved_tokens == sum(len(f"t{t % 11}") for t in range(299, 700)) and deep[7, 701].saved_tokens == 0
    assert deep[7, 700].ends_sha256 == hashlib.sha256(b"8").hexdigest()
    assert (deep[100, 2].n_convs, deep[100, 2].parent_conv_id, deep[101, 1].parent_conv_id, deep[101, 1].n_children) == (300, 100, 7, 1)
    assert deep[100, 2].ends_sha256 == hashlib.sha256(",".join(str(c) for c in short if c % 2 == 0).encode()).hexdigest()


def test_few_conversations(spark):
    for rows in ([], [(6, 0, "u", "gone")], [(6, 0, "u", "x"), (11, 0, "u", "y"), (5, 0, "u", "z")], [(4, 1, None, None)] * 3):
        df = spark.createDataFrame(rows, SCHEMA)
        assert got(ct.rebuilt_trie(df)) == (trie_of(rebuilt(rows)) if rows else [])


def test_leaves_and_savings_of_plain_conversations(spark):
    rows = [(c, t, "u", f"{t if c % 4 else 'x'}") for c in range(20) for t in range(c % 6 + 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(ct.plain_trie(df)) == trie_of(plain(rows))

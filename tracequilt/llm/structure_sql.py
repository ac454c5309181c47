"""DuckDB SQL for the Merkle manifest, the conversation trie and the decontamination report."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned checksum of an ASCII text, bit by bit (reflected polynomial 0xEDB88320)."""
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, k: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))"
    letters = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {letters}), lambda c, b: {step}), 4294967295::UBIGINT)"


def merkle() -> str:
    def field(c: str) -> str:
        return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def tree(levels: str, climb: str, base: str, start: str) -> str:
        return f"""
      {levels} AS (SELECT tree, 0 AS l, idx, width, h FROM {base}
        UNION ALL SELECT tree, l + 1, idx // 3, (width + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM {levels} WHERE width > 1 GROUP BY tree, l, idx // 3, width),
      {climb} AS ({start}
        UNION ALL SELECT c.r, c.l + 1, c.tree, c.idx // 3, sha256(string_agg(CASE WHEN s.idx = c.idx THEN c.fold ELSE s.h END, '' ORDER BY s.idx)),
          c.proof || coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (WHERE s.idx <> c.idx), '')
        FROM {climb} c JOIN {levels} s ON s.tree = c.tree AND s.l = c.l AND s.idx // 3 = c.idx // 3 AND s.width > 1 GROUP BY c.r, c.l, c.tree, c.idx, c.fold, c.proof)"""

    return f"""WITH RECURSIVE docs AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM documents),
      found AS (SELECT r, doc_id, source, {leaf('text')} AS leaf, {leaf("CASE WHEN " + crc32('CAST(doc_id AS VARCHAR)') + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS forged FROM docs),
      ranked AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx,
        count(*) OVER (PARTITION BY source) AS width FROM found),
      base AS (SELECT tree, idx, width, leaf AS h FROM ranked),
      {tree('lv', 'up', 'base', "SELECT r, 0 AS l, tree, idx, forged AS fold, '' AS proof FROM ranked")},
      tops AS (SELECT 0 AS tree, tree AS idx, count(*) OVER () AS width, h FROM lv WHERE width = 1),
      half AS (SELECT r, tree, arg_max(fold, l) AS fold, arg_max(proof, l) AS proof FROM up GROUP BY r, tree),
      {tree('lv2', 'up2', 'tops', "SELECT r, 0 AS l, 0 AS tree, tree AS idx, fold, proof FROM half")},
      whole AS (SELECT r, arg_max(fold, l) AS fold, arg_max(proof, l) AS proof FROM up2 GROUP BY r),
      root AS (SELECT h AS root FROM lv2 WHERE width = 1)
      SELECT k.doc_id, k.leaf, t.h AS subroot, root, sha256(w.proof) AS proof_sha256, w.fold AS folded_root, w.fold = root AS verified
      FROM ranked k JOIN whole w USING (r) JOIN tops t ON t.idx = k.tree CROSS JOIN root"""


def trie() -> str:
    return f"""WITH turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS v
        FROM conversations WHERE conv_id IS NOT NULL),
      lists AS (SELECT c, list(v ORDER BY p) AS own FROM turns GROUP BY c),
      built AS (SELECT a.c, coalesce(list_slice(b.own, 1, h), []) || coalesce(list_slice(a.own, h + 1, len(a.own)), []) AS s
        FROM (SELECT *, CAST({crc32('CAST(c AS VARCHAR)')} % 9 AS BIGINT) AS h FROM lists) a LEFT JOIN lists b ON b.c = a.c - a.c % 5),
      pre AS MATERIALIZED (SELECT c, d, len(s) AS n, CASE WHEN d = 0 THEN '' ELSE md5(CAST(list_slice(s, 1, d) AS VARCHAR)) || md5(to_json(list_slice(s, 1, d))) END AS k,
        CASE WHEN d = 0 THEN NULL WHEN d = 1 THEN '' ELSE md5(CAST(list_slice(s, 1, d - 1) AS VARCHAR)) || md5(to_json(list_slice(s, 1, d - 1))) END AS up,
        CASE WHEN d = 0 THEN 0 ELSE strlen(s[d].t) END AS bytes FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM built)),
      nodes AS MATERIALIZED (SELECT k, any_value(up) AS up, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = n), '')) AS ends_sha256 FROM pre GROUP BY k),
      kids AS (SELECT up AS k, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
      above AS (SELECT p.k AS top, sum((v.n_convs - 1) * v.bytes) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
        FROM nodes v JOIN pre p ON p.c = v.conv_id AND p.d <= v.depth LEFT JOIN kids ON kids.k = v.k GROUP BY p.k)
      SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, x.n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, x.ends_sha256
      FROM nodes x LEFT JOIN nodes u ON u.k = x.up LEFT JOIN kids ON kids.k = x.k JOIN above ON above.top = x.k"""


def decontamination(window: int = 10) -> str:
    words = (
        "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
        r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
      items AS (SELECT item_id, {words} AS w FROM benchmark),
      wins AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
        FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least({window}, len(w)) AS n FROM items WHERE len(w) > 0))),
      sizes AS (SELECT DISTINCT n FROM wins),
      seen AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
      hits AS MATERIALIZED (SELECT r, i, n, item_id FROM seen JOIN wins USING (n, s)),
      cover AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
      named AS (SELECT r, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
      SELECT doc_id, len(w) AS n_words, coalesce(cover.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(cover.n, 0) > 0 AS contaminated
      FROM docs LEFT JOIN cover USING (r) LEFT JOIN named USING (r)"""

"""License scans by canonical digests.

A text is brought to a canonical form (case, punctuation, copyright lines and
equivalent spellings do not count), digested as a whole, and looked up among the
digests of known licences. Every line is looked up as a text of its own as well,
which finds one-line notices. Columns and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequilt.llm.common import keyed_text
from tracequilt.llm.license_texts import NOTICES, TEXTS
from tracequilt.runtime import computed, materialize

#: Spellings that count as one, (variant, canonical). From public matching guidelines for licences.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("cancelled", "canceled"), ("catalogue", "catalog"),
    ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"),
    ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"),
    ("licenced", "licensed"), ("licences", "licenses"), ("modelled", "modeled"), ("offence", "offense"), ("organisation", "organization"),
    ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)
#: A line that states a copyright and nothing of the licence. It holds no quote, so it is a literal in both dialects.
COPYRIGHT = (
    r"^[^\p{L}\p{N}(©]*((copyright|copr[.]?)[ \t]*([(]c[)]|©|[0-9]{4}|:|by )|([(]c[)]|©)[ \t]*(copyright[ \t]*)?[0-9]{4})"
    r"|^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"
)
#: Letters and digits are words; everything else parts them, by two blanks so that each word keeps its own.
PARTING = r"[^\p{L}\p{N}]+"


def canonical_line(line: str, raw: str = "r", everywhere: str = "") -> str:
    """SQL for a line's canonical words, each between blanks; empty for a copyright line.

    ``raw`` marks literals whose backslashes stand for themselves, ``everywhere``
    is the argument that makes a replacement global: the dialects differ there only.
    """
    words = f"regexp_replace(concat(' ', lower({line}), ' '), {raw}'{PARTING}', '  '{everywhere})"
    for variant, canonical in SPELLINGS:
        words = f"replace({words}, ' {variant} ', ' {canonical} ')"
    return words


def squeezed(words: str) -> str:
    """SQL that leaves one blank between words: two lines meet with four, words with two."""
    return f"trim(replace(replace({words}, '  ', ' '), '  ', ' '))"


def canonical(texts: DataFrame, text: str) -> DataFrame:
    """Adds ``lines`` (canonical lines that hold words) and ``digest`` (of the whole canonical text; null if it is empty)."""
    rows = computed(
        texts,
        lines=f"transform(filter(split(lower({text}), '\\n'), x -> x RLIKE r'[\\p{{L}}\\p{{N}}]' AND NOT x RLIKE r'{COPYRIGHT}'),"
        f" x -> {canonical_line('x')})",
    )
    return computed(rows, digest=f"CASE WHEN size(lines) > 0 THEN sha2({squeezed('array_join(lines, {0})')}, 256) END".replace("{0}", "''"))


def scan(docs: DataFrame, known: list[tuple[str, str]] = TEXTS + NOTICES) -> DataFrame:
    """doc_id, text_digest, license_id, n_notices, notices of every row.

    license_id is that of a known text equal to the whole document; of several,
    the smallest. n_notices counts the lines that are a known text by themselves;
    notices lists their distinct ids, sorted and comma-joined, empty if none. Null
    and empty texts, and those of copyright lines alone, have no digest and match
    nothing. Rows without id and repeated rows are scanned like any other; other
    columns are ignored.

    Both lookups are equi-joins with one row per known digest. Only lines as long
    as some known text are digested. Lines that match are gathered by document and
    text, so repeated rows, alike in both, find the same result.
    """
    spark = docs.sparkSession
    listed = materialize(canonical(spark.createDataFrame(known, "license_id string, known_text string"), "known_text"), "licences")
    table = listed.where("digest IS NOT NULL").groupBy(F.col("digest").alias("known")).agg(F.min("license_id").alias("license_id"))
    # The length that each known text has as one line: as many numbers as known texts.
    one_line = F.expr("length(replace(array_join(lines, ''), '    ', '  '))")
    lengths = [r[0] for r in listed.where("size(lines) > 0").select(one_line).distinct().collect()]
    fits = f"length(x) IN ({', '.join(map(str, lengths))})" if lengths else "false"
    rows = computed(canonical(keyed_text(docs), "text"), copy="xxhash64(text)", some=f"filter(lines, x -> {fits})")
    rows = materialize(rows.select("doc_id", "copy", "digest", F.expr(f"transform(some, x -> sha2({squeezed('x')}, 256))").alias("some")), "licence-rows")
    gathered = (
        rows.select("doc_id", "copy", F.posexplode("some").alias("at", "known")).join(table, "known")
        .groupBy(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"))
        .agg(F.countDistinct("at").alias("_n"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("_notices"))
    )
    return (
        rows.join(table, F.col("digest") == F.col("known"), "left")
        .join(gathered, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")), "left")
        .select(
            "doc_id", F.col("digest").alias("text_digest"), "license_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_notices"),
            F.coalesce("_notices", F.lit("")).alias("notices"),
        )
    )


def oracle(known: list[tuple[str, str]] = TEXTS + NOTICES) -> str:
    """The scan as DuckDB SQL, from the known texts on."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in known)

    def lines(text: str) -> str:
        kept = f"list_filter(string_split(lower({text}), chr(10)), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(x, '{COPYRIGHT}'))"
        return f"list_transform({kept}, lambda x: {canonical_line('x', '', ', ' + quoted('g'))})"

    whole = squeezed("array_to_string(lines, '')")
    return f"""
WITH known AS (SELECT id, {lines("text")} AS lines FROM (VALUES {values}) AS v(id, text)),
digests AS (SELECT sha256({whole}) AS digest, min(id) AS id FROM known WHERE len(lines) > 0 GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, {lines("coalesce(text, '')")} AS lines FROM documents),
n AS (
  SELECT rid, count(*) AS n, string_agg(DISTINCT id, ',' ORDER BY id) AS ids
  FROM (SELECT rid, unnest(lines) AS x FROM d) l JOIN digests ON digest = sha256({squeezed("x")}) GROUP BY rid),
w AS (SELECT *, CASE WHEN len(lines) > 0 THEN sha256({whole}) END AS text_digest FROM d)
SELECT doc_id, text_digest, digests.id AS license_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_notices, coalesce(n.ids, '') AS notices
FROM w LEFT JOIN digests ON digest = text_digest LEFT JOIN n ON n.rid = w.rid"""

"""Line-first cleaning: judge lines, drop those that fail, reject texts that lose too much.

Columns and SQL functions only. All counts of one text are made inside its row, so
nothing is shuffled and no key can become hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequilt.llm.common import BLANKS, keyed_text
from tracequilt.runtime import computed

#: Phrases that mark a short line as page furniture. Lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use",
    "enable javascript", "javascript is disabled", "skip to content", "skip to main content",
    "click here", "read more", "sign up for", "subscribe to our", "powered by", "lorem ipsum",
    "back to top", "share this",
)
#: Last characters of a finished line: sentence ends and what may close after them.
TERMINAL = ".!?:;…\"'”’)]»。！？"
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Marks between the entries of a navigation line.
SEPARATORS = (" | ", " > ", " » ", " · ", " • ")


@dataclass(frozen=True)
class LineRules:
    """A line fails when any rule says so; a text is rejected when too few of its characters are left."""

    #: Lines with fewer words need a terminal mark.
    open_line_words: int = 8
    #: Separators that make a line navigation, if at least one stands for every five words.
    separators: int = 3
    words_per_separator: int = 5
    #: Longest line, in words, that a boilerplate phrase condemns.
    boilerplate_words: int = 40
    #: A line with more than one symbol for so many words fails.
    words_per_symbol: int = 3
    #: Least share of the non-empty lines' characters that must stay, in percent.
    keep_percent: int = 50
    #: Base rules: fewest words, and the largest share of words in repeated windows, in percent.
    min_words: int = 10
    max_repeat_percent: int = 20


#: Blanks taken off a line's ends, beside the space: tab and carriage return.
TRIM = "concat(' ', chr(9), chr(13))"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def without(line: str, marks: str) -> str:
    for mark in marks:
        line = f"replace({line}, {sql_text(mark)}, '')"
    return line


def holds_phrase(text: str) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {sql_text(p)})" for p in BOILERPLATE) + ")"


def line_fails(line: str, rules: LineRules, furniture: str) -> str:
    """SQL that is true for a failing line, alike in Spark and DuckDB.

    ``line`` is a trimmed line with text in it; ``furniture`` says whether the
    whole text holds any boilerplate phrase, which saves looking into each line.
    """
    words = f"(length({line}) - length(replace({line}, ' ', '')) + 1)"
    marks = "(" + " + ".join(f"(length({line}) - length(replace({line}, {sql_text(s)}, ''))) / {len(s)}" for s in SEPARATORS) + ")"
    return (
        f"(({words} < {rules.open_line_words} AND NOT contains({sql_text(TERMINAL)}, right({line}, 1)))"
        f" OR ({marks} >= {rules.separators} AND {marks} * {rules.words_per_separator} >= {words})"
        f" OR ({furniture} AND {words} <= {rules.boilerplate_words} AND {holds_phrase(line)})"
        f" OR (length({line}) - length({without(line, SYMBOLS)})) * {rules.words_per_symbol} > {words})"
    )


def assess(docs: DataFrame, rules: LineRules = LineRules(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts, base rules, the verdict and the cleaned text of every row.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, line_chars, kept_chars, kept, cleaned, and ``_carried``, a struct
    of the columns named in ``carry``. A null text is empty: no words,
    base_failed, not kept. Null ids stay null, repeated rows are judged each for
    itself, other columns are ignored, and an empty table gives no rows.
    Five-word windows are told apart by 64-bit hashes within one text.
    """
    rows = computed(
        keyed_text(docs, F.struct(*carry, F.lit(0).alias("_zero")).alias("_carried")),
        words=f"array_remove(split(text, r'[{BLANKS}]+'), '')",
        worded=f"filter(split(text, '\\n'), x -> x RLIKE r'[^{BLANKS}]')",
        furniture=holds_phrase("text"),
        symbols=f"regexp_count(text, '[{SYMBOLS}]')",
        word_chars=f"length(text) - regexp_count(text, r'[{BLANKS}]')",
    ).drop("text")
    rest = ", ".join(f"get(words, i + {k})" for k in range(1, 5))
    rows = computed(
        rows,
        windows=f"CASE WHEN size(words) >= 5 THEN slice(transform(words, (w, i) -> xxhash64(w, {rest})), 1, size(words) - 4)"
        " ELSE array() END",
        n_words="size(words)",
        trimmed=f"transform(worded, x -> trim(BOTH {TRIM} FROM x))",
        dup_lines="size(worded) - size(array_distinct(worded))",
    ).drop("words", "worded")
    rows = computed(
        rows,
        # Only texts that hold a window twice go on to sorting.
        ordered="CASE WHEN size(windows) > size(array_distinct(windows))"
        " THEN sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i))) END",
        good=f"filter(trimmed, x -> NOT {line_fails('x', rules, 'furniture')})",
        line_chars="aggregate(trimmed, 0, (a, x) -> a + length(x))",
    ).drop("windows", "trimmed")
    rows = computed(
        rows,
        twice="sort_array(transform(filter(ordered, (x, j) -> x.h = get(ordered, j - 1).h OR x.h = get(ordered, j + 1).h), x -> x.i))",
        kept_chars="aggregate(good, 0, (a, x) -> a + length(x))",
    ).drop("ordered")
    rows = computed(
        rows,
        repeats="coalesce(aggregate(twice, named_struct('n', 0, 'e', 0),"
        " (a, i) -> named_struct('n', a.n + i + 5 - greatest(a.e, i), 'e', i + 5), a -> a.n), 0)",
    )
    failed = F.expr(f"n_words < {rules.min_words} OR 100L * repeats > {rules.max_repeat_percent}L * n_words")
    count = lambda name: F.col(name).cast("long")
    return rows.select(
        "doc_id", count("n_words").alias("n_words"), count("word_chars").alias("word_chars"), count("symbols").alias("n_symbols"),
        count("dup_lines").alias("n_dup_lines"), count("repeats").alias("n_repeat_words"), failed.alias("base_failed"),
        count("line_chars").alias("line_chars"), count("kept_chars").alias("kept_chars"),
        (~failed & F.expr(f"100L * kept_chars >= {rules.keep_percent}L * line_chars")).alias("kept"),
        F.array_join("good", "\n").alias("cleaned"), "_carried",
    )


def quality_verdicts(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The counts and the verdict without the texts."""
    return assess(docs, rules).drop("cleaned", "_carried")


def clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Rows whose text passes, with failing lines taken out; all columns stay and ``n_chars`` follows the text.

    A row's verdict comes from its own text, so nothing is joined.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    made = {"doc_id": F.col("doc_id"), "text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    kept = assess(docs, rules, others).where("kept")
    return kept.select(*[made.get(c, F.col("_carried")[c]).alias(c) for c in docs.columns])


def oracle(rules: LineRules = LineRules()) -> str:
    """The verdicts as DuckDB SQL."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
p AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^{BLANKS}]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{BLANKS}]')) AS worded,
    {holds_phrase("text")} AS furniture
  FROM d),
win AS (
  SELECT rid, i, list_slice(words, i, i + 4) AS five FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM p)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, five) AS n FROM win) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS t(k) GROUP BY rid),
q AS (
  SELECT p.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(list_sum(list_transform(words, lambda x: length(x))) AS BIGINT) AS chars,
    CAST(length(text) - length({without("text", SYMBOLS)}) AS BIGINT) AS n_symbols,
    CAST(len(worded) - len(list_distinct(worded)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, furniture,
    list_transform(worded, lambda x: trim(x, {TRIM})) AS lines
  FROM p LEFT JOIN covered c ON c.rid = p.rid),
r AS (
  SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
    CAST(coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS BIGINT) AS line_chars,
    CAST(coalesce(list_sum(list_transform(
      list_filter(lines, lambda x: NOT {line_fails("x", rules, "furniture")}), lambda x: length(x))), 0) AS BIGINT) AS kept_chars
  FROM q)
SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line_chars, kept_chars,
  NOT base_failed AND 100 * kept_chars >= {rules.keep_percent} * line_chars AS kept
FROM r"""

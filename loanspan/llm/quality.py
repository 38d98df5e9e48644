"""Line-first quality rules.

Each line is judged by itself; failing lines are removed, and a document that loses too much of
its text is rejected. Built-in functions only, one pass, no shuffle: a document never leaves its
row, so a hot source or a long text costs what its length costs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanspan.llm.common import SPACE, replacing, text_of, windows, words_of

#: Characters counted as symbols.
SYMBOLS = r"[#*$%&|<>]"
#: Marks that end a sentence or a heading, before white space at a line's end.
TERMINAL = r"[.!?:;,\"'”»…。！？)\]]" + SPACE + r"*\z"
#: Marks between the entries of a menu.
SEPARATORS = r"[|»›•·>]"
#: A line of at most BOILERPLATE_WORDS words with one of these phrases is boilerplate.
BOILERPLATE = (
    r"(?i)(javascript|cookie|terms of (use|service)|privacy policy|all rights reserved"
    r"|licensed under|copyright|©|sign up|log in|subscribe|read more|click here|lorem ipsum"
    r"|spdx-license)"
)
BOILERPLATE_WORDS = 30
#: A line without terminal mark passes only with this many words.
OPEN_LINE_WORDS = 8
#: Shares of a line's words: symbols and repeated exclamation marks, menu separators.
MAX_MARKS_PER_WORD = 0.5
MAX_SEPARATORS_PER_WORD = 0.2
#: A document must keep this share, in percent, of its word characters.
MIN_KEPT_PERCENT = 50
WINDOW = 8


def line_passes(entry: Column) -> Column:
    """Whether a line, with its number of words, passes the three kinds of rules."""
    line, n_words = entry["line"], entry["n_words"]
    without = lambda pattern: F.length(line) - F.length(F.regexp_replace(line, pattern, ""))
    punctuation = (line.rlike(TERMINAL) | (n_words >= OPEN_LINE_WORDS)) & (
        without(r"[#*$%&<>!]") <= MAX_MARKS_PER_WORD * n_words
    )
    navigation = without(SEPARATORS) <= MAX_SEPARATORS_PER_WORD * n_words
    boilerplate = (n_words > BOILERPLATE_WORDS) | ~line.rlike(BOILERPLATE)
    return punctuation & navigation & boilerplate


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with line-cleaned text, counts and verdict.

    Adds to each row of `docs`, in place of columns of the same names:
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint), base_failed, kept
    (boolean), n_lines, n_lines_kept, kept_chars (bigint) and clean_text (the passing lines).

    Null and empty texts have no words: base_failed is true, kept false, clean_text empty. Other
    columns, null ids included, pass through; repeated rows are judged one by one. A repeated
    window is found by its 64-bit hash within one document.
    """
    content = text_of(F.col(f"`{text}`"))
    base = docs.withColumn("__text", content).withColumns(
        {
            "__words": words_of(F.col("__text")),
            "__lines": F.filter(
                F.transform(
                    F.split("__text", "\n", -1),
                    lambda x: F.struct(x.alias("line"), F.size(words_of(x)).alias("n_words")),
                ),
                lambda x: x["n_words"] > 0,
            ),
        }
    )
    hashed = base.withColumns(
        {
            "__hashes": windows(F.col("__words"), WINDOW),
            "__full": F.col("__lines.line"),
            "__kept": F.filter("__lines", line_passes)["line"],
        }
    )
    # Windows by hash, then place; neighbours with one hash are repeats.
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    ordered = hashed.withColumn(
        "__ordered",
        F.when(
            F.size(F.array_distinct("__hashes")) < F.size("__hashes"),
            F.sort_array(
                F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
            ),
        ).otherwise(none),
    )
    same = lambda x, j: F.coalesce(F.get("__ordered", j)["h"] == x["h"], F.lit(False))
    placed = ordered.withColumn(
        "__places",
        F.sort_array(
            F.array_compact(
                F.transform(
                    "__ordered", lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"])
                )
            )
        ),
    )
    places, rest = F.col("__places"), F.greatest(F.size("__places") - 1, F.lit(0))
    steps = F.zip_with(
        F.slice(places, 2, rest), F.slice(places, 1, rest), lambda b, a: F.least(b - a, F.lit(WINDOW))
    )
    n_repeat = F.when(
        F.size(places) > 0,
        F.aggregate(steps, F.lit(WINDOW).cast("bigint"), lambda total, x: total + x),
    ).otherwise(F.lit(0).cast("bigint"))
    chars = lambda x: F.length(F.regexp_replace(x, f"{SPACE}+", "")).cast("bigint")
    counted = placed.withColumns(
        {
            "__n_words": F.size("__words").cast("bigint"),
            "__word_chars": chars(F.col("__text")),
            "__clean": F.array_join("__kept", "\n"),
            "__n_repeat": n_repeat,
        }
    )
    failed = (F.col("__n_words") < 20) | (100 * F.col("__n_repeat") > 30 * F.col("__n_words"))
    kept_chars = chars(F.col("__clean"))
    result = replacing(
        counted,
        {
            "n_words": F.col("__n_words"),
            "word_chars": F.col("__word_chars"),
            "n_symbols": F.length(
                F.regexp_replace(F.col("__text"), f"[^{SYMBOLS[1:]}+", "")
            ).cast("bigint"),
            "n_dup_lines": (F.size("__full") - F.size(F.array_distinct("__full"))).cast("bigint"),
            "n_repeat_words": F.col("__n_repeat"),
            "base_failed": failed,
            "kept": ~failed & (100 * kept_chars >= MIN_KEPT_PERCENT * F.col("__word_chars")),
            "n_lines": F.size("__full").cast("bigint"),
            "n_lines_kept": F.size("__kept").cast("bigint"),
            "kept_chars": kept_chars,
            "clean_text": F.col("__clean"),
        },
    )
    return result.drop(*[c for c in result.columns if c.startswith("__") and c not in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    """Counts and verdict of each document."""
    return clean_lines(docs.select("doc_id", "text")).drop("text", "clean_text")


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_SHARE = "length(line) - length(regexp_replace(line, '{}', '', 'g'))"

SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), worded AS (
  SELECT rid, doc_id, t, {_WORDS.format("t")} AS w FROM base
), wins AS (
  SELECT rid, i, array_to_string(w[i : i + 7], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM worded WHERE len(w) >= 8)
), repeats AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM wins)
  WHERE c > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM repeats, range(8) AS r(k) GROUP BY rid
), lines AS (
  SELECT rid, line, len({_WORDS.format("line")}) AS nw
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM base)
), judged AS (
  SELECT rid, line, nw > 0
    AND (regexp_matches(line, '{TERMINAL.replace("'", "''")}') OR nw >= {OPEN_LINE_WORDS})
    AND {_SHARE.format("[#*$%&<>!]")} <= {MAX_MARKS_PER_WORD} * nw
    AND {_SHARE.format(SEPARATORS)} <= {MAX_SEPARATORS_PER_WORD} * nw
    AND (NOT regexp_matches(line, '{BOILERPLATE}') OR nw > {BOILERPLATE_WORDS}) AS ok
  FROM lines WHERE nw > 0
), by_line AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dups,
    count(*) FILTER (ok) AS n_lines_kept,
    coalesce(sum(length(regexp_replace(line, '{SPACE}+', '', 'g'))) FILTER (ok), 0)::BIGINT AS kept_chars
  FROM judged GROUP BY rid
), joined AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '{SPACE}+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^{SYMBOLS[1:]}', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dups, 0)::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_lines_kept, 0)::BIGINT AS n_lines_kept,
    coalesce(kept_chars, 0)::BIGINT AS kept_chars
  FROM worded LEFT JOIN by_line USING (rid) LEFT JOIN covered USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
    AND 100 * kept_chars >= {MIN_KEPT_PERCENT} * word_chars AS kept,
  n_lines, n_lines_kept, kept_chars
FROM joined
"""

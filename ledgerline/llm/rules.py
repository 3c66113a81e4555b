"""Quality rules: a threshold table compiled into one Spark projection, with no user function.

Every measure below is a Spark SQL expression on the row's own text, so the
whole filter is a scan and a projection: nothing is shuffled, no key can be
hot, and a lost executor only repeats its own rows.

Cases: a null or empty text has no words, all counts 0 and fails the base
rule on length; a text with fewer than three words has no 3-word window;
repeated rows are judged one by one; a table without rows gives none; the
document's own columns travel as one struct, so none of them can clash with
a measure.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACES, whole_row

#: Common words of the four languages of the corpus (fixed values).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "are", "by", "this", "be", "from", "or", "at",
    "de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo",
    "le", "et", "les", "des", "du", "dans", "qui", "est", "pour", "pas", "au", "sur", "ne", "par", "plus", "avec", "une",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf", "ist", "nicht", "ein", "dem", "eine", "als", "auch",
)


@dataclass(frozen=True)
class Rule:
    """Keep a document only if ``low <= measure <= high`` (a null bound does not bind)."""

    measure: str
    low: float | None
    high: float | None


#: Thresholds on measures of :func:`measures`.
RULES = (
    Rule("n_words", 50, None),
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", None, 0.3),
    Rule("stop_word_ratio", 0.03, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("upper_ratio", None, 0.6),
    Rule("repeat_word_ratio", None, 0.5),
)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the document's own columns as a struct), its counts and its ratios.

    Words in repeated 3-word windows: the windows' hashes are sorted with
    their positions, a window equal to a neighbour in that order is repeated,
    and the distinct positions that repeated windows cover are counted.
    """
    stop = list(STOP_WORDS)
    d = docs.select(whole_row(docs), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.select(
        "row",
        F.filter(F.split("t", SPACES), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "").alias("lines"),
        F.length(F.regexp_replace("t", SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"))
    d = d.select(
        "row", "word_chars", "n_symbols", "n_upper",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
        F.when(F.size("words") >= 3, F.array_sort(F.transform(
            F.sequence(F.lit(0), F.size("words") - 3),
            lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"),
                               i.alias("i"))))).alias("windows"))
    near = lambda k: F.get("windows", k)["h"]
    d = d.withColumn("windows", F.filter("windows", lambda x, k: F.equal_null(x["h"], near(k - 1))
                                         | F.equal_null(x["h"], near(k + 1))))
    d = d.withColumn("n_repeat_words", F.coalesce(F.size(F.array_distinct(F.flatten(F.transform(
        "windows", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))), F.lit(0)).cast("long")).drop("windows")
    share = lambda c, n: F.col(c) / F.greatest(n, F.lit(1))
    return d.select(
        "*",
        share("word_chars", "n_words").alias("mean_word_chars"),
        share("n_symbols", "n_words").alias("symbol_ratio"),
        share("n_stop_words", "n_words").alias("stop_word_ratio"),
        share("n_repeat_words", "n_words").alias("repeat_word_ratio"),
        share("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        share("n_upper", "word_chars").alias("upper_ratio"))


def verdict(rules=RULES) -> Column:
    """The threshold table as one boolean expression."""
    ok = F.lit(True)
    for r in rules:
        if r.low is not None:
            ok = ok & (F.col(r.measure) >= r.low)
        if r.high is not None:
            ok = ok & (F.col(r.measure) <= r.high)
    return ok


def base_failed() -> Column:
    """Too short, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``row``, the measures, ``base_failed`` and ``kept`` of each document."""
    return measures(docs, text).withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules))


def keep(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The documents that pass, with their own columns.

    Each row yields itself or nothing.  A plain filter on ``kept`` would be
    pushed below the projections, which repeats every measure in every place
    that uses it.
    """
    return judge(docs, text, rules).select(F.inline(F.when(F.col("kept"), F.array("row"))))


def oracle(rules=RULES) -> str:
    """The same judgement in DuckDB SQL over the table ``documents``."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    ok = " AND ".join(f"{r.measure} {op} {v}" for r in rules for op, v in ((">=", r.low), ("<=", r.high)) if v is not None)
    return rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS three
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, three) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
counts AS (
  SELECT s.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop,
         length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id),
ratios AS (
  SELECT *, word_chars / greatest(n_words, 1)::DOUBLE AS mean_word_chars, n_symbols / greatest(n_words, 1)::DOUBLE AS symbol_ratio,
         n_stop / greatest(n_words, 1)::DOUBLE AS stop_word_ratio, n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeat_word_ratio,
         n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_ratio, n_upper / greatest(word_chars, 1)::DOUBLE AS upper_ratio,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {ok} AS kept
FROM ratios"""

"""Operator 5: line-first cleaning, in DataFrame functions alone."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

SYMBOLS = "#*$%&|<>"
#: Phrases that mark a line as boilerplate.
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "javascript", "sign up", "log in", "subscribe", "click here", "read more", "share this", "lorem ipsum")
#: A line fails if symbols are over 1 in SYMBOL_SHARE of its characters, if it has over 1 exclamation mark per
#: MARK_WORDS words, or NAVIGATION separators or more.
SYMBOL_SHARE, MARK_WORDS, NAVIGATION = 20, 3, 3
#: A document goes if over LOST percent of its word characters were in failed lines.
LOST = 50
MIN_WORDS, MAX_REPEATED = 50, 50


def without(text: Column, chars: str) -> Column:
    """text without chars: a byte scan for each, as translate() makes a string of every character."""
    return functools.reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)


def n_of(text: Column, chars: str) -> Column:
    """How often chars, all of the same number of bytes, are in text."""
    (width,) = {len(c.encode()) for c in chars}
    gone = F.octet_length(text) - F.octet_length(without(text, chars))
    return gone if width == 1 else F.floor(gone / width).cast("int")


def blank(line: Column) -> Column:
    return ~line.rlike(r"[^\x20\x09-\x0D]")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda's argument is bound, not copied into the body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(hashes: Column) -> Column:
    """How many words the repeated 3-word windows cover, given the hash of every window in order."""
    spots = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        twice = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        # Out of bounds is null: neither a match nor, with the other side false, true.
        return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twice(x, i), F.get(s, i - 1)["h"] == x["h"], F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))

    def total(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    return let(let(spots, starts), total)


def line_fails(line: Column) -> Column:
    """Whether a line with a word fails one of the punctuation, navigation and boilerplate rules."""
    marks = line.contains("!") & (n_of(line, "!") * MARK_WORDS > size_words(line))
    symbols = line.rlike(f"[{SYMBOLS}]") & (n_of(line, SYMBOLS) * SYMBOL_SHARE > F.length(without(line, SPACES)))
    navigation = n_of(line, "|") + n_of(line, "»") + n_of(line, "•") >= NAVIGATION
    # lower() finds candidates fast, but also folds other letters to ASCII ones; the pattern folds A-Z only.
    low = let(F.lower(line), lambda x: functools.reduce(lambda a, p: a | x.contains(p), BOILERPLATE, F.lit(False)))
    return symbols | marks | navigation | (low & line.rlike("(?i)" + "|".join(BOILERPLATE)))


def size_words(line: Column) -> Column:
    """Words of a line, by the blanks in it: at least the words minus one."""
    return n_of(line, SPACES) + 1


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, failed_lines, kept_chars, clean_text).

    A null or empty text has no words and zeros; repeated rows stay. n_repeat_words compares windows by 64-bit hashes
    of their words. clean_text: the lines that passed, joined by line ends.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = base.select("doc_id", "text", words(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: ~blank(x)).alias("lines"))
    w = F.col("w")
    windows = F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(let(w, lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - 3), lambda i: F.xxhash64(F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)))))
    seen = cut.select("*", windows.alias("h"), F.filter("lines", lambda x: ~line_fails(x)).alias("good"))
    return seen.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        n_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # Most texts repeat no window; those skip the sort.
        F.when(F.size(F.array_distinct("h")) == F.size("h"), F.lit(0)).otherwise(_covered(F.col("h"))).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("good")).cast("long").alias("failed_lines"),
        F.when(F.size("lines") == F.size("good"), F.length(F.array_join("w", ""))).otherwise(F.length(without(F.array_join("good", "\n"), SPACES))).cast("long").alias("kept_chars"),
        F.array_join("good", "\n").alias("clean_text"),
    )


def clean(docs: DataFrame) -> DataFrame:
    """measure() with base_failed and kept; kept is false if base_failed, else whether enough text passed the line rules."""
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    enough = 100 * (F.col("word_chars") - F.col("kept_chars")) <= LOST * F.col("word_chars")
    return measure(docs).withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & enough)


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _sql_without(text: str, chars: str) -> str:
    return f"translate({text}, {chars}, '')"


def _sql_n(text: str, chars: str) -> str:
    return f"(length({text}) - length({_sql_without(text, chars)}))"


_PHRASES = " OR ".join(f"contains(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{p}')" for p in BOILERPLATE)
_FAILS = f"""({_sql_n("l", f"'{SYMBOLS}'")} * {SYMBOL_SHARE} > length({_sql_without("l", _BLANKS)})
  OR {_sql_n("l", "'!'")} * {MARK_WORDS} > {_sql_n("l", _BLANKS)} + 1
  OR {_sql_n("l", "'|' || chr(187) || chr(8226)")} >= {NAVIGATION} OR {_PHRASES})"""
#: The same rows in DuckDB.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, list_filter(string_split_regex(text, '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g2 AS (SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2]) AS n FROM g),
r AS (SELECT k, count(DISTINCT i + j) AS n FROM g2, (VALUES (0), (1), (2)) t(j) WHERE n > 1 GROUP BY k),
l AS (SELECT k, unnest(string_split(text, chr(10))) AS l FROM d),
l2 AS (SELECT k, l, length({_sql_without("l", _BLANKS)}) AS c FROM l WHERE length({_sql_without("l", _BLANKS)}) > 0),
s AS (SELECT k, count(*) - count(DISTINCT l) AS dup, coalesce(sum(c) FILTER (WHERE NOT {_FAILS}), 0) AS good FROM l2 GROUP BY k),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length({_sql_without("text", _BLANKS)})::BIGINT AS word_chars,
  {_sql_n("text", f"'{SYMBOLS}'")}::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(good, 0) AS good
  FROM d JOIN w USING (k) LEFT JOIN r USING (k) LEFT JOIN s USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words)
    AND 100 * (word_chars - good) <= {LOST} * word_chars AS kept
FROM m"""

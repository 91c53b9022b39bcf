"""Operator 8 [native]: quality rules.

A table of thresholds (``RULES``) over named statistics (``statistics``) is compiled into one
projection: word and line statistics, one boolean per rule, the verdict.  Only built-in
functions; no shuffle; every text is read whole.

Cases: null counts as the empty text (no words: fails).  Statistics of wordless texts are 0,
so ratios never divide by zero.  Repeated rows each give a row, an empty table none; texts are
read whole, whatever their length.  Statistics live in one
struct column, so other columns of the input cannot clash; only id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockledger.llm.common import ASCII_SPACE, let, read

REPEAT_WINDOW = 8
SYMBOLS = "#*$%&|<>"                  # fixed by the contract
# Frequent function words of the languages in the corpus.
STOP_WORDS = ("the of and to a in is that it for was on with be by as this are at from "
              "der die und den von zu das mit sich auf des für ist nicht dem im ein als eine "
              "de la le et les en un du une que pour est qui par dans sur au pas avec "
              "el y los se del las por no con su para al es una lo").split()


@dataclass(frozen=True)
class Rule:
    """The text fails when ``100 * stat < low * per`` or ``100 * stat > high * per``; limits in percent of ``per``.

    It applies to texts of at least ``min_words`` words (and a positive ``per``).
    """
    name: str
    stat: str
    per: str
    low: int | None = None
    high: int | None = None
    min_words: int = 20


# The threshold table.  Percentages are whole numbers: comparisons stay exact.
RULES = (
    Rule("short_mean_word", "word_chars", "n_words", low=200),
    Rule("long_mean_word", "word_chars", "n_words", high=1300),
    Rule("symbols", "n_symbols", "n_words", high=30),
    Rule("exclaimed_words", "n_exclaimed", "n_words", high=30),
    Rule("few_stop_words", "n_stop_words", "n_words", low=4, min_words=50),
    Rule("few_alphabetic_words", "n_alpha_words", "n_words", low=70),
    Rule("echoed_words", "n_echo_words", "n_words", high=30),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=30),
)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, ASCII_SPACE, -1), "")


def repeated_words(words: Column, n: int = REPEAT_WINDOW) -> Column:
    """Words inside windows of ``n`` words that occur twice or more in the text.

    Windows are compared by 64-bit hash; the sorted (hash, place) list and the sweep are
    only computed for texts whose hashes are not all distinct.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n)))

    def covered(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            twin = F.filter(p, lambda x, k: ((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | (F.get(p, k + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-n).alias("at"))
        return let(pairs, lambda p: F.aggregate(
            starts(p), zero,
            lambda a, i: F.struct((a["n"] + F.least(F.lit(n), i - a["at"])).cast("long").alias("n"), i.alias("at")),
            lambda a: a["n"]))

    none = F.lit(0).cast("long")
    return F.when(F.size(words) <= n, none).otherwise(
        let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), none).otherwise(covered(hs))))


def statistics(text: Column) -> Column:
    """struct of all statistics the rules may use."""
    stop = "(?iu)(?<![\\p{L}\\p{N}])(?:" + "|".join(sorted(STOP_WORDS)) + ")(?![\\p{L}\\p{N}])"
    # one pass over the lines that have a word
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_line = let(lines, lambda ls: F.struct(
        F.size(ls).cast("long").alias("n_lines"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(ls, lambda x: x.rlike(r"^\s*(?:[-*•‣▪+]|\d{1,3}[.)])\s"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(ls, lambda x: x.rlike(r"(?:\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis_lines")))
    by_word = let(words_of(text), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.size(F.filter(ws, lambda x, i: F.get(ws, i - 1) == x)).cast("long").alias("n_echo_words"), repeated_words(ws).alias("n_repeat_words")))
    return F.struct(
        by_word.alias("w"), by_line.alias("l"),
        F.length(F.regexp_replace(text, ASCII_SPACE, "")).cast("long").alias("word_chars"),
        count_of(text, "[" + SYMBOLS + "]").alias("n_symbols"),
        count_of(text, r"!(?=[\x20\x09-\x0D]|$)").alias("n_exclaimed"),
        count_of(text, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]*\p{L}[^\x20\x09-\x0D]*").alias("n_alpha_words"),
        count_of(text, stop).alias("n_stop_words"))


def fails(s: dict[str, Column], rule: Rule) -> Column:
    value, per = s[rule.stat] * 100, s[rule.per]
    out = F.lit(False)
    if rule.low is not None:
        out = out | (value < per * rule.low)
    if rule.high is not None:
        out = out | (value > per * rule.high)
    return (s["n_words"] >= rule.min_words) & (per > 0) & out


def apply_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, all statistics, base_failed, failed: names of the failed rules, kept)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), statistics(text).alias("s"))
    s = {c: F.col(f"s.{c}") for c in ("word_chars", "n_symbols", "n_exclaimed", "n_alpha_words", "n_stop_words")}
    s |= {c: F.col(f"s.w.{c}") for c in ("n_words", "n_echo_words", "n_repeat_words")}
    s |= {c: F.col(f"s.l.{c}") for c in ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")}
    base = (s["n_words"] < 20) | (s["n_repeat_words"] * 100 > s["n_words"] * 30)
    failed = F.filter(F.array(*[F.when(fails(s, r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return src.select("id", *[c.alias(n) for n, c in s.items()], base.alias("base_failed"), failed.alias("failed"),
                      (~base & (F.size(failed) == 0)).alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    out = apply_rules(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept")


def _sql_rule(r: Rule) -> str:
    parts = [f"{r.stat} * 100 < {r.per} * {r.low}"] * (r.low is not None) + [f"{r.stat} * 100 > {r.per} * {r.high}"] * (r.high is not None)
    return f"(n_words >= {r.min_words} AND {r.per} > 0 AND ({' OR '.join(parts)}))"


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
a AS (
  SELECT rid, doc_id, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws
  FROM d),
win AS (
  SELECT rid, i, ws[i:i + 7] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM a WHERE len(ws) > 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT x) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS x FROM rep) GROUP BY rid),
tok AS (
  SELECT rid, lower(tk) AS tk, count(*) AS c
  FROM (SELECT rid, unnest(regexp_extract_all(t, '[\p{L}\p{N}]+')) AS tk FROM d) GROUP BY ALL),
stop AS (SELECT rid, sum(c) AS n FROM tok WHERE tk IN (STOPS) GROUP BY rid),
s AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '^\s*(?:[-*•‣▪+]|\d{1,3}[.)])\s'))) AS n_bullet_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '(?:\.\.\.|…)\s*$'))) AS n_ellipsis_lines,
         coalesce(cov.n, 0) AS n_repeat_words, coalesce(stop.n, 0) AS n_stop_words,
         len(list_filter(ws, lambda x, i: x = ws[i - 1])) AS n_echo_words,
         len(list_filter(ws, lambda x: regexp_matches(x, '!$'))) AS n_exclaimed,
         len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS n_alpha_words
  FROM a LEFT JOIN cov USING (rid) LEFT JOIN stop USING (rid)),
v AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, FAILS AS rule_failed FROM s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT rule_failed AS kept
FROM v
""".replace("STOPS", ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))).replace("FAILS", " OR ".join(map(_sql_rule, RULES)))

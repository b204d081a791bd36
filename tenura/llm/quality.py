"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a DataFrame expression over the document's own text, so the
operator is one narrow projection: no shuffle, no Python.  Rows are kept or
rejected one by one; null texts have no words and are rejected by the base
rule, repeated rows are judged alike, and columns beside ``text`` pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK_RUN = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be this by are at from "
    "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als "
    "de la le et les des en un du une que est pour qui sur dans au par pas avec "
    "que el y los se del las por con no una su al para es lo"
).split()

#: As they stand in running text; words in capitals throughout don't count.
STOP_FORMS = tuple(dict.fromkeys([*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]))


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= amount / per <= high`` (``per`` at least 1)."""

    name: str
    amount: str
    per: str | None
    low: float | None = None
    high: float | None = None


#: The production table.  Ratios are per word unless ``per`` names another measure.
RULES = (
    Rule("words", "n_words", None, low=50),
    Rule("mean_word_chars", "word_chars", "n_words", low=2.5, high=12.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("shouted_lines", "n_shouted_lines", "n_lines", high=0.5),
)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


#: Up to so many repeated windows their places are looked up one by one.
FEW = 48


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Windows are compared by their 64-bit hash.  Distinct hashes settle many
    texts.  Else the sorted hashes tell the repeated ones; where those are few
    their places are looked up in the short list, and a text of many repeats
    sorts (hash, place) pairs instead, so that no text takes quadratic time."""
    starts = F.sequence(F.lit(0), F.size(words) - 3)

    def count(hashes):
        def covered(places):
            return F.aggregate(
                places, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
                lambda acc, i: F.struct(i.alias("last"),
                                        (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
                lambda acc: acc["n"])

        def by_lookup(twice):
            return covered(F.filter(starts, lambda i: F.array_contains(twice, F.get(hashes, i))))

        def by_sorting(o):
            def equal(x, y):
                return F.coalesce(x["h"] == y["h"], F.lit(False))
            found = F.filter(o, lambda x, k: equal(x, F.get(o, k - 1)) | equal(x, F.get(o, k + 1)))
            return covered(F.sort_array(F.transform(found, lambda x: x["i"])))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(
            s, lambda h, k: F.coalesce(F.get(s, k - 1) == h, F.lit(False)))))
        several = _let(twice, lambda t: F.when(F.size(t) <= FEW, by_lookup(t)).otherwise(_let(pairs, by_sorting)))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(several)

    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(hashes, count))


def measures(text: Column) -> Column:
    """One struct with every measure that the rules may use (longs)."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def of_words(t, words, lines):
        def number(x):
            return x.cast("long")
        return F.struct(
            number(F.size(words)).alias("n_words"),
            number(F.length(F.array_join(words, ""))).alias("word_chars"),
            number(F.regexp_count(t, F.lit(SYMBOLS))).alias("n_symbols"),
            number(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            number(F.size(lines)).alias("n_lines"),
            number(F.size(F.filter(words, lambda w: w.isin(*STOP_FORMS)))).alias("n_stop_words"),
            number(F.size(F.filter(lines, lambda x: x.rlike("!!") & (F.upper(x) == x)))).alias("n_shouted_lines"))

    return _let(text, lambda t: _let(
        F.array_remove(F.split(t, BLANK_RUN), ""),
        lambda words: _let(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(NOT_BLANK)),
                           lambda lines: of_words(t, words, lines))))


def compile_rules(m: Column, rules=RULES) -> Column:
    """The table as one boolean expression over the struct ``m``."""
    passed = F.lit(True)
    for r in rules:
        value = m[r.amount] / F.greatest(m[r.per], F.lit(1)) if r.per else m[r.amount]
        if r.low is not None:
            passed = passed & (value >= F.lit(r.low))
        if r.high is not None:
            passed = passed & (value <= F.lit(r.high))
    return passed


def base_failed(m: Column) -> Column:
    """Under 50 words, or over half of them in repeated windows."""
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def judge(docs: DataFrame, text: str = "text", rules=RULES, measured: str = "__quality") -> DataFrame:
    """``docs`` with one more column: a struct of the measures, base_failed and kept."""
    return docs.withColumn(measured, _let(measures(F.col(text)), lambda m: m.withField("base_failed", base_failed(m))
                                          .withField("kept", _kept(m, rules))))


def _kept(m: Column, rules) -> Column:
    return ~base_failed(m) & compile_rules(m, rules)


def keep_good(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.  The verdict is one
    expression: as a column that a filter reads, every measure would be worked
    out again for each rule when Spark pushes the filter down."""
    return docs.where(_let(measures(F.col(text)), lambda m: _kept(m, rules)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and measures of every document."""
    q = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return q.select("doc_id", *[F.col("__quality")[c].alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def _oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_FORMS)
    values = {r: f"({r.amount} / greatest({r.per}, 1))" if r.per else r.amount for r in RULES}
    tests = [f"{v} >= {r.low}" for r, v in values.items() if r.low is not None]
    tests += [f"{v} <= {r.high}" for r, v in values.items() if r.high is not None]
    blank = r"[\x20\x09-\x0D]"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{blank}+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM c WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(l) AS n_lines, len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop_words,
         len(list_filter(l, lambda x: contains(x, '!!') AND upper(x) = x)) AS n_shouted_lines
  FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(tests)} AS kept
FROM f"""


QUERIES = {"op9_quality_rules": op9_quality_rules}
SQL = {"op9_quality_rules": _oracle()}

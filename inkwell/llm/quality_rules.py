"""Operator 5 (native): quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger holds its failure bits and the measurements behind them. A policy is
a named version: a mask of the rules that drop a document. Applying a policy, or comparing policies, is bit arithmetic on the ledger
and never touches the text again; ablations are bitwise aggregates over the masks. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

WORD_GAP = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rules in the order of their bits. Each tests measured columns and holds where the document fails. Integers only.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 12 * n_words",
}
BASE = ("few_words", "repeated_words")

#: Versioned policies: the rules that drop a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE,
    "strict-1": tuple(RULES),
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Words are maximal runs of characters other than ASCII blanks. Null and empty texts measure 0 everywhere. Lines count
    if they have a word. A word counts as repeated if one of the 3-word windows it is in is found twice or more in the text; windows are
    compared by 64-bit hashes within one text. Repeated rows and null ids are rows like any other, an empty table gives none, and other
    columns are left out, so their names can't clash. Repeats come from a sort of (hash, position) inside the row, where two windows have
    one hash: no row leaves its task, however long a text is, and time is n log n in its words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Each select below holds what later ones use more than once
    words = F.filter(F.split(text, WORD_GAP, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, BLANK_CHARS, "") != "")
    solid = F.translate(text, BLANK_CHARS, "")
    base = docs.select(F.col(id_col), words.alias("w"), lines.alias("l"), F.length(solid).cast("long").alias("word_chars"), (F.length(solid) - F.length(F.translate(solid, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    counted = base.select(
        id_col, "word_chars", "n_symbols", F.size("w").cast("long").alias("n_words"), F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    third = F.slice("h", 3, F.greatest(F.size("h") - 2, F.lit(0)))
    window = F.zip_with(F.zip_with(F.slice("h", 1, F.size(third)), F.slice("h", 2, F.size(third)), lambda a, b: F.xxhash64(a, b)), third, lambda a, b: F.xxhash64(a, b))
    hashed = counted.select("*", window.alias("v")).drop("h")
    # sort_array compares in generated code, array_sort by a function that is interpreted; without repeats there is nothing to sort
    repeats = F.size(F.array_distinct("v")) < F.size("v")
    sort = hashed.select("*", F.when(repeats, F.sort_array(F.transform("v", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s")).drop("v")
    n = F.size("s")
    # neighbours in the sorted array: before[k] = s[k-1], after[k] = s[k+1]; a window is repeated if one of them has its hash
    marked = F.zip_with(F.zip_with("s", F.slice("s", 2, n), lambda a, b: F.struct(a.x.alias("x"), a.i.alias("i"), F.coalesce(a.x == b.x, F.lit(False)).alias("next"))), F.concat(F.array(F.lit(None).cast("bigint")), F.transform(F.slice("s", 1, F.greatest(n - 1, F.lit(0))), lambda a: a.x)), lambda a, b: F.struct(a.i.alias("i"), (a.next | F.coalesce(a.x == b, F.lit(False))).alias("hit")))
    places = F.array_sort(F.transform(F.filter(marked, lambda a: F.coalesce(a.hit, F.lit(False))), lambda a: a.i))
    found = sort.select("*", places.alias("p")).drop("s")
    covered = F.zip_with("p", F.slice("p", 2, F.size("p")), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    return found.select(id_col, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long")).alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements of measure() and ``failures``, the bits of all rules that the document fails."""
    bits: list[Column] = [F.when(F.expr(test), F.lit(bit(rule))).otherwise(F.lit(0)) for rule, test in RULES.items()]
    return measure(docs, id_col, text_col).withColumn("failures", reduce(lambda a, b: a.bitwiseOR(b), bits))


def apply_policy(book: DataFrame, policy: str) -> DataFrame:
    """Adds ``kept``: no rule of the policy fails. ``book`` is a ledger, stored or not."""
    return book.withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """One row per rule of the policy: documents that fail it, that only it drops, that stay if it is left out, and the bits of the
    policy's rules that fail with it in some (with_some) or in every (with_all) document that fails it.

    The ledger is first counted by its failure bits within the policy, at most 2^rules rows; each of these stands once for every
    rule, and bit operations and bitwise aggregates do the rest. Repeated rows count each; an empty ledger gives zeros.
    """
    whole = mask(policy)
    counts = book.groupBy(F.col("failures").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    # a row without documents for every rule, so that rules that nothing fails are in the result
    counts = counts.unionByName(book.sparkSession.range(1).select(F.lit(0).alias("bits"), F.lit(0).cast("long").alias("n")))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).alias("bit")) for r in POLICIES[policy])))
    each = counts.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit", F.col("bits").bitwiseAND(F.col("r.bit")).alias("hit"), F.col("bits").bitwiseXOR(F.col("r.bit")).alias("other"))
    fails = F.when(F.col("hit") != 0, F.col("other"))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("hit") != 0, F.col("n")).otherwise(0)).alias("n_fail"),
        F.sum(F.when(F.col("other") == 0, F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when((F.col("bits") == 0) | (F.col("other") == 0), F.col("n")).otherwise(0)).alias("kept_without"),
        F.coalesce(F.bit_or(fails), F.lit(0)).cast("long").alias("with_some"),
        F.coalesce(F.bit_and(fails), F.lit(0)).cast("long").alias("with_all"),
    )


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Whole documents table: the ledger is stored once, then read under policy strict-1, whose mask holds the two base rules."""
    book = apply_policy(stored(ledger(table(spark, sf_dir, "documents")), "ledger"), "strict-1")
    base = sum(bit(r) for r in BASE)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failures").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept", F.col("failures").cast("long").alias("failures"), F.lit("strict-1").alias("policy"))


def quality_ablations(spark, sf_dir: str) -> DataFrame:
    """The ablation report of strict-1 over the whole documents table."""
    return ablations(ledger(table(spark, sf_dir, "documents")), "strict-1")


_LEDGER_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM k WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 3 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 12 * n_words THEN 32 ELSE 0 END)::BIGINT AS failures FROM m)
"""

OP5_SQL = _LEDGER_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed,
       failures = 0 AS kept, failures, 'strict-1' AS policy
FROM f
"""

_RULE_ROWS = ", ".join(f"('{r}', {bit(r)})" for r in POLICIES["strict-1"])
ABLATION_SQL = f"""{_LEDGER_SQL}
SELECT rule, count(*) FILTER (WHERE failures & b <> 0) AS n_fail, count(*) FILTER (WHERE failures = b) AS n_only, count(*) FILTER (WHERE failures IN (0, b)) AS kept_without,
       coalesce(bit_or(failures - b) FILTER (WHERE failures & b <> 0), 0)::BIGINT AS with_some, coalesce(bit_and(failures - b) FILTER (WHERE failures & b <> 0), 0)::BIGINT AS with_all
FROM (VALUES {_RULE_ROWS}) AS r (rule, b) LEFT JOIN f ON true
GROUP BY rule
"""

"""Quality rules as a bitmask ledger, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Each rule's bit, its name and when it fails, over the measurements. The first two are the base rules.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "4 * n_symbols > n_words"),
    ("duplicate_lines", "n_lines > 1 AND 2 * n_dup_lines > n_lines"),
    ("long_words", "word_chars > 15 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("capitals", "2 * n_capitals > word_chars"),
)
#: Versions of the policy: the rules that a document must not fail.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "symbols", "duplicate_lines"),
    "v2": tuple(name for name, _ in RULES),
}
BASE = "base"


def bit(name: str) -> int:
    return 1 << [n for n, _ in RULES].index(name)


def mask(policy: str) -> int:
    return sum(map(bit, POLICIES[policy]))


def _repeats(words: Column) -> Column:
    """Words within windows of three words that occur twice or more in the array, each word once.

    Windows are compared by XXH64 of their three words. Sorted with their places, equal ones are
    neighbours; the places of those are sorted again, and each adds up to three words, less what the next covers.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(words, i), F.lit(" "), F.element_at(words, i + 1), F.lit(" "), F.element_at(words, i + 2)))
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, i: F.get(a, i)["h"].eqNullSafe(F.get(a, i - 1)["h"]) | F.get(a, i)["h"].eqNullSafe(F.get(a, i + 1)["h"])
    twice = lambda a: F.filter(F.transform(a, lambda x, i: F.when(same(a, i), x["i"])), lambda x: x.isNotNull())
    sum_up = F.aggregate(
        F.array_sort(F.flatten(F.transform(F.array(placed), twice))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    some = F.flatten(F.transform(F.array(hashes), lambda a: F.array(F.size(F.array_distinct(a)) < F.size(a))))
    return F.when(n < 4, F.lit(0).cast("long")).when(F.element_at(some, 1), sum_up).otherwise(F.lit(0).cast("long"))


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, failed): every measurement and rule once for each row of docs (doc_id, text, ...).

    Measurements are long: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals.
    `failed` has the bit of each failed rule. A null text is one without words. Repeated rows give a row each.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), words.alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    count = lambda chars: (F.length("text") - F.length(F.translate("text", chars, ""))).cast("long")
    measured = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        count("#*$%&|<>").alias("n_symbols"),
        _repeats(F.col("words")).alias("n_repeat_words"),
        lines.alias("lines"),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
    )
    measured = measured.select("*", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines")).drop("lines")
    failed = sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)), F.lit(0))
    return measured.withColumn("failed", failed.cast("long"))


def passes(failed: Column, policy: str) -> Column:
    return failed.bitwiseAND(mask(policy)) == 0


def judged(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with base_failed and kept: kept is false if a base rule fails, else what the policy says."""
    rows = ledger(docs)
    base = ~passes(rows["failed"], BASE)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & passes(rows["failed"], policy)).alias("kept"), rows["failed"].alias("failed_bits"),
    )


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """(rule, n_failed, n_only): of a ledger, the rows that each rule of the policy turns away, and those that no other of its rules does.

    One aggregation to the few bit patterns that occur, then bitwise sums over them.
    """
    patterns = rows.groupBy(F.col("failed").bitwiseAND(mask(policy)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = POLICIES[policy]
    sums = [F.sum(F.when(F.col("bits").bitwiseAND(bit(r)) != 0, F.col("n")).otherwise(0)) for r in names]
    only = [F.sum(F.when(F.col("bits") == bit(r), F.col("n")).otherwise(0)) for r in names]
    row = patterns.agg(F.array(*(F.struct(F.lit(r).alias("rule"), F.coalesce(a, F.lit(0)).cast("long").alias("n_failed"), F.coalesce(b, F.lit(0)).cast("long").alias("n_only")) for r, a, b in zip(names, sums, only))).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.*")


def oracle_sql(policy: str = "v2") -> str:
    """The same for DuckDB."""
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, (_, rule) in enumerate(RULES))
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i:i + 2])) AS three
  FROM w WHERE len(words) >= 4
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, three) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 3) AS r(k) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id
), f AS (
  SELECT *, CAST({bits} AS BIGINT) AS failed_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & {mask(BASE)} <> 0 AS base_failed,
       failed_bits & {mask(BASE) | mask(policy)} = 0 AS kept, failed_bits
FROM f
"""


def ablation_sql() -> str:
    """ablation() of each policy for DuckDB."""
    parts = []
    for policy, names in POLICIES.items():
        for r in names:
            parts.append(f"SELECT '{policy}' AS policy, '{r}' AS rule, count(*) FILTER (failed_bits & {bit(r)} <> 0) AS n_failed, count(*) FILTER (failed_bits & {mask(policy)} = {bit(r)}) AS n_only FROM l")
    return f"WITH l AS ({oracle_sql()})\n" + "\nUNION ALL ".join(parts)

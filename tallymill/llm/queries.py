"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import scratch_path
from . import bpe, collocations, decontaminate, jaccard_join, language, licenses, quality, rules, simhash, spelling, substring, token_files, toxicity
from .common import documents, materialize


#: The tokenizer file, of the public vocabularies; it stays where it is.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), TOKENIZER)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), words=3, radius=3)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(documents(spark, sf_dir))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(documents(spark, sf_dir))


def rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents is stored once; each policy is then applied to its bits."""
    rows = materialize(rules.ledger(documents(spark, sf_dir)).select("doc_id", "failed"))
    each = [rules.ablation(rows, policy).select(F.lit(policy).alias("policy"), "rule", "n_failed", "n_only") for policy in rules.POLICIES]
    return reduce(DataFrame.unionByName, each)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark)
    token_files.write(documents(spark, sf_dir), TOKENIZER, path)
    return token_files.digests(spark, path)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(documents(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, unnest(range(0, len(words) - 19)) AS start,
         unnest(list_transform(range(1, len(words) - 18), lambda i: array_to_string(words[i:i + 19], ' '))) AS content
  FROM w WHERE len(words) >= 20
), later AS (
  SELECT doc_id, start FROM (
    SELECT doc_id, start, min({'d': doc_id, 's': start}) OVER (PARTITION BY content) AS least FROM windows
  ) WHERE {'d': doc_id, 's': start} > least
), gone AS (
  SELECT DISTINCT doc_id, start + k AS pos FROM later, range(0, 20) AS r(k)
), each AS (
  SELECT doc_id, unnest(range(0, len(words))) AS pos, unnest(words) AS word FROM w
), kept AS (
  SELECT e.doc_id, count(*) AS n_words, count(g.pos) AS n_removed,
         coalesce(string_agg(e.word, ' ' ORDER BY e.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_language": op3_language,
    "op4_licenses": op4_licenses,
    "op5_decontaminate": op5_decontaminate,
    "op6_substring": op6_substring,
    "op7_toxicity": op7_toxicity,
    "op8_rules": op8_rules,
    "rules_ablation": rules_ablation,
    "op9_quality": op9_quality,
    "op10_token_files": op10_token_files,
    "op11_spelling": op11_spelling,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL: dict[str, str] = {
    "op4_licenses": licenses.oracle_sql(),
    "op6_substring": OP6_SQL,
    "op8_rules": rules.oracle_sql(),
    "rules_ablation": rules.ablation_sql(),
    "op12_jaccard_join": jaccard_join.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
}

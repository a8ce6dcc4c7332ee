"""Licence scans by a positional index of rare words, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label, whether it is of the base, the template's words, and its mandatory phrase (part of them).
TEMPLATES: tuple[tuple[str, bool, str, str], ...] = (
    ("cc-by", True, "cc by", "cc by"),
    ("gpl", True, "general public license", "general public license"),
    ("reserved", True, "all rights reserved", "all rights reserved"),
    ("apache-2.0", False, "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit", False, "released under the mit license", "mit license"),
    ("gpl-3.0", False, "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", False, "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", False, "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", False, "licensed under the gnu affero general public license", "affero general public license"),
    ("cc-by-nc", False, "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", False, "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", False, "licensed under cc by nd 4 0", "cc by nd"),
    ("cc0", False, "released under cc0 1 0 universal", "cc0 1 0"),
    ("bsd-3-clause", False, "licensed under the bsd 3 clause license", "bsd 3 clause"),
    ("bsd-2-clause", False, "licensed under the bsd 2 clause license", "bsd 2 clause"),
    ("mpl-2.0", False, "licensed under the mozilla public license version 2 0", "mozilla public license"),
    ("epl", False, "licensed under the eclipse public license", "eclipse public license"),
    ("isc", False, "released under the isc license", "isc license"),
    ("unlicense", False, "released into the public domain under the unlicense", "the unlicense"),
    # from the licences' own texts and notices
    ("mit", False, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "person obtaining a copy of this software and associated documentation files"),
    ("bsd", False, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", False, "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "names of its contributors may be used to endorse or promote products"),
    ("isc", False, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2.0", False, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "software distributed under the license is distributed on an as is basis"),
    ("gpl-3.0-or-later", False, "either version 3 of the license or at your option any later version", "version 3 of the license or at your option any later version"),
    ("gpl-2.0-or-later", False, "either version 2 of the license or at your option any later version", "version 2 of the license or at your option any later version"),
    ("unlicense", False, "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    ("bsl-1.0", False, "distributed under the boost software license version 1 0", "boost software license version 1 0"),
    ("zlib", False, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "versions must be plainly marked as such and must not be misrepresented"),
)
#: Words a template is looked up by: so many of its mandatory phrase, those of the highest IDF.
RARE = 2
#: What separates words: all ASCII but digits and small letters (A-Z is lower-cased before).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BETWEEN), "")


def document_frequencies(docs: DataFrame) -> dict[str, int]:
    """In how many of all documents each licence word is, from one pass; as many entries as the templates have words."""
    vocabulary = sorted({w for _, _, _, phrase in TEMPLATES for w in phrase.split()})
    found = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("w"))
    n = dict.fromkeys(vocabulary, 0)
    return n | {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def postings(frequency: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """rare word -> (template, place in the template), for the RARE words of highest IDF (least frequency) of each mandatory phrase."""
    index: dict[str, list[tuple[int, int]]] = {}
    for k, (_, _, template, phrase) in enumerate(TEMPLATES):
        words, key = template.split(), phrase.split()
        start = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        rare = sorted(dict.fromkeys(key), key=lambda w: (frequency.get(w, 0), w))[:RARE]
        for w in rare:
            index.setdefault(w, []).extend((k, start + i) for i, x in enumerate(key) if x == w)
    return index


def _starts(words: Column, k: int, entries: dict[str, list[int]]) -> Column:
    """Where template k's mandatory phrase stands, by its first word's place in the file.

    Each place of the rarest word gives one start; of the other rare words' postings those must agree on
    it, and then every word of the phrase must stand in its place.
    """
    _, _, template, phrase = TEMPLATES[k]
    whole, key = template.split(), phrase.split()
    lead = next(i for i in range(len(whole)) if whole[i : i + len(key)] == key)
    first, *others = entries
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == first)
    at = F.flatten(F.transform(places, lambda i: F.array(*(i - (p - lead) for p in entries[first]))))
    agree = lambda i: reduce(lambda a, b: a & b, (reduce(or_, (F.get(words, i + p - lead).eqNullSafe(F.lit(w)) for p in entries[w])) for w in others), F.lit(True))
    verify = lambda i: reduce(lambda a, b: a & b, (F.get(words, i + j).eqNullSafe(F.lit(w)) for j, w in enumerate(key)))
    return F.filter(F.array_distinct(at), lambda i: (i >= 0) & agree(i) & verify(i))


def _share(words: Column, starts: Column, k: int) -> Column:
    """The largest share of template k's words that stand in their places around a found phrase."""
    _, _, template, phrase = TEMPLATES[k]
    whole, key = template.split(), phrase.split()
    lead = next(i for i in range(len(whole)) if whole[i : i + len(key)] == key)
    here = lambda i: sum((F.get(words, i - lead + j).eqNullSafe(F.lit(w)).cast("int") for j, w in enumerate(whole)), F.lit(0))
    return F.array_max(F.transform(starts, lambda i: here(i) / len(whole)))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs (doc_id, text, ...).

    n_base counts all places of base phrases, first_word and last_word are their smallest and largest
    start (null without one); labels has the other templates' labels too. The score is the largest share
    of a found template's words in place, 0 without one. A null text has no words. Only rows that hold
    one of the index's words are looked at further. Repeated rows give a row each.
    """
    frequency = document_frequencies(docs)
    index = postings(frequency)
    entries: list[dict[str, list[int]]] = [{} for _ in TEMPLATES]
    for w in sorted(index, key=lambda w: (frequency[w], w)):  # so each template's rarest is its first
        for k, place in index[w]:
            entries[k].setdefault(w, []).append(place)
    rows = docs.select(F.col("doc_id").cast("long"), words_of(F.col("text")).alias("words"))
    # in each row the starts of each template, or null where the row has no word of the index
    some = F.arrays_overlap("words", F.array(*map(F.lit, sorted(index))))
    none = F.array().cast("array<int>")
    each = [F.when(F.array_contains("words", next(iter(e))), _starts(F.col("words"), k, e)).otherwise(none).alias(f"t{k}") for k, e in enumerate(entries)]
    found = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), "words", F.when(some, F.struct(*each)).alias("at"))
    label = lambda k: F.when(F.size(F.col(f"at.t{k}")) > 0, F.lit(TEMPLATES[k][0]))
    names = lambda ks: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.array(*map(label, ks)))), ","), F.lit(""))
    base = [k for k, t in enumerate(TEMPLATES) if t[1]]
    places = F.when(F.col("at").isNotNull(), F.flatten(F.array(*(F.col(f"at.t{k}") for k in base)))).otherwise(none)
    shares = F.when(F.col("at").isNotNull(), F.array_max(F.array(*(_share(F.col("words"), F.col(f"at.t{k}"), k) for k in range(len(TEMPLATES))))))
    return found.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        names(base).alias("base_labels"), names(range(len(TEMPLATES))).alias("labels"), F.round(F.coalesce(shares, F.lit(0.0)), 6).alias("score"),
    )


def oracle_sql() -> str:
    """The same for DuckDB: phrases as text between single spaces."""
    has = lambda phrase: f"contains(line, ' {phrase} ')"
    names = lambda ts: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {has(t[3])} THEN '{t[0]}' END" for t in ts) + "], lambda x: x IS NOT NULL))), ',')"
    starts = lambda phrase: f"list_filter(range(1, len(words) + 1), lambda i: array_to_string(words[i:i + {len(phrase.split()) - 1}], ' ') = '{phrase}')"
    base = [t for t in TEMPLATES if t[1]]
    shares = []
    for _, _, template, phrase in TEMPLATES:
        whole, key = template.split(), phrase.split()
        lead = next(i for i in range(len(whole)) if whole[i : i + len(key)] == key)
        here = " + ".join(f"(CASE WHEN i - {lead} + {j} >= 1 AND words[i - {lead} + {j}] = '{w}' THEN 1 ELSE 0 END)" for j, w in enumerate(whole))
        shares.append(f"CASE WHEN {has(phrase)} THEN list_max(list_transform({starts(phrase)}, lambda i: ({here}) / {float(len(whole))})) ELSE 0 END")
    return f"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents
), l AS (
  SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS line FROM w
), b AS (
  SELECT *, CASE WHEN {" OR ".join(has(t[3]) for t in base)} THEN flatten([{", ".join(starts(t[3]) for t in base)}]) ELSE [] END AS places FROM l
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
       CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
       {names(base)} AS base_labels, {names(TEMPLATES)} AS labels,
       round(CAST(greatest({", ".join(shares)}) AS DOUBLE), 6) AS score
FROM b
"""

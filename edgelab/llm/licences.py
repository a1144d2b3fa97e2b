"""Canonical digest lookup of licence texts, with DataFrame functions only.

A text is normalised - case, copyright statements, equivalent spellings, punctuation and white space - and the SHA-256 of the
whole result is hash-joined to the digests of known licences. The same is done for each line, so that a notice within a
document is found as a text of its own. A copyright statement is a line that begins with one and names a year, up to where
the licence's own words begin. Null texts count as empty; empty texts match nothing; repeated rows get equal results; texts
and lines of any length are digested whole. Of two known licences with one digest, the first by name wins. Extra columns
are ignored, whatever their names; an empty table gives an empty result. The known digests are a list that the caller
holds, which bounds the broadcast; a document's notices are the sorted distinct licences of its lines.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licence_texts import KNOWN

#: Spellings taken as one (fixed values).
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("organisation", "organization"), ("favour", "favor"), ("per cent", "percent"), ("copyright owner", "copyright holder")]
_WORD_GAP = re.compile("[- ]")
# Patterns in a syntax that the JVM's and DuckDB's regular expressions share.
COPYRIGHT = "^[ \t#*/;-]*(?:copyright|\\(c\\)|©).*?[0-9]{4}.*?(permission is|permission to|redistribution and|licensed under|released under|this software|this work|$)"
SIGNS = "[^a-z0-9\\x{80}-\\x{10ffff}]+"


def _spelled(x: Column) -> Column:
    """One spelling; words stand between single spaces."""
    x = F.replace(x, F.lit(" "), F.lit("  "))  # so that each word has its own spaces
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(f" {_WORD_GAP.sub('  ', a)} "), F.lit(f" {_WORD_GAP.sub('  ', b)} "))
    return F.replace(x, F.lit("  "), F.lit(" "))


def canonical_lines(text: Column) -> Column:
    """The normalised lines of a text, each between spaces, without copyright statements."""
    lines = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n"), lambda x: F.regexp_replace(x, F.lit(COPYRIGHT), F.lit("$1")))
    return F.transform(lines, lambda x: F.regexp_replace(F.concat(F.lit(" "), x, F.lit(" ")), SIGNS, " "))


def canonical(lines: Column) -> Column:
    """Normalised lines as one text."""
    return F.trim(_spelled(F.concat(F.lit(" "), F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), " "), F.lit(" "))))


def _sha(x: Column) -> Column:
    return F.when(x != "", F.sha2(x, 256))


def digest(text: Column) -> Column:
    """Hex SHA-256 of the normalised text; null if nothing is left of it."""
    return _sha(canonical(canonical_lines(text)))


def known_digests(spark, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(digest, licence) of the known texts: as many rows as the list has, or fewer."""
    rows = spark.createDataFrame(known, "licence string, known string")
    return rows.select(digest(F.col("known")).alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(documents: DataFrame, known_texts: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """doc_id, text_digest, text_licence (null if unknown), notices (sorted distinct licences of lines), n_notices (such lines).
    known_texts: (SPDX identifier, text) of each licence looked for, such as a folder of licence files holds."""
    known = known_digests(documents.sparkSession, known_texts)
    entries = [F.lit(x) for r in known.collect() for x in (r["digest"], r["licence"])]  # the fixed list
    by_digest = F.create_map(*entries)
    # Lines are looked up in place, which keeps a document's row whole and deals nothing.
    cut = documents.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    hits = F.filter(F.transform("lines", lambda x: by_digest[F.sha2(F.trim(_spelled(x)), 256)]), lambda x: x.isNotNull())
    whole = cut.select("doc_id", _sha(canonical(F.col("lines"))).alias("text_digest"), hits.alias("hits")).join(F.broadcast(known.withColumnRenamed("licence", "text_licence")), F.col("text_digest") == F.col("digest"), "left")
    return whole.select("doc_id", "text_digest", "text_licence", F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("notices"), F.size("hits").cast("long").alias("n_notices"))


def scan_sql(source: str) -> str:
    """The same in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def spelled(x: str) -> str:
        x = f"replace({x}, ' ', '  ')"
        for a, b in SPELLINGS:
            x = f"replace({x}, ' {_WORD_GAP.sub('  ', a)} ', ' {_WORD_GAP.sub('  ', b)} ')"
        return f"replace({x}, '  ', ' ')"

    def lines(x: str) -> str:
        kept = f"list_transform(string_split(lower(coalesce({x}, '')), chr(10)), lambda x: regexp_replace(x, {quote(COPYRIGHT)}, '\\1'))"
        return f"list_transform({kept}, lambda x: regexp_replace(' ' || x || ' ', {quote(SIGNS)}, ' ', 'g'))"

    def digest_of(cut: str) -> str:
        joined = f"coalesce(array_to_string(list_filter(list_transform({cut}, lambda x: trim(x)), lambda x: x <> ''), ' '), '')"
        return f"sha256(nullif(trim({spelled(f"' ' || {joined} || ' '")}), ''))"

    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in KNOWN)
    return f"""
WITH known AS (SELECT {digest_of(lines('k'))} AS digest, min(l) AS licence FROM (VALUES {values}) v(l, k) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS rn, doc_id, {lines('text')} AS cut FROM {source}),
lines AS (SELECT rn, unnest(cut) AS line FROM docs),
hits AS (SELECT rn, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS names FROM lines JOIN known ON known.digest = sha256(nullif(trim({spelled('line')}), '')) GROUP BY rn),
whole AS (SELECT rn, doc_id, {digest_of('cut')} AS text_digest FROM docs)
SELECT doc_id, text_digest, known.licence AS text_licence, coalesce(names, '') AS notices, CAST(coalesce(n, 0) AS BIGINT) AS n_notices
FROM whole LEFT JOIN known ON known.digest = text_digest LEFT JOIN hits USING (rn)"""

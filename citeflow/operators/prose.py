"""Operators on review text: citations, headings, sentences, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A citation of a key in text.
CITATION = r"\[@([\w\-:]+)\]"


def keys(text: Column) -> Column:
    """Citation keys of a text in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(1))


def occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, cited): each citation with its number in the text."""
    return docs.select(key, F.posexplode(keys(F.col(text))).alias("pos", "cited"))


def under_headings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, cited, section): each citation with the nearest heading before
    it. The text is split at headings, so a citation finds its own without a
    range join."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n(?=## )")
    rows = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(parts).alias("part", "block"))
    rows = rows.select(key, "part", F.nullif(F.regexp_extract("block", r"^## ([^\n]*)", 1), F.lit("")).alias("section"), F.posexplode(keys(F.col("block"))).alias("nth", "cited"))
    return rows.select(key, "part", "nth", "cited", "section")


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, size): characters under each heading, the first of equal
    headings."""
    rows = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.concat(F.lit("\n"), F.col(text)), r"\n(?=## )")).alias("part", "block"))
    rows = rows.where(F.col("block").startswith("## ")).select(key, "part", F.trim(F.regexp_extract("block", r"^## ([^\n]*)", 1)).alias("section"), F.length(F.regexp_replace("block", r"^## [^\n]*\n?", "")).alias("size"))
    return rows.groupBy(key, "section").agg(F.min_by("size", "part").alias("size"))


def cited_sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, nth, cited, sentence): for each citation the text of its line
    since the citation before it, without marks, trimmed."""
    lines = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line", "t")).where(F.col("t").contains("[@"))
    spans = F.split("t", CITATION)
    rows = lines.select(key, "line", F.posexplode(F.arrays_zip(keys(F.col("t")).alias("cited"), spans.alias("span"))).alias("nth", "z"))
    return rows.where("z.cited IS NOT NULL").select(key, "line", "nth", F.col("z.cited").alias("cited"), F.trim(F.regexp_replace("z.span", r"^[\s.;,]+", "")).alias("sentence"))


def pipe_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, verdict, item, reason): rows of a screening table, written
    as ``n | verdict | item | reason``."""
    lines = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line", "t"))
    cells = F.transform(F.split("t", r"\|"), lambda x: F.trim(x))
    rows = lines.where(F.col("t").rlike(r"^\s*\d+\s*\|")).select(key, "line", cells.alias("c")).where(F.size("c") >= 4)
    return rows.select(key, "line", F.lower(F.col("c")[1]).alias("verdict"), F.col("c")[2].alias("item"), F.col("c")[3].alias("reason"))


def front_matter(text: Column, field: str) -> Column:
    """A field of a card's front matter; null where there is none."""
    block = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)^---\n(.*?)\n---", 1)
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?m)^{field}:[ ]*(.*)$", 1)), F.lit(""))


def bigrams(word: Column) -> Column:
    """Character pairs of a string."""
    return F.when(F.length(word) >= 2, F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def content_terms(text: Column) -> Column:
    """Distinct content terms: Latin words of four and more letters, and the
    character pairs of Chinese runs."""
    low = F.lower(F.coalesce(text, F.lit("")))
    latin = F.regexp_extract_all(low, F.lit(r"[a-z]{4,}"), F.lit(0))
    han = F.flatten(F.transform(F.regexp_extract_all(low, F.lit("[\\x{4e00}-\\x{9fff}]{2,}"), F.lit(0)), bigrams))
    return F.array_distinct(F.concat(latin, han))

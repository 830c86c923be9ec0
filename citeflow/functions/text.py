"""Scalar text functions as column expressions (JVM side, no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"[^\p{L}\p{M}\p{N}]+"


def plain(text: Column) -> Column:
    """Markup tags and entities replaced by a blank, white space squeezed,
    trimmed. Null stays null."""
    text = F.regexp_replace(text, r"<[^<>]{0,200}>", " ")
    text = F.regexp_replace(text, r"&(?:[a-zA-Z]{2,8}|#\d{1,6});", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def word_list(text: Column) -> Column:
    """Lower-cased words of a text in order, repeats too, without markup and
    punctuation; an empty list for null."""
    parts = F.split(F.regexp_replace(F.lower(plain(F.coalesce(text, F.lit("")))), WORD_BREAK, " "), " ")
    return F.filter(parts, lambda w: w != "")


def words(text: Column) -> Column:
    """The distinct words of ``word_list`` in order of first occurrence."""
    return F.array_distinct(word_list(text))


def doi_key(raw: Column) -> Column:
    """One form for a DOI however it is written: no resolver or ``doi:``
    prefix, ``%2F`` decoded, trimmed of closing punctuation, lower case. Null
    where nothing of the form ``10.x/y`` is left."""
    x = F.lower(F.trim(F.regexp_replace(raw, r"\s+", " ")))
    x = F.regexp_replace(x, "%2f", "/")
    x = F.regexp_replace(x, r"^(?:https?://[^/]+/+|(?:www\.)?(?:dx\.)?doi\.org/+)(?=.*10\.)", "")
    x = F.regexp_replace(x, r"^(?:urn:|info:)?doi\s*[:/]?\s*", "")
    x = F.regexp_replace(x, r"[\s.,;:)\]}>\"']+$", "")
    return F.when(x.rlike(r"^10\.\d+/\S"), x)


def loose_key(raw: Column) -> Column:
    """A key lower-cased, without surrounding white space (tabs and Unicode
    blanks too); null for a blank one."""
    x = F.regexp_replace(F.lower(raw), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.when(x != "", x)

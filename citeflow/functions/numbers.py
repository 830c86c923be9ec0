"""Numbers in text: extraction and comparison as decimals, in the JVM.

A text is read by one scanner. Each atom that it finds is a name with digits, an
index, a publication year or a number; only the last has the group that is kept,
so nothing is rewritten before numbers are looked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may stand between groups of three digits, LaTeX's thin spaces among it.
GAP = r"(?:,|\s|\{,\}|\\[,;\s])"
#: Four digits that may be a year.
YEAR = r"(?:19|20)\d\d"
#: Kinds of atoms, the first that fits counts.
ATOMS = {
    "index": r"[_^]\s*(?:\{[^{}]*\}|[A-Za-z0-9]+)",
    "year in brackets": rf"[(（]\s*{YEAR}[a-z]?\s*[)）]",
    "year before its sign": rf"{YEAR}\s*年(?![龄代])",
    "word, perhaps with digits": r"\p{IsLatin}(?:[\p{IsLatin}\p{N}]|[.\-]+(?=[\p{IsLatin}\p{N}]))*",
    "digits before a capital": r"\d+(?:-+\d+)*-*\p{Lu}[\p{IsLatin}\d\-]*",
    "number": rf"((?:\d{{1,3}}(?:{GAP}\d{{3}})+(?!\d)|\d{{1,2}}(?:,\d\d)+,\d{{3}}(?!\d)|\d+)(?:\.\d+)?|\.\d+)",
}
SCANNER = "|".join(ATOMS.values())


def fold_width(text: Column) -> Column:
    """Full-width digits, point and percent sign as ASCII; the full-width comma
    separates clauses and stays."""
    return F.translate(text, "０１２３４５６７８９．％", "0123456789.%")


def numbers(text: Column) -> Column:
    """Numbers of a text in order, both ends of a range, as strings with a
    leading zero and without gaps between groups of digits. Digits within names
    (HbA1c, 5-HT), LaTeX indices and years of publication are none; null has an
    empty list."""
    found = F.regexp_extract_all(fold_width(F.coalesce(text, F.lit(""))), F.lit(SCANNER), F.lit(1))
    bare = F.transform(F.filter(found, lambda x: x != ""), lambda x: F.regexp_replace(x, r"[^\d.]", ""))
    return F.transform(bare, lambda x: F.when(x.startswith("."), F.concat(F.lit("0"), x)).otherwise(x))


def decimals(values: Column) -> Column:
    """Number strings as exact decimals; null for what is none."""
    return F.transform(values, lambda x: x.try_cast("decimal(38,10)"))


def missing(claimed: Column, source: Column) -> Column:
    """Claimed numbers whose value is not among the source's, in order."""
    have = decimals(source)
    return F.filter(claimed, lambda x: ~F.coalesce(F.array_contains(have, x.try_cast("decimal(38,10)")), F.lit(False)))

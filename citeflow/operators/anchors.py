"""What stands near what in a text: marks and their nearest partners, names
before citations, numbers close together."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDECAR = r"<!-- claim:([\w\-]+)(?: type:([\w\-]+))? -->"
#: A family name at the end of a text, perhaps with others and a year.
ANCHOR = r"(\p{Lu}[\p{L}'’\-]+)(?:\s+et al\.?|\s+(?:&|and)\s+\p{Lu}[\p{L}'’\-]+|\s*等)?,?\s*\(?((?:19|20)\d\d)?\)?[\s,]*$"


def sidecars(text: Column) -> Column:
    """Claim marks of a text in order: (id, type), factual where no type is
    given."""
    marks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SIDECAR), F.lit(0))
    return F.transform(marks, lambda m: F.struct(F.regexp_extract(m, SIDECAR, 1).alias("id"), F.coalesce(F.nullif(F.regexp_extract(m, SIDECAR, 2), F.lit("")), F.lit("factual")).alias("type")))


def nearest_sidecars(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nth, cited, claim): each citation with a claim mark. Where there are
    as many marks as citations they go by number, else by the smaller distance
    in characters (ties: the one before).

    The text is split at marks; a running sum gives offsets, and two windows
    over a document carry the last and the next mark: no range join."""
    pieces = F.split(F.col(text), r"(?=\[@[\w\-:]+\])|(?=<!-- claim:)")
    rows = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(pieces).alias("i", "p"))
    w = Window.partitionBy(key).orderBy("i")
    rows = rows.withColumn("at", F.sum(F.length("p")).over(w.rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["at"])
    rows = rows.withColumn("cited", F.nullif(F.regexp_extract("p", r"^\[@([\w\-:]+)\]", 1), F.lit(""))).withColumn("claim", F.nullif(F.regexp_extract("p", "^" + SIDECAR, 1), F.lit("")))
    mark = F.when(F.col("claim").isNotNull(), F.struct("at", "claim"))
    before, after = F.last(mark, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(mark, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    total = Window.partitionBy(key)
    rows = rows.withColumns({"b": before, "a": after, "nc": F.count("cited").over(total), "nm": F.count("claim").over(total)})
    rows = rows.withColumns({"nth": F.count("cited").over(w) - 1, "mth": F.count("claim").over(w) - 1})
    cites = rows.where("cited IS NOT NULL").select(key, "nth", "cited", "at", "a", "b", "nc", "nm")
    marks = rows.where("claim IS NOT NULL").select(key, F.col("mth").alias("nth"), F.col("claim").alias("same"))
    nearest = F.when(F.col("b").isNull(), F.col("a.claim")).when(F.col("a").isNull() | (F.col("at") - F.col("b.at") <= F.col("a.at") - F.col("at")), F.col("b.claim")).otherwise(F.col("a.claim"))
    return cites.join(marks, [key, "nth"], "left").select(key, "nth", "cited", F.when(F.col("nc") == F.col("nm"), F.col("same")).otherwise(nearest).alias("claim"))


def anchor(sentence: Column) -> Column:
    """(family, year) named right before a citation; null fields where none."""
    tail = F.substring(sentence, -60, 60)
    return F.struct(F.nullif(F.regexp_extract(tail, ANCHOR, 1), F.lit("")).alias("family"), F.regexp_extract(tail, ANCHOR, 2).try_cast("int").alias("year"))


def disagrees(found: Column, family: Column, year: Column) -> Column:
    """How an anchor differs from the record: ``family`` at over one edit,
    ``year``; empty where it does not."""
    name = F.when(found["family"].isNotNull() & (F.levenshtein(F.lower(found["family"]), family) > 1), "family")
    when = F.when(found["year"].isNotNull() & year.isNotNull() & (found["year"] != year), "year")
    return F.array_compact(F.array(name, when))


def window_of(numbers: list[str], text: str, width: int) -> str | None:
    """The part of the text where all numbers stand within ``width`` characters
    of an occurrence of the first; None where they do not."""
    values = {float(n) for n in numbers}
    places = [(m.start(), m.end(), float(m[0])) for m in re.finditer(r"(?<![\d.])\d+(?:\.\d+)?", re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", text))]
    text = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", text)
    first = float(numbers[0]) if numbers else None
    for s, e, v in places:
        if v == first:
            lo, hi = max(0, s - width), min(len(text), e + width)
            if values <= {x for a, b, x in places if a >= lo and b <= hi}:
                return text[lo:hi]
    return None


def _windows(numbers: pd.Series, text: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([window_of(list(n), t, int(w)) if n is not None and len(n) and t is not None else None for n, t, w in zip(numbers, text, width)])


def colocated(numbers: Column, text: Column, width: int) -> Column:
    """``window_of`` for each row; null for null or no numbers."""
    return F.pandas_udf(_windows, T.StringType())(numbers, text, F.lit(width))

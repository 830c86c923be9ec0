"""Similarity by matching blocks, which Spark has no function for."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def block_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two strings; null where one is null."""
    return F.pandas_udf(_ratios, T.DoubleType())(a, b)


def closest(wanted: DataFrame, declared: DataFrame, group: str, name: str, n: int = 3, cutoff: float = 0.4) -> DataFrame:
    """For each distinct wanted (group, name) the n declared names of its group
    of highest ratio, at least the cutoff; ``sure`` from 0.8 on. Both sides are
    distinct names first, so a group with many rows has few pairs."""
    a = wanted.select(group, F.col(name).alias("wanted")).where("wanted IS NOT NULL").distinct()
    b = declared.select(group, F.col(name).alias("declared")).where("declared IS NOT NULL").distinct()
    scored = a.join(b, group).withColumn("ratio", block_ratio(F.col("wanted"), F.col("declared"))).where(F.col("ratio") >= cutoff)
    w = Window.partitionBy(group, "wanted").orderBy(F.desc("ratio"), "declared")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn("sure", F.col("ratio") >= 0.8)

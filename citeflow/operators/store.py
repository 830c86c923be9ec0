"""The record store: normal form on read, first-seen and last-seen merges, and
updates as joins. Tables are never updated in place: each operator gives the new
table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeflow.functions import records as R


def normalized_entries(entries: DataFrame) -> DataFrame:
    """Entries in the schema's normal form: lower-case DOI, lists without
    nulls, closed enumerations, empty strings as null where the field may be
    absent. A field of a wrong value becomes null or the default."""
    return entries.withColumns({
        "doi": F.lower(F.coalesce("doi", F.lit(""))), "title": F.coalesce("title", F.lit("")), "journal": F.coalesce("journal", F.lit("")),
        "authors": R.strings(F.col("authors")), "issn": R.strings(F.col("issn")), "supersedes": R.strings(F.col("supersedes")),
        "asset_ids": R.strings(F.col("asset_ids")), "retraction_notes": R.strings(F.col("retraction_notes")),
        "gap": R.filled(F.col("gap")), "excluded_reason": R.filled(F.col("excluded_reason")), "superseded_by": R.filled(F.col("superseded_by")),
        "study_type": R.known(F.col("study_type"), R.STUDY_TYPES, "other"),
        "verification_status": R.known(F.col("verification_status"), R.VERIFICATION, "pending"),
        "oa_status": F.coalesce(R.filled(F.col("oa_status")), F.lit("unknown")),
        "retracted": F.coalesce("retracted", F.lit(False)), "has_fulltext_xml": F.coalesce("has_fulltext_xml", F.lit(False)),
    })


def normalized_gaps(gaps: DataFrame) -> DataFrame:
    """Gaps in normal form: closed status, blank query as null, lists without
    nulls, missing creation round as 0."""
    return gaps.withColumns({
        "status": R.known(F.col("status"), R.GAP_STATUS, "pending"), "query": F.when(F.trim("query") != "", F.col("query")),
        "depends_on": R.strings(F.col("depends_on")), "subgap_of": R.filled(F.col("subgap_of")), "created_round": F.coalesce("created_round", F.lit(0)),
    })


def current(rows: DataFrame, keys: list[str], order: list[str], deleted: str | None = "deleted") -> DataFrame:
    """The last row of each key by order; keys whose last row is a tombstone are
    left out."""
    last = one_each(rows, keys, [F.col(c).desc() for c in order])
    return last.where(~F.coalesce(deleted, F.lit(False))) if deleted else last


def one_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order. Written as a ranking, so that columns
    nobody asks for are pruned down to the scan, which an aggregate of whole
    rows would prevent; the group limit keeps one row a key map-side, so a key
    of a third of all rows is one row for each task in the shuffle."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def merged(rows: DataFrame, keys: list[str], order: str, first: list[str], last: list[str], sticky: dict[str, str] | None = None) -> DataFrame:
    """Upsert of a stream of versions: ``first`` columns keep the first value
    that is not null, ``last`` columns take the last that is not null; a
    ``sticky`` column keeps the named value once it has been reached. It is one
    aggregation, so a key with any number of versions is combined map-side."""
    aggs = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in last]
    for c, value in (sticky or {}).items():
        aggs.append(F.when(F.bool_or(F.coalesce(F.col(c) == value, F.lit(False))), F.lit(value)).otherwise(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))).alias(c))
    return rows.groupBy(*keys).agg(*aggs, F.count("*").alias("versions"))


def put(store: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The store with rows added, in place of those of the same keys."""
    return store.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def without(store: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The store without the rows of the given keys."""
    return store.join(gone.select(*keys).distinct(), keys, "left_anti")


def marked(store: DataFrame, hits: DataFrame, keys: list[str], column: str, value) -> DataFrame:
    """The store with column set to value where the keys are among hits."""
    mark = hits.select(*keys).distinct().withColumn("__hit", F.lit(True))
    return store.join(mark, keys, "left").withColumn(column, F.when(F.col("__hit"), F.lit(value)).otherwise(F.col(column))).drop("__hit")


def ordered_verdicts(verdicts: DataFrame, key: str, order: str) -> DataFrame:
    """The verdict that stands for each key when several are applied in order."""
    return verdicts.groupBy(key).agg(F.max_by("verdict", order).alias("verdict"), F.count("*").alias("given"))


def supersession(pairs: DataFrame) -> DataFrame:
    """From (old, new, similarity) the links to store: the most similar new
    record of each old one (ties: least), and for each new one the sorted list
    of the old."""
    best = pairs.groupBy("old").agg(F.min_by("new", F.struct((-F.col("similarity")).alias("s"), "new")).alias("superseded_by"))
    olds = best.groupBy(F.col("superseded_by").alias("doi")).agg(F.array_sort(F.collect_set("old")).alias("supersedes"))
    return best.select(F.col("old").alias("doi"), "superseded_by").join(olds, "doi", "full")

"""Merging, fusing and cutting rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeflow.runtime import cut

RRF = 60


def merged_hits(hits: DataFrame, query: str, doi: Column, source_order: Column) -> DataFrame:
    """One hit for each query and DOI: the most cited copy (ties: the first),
    at the place where the DOI first came, counting sources in order. Hits
    without a DOI are left out.

    One aggregation instead of a window: a query with a third of all rows is
    combined map-side."""
    rows = hits.withColumn("__doi", doi).where(F.coalesce("__doi", F.lit("")) != "").withColumn("__pos", F.struct(source_order.alias("s"), "rank0", "hit_id"))
    best = F.min_by(F.struct(*hits.columns), F.struct((-F.coalesce("cited_by_count", F.lit(0))).alias("c"), "__pos"))
    merged = rows.groupBy(query, "__doi").agg(best.alias("__h"), F.min("__pos").alias("__first"), F.count("*").alias("copies"))
    return merged.select(query, F.col("__doi").alias("doi"), *[F.col(f"__h.{c}").alias(c) for c in hits.columns if c not in (query, "doi")], F.col("__first").alias("first_at"), "copies")


def fused(hits: DataFrame, query: str, doi: Column, sources: list[str]) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (60 + rank) of a DOI over the
    sources' rankings; a source ranks a DOI by its first occurrence, 0 first."""
    rows = hits.where(F.col("source").isin(sources)).withColumn("__doi", doi).where(F.coalesce("__doi", F.lit("")) != "")
    firsts = rows.groupBy(query, "source", "__doi").agg(F.min(F.struct("rank0", "hit_id")).alias("p"))
    ranked = numbered(firsts, [query, "source"], ["p"], "__place").withColumn("r", F.col("__place") - 1)
    return ranked.groupBy(query, F.col("__doi").alias("doi")).agg(F.sum(1.0 / (RRF + F.col("r"))).alias("score"), F.count("*").alias("sources"))


def top(rows: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group. Spark keeps k rows a group map-side
    (WindowGroupLimit) before it shuffles."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def saturation(counts: DataFrame, group: list[str], round_: str, new: str) -> DataFrame:
    """For each round: what came in, what there is up to it, and their ratio."""
    w = Window.partitionBy(*group).orderBy(round_).rowsBetween(Window.unboundedPreceding, 0)
    out = counts.withColumn("upto", F.sum(new).over(w))
    return out.withColumn("ratio", F.when(F.col("upto") > 0, F.col(new) / F.col("upto")))


def admitted(candidates: DataFrame, group: list[str], key: Column, eligible: Column, cap: int) -> DataFrame:
    """Capped admission with look-ahead, in ascending order of key: the first
    ``cap`` eligible candidates of each group are admitted; of those after the
    cap, the first max(20, 3 cap) are scanned, and ``more`` tells whether one is
    eligible.

    Both cuts are group limits that run map-side; the rest is aggregation, so no
    task holds a whole group. Groups are not null."""
    rows = candidates.withColumn("__ok", eligible).withColumn("__key", key)
    first = top(rows.where("__ok"), group, [F.col("__key")], cap, "__r").groupBy(*group).agg(F.count("*").alias("admitted"), F.max("__key").alias("__last"))
    full = first.select(*group, "admitted", F.when(F.col("admitted") == cap, F.col("__last")).alias("__full"))
    rows = rows.join(full, group, "left")
    counts = rows.groupBy(*group).agg(
        F.coalesce(F.max("admitted"), F.lit(0)).alias("admitted"), F.count_if(~F.col("__ok") & (F.col("__full").isNull() | (F.col("__key") <= F.col("__full")))).alias("rejected")
    )
    ahead = top(rows.where(F.col("__key") > F.col("__full")), group, [F.col("__key")], max(20, 3 * cap), "__r")
    ahead = ahead.groupBy(*group).agg(F.bool_or("__ok").alias("more"))
    return counts.join(ahead, group, "left").withColumn("more", F.coalesce("more", F.lit(False)))


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their number in the group by ascending order, from 1.

    Rows are range-partitioned by group and order, numbered within each piece,
    and moved on by the size of the pieces before it, so that a group of any
    size is spread over tasks. group and order together are unique."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    held = cut(rows.repartitionByRange(n, *group, *order).withColumn("__piece", F.spark_partition_id()))
    sizes = held.groupBy(*group, "__piece").agg(F.count("*").alias("__size"))
    w = Window.partitionBy(*group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(c).alias(f"__{c}") for c in group], F.col("__piece").alias("__at"), F.coalesce(F.sum("__size").over(w), F.lit(0)).alias("__before"))
    same = held["__piece"] == sizes["__at"]
    for c in group:
        same = same & held[c].eqNullSafe(sizes[f"__{c}"])
    local = F.row_number().over(Window.partitionBy(*group, "__piece").orderBy(*order))
    return held.join(sizes, same).withColumn(name, (local + F.col("__before")).cast("int")).select(*rows.columns, name)


def snowball(edges: DataFrame, seeds: DataFrame, min_overlap: int = 1) -> DataFrame:
    """One hop from seeds (group, id) over edges (citing, cited): candidates
    that are no seed of the group, with how many of its seeds cite them
    (ancestor) or are cited by them (descendant), at least min_overlap; in groups of
    which no more than two seeds have an edge, one is enough."""
    up = edges.join(seeds, edges["citing"] == seeds["id"]).select("group", F.col("cited").alias("candidate"), F.lit("ancestor").alias("side"), "id")
    down = edges.join(seeds, edges["cited"] == seeds["id"]).select("group", F.col("citing").alias("candidate"), F.lit("descendant").alias("side"), "id")
    found = up.unionByName(down).distinct()
    found = found.join(seeds.select("group", F.col("id").alias("candidate")), ["group", "candidate"], "left_anti")
    counted = found.groupBy("group", "candidate", "side").agg(F.count("*").alias("overlap"))
    if min_overlap <= 1:
        return counted
    ends = edges.select(F.col("citing").alias("id")).union(edges.select("cited")).distinct()
    resolved = seeds.distinct().join(ends, "id", "left_semi").groupBy("group").agg(F.count("*").alias("__resolved"))
    return counted.join(resolved, "group", "left").where((F.col("overlap") >= min_overlap) | (F.col("__resolved") <= 2)).drop("__resolved")


def upper_median(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """The upper of the two middle values. Rows are counted by value first, so
    the ranking runs over distinct values."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*group)
    upto = n.withColumns({"__upto": F.sum("__n").over(w.orderBy(value)), "__all": F.sum("__n").over(w)})
    reached = upto.where(F.col("__upto") >= F.floor(F.col("__all") / 2) + 1)
    return reached.groupBy(*group).agg(F.min(value).alias("upper_median"))

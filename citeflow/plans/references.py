"""Queries of the references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.functions.text import loose_key
from citeflow.operators.orphans import orphans, targets
from citeflow.runtime import table


def _references(spark: SparkSession, d: str) -> list[tuple[DataFrame, DataFrame]]:
    """For each of the three references: its rows (ref_table, topic, ref_id,
    ref_key, round, key, at) and its targets."""
    entries = table(spark, d, "entries").select("entry_id", "topic", "gap", "added_round", "citation_key", "arrived_at", "deleted")
    gaps = table(spark, d, "gaps").select("topic", "gap_id", "depends_on", "created_round", "arrived_at", "deleted")
    claims = table(spark, d, "claims").select("claim_id", "topic", "round", "key", "arrived_at")
    gap_targets = targets(gaps.withColumn("key", loose_key(F.col("gap_id"))).where("key IS NOT NULL"), ["topic", "key"], "arrived_at", "deleted")
    entry_targets = targets(entries.withColumn("key", loose_key(F.col("citation_key"))).where("key IS NOT NULL"), ["topic", "key"], "arrived_at", "deleted")

    def refs(df: DataFrame, name: str, ident, raw: str, period: str, record: list[str]) -> DataFrame:
        # The first arrival belongs to the record, whichever of its rows holds the reference.
        first = df.groupBy(*record).agg(F.min("arrived_at").alias("at"))
        rows = df.select(*record, F.col("topic").alias("__topic"), ident.alias("ref_id"), F.col(raw).alias("ref_key"), F.col(period).cast("int").alias("round")).distinct()
        same = None
        for c in record:
            on = rows[c].eqNullSafe(first[c])
            same = on if same is None else same & on
        return rows.join(first, same).select(
            F.lit(name).alias("ref_table"), F.col("__topic").alias("topic"), "ref_id", "ref_key", "round", loose_key(F.col("ref_key")).alias("key"), "at"
        )

    of_entries = refs(entries, "entries", F.col("entry_id").cast("string"), "gap", "added_round", ["entry_id"])
    of_claims = refs(claims, "claims", F.col("claim_id"), "key", "round", ["claim_id"])
    first = gaps.groupBy("topic", "gap_id").agg(F.min("arrived_at").alias("at"))
    of_gaps = (
        gaps.select("topic", "gap_id", F.explode("depends_on").alias("ref_key"), F.col("created_round").cast("int").alias("round")).distinct()
        .join(first, ["topic", "gap_id"])
        .select(F.lit("gaps").alias("ref_table"), "topic", F.col("gap_id").alias("ref_id"), "ref_key", "round", loose_key(F.col("ref_key")).alias("key"), "at")
    )
    return [(of_entries, gap_targets), (of_gaps, gap_targets), (of_claims, entry_targets)]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for refs, found in _references(spark, d):
        part = orphans(refs, found, ["topic", "key"], at="at", match="full", required=["key"])
        out = part if out is None else out.unionByName(part)
    return out


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references. Null and blank keys are no references; a key without a
    topic lies in no topic, so it has no target (full match)."""
    return _orphans(spark, d).select("ref_table", "topic", "ref_id", "ref_key").distinct()


def p5_by_round(spark: SparkSession, d: str) -> DataFrame:
    """Orphans of each table, round and reason."""
    return _orphans(spark, d).groupBy("ref_table", "round", "why").agg(F.count("*").alias("orphans"))


QUERIES = {"p5_found": p5_found, "p5_by_round": p5_by_round}

_KEY = "nullif(regexp_replace(lower({}), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '')"
_REFS = f"""
WITH gt AS (SELECT topic, {_KEY.format('gap_id')} AS key, min(arrived_at) AS first_at, bool_or(coalesce(deleted, false)) AS gone
            FROM gaps GROUP BY ALL HAVING key IS NOT NULL),
et AS (SELECT topic, {_KEY.format('citation_key')} AS key, min(arrived_at) AS first_at, bool_or(coalesce(deleted, false)) AS gone
       FROM entries GROUP BY ALL HAVING key IS NOT NULL),
refs AS (
  SELECT DISTINCT 'entries' AS ref_table, topic, CAST(e.entry_id AS VARCHAR) AS ref_id, gap AS ref_key, CAST(added_round AS INTEGER) AS round, seen
  FROM entries e JOIN (SELECT entry_id, min(arrived_at) AS seen FROM entries GROUP BY entry_id) f USING (entry_id)
  UNION ALL
  SELECT DISTINCT 'gaps', topic, gap_id, unnest(depends_on), CAST(created_round AS INTEGER), seen
  FROM gaps JOIN (SELECT topic, gap_id, min(arrived_at) AS seen FROM gaps GROUP BY topic, gap_id) f USING (topic, gap_id)
  UNION ALL
  SELECT DISTINCT 'claims', topic, claim_id, key, CAST(round AS INTEGER), seen
  FROM claims JOIN (SELECT claim_id, min(arrived_at) AS seen FROM claims GROUP BY claim_id) f USING (claim_id)
),
keyed AS (SELECT *, {_KEY.format('ref_key')} AS key FROM refs),
judged AS (
  SELECT r.*, CASE WHEN t.key IS NULL THEN 'missing' WHEN t.gone THEN 'deleted' WHEN t.first_at > r.seen THEN 'later' END AS why
  FROM keyed r LEFT JOIN (SELECT 'g' AS kind, * FROM gt UNION ALL SELECT 'e', * FROM et) t
    ON t.topic = r.topic AND t.key = r.key AND t.kind = CASE WHEN r.ref_table = 'claims' THEN 'e' ELSE 'g' END
  WHERE r.key IS NOT NULL
)
"""
SQL = {
    "p5_found": _REFS + "SELECT DISTINCT ref_table, topic, ref_id, ref_key FROM judged WHERE why IS NOT NULL",
    "p5_by_round": _REFS + "SELECT ref_table, round, why, count(*) AS orphans FROM judged WHERE why IS NOT NULL GROUP BY ALL",
}

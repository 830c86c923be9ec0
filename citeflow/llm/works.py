"""Queries of the groups of entries of one work and of their survivors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.functions.text import doi_key, word_list
from citeflow.llm.neardup import equal_links, groups
from citeflow.llm.survivor import survivors
from citeflow.runtime import cut, release, table

#: The similarity and least length that the test data state for titles.
SIMILARITY, LEAST = 0.65, 5


def work_groups(entries: DataFrame) -> DataFrame:
    """(entry_id, component) of entries of works with more than one record."""
    docs = entries.select("entry_id", word_list(F.col("title")).alias("tokens"), doi_key(F.col("doi")).alias("doi"))
    return groups(docs, "entry_id", "tokens", SIMILARITY, LEAST, same=equal_links(docs, "entry_id", "doi"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each entry of a work with more than one record, and the work's class."""
    return work_groups(table(spark, d, "entries")).select("entry_id", F.col("component").alias("work"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of entries of one work, smaller id first, joined by third records
    too."""
    of = cut(work_groups(table(spark, d, "entries")))
    a, b = of.withColumnRenamed("entry_id", "entry_a"), of.withColumnRenamed("entry_id", "entry_b")
    return a.join(b, "component").where("entry_a < entry_b").select("entry_a", "entry_b")


FIELDS = ["doi", "title", "authors", "year", "journal", "issn", "study_type", "gap", "oa_status", "oa_pdf_url", "citation_key"]


def lost(entries: DataFrame, of: DataFrame) -> DataFrame:
    """(entry_id) of records that another one of their work supersedes, by
    either one's link. of: (entry_id, component)."""
    # A record meets its own DOI and those of its links. The least and greatest id
    # of those who own a DOI, or claim to supersede it, tell whether there is another one.
    role = lambda kind, raw: F.struct(F.lit(kind).alias("kind"), raw.alias("raw"))
    roles = F.array(role("own", F.col("doi")), role("by", F.col("superseded_by")))
    roles = F.concat(roles, F.transform(F.coalesce("supersedes", F.array()), lambda raw: role("beats", raw)))
    links = entries.select("entry_id", F.explode(roles).alias("x")).select("entry_id", "x.kind", doi_key(F.col("x.raw")).alias("doi"))
    links = cut(links.where("doi IS NOT NULL").join(of, "entry_id").distinct())
    owner, winner = (F.when(F.col("kind") == kind, F.col("entry_id")) for kind in ("own", "beats"))
    ends = links.groupBy("component", "doi").agg(F.min(owner).alias("owner"), F.max(owner).alias("last_owner"), F.min(winner).alias("winner"), F.max(winner).alias("last_winner"))
    met = links.where("kind <> 'beats'").join(ends, ["component", "doi"])
    return met.where("CASE kind WHEN 'by' THEN entry_id <> owner OR entry_id <> last_owner ELSE entry_id <> winner OR entry_id <> last_winner END").select("entry_id").distinct()


def _best(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "entries")
    of = cut(work_groups(entries))
    of = cut(of.join(lost(entries, of).withColumn("lost", F.lit(True)), "entry_id", "left"))
    release(spark)
    used = [*FIELDS, "entry_id", "verification_status", "retracted", "deleted", "arrived_at", "seq"]
    # A record's rows: the latest arrival that is no tombstone speaks for it.
    latest = entries.select(used).join(of, "entry_id").groupBy("component", "entry_id", "lost").agg(F.max_by(F.struct(*[c for c in used if c != "entry_id"]), F.struct(~F.coalesce("deleted", F.lit(False)), "arrived_at", "seq")).alias("r"))
    latest = latest.select("component", "entry_id", "lost", *[F.col(f"r.{c}").alias(c) for c in used if c != "entry_id"])
    sound = (F.col("verification_status") == "verified").cast("int") * 4 + (~F.coalesce("retracted", F.lit(False))).cast("int") * 2 + F.col("lost").isNull().cast("int")
    right = (F.col("verification_status") == "verified") & ~F.coalesce("retracted", F.lit(False)) & F.col("lost").isNull()
    trust = F.when(right, 8).otherwise(F.coalesce(sound, F.lit(0)))
    blank = {c: F.when(F.trim(c) != "", F.col(c)) for c in ("title", "journal", "gap", "oa_status", "oa_pdf_url", "study_type", "citation_key")}
    blank |= {c: F.when(F.size(c) > 0, F.col(c)) for c in ("authors", "issn")}
    shaped = latest.withColumns(blank).withColumn("doi", doi_key(F.col("doi"))).withColumn("trust", trust)
    return survivors(shaped, "component", "entry_id", FIELDS, "arrived_at", "trust")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The record to keep of each group of entries of one work."""
    return _best(spark, d).select("entry_id")


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each group with the best value of each field."""
    return _best(spark, d).withColumnRenamed("component", "work")


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups, "p6_found": p6_found, "p6_records": p6_records}
SQL: dict[str, str] = {}

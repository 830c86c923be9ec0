"""Queries over search hits: merging, fusion, cuts, expansion, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeflow.functions.text import doi_key
from citeflow.operators import linking, ranking, store
from citeflow.plans.records import _JAC, _WORDS, E_SQL, _entries, doi_sql
from citeflow.runtime import table

SOURCES = ["crossref", "semantic", "pubmed", "biorxiv", "clinicaltrials"]
CAP = 5


def _hits(s, d):
    """One row for each hit_id."""
    return store.one_each(table(s, d, "hits"), ["hit_id"], [F.col("retrieved_at"), F.col("rank0")])


H_SQL = "h AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY retrieved_at, rank0) = 1)"


def _order():
    return F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))


_O = "list_position(['crossref','semantic','pubmed','biorxiv','clinicaltrials'], source)"


def hits_by_source(s, d):
    return _hits(s, d).groupBy("source").agg(F.count("*").alias("hits"), F.countDistinct("query_id").alias("queries"), F.count(doi_key(F.col("doi"))).alias("with_doi"), F.count_if(F.col("doi").startswith("nct:")).alias("trial_keys"))


def e8_merged_hits(s, d):
    m = ranking.merged_hits(_hits(s, d), "query_id", F.lower("doi"), _order())
    return ranking.numbered(m, ["query_id"], ["first_at"], "place").select("query_id", "doi", "hit_id", "source", "cited_by_count", "copies", "place")


def e9_new_hits(s, d):
    """DOIs of hits that no entry has."""
    have = _entries(s, d).select(doi_key(F.col("doi")).alias("k")).where("k IS NOT NULL").distinct()
    h = _hits(s, d).select(doi_key(F.col("doi")).alias("k"), "source").where("k IS NOT NULL")
    return h.join(have, "k", "left_anti").groupBy("k").agg(F.count("*").alias("hits"), F.countDistinct("source").alias("sources"))


def g1_rank_fusion(s, d):
    f = ranking.fused(_hits(s, d), "query_id", F.lower("doi"), ["crossref", "semantic"])
    return f.select("query_id", "doi", F.round("score", 9).alias("score"), "sources")


def hits_most_cited(s, d):
    """The ten most cited DOIs of each query."""
    m = ranking.merged_hits(_hits(s, d), "query_id", F.lower("doi"), _order())
    return ranking.top(m, ["query_id"], [F.coalesce("cited_by_count", F.lit(0)).desc(), F.col("doi")], 10).select("query_id", "doi", F.coalesce("cited_by_count", F.lit(0)).alias("cited"), "rank")


def _edges(s, d):
    """Edges from each query's first hit to its others."""
    h = _hits(s, d).select("query_id", doi_key(F.col("doi")).alias("k"), "rank0", "hit_id").where("k IS NOT NULL")
    head = h.groupBy("query_id").agg(F.min_by("k", F.struct("rank0", "hit_id")).alias("citing"))
    edges = h.join(head, "query_id").where("k <> citing").select("citing", F.col("k").alias("cited")).distinct()
    return edges


def _seeds(s, d):
    return _entries(s, d).select(F.col("topic").alias("group"), doi_key(F.col("doi")).alias("id")).where("id IS NOT NULL").distinct()


def e10_snowball(s, d):
    """One hop over edges; seeds are the entries of each topic."""
    return ranking.snowball(_edges(s, d), _seeds(s, d))


def e10_overlapping(s, d):
    """The same, candidates that two seeds and more lead to."""
    return ranking.snowball(_edges(s, d), _seeds(s, d), 2)


def g5_admission(s, d):
    """Capped admission of each query's new hits with look-ahead."""
    have = _entries(s, d).select(doi_key(F.col("doi")).alias("k")).where("k IS NOT NULL").distinct().withColumn("known", F.lit(True))
    m = ranking.merged_hits(_hits(s, d), "query_id", doi_key(F.col("doi")), _order()).withColumnRenamed("doi", "k").join(have, "k", "left")
    ok = F.col("known").isNull() & (F.coalesce("year", F.lit(0)) >= 2010)
    return ranking.admitted(m, ["query_id"], F.struct((-F.coalesce("cited_by_count", F.lit(0))).alias("c"), "k"), ok, CAP)


def e19_recall(s, d):
    """For each source, how many of its known works the store has."""
    have = _entries(s, d).select(doi_key(F.col("doi")).alias("k")).where("k IS NOT NULL").distinct().withColumn("hit", F.lit(1))
    known = _hits(s, d).select("source", doi_key(F.col("doi")).alias("k")).where("k IS NOT NULL").distinct()
    j = known.join(have, "k", "left")
    return j.groupBy("source").agg(F.count("*").alias("known"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 3).alias("recall"))


def e28_title_suggestions(s, d):
    """For each hit whose id is divisible by 20, the three entries of most
    similar title: a search of a stated query set against all entries."""
    q = _hits(s, d).where("hit_id % 20 = 0").select(F.col("hit_id").alias("qid"), "title")
    c = _entries(s, d).select(F.col("entry_id").alias("cid"), "title")
    return linking.suggestions(q, c, 3, 0.4).select("qid", "cid", F.round("similarity", 6).alias("similarity"), "rank", "match")


def query_overlap(s, d):
    """DOIs found by several queries."""
    h = _hits(s, d).select(doi_key(F.col("doi")).alias("k"), "query_id").where("k IS NOT NULL")
    return h.groupBy("k").agg(F.countDistinct("query_id").alias("queries")).where("queries >= 2")


def d14_hits_without_usable_doi(s, d):
    h = _hits(s, d)
    why = F.when(F.trim(F.coalesce("doi", F.lit(""))) == "", "blank").when(F.lower("doi").startswith("nct:"), "trial").when(doi_key(F.col("doi")).isNull(), "malformed")
    return h.select("source", why.alias("why")).where("why IS NOT NULL").groupBy("source", "why").agg(F.count("*").alias("hits"))


def years_by_source(s, d):
    y = F.when(F.coalesce("year", F.lit(0)) > 0, F.col("year").cast("int"))
    return _hits(s, d).groupBy("source", y.alias("year")).agg(F.count("*").alias("hits"), F.sum(F.coalesce("cited_by_count", F.lit(0))).cast("long").alias("cited"))


NAMES = [hits_by_source, e8_merged_hits, e9_new_hits, g1_rank_fusion, hits_most_cited, e10_snowball, e10_overlapping, g5_admission, e19_recall, e28_title_suggestions, query_overlap, d14_hits_without_usable_doi, years_by_source]
QUERIES = {f.__name__: f for f in NAMES}

_HK = f"hk AS (SELECT *, {doi_sql('doi')} AS k FROM h)"
_EK = f"ek AS (SELECT DISTINCT {doi_sql('doi')} AS k FROM e WHERE {doi_sql('doi')} IS NOT NULL)"
_MERGED = f"""r AS (SELECT *, lower(doi) AS dk, row_number() OVER (PARTITION BY query_id, lower(doi) ORDER BY coalesce(cited_by_count,0) DESC, {_O}, rank0, hit_id) AS b,
  min(struct_pack(s := {_O}, r := rank0, i := hit_id)) OVER (PARTITION BY query_id, lower(doi)) AS f, count(*) OVER (PARTITION BY query_id, lower(doi)) AS copies FROM h WHERE coalesce(doi,'') <> ''), m AS (SELECT * FROM r WHERE b = 1)"""
_SNOW = f"""{H_SQL}, {_HK}, {E_SQL}, s AS (SELECT DISTINCT topic AS "group", {doi_sql('doi')} AS id FROM e WHERE {doi_sql('doi')} IS NOT NULL),
hd AS (SELECT query_id, arg_min(k, struct_pack(r := rank0, i := hit_id)) AS citing FROM hk WHERE k IS NOT NULL GROUP BY 1),
ed AS (SELECT DISTINCT citing, k AS cited FROM hk JOIN hd USING (query_id) WHERE k IS NOT NULL AND k <> citing),
f AS (SELECT s."group", cited AS candidate, 'ancestor' AS side, id FROM ed JOIN s ON s.id = citing UNION SELECT s."group", citing, 'descendant', id FROM ed JOIN s ON s.id = cited),
n AS (SELECT "group", candidate, side, count(*) AS overlap FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s."group" = f."group" AND s.id = f.candidate) GROUP BY ALL)"""
SQL = {
    "hits_by_source": f"WITH {H_SQL}, {_HK} SELECT source, count(*) AS hits, count(DISTINCT query_id) AS queries, count(k) AS with_doi, count(*) FILTER (starts_with(doi,'nct:')) AS trial_keys FROM hk GROUP BY 1",
    "e8_merged_hits": f"WITH {H_SQL}, {_MERGED} SELECT query_id, dk AS doi, hit_id, source, cited_by_count, copies, CAST(row_number() OVER (PARTITION BY query_id ORDER BY f) AS INTEGER) AS place FROM m",
    "e9_new_hits": f"WITH {H_SQL}, {_HK}, {E_SQL}, {_EK} SELECT k, count(*) AS hits, count(DISTINCT source) AS sources FROM hk WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM ek) GROUP BY 1",
    "g1_rank_fusion": f"WITH {H_SQL}, f AS (SELECT query_id, source, lower(doi) AS doi, min(struct_pack(r := rank0, i := hit_id)) AS p FROM h WHERE source IN ('crossref','semantic') AND coalesce(doi,'') <> '' GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY p) - 1 AS r FROM f) SELECT query_id, doi, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, count(*) AS sources FROM n GROUP BY 1, 2",
    "hits_most_cited": f"WITH {H_SQL}, {_MERGED} SELECT query_id, dk AS doi, coalesce(cited_by_count,0) AS cited, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(cited_by_count,0) DESC, dk) AS INTEGER) AS rank FROM m QUALIFY rank <= 10",
    "e10_snowball": f"""WITH {_SNOW}
SELECT * FROM n""",
    "e10_overlapping": f"""WITH {_SNOW}, r AS (SELECT "group", count(*) AS seeds FROM s WHERE EXISTS (SELECT 1 FROM ed WHERE ed.citing = s.id OR ed.cited = s.id) GROUP BY 1)
SELECT n.* FROM n LEFT JOIN r ON r."group" = n."group" WHERE overlap >= 2 OR seeds <= 2""",
    "g5_admission": f"""WITH {H_SQL}, {_HK}, {E_SQL}, {_EK}, m AS (SELECT * FROM hk WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY coalesce(cited_by_count,0) DESC, {_O}, rank0, hit_id) = 1),
o AS (SELECT query_id, k, (ek.k IS NULL AND coalesce(year,0) >= 2010) AS ok, row_number() OVER w AS pos FROM m LEFT JOIN ek USING (k) WINDOW w AS (PARTITION BY query_id ORDER BY coalesce(cited_by_count,0) DESC, m.k)),
n AS (SELECT *, sum(ok::INT) OVER (PARTITION BY query_id ORDER BY pos) AS n FROM o), u AS (SELECT *, min(CASE WHEN ok AND n = {CAP} THEN pos END) OVER (PARTITION BY query_id) AS f FROM n)
SELECT query_id, count(*) FILTER (ok AND n <= {CAP}) AS admitted, count(*) FILTER (NOT ok AND (f IS NULL OR pos <= f)) AS rejected, coalesce(bool_or(ok AND pos BETWEEN f + 1 AND f + {max(20, 3 * CAP)}), false) AS more FROM u GROUP BY 1""",
    "e19_recall": f"WITH {H_SQL}, {_HK}, {E_SQL}, {_EK}, n AS (SELECT DISTINCT source, k FROM hk WHERE k IS NOT NULL) SELECT source, count(*) AS known, count(ek.k) AS found, round(count(ek.k) / count(*), 3) AS recall FROM n LEFT JOIN ek USING (k) GROUP BY 1",
    "e28_title_suggestions": f"""WITH {H_SQL}, {E_SQL}, q AS (SELECT hit_id AS qid, {_WORDS.format('title')} AS qw FROM h WHERE hit_id % 20 = 0), c AS (SELECT entry_id AS cid, {_WORDS.format('title')} AS cw FROM e),
p AS (SELECT qid, cid, {_JAC.format(a='qw', b='cw')} AS s FROM q, c WHERE len(qw) > 0 AND len(cw) > 0), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, cid) AS rank FROM p WHERE s >= 0.4)
SELECT qid, cid, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank, s >= 0.6 AS match FROM k WHERE rank <= 3""",
    "query_overlap": f"WITH {H_SQL}, {_HK} SELECT k, count(DISTINCT query_id) AS queries FROM hk WHERE k IS NOT NULL GROUP BY 1 HAVING count(DISTINCT query_id) >= 2",
    "d14_hits_without_usable_doi": f"WITH {H_SQL}, {_HK}, w AS (SELECT source, CASE WHEN trim(coalesce(doi,'')) = '' THEN 'blank' WHEN starts_with(lower(doi),'nct:') THEN 'trial' WHEN k IS NULL THEN 'malformed' END AS why FROM hk) SELECT source, why, count(*) AS hits FROM w WHERE why IS NOT NULL GROUP BY ALL",
    "years_by_source": f"WITH {H_SQL} SELECT source, CASE WHEN coalesce(year,0) > 0 THEN CAST(year AS INTEGER) END AS year, count(*) AS hits, CAST(sum(coalesce(cited_by_count,0)) AS BIGINT) AS cited FROM h GROUP BY 1, 2",
}

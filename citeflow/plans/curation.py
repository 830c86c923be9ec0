"""Queries of curation: names, corrections, journals, clusters among cited
entries, set operations, unions of assets, notes, updates from results."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeflow.functions import records as R
from citeflow.functions.text import doi_key
from citeflow.operators import store
from citeflow.operators.ranking import numbered
from citeflow.plans.records import _CLUSTER, E_SQL, _entries, doi_sql
from citeflow.plans.reviews import C_SQL, _claims, _docs
from citeflow.runtime import table
from citeflow.sources import files


def c12_author_names(s, d):
    """Each author as family name and initials."""
    a = table(s, d, "entries").select(F.explode("authors").alias("author")).where("author IS NOT NULL").distinct()
    given = F.trim(F.split_part("author", F.lit(","), F.lit(2)))
    letters = F.array_join(F.transform(F.regexp_extract_all(given, F.lit(r"[\p{L}]+"), F.lit(0)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), " ")
    family = F.trim(F.split_part("author", F.lit(","), F.lit(1)))
    return a.select("author", F.when(letters != "", F.concat(family, F.lit(", "), letters)).otherwise(family).alias("formatted"))


def c24_corrections(s, d):
    """Correction notices by kind."""
    c = _entries(s, d).select(F.explode("verification.corrections").alias("c")).where("c IS NOT NULL")
    low = F.lower("c")
    kind = F.when(low.contains("retract"), "retraction").when(low.contains("concern"), "concern").when(low.isin(R.ERRATA), "erratum").otherwise("other")
    return c.groupBy(kind.alias("kind")).agg(F.count("*").alias("notices"))


def c31_journal_signals(s, d):
    """Journals whose signals are known, and how many look weak: low h-index
    and not in the open-access directory."""
    j = _entries(s, d).where("journal_signals IS NOT NULL AND journal <> ''")
    weak = (F.coalesce("journal_signals.h_index", F.lit(999)) < 10) & ~F.coalesce("journal_signals.in_doaj", F.lit(False))
    return j.groupBy("journal").agg(F.count("*").alias("entries"), F.count_if(weak).alias("weak"))


def issn_records(s, d):
    i = _entries(s, d).select(F.explode("issn").alias("i")).where("i IS NOT NULL")
    return i.groupBy(F.upper(F.regexp_replace("i", "[^0-9Xx]", "")).alias("issn")).agg(F.count("*").alias("entries"))


def e22_cited_clusters(s, d):
    """Title clusters of which a topic cites more than one entry."""
    used = _claims(s, d).select("topic", F.col("key").alias("citation_key")).distinct()
    e = _entries(s, d).select("topic", "citation_key", "entry_id", R.title_cluster(F.col("title")).alias("cluster")).where("cluster IS NOT NULL")
    return e.join(used, ["topic", "citation_key"]).groupBy("topic", "cluster").agg(F.countDistinct("entry_id").alias("entries")).where("entries > 1")


def h2_store_dump(s, d):
    """Place of each entry in its topic's dump: by gap, cited first, by key."""
    used = _claims(s, d).select("topic", F.col("key").alias("citation_key")).distinct().withColumn("cited", F.lit(True))
    e = _entries(s, d).select("topic", "gap", "citation_key", "entry_id").join(used, ["topic", "citation_key"], "left").withColumn("cited", F.coalesce("cited", F.lit(False)))
    e = e.select("topic", "entry_id", "cited", F.coalesce("gap", F.lit("")).alias("g"), (~F.col("cited")).alias("later"), F.coalesce("citation_key", F.lit("")).alias("key"))
    return numbered(e, ["topic"], ["g", "later", "key", "entry_id"], "place").select("topic", "entry_id", "cited", "place")


def j28_paragraphs(s, d):
    """Citations of each paragraph of a document."""
    p = _docs(s, d).where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", r"\n{2,}")).alias("paragraph", "p"))
    n = F.size(F.regexp_extract_all("p", F.lit(r"\[@([\w\-:]+)\]"), F.lit(1)))
    return p.select("doc_id", "paragraph", n.alias("citations")).where("citations > 0")


def b7_asset_union(s, d):
    """Assets of each entry over all of its versions."""
    a = table(s, d, "entries").select("entry_id", F.explode("asset_ids").alias("a")).where("a IS NOT NULL")
    return a.groupBy("entry_id").agg(F.array_join(F.array_sort(F.collect_set("a")), "|").alias("assets"))


def b8_gap_notes(s, d):
    n = files.notes(_entries(s, d))
    return n.select("topic", "gap", "entries", F.sha1("text").alias("text_sha1"))


def i7_doi_sets(s, d):
    """DOIs that only entries, only hits or both have."""
    e = _entries(s, d).select(doi_key(F.col("doi")).alias("k")).where("k IS NOT NULL").distinct()
    h = table(s, d, "hits").select(doi_key(F.col("doi")).alias("k")).where("k IS NOT NULL").distinct()
    parts = [("both", e.intersect(h)), ("entries", e.exceptAll(h)), ("hits", h.exceptAll(e))]
    out = None
    for name, df in parts:
        row = df.agg(F.count("*").alias("dois")).select(F.lit(name).alias("held_by"), "dois")
        out = row if out is None else out.unionByName(row)
    return out


def f21_partial_checks(s, d):
    v = F.coalesce("verification.partial", F.lit(False))
    return _entries(s, d).groupBy("topic").agg(F.count_if(v).alias("partial"), F.count_if(F.coalesce(F.size("verification.warnings"), F.lit(0)) > 0).alias("warned"), F.countDistinct("verification.provider").alias("providers"))


def k11_prune_targets(s, d):
    """Verified entries that no claim cites."""
    used = _claims(s, d).select("topic", F.col("key").alias("citation_key")).distinct()
    e = _entries(s, d).where("verification_status = 'verified' AND coalesce(excluded_reason, '') = ''").select("topic", "citation_key", "entry_id")
    return store.without(e, used, ["topic", "citation_key"])


def k17_apply_results(s, d):
    """The store after results: entries take the year and the title of the hit
    of their DOI where they have none."""
    h = table(s, d, "hits").withColumn("k", doi_key(F.col("doi"))).where("k IS NOT NULL").groupBy("k").agg(F.min_by(F.struct("title", "year"), "hit_id").alias("h"))
    e = _entries(s, d).select("entry_id", "title", F.col("year").cast("int").alias("year"), doi_key(F.col("doi")).alias("k"))
    year = F.coalesce("year", F.when(F.col("h.year") > 0, F.col("h.year").cast("int")))
    return e.join(h, "k", "left").select("entry_id", F.coalesce(F.when(F.trim("title") != "", F.col("title")), F.col("h.title")).alias("title"), year.alias("year"))


def a13_known_items(s, d):
    """Known works of each topic: the entries that came as seeds."""
    e = _entries(s, d).where("source LIKE 'seed%'")
    return e.groupBy("topic").agg(F.count("*").alias("seeds"), F.countDistinct(doi_key(F.col("doi"))).alias("dois"))


NAMES = [c12_author_names, c24_corrections, c31_journal_signals, issn_records, e22_cited_clusters, h2_store_dump, j28_paragraphs, b7_asset_union, b8_gap_notes, i7_doi_sets, f21_partial_checks, k11_prune_targets, k17_apply_results, a13_known_items]
QUERIES = {f.__name__: f for f in NAMES}

_EK = f"ek AS (SELECT DISTINCT {doi_sql('doi')} AS k FROM e WHERE {doi_sql('doi')} IS NOT NULL)"
_HK = f"hk AS (SELECT DISTINCT {doi_sql('doi')} AS k FROM hits WHERE {doi_sql('doi')} IS NOT NULL)"
SQL = {
    "c12_author_names": "WITH n AS (SELECT DISTINCT unnest(authors) AS author FROM entries), p AS (SELECT author, trim(split_part(author, ',', 1)) AS f, array_to_string(list_transform(regexp_extract_all(trim(split_part(author, ',', 2)), '[\\p{L}]+'), lambda w: upper(substr(w, 1, 1)) || '.'), ' ') AS l FROM n WHERE author IS NOT NULL) SELECT author, CASE WHEN l <> '' THEN f || ', ' || l ELSE f END AS formatted FROM p",
    "c24_corrections": f"WITH {E_SQL}, c AS (SELECT lower(unnest(verification.corrections)) AS c FROM e) SELECT CASE WHEN contains(c, 'retract') THEN 'retraction' WHEN contains(c, 'concern') THEN 'concern' WHEN c IN ('correction','erratum','corrigendum') THEN 'erratum' ELSE 'other' END AS kind, count(*) AS notices FROM c WHERE c IS NOT NULL GROUP BY 1",
    "c31_journal_signals": f"WITH {E_SQL} SELECT journal, count(*) AS entries, count(*) FILTER (coalesce(journal_signals.h_index, 999) < 10 AND NOT coalesce(journal_signals.in_doaj, false)) AS weak FROM e WHERE journal_signals IS NOT NULL AND journal <> '' GROUP BY 1",
    "issn_records": f"WITH {E_SQL}, i AS (SELECT unnest(issn) AS i FROM e) SELECT upper(regexp_replace(i, '[^0-9Xx]', '', 'g')) AS issn, count(*) AS entries FROM i WHERE i IS NOT NULL GROUP BY 1",
    "e22_cited_clusters": f"WITH {C_SQL}, {E_SQL}, u AS (SELECT DISTINCT topic, key FROM c), k AS (SELECT topic, citation_key, entry_id, {_CLUSTER} AS cluster FROM e) SELECT k.topic, cluster, count(DISTINCT entry_id) AS entries FROM k JOIN u ON u.topic = k.topic AND u.key = k.citation_key WHERE cluster IS NOT NULL GROUP BY ALL HAVING count(DISTINCT entry_id) > 1",
    "h2_store_dump": f"WITH {C_SQL}, {E_SQL}, u AS (SELECT DISTINCT topic, key FROM c), k AS (SELECT e.topic, gap, citation_key, entry_id, u.key IS NOT NULL AS cited FROM e LEFT JOIN u ON u.topic = e.topic AND u.key = e.citation_key) SELECT topic, entry_id, cited, CAST(row_number() OVER (PARTITION BY topic ORDER BY coalesce(gap, ''), cited DESC, coalesce(citation_key, ''), entry_id) AS INTEGER) AS place FROM k",
    "j28_paragraphs": "WITH p AS (SELECT doc_id, unnest(range(len(regexp_split_to_array(text, '\\n{2,}')))) AS paragraph, unnest(regexp_split_to_array(text, '\\n{2,}')) AS p FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, CAST(paragraph AS INTEGER) AS paragraph, CAST(len(regexp_extract_all(p, '\\[@([\\w\\-:]+)\\]', 1)) AS INTEGER) AS citations FROM p) SELECT * FROM n WHERE citations > 0",
    "b7_asset_union": "WITH a AS (SELECT DISTINCT entry_id, unnest(asset_ids) AS a FROM entries) SELECT entry_id, string_agg(a, '|' ORDER BY a) AS assets FROM a WHERE a IS NOT NULL GROUP BY 1",
    "b8_gap_notes": f"WITH {E_SQL}, l AS (SELECT topic, gap, coalesce(year, 0) AS y, coalesce(citation_key, '') AS k, '- [@' || coalesce(citation_key, '') || '] ' || coalesce(title, '') || ' (' || coalesce(CAST(year AS VARCHAR), 'n.d.') || ')' AS t FROM e WHERE gap IS NOT NULL) SELECT topic, gap, count(*) AS entries, sha1(string_agg(t, chr(10) ORDER BY y, k, t)) AS text_sha1 FROM l GROUP BY 1, 2",
    "i7_doi_sets": f"WITH {E_SQL}, {_EK}, {_HK} SELECT 'both' AS held_by, count(*) AS dois FROM ek JOIN hk USING (k) UNION ALL SELECT 'entries', count(*) FROM ek WHERE k NOT IN (SELECT k FROM hk) UNION ALL SELECT 'hits', count(*) FROM hk WHERE k NOT IN (SELECT k FROM ek)",
    "f21_partial_checks": f"WITH {E_SQL} SELECT topic, count(*) FILTER (coalesce(verification.partial, false)) AS partial, count(*) FILTER (coalesce(len(verification.warnings), 0) > 0) AS warned, count(DISTINCT verification.provider) AS providers FROM e GROUP BY 1",
    "k11_prune_targets": f"WITH {C_SQL}, {E_SQL} SELECT topic, citation_key, entry_id FROM e WHERE verification_status = 'verified' AND coalesce(excluded_reason, '') = '' AND NOT EXISTS (SELECT 1 FROM c WHERE c.topic = e.topic AND c.key = e.citation_key)",
    "k17_apply_results": f"WITH {E_SQL}, hk AS (SELECT {doi_sql('doi')} AS k, title, year, hit_id FROM hits), h AS (SELECT * FROM hk WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY hit_id) = 1), ek AS (SELECT entry_id, title, year, {doi_sql('doi')} AS k FROM e) SELECT entry_id, coalesce(CASE WHEN trim(ek.title) <> '' THEN ek.title END, h.title) AS title, CAST(coalesce(ek.year, CASE WHEN h.year > 0 THEN h.year END) AS INTEGER) AS year FROM ek LEFT JOIN h USING (k)",
    "a13_known_items": f"WITH {E_SQL} SELECT topic, count(*) AS seeds, count(DISTINCT {doi_sql('doi')}) AS dois FROM e WHERE source LIKE 'seed%' GROUP BY 1",
}

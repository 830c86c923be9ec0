"""Queries over the record store: normal forms, keys, strings, merges, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeflow.functions import records as R
from citeflow.functions.text import doi_key, plain
from citeflow.operators import linking, ranking, store
from citeflow.runtime import table

T = table
#: Terms of the keyword search, a parameter of the report.
KEYWORDS = ["randomised", "dose", "renal"]
#: Words of titles that carry no topic (fixed values).
STOP = (
    "analysis", "approach", "association", "based", "between", "clinical", "comparison", "effect", "effects", "evidence", "from", "impact", "into", "meta", "methods", "model",
    "outcomes", "over", "patients", "randomized", "randomised", "review", "studies", "study", "systematic", "trial", "trials", "with", "without", "using", "their", "that", "this",
    "among", "across", "during", "after", "before", "versus", "role", "data", "results",
)


def _entries(s, d):
    """One row for each entry_id: the one that arrived last."""
    return store.one_each(T(s, d, "entries"), ["entry_id"], [F.col("seq").desc()])


E_SQL = "e AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY seq DESC) = 1)"


def doi_sql(x: str) -> str:
    """DOI normal form in DuckDB."""
    x = f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"
    x = f"replace({x}, '%2f', '/')"
    x = f"CASE WHEN regexp_matches({x}, '^(https?://[^/]+/+|(www\\.)?(dx\\.)?doi\\.org/+).*10\\.') THEN regexp_replace({x}, '^(?:https?://[^/]+/+|(?:www\\.)?(?:dx\\.)?doi\\.org/+)', '') ELSE {x} END"
    x = f"regexp_replace({x}, '^(?:urn:|info:)?doi\\s*[:/]?\\s*', '')"
    x = f"regexp_replace({x}, '[\\s.,;:)\\]}}>\"'']+$', '')"
    return f"(CASE WHEN regexp_matches({x}, '^10\\.\\d+/\\S') THEN {x} END)"


def c1_normalized_entries(s, d):
    e = store.normalized_entries(T(s, d, "entries"))
    return e.select("entry_id", "seq", "doi", "title", "journal", F.array_join("authors", "|").alias("authors"), "year", "gap", "study_type", "verification_status", "oa_status", "retracted", "has_fulltext_xml", "superseded_by", F.size("supersedes").alias("n_supersedes"), "excluded_reason")


def c1_normalized_gaps(s, d):
    g = store.normalized_gaps(T(s, d, "gaps"))
    return g.select("topic", "gap_id", "arrived_at", "status", "query", F.array_join("depends_on", "|").alias("depends_on"), "subgap_of", "created_round", F.array_join(F.array_sort(F.map_keys(F.coalesce("fields", F.create_map().cast("map<string,string>")))), "|").alias("field_names"))


def c2_grounding(s, d):
    e = _entries(s, d)
    level = R.grounding(F.col("fetch_state.fulltext_xml"), F.col("has_fulltext_xml"), F.col("fetch_state.ocr"), F.col("paths.abstract"), F.col("paths.pdf_text"), F.col("paths.ocr"))
    rungs = {"abstract": F.col("fetch_state.abstract"), "fulltext": F.col("fetch_state.fulltext_xml"), "pdf": F.col("fetch_state.pdf"), "ocr": F.col("fetch_state.ocr")}
    return e.select("entry_id", level.alias("grounding"), (level != "title_only").alias("grounded"), R.next_rung(level, rungs).alias("next_rung"))


def c5_publication_flags(s, d):
    low = F.transform(F.coalesce("verification.corrections", F.array().cast("array<string>")), lambda x: F.lower(x))
    return _entries(s, d).select(
        "entry_id", F.when(F.coalesce("retracted", F.lit(False)), "retracted").otherwise("none").alias("retraction_status"),
        F.coalesce(F.exists(low, lambda x: x.contains("concern")), F.lit(False)).alias("expression_of_concern"),
        F.when(F.exists(low, lambda x: x.isin(R.ERRATA)), "corrected").otherwise("none").alias("erratum_status"),
        F.when(F.coalesce("journal", F.lit("")).rlike(R.PREPRINT_NAMES), "preprint").otherwise("published").alias("preprint_status"),
        R.title_cluster(F.col("title")).alias("duplicate_cluster_id"),
    )


def c7_title_clusters(s, d):
    e = _entries(s, d).select("entry_id", R.title_cluster(F.col("title")).alias("cluster")).where("cluster IS NOT NULL")
    return e.groupBy("cluster").agg(F.count("*").alias("entries"), F.min("entry_id").alias("first_entry")).where("entries > 1")


def c8_citation_keys(s, d):
    e = _entries(s, d).withColumn("base", R.key_base(F.col("authors"), F.col("year")))
    e = ranking.numbered(e, ["topic", "base"], ["seq"], "n")  # a base may hold any number of entries
    n = F.col("n")
    suffix = F.when(F.col("n") == 1, "").when(F.col("n") <= 11, F.substring(F.lit("abcdefghij"), F.col("n") - 1, F.lit(1))).otherwise("x")
    return e.select("entry_id", "topic", F.concat("base", suffix).alias("generated_key"), R.hashed_key(F.col("base"), F.col("doi")).alias("hashed_key"))


def c10_references(s, d):
    e = _entries(s, d)
    a = R.strings(F.col("authors"))
    return e.select("entry_id", R.apa(a, F.col("year"), F.col("title"), F.col("journal"), F.lower(F.coalesce("doi", F.lit("")))).alias("reference"), R.in_text(a).alias("in_text"))


def c15_families(s, d):
    names = T(s, d, "entries").select(F.explode("authors").alias("author")).where("author IS NOT NULL").distinct()
    return names.select("author", R.family(F.col("author")).alias("family"), R.bare_family(F.col("author")).alias("bare_family"))


def c26_normalized_dois(s, d):
    rows = T(s, d, "entries").select(F.lit("entries").alias("origin"), "doi").unionByName(T(s, d, "hits").select(F.lit("hits").alias("origin"), "doi"))
    return rows.groupBy("origin", doi_key(F.col("doi")).alias("doi_key")).agg(F.count("*").alias("records"), F.countDistinct("doi").alias("spellings"))


def c27_warning_codes(s, d):
    w = _entries(s, d).select(F.explode("verification.warnings").alias("w")).where("w IS NOT NULL")
    return w.groupBy(F.split_part("w", F.lit("("), F.lit(1)).alias("code")).agg(F.count("*").alias("n"))


def c29_gap_required_fields(s, d):
    g = T(s, d, "gaps").groupBy("topic", "gap_id").agg(F.max_by("fields", "arrived_at").alias("fields"))
    have = F.map_keys(F.map_filter(F.coalesce("fields", F.create_map().cast("map<string,string>")), lambda k, v: v != ""))
    return g.select("topic", "gap_id", F.array_join(F.array_except(F.array(*map(F.lit, ["population", "intervention", "comparator", "outcome"])), have), ",").alias("missing"))


def d7_relevant_titles(s, d):
    """Entries whose title holds none of their gap's relevance terms."""
    g = T(s, d, "gaps").groupBy("topic", "gap_id").agg(F.max_by("relevance_terms", F.struct("arrived_at", "relevance_terms")).alias("relevance_terms"))
    raw = F.trim(F.coalesce("relevance_terms", F.lit("")))
    terms = F.filter(F.transform(F.split(raw, F.when(raw.contains(","), F.lit(",")).otherwise(F.lit(r"\s+"))), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    e = _entries(s, d).select("entry_id", "topic", F.col("gap").alias("gap_id"), F.lower(F.coalesce("title", F.lit(""))).alias("title"))
    j = e.join(g.select("topic", "gap_id", terms.alias("terms")), ["topic", "gap_id"])
    hit = (F.size("terms") == 0) | F.exists("terms", lambda t: F.col("title").contains(t))
    return j.groupBy("topic", "gap_id").agg(F.count("*").alias("entries"), F.count_if(hit).alias("relevant"))


def d12_doi_shapes(s, d):
    return T(s, d, "hits").groupBy("source", F.coalesce(F.col("doi").rlike(r"^10\..+/.+$"), F.lit(False)).alias("valid")).agg(F.count("*").alias("n"))


def _standing(s, d):
    """The first record of each DOI, without those retracted or superseded."""
    e = store.normalized_entries(T(s, d, "entries")).groupBy("doi").agg(F.min_by(F.struct("title", "authors", "year", "journal", "retracted", "superseded_by"), "seq").alias("r"))
    return e.where("doi <> ''").select("doi", "r.*").where("NOT retracted AND superseded_by IS NULL")


def e7_near_duplicate_titles(s, d):
    return linking.near_duplicates(_standing(s, d)).select("old", "new", F.round("similarity", 6).alias("similarity"))


def k16_supersession(s, d):
    out = store.supersession(linking.near_duplicates(_standing(s, d)).withColumn("similarity", F.round("similarity", 9)))
    return out.select("doi", "superseded_by", F.array_join("supersedes", "|").alias("supersedes"))


def e5_phantom_gaps(s, d):
    declared = T(s, d, "gaps").select("topic", F.col("gap_id").alias("gap")).distinct()
    e = _entries(s, d).where("gap IS NOT NULL AND gap <> ''")
    return e.join(declared, ["topic", "gap"], "left_anti").groupBy("topic", "gap").agg(F.count("*").alias("entries"))


def e6_gap_evidence(s, d):
    """Entries that speak for a gap: its own and its parent's."""
    g = T(s, d, "gaps").select("topic", "gap_id", "subgap_of").distinct()
    reach = g.select("topic", "gap_id", F.explode(F.array_distinct(F.filter(F.array("gap_id", "subgap_of"), lambda x: x.isNotNull()))).alias("gap")).distinct()
    return reach.join(_entries(s, d).select("topic", "gap", "entry_id"), ["topic", "gap"]).groupBy("topic", "gap_id").agg(F.countDistinct("entry_id").alias("entries"))


def f1_bucket_matrix(s, d):
    e = store.normalized_entries(_entries(s, d))
    bucket = F.when(F.col("excluded_reason").isNotNull(), "excluded").otherwise(F.col("verification_status"))
    return e.select("topic", F.coalesce("gap", F.lit("<no gap>")).alias("gap"), bucket.alias("b")).groupBy("topic", "gap").pivot("b", ["excluded", "failed", "pending", "verified"]).count().fillna(0, ["excluded", "failed", "pending", "verified"])


def f3_tier_summary(s, d):
    e = store.normalized_entries(_entries(s, d))
    n = e.groupBy("topic", "study_type").agg(F.count("*").alias("n"))
    rank = F.array_position(F.array(*map(F.lit, R.STUDY_TYPES)), F.col("study_type"))
    parts = F.array_sort(F.collect_list(F.struct(rank.alias("o"), F.concat("study_type", F.lit("="), F.col("n").cast("string")).alias("t"))))
    return n.groupBy("topic").agg(F.array_join(F.transform(parts, lambda x: x["t"]), ", ").alias("tiers"))


def f7_funnel(s, d):
    e = store.normalized_entries(_entries(s, d))
    used = T(s, d, "claims").select("topic", F.col("key").alias("citation_key")).distinct().withColumn("cited", F.lit(1))
    j = e.join(used, ["topic", "citation_key"], "left")
    g = j.groupBy("topic").agg(F.count("*").alias("identified"), F.count_if(F.col("verification_status") != "failed").alias("screened"), F.count_if("retracted").alias("retracted"), F.count_if(F.col("excluded_reason").isNotNull()).alias("excluded"), F.count("cited").alias("included"))
    return g.withColumn("included_pct", F.round(100 * F.col("included") / F.col("identified"), 1))


def f8_round_additions(s, d):
    return _entries(s, d).groupBy("topic", F.col("added_round").cast("int").alias("round"), "gap", "source").agg(F.count("*").alias("added"))


def f10_rounds_filled(s, d):
    """Entries of each round, rounds without any included."""
    n = _entries(s, d).where("added_round IS NOT NULL").groupBy("topic", F.col("added_round").cast("int").alias("round")).agg(F.count("*").alias("n"))
    spans = n.groupBy("topic").agg(F.max("round").alias("last")).where("last >= 1").select("topic", F.explode(F.sequence(F.lit(1), "last")).alias("round"))
    return spans.join(n, ["topic", "round"], "left").fillna(0, ["n"])


def f12_latest_round(s, d):
    a = T(s, d, "topics").select("topic", F.col("rounds").cast("int").alias("r"))
    b = T(s, d, "entries").select("topic", F.col("added_round").cast("int").alias("r"))
    c = T(s, d, "gaps").select("topic", F.col("created_round").cast("int").alias("r"))
    return a.unionByName(b).unionByName(c).groupBy("topic").agg(F.coalesce(F.max("r"), F.lit(0)).alias("latest_round"))


def f13_term_clusters(s, d):
    declared = T(s, d, "gaps").select("topic", F.col("gap_id").alias("gap")).distinct().withColumn("declared", F.lit(True))
    terms = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("[a-z][a-z0-9-]{3,}"), F.lit(0))), F.array(*map(F.lit, STOP)))
    e = _entries(s, d).select("topic", "gap", F.coalesce("citation_key", "doi").alias("key"), F.explode(terms).alias("term"))
    j = e.join(declared, ["topic", "gap"], "left")
    g = j.groupBy("topic", "term").agg(F.countDistinct("key").alias("n"), F.array_sort(F.collect_set(F.when(F.col("declared"), F.col("gap")))).alias("gaps")).where("n >= 3")
    return g.select("topic", "term", "n", F.array_join("gaps", ",").alias("gaps"), (F.size("gaps") == 0).alias("uncovered"))


def g3_seed_top(s, d):
    from citeflow.operators.ranking import top

    e = store.normalized_entries(_entries(s, d)).where("gap IS NOT NULL")
    tier = F.array_position(F.array(*map(F.lit, R.STUDY_TYPES)), F.col("study_type"))
    return top(e.withColumn("tier", tier), ["topic", "gap"], [F.col("tier"), F.coalesce(F.col("year"), F.lit(0)).desc(), F.col("doi"), F.col("entry_id")], 3).select("topic", "gap", "entry_id", "rank")


def g2_saturation(s, d):
    from citeflow.operators.ranking import saturation

    n = _entries(s, d).where("added_round IS NOT NULL").groupBy("topic", F.col("added_round").cast("int").alias("round")).agg(F.count("*").alias("n"))
    return saturation(n, ["topic"], "round", "n").select("topic", "round", "n", "upto", F.round("ratio", 6).alias("ratio"), (F.col("ratio") <= 0.1).alias("quiet"))


def g11_upsert(s, d):
    """The store after all versions: gap, round and source as first seen, the
    rest as last seen; verified once verified."""
    e = T(s, d, "entries").withColumn("gap", R.filled(F.col("gap")))
    return store.merged(e, ["entry_id"], "seq", ["gap", "added_round", "source"], ["title", "year", "doi"], {"verification_status": "verified"})


def k_current_entries(s, d):
    return store.current(T(s, d, "entries"), ["entry_id"], ["arrived_at", "seq"]).select("entry_id", "topic", "doi", "title", "seq")


def h1_keyword_top(s, d):
    score = linking.keyword_score(F.col("title"), F.col("journal"), KEYWORDS)
    e = _entries(s, d).where(~F.coalesce("retracted", F.lit(False))).withColumn("score", score).where("score >= 1.0")
    return e.orderBy(F.desc("score"), "topic", "doi", "entry_id").limit(30).select("topic", "entry_id", "score")


def h3_study_types(s, d):
    e = store.normalized_entries(_entries(s, d))
    return e.groupBy("topic", "study_type").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def h4_reference_order(s, d):
    from citeflow.operators.ranking import numbered

    e = _entries(s, d)
    fam = F.lower(F.trim(F.split_part(F.coalesce(F.try_element_at("authors", F.lit(1)), F.lit("")), F.lit(","), F.lit(1))))
    e = e.select("topic", "entry_id", fam.alias("family"), F.coalesce("year", F.lit(0)).alias("year"))
    return numbered(e, ["topic"], ["family", "year", "entry_id"], "place").select("topic", "entry_id", "place")


def m5_verification(s, d):
    """Entries against the hit of their DOI: how title, year and first author
    disagree."""
    e = _entries(s, d).select("entry_id", doi_key(F.col("doi")).alias("k"), "title", "year", "authors").where("k IS NOT NULL")
    h = T(s, d, "hits").withColumn("k", doi_key(F.col("doi"))).where("k IS NOT NULL").groupBy("k").agg(F.min_by(F.struct(F.col("title").alias("h_title"), F.col("year").alias("h_year"), F.col("authors").alias("h_authors")), "hit_id").alias("h")).select("k", "h.*")
    j = e.join(h, "k", "left")
    sim = R.jaccard(R.word_set(F.col("title")), R.word_set(F.col("h_title")))
    first = R.bare_family(F.try_element_at("h_authors", F.lit(1)))
    claimed = F.transform(R.strings(F.col("authors")), R.bare_family)
    found = F.col("h_title").isNotNull() | F.col("h_authors").isNotNull()
    codes = F.array_compact(F.array(
        F.when(~found, "not_found"), F.when(found & (sim < 0.4), "title_mismatch"),
        F.when(found & F.col("year").isNotNull() & F.col("h_year").isNotNull() & (F.col("h_year") != 0) & (F.col("year") != F.col("h_year")), "year_mismatch"),
        F.when(found & (F.size("authors") > 0) & (F.size("h_authors") > 0) & (first != "") & ~F.array_contains(claimed, first), "first_author_mismatch"),
    ))
    return j.select("entry_id", F.array_join(codes, ",").alias("codes"))


def a21_source_text(s, d):
    """The richest text behind each path and its length: one row a path."""
    src = T(s, d, "sources").where("text IS NOT NULL AND text <> ''")
    order = F.when(F.col("level") == "pdf_text", 1).when(F.col("level") == "ocr", 2).otherwise(3)
    return src.groupBy("topic", F.lower("doi").alias("doi")).agg(F.min_by(F.struct("level", F.length("text").alias("chars")), F.struct(order.alias("o"), "source_id")).alias("r")).select("topic", "doi", "r.*")


def a22_abstract_cards(s, d):
    from citeflow.operators.prose import front_matter

    src = T(s, d, "sources").where("level = 'abstract'").groupBy("source_id").agg(F.min("text").alias("text"))
    section = F.regexp_extract("text", r"(?ms)^## Abstract[ ]*\n(.*?)(?=^## |\z)", 1)
    return src.where(F.col("text").startswith("---\n")).select("source_id", front_matter(F.col("text"), "doi").alias("doi"), front_matter(F.col("text"), "year").alias("year"), F.length(F.trim(F.regexp_replace(section, r"\s+", " "))).alias("chars"))


def j45_plain_text(s, d):
    src = T(s, d, "sources").where("level = 'abstract'").select("source_id", "text").distinct()
    return src.where("text LIKE '%<%'").select("source_id", plain(F.col("text")).alias("plain"))


NAMES = [c1_normalized_entries, c1_normalized_gaps, c2_grounding, c5_publication_flags, c7_title_clusters, c8_citation_keys, c10_references, c15_families, c26_normalized_dois, c27_warning_codes, c29_gap_required_fields, d7_relevant_titles, d12_doi_shapes, e5_phantom_gaps, e6_gap_evidence, e7_near_duplicate_titles, k16_supersession, f1_bucket_matrix, f3_tier_summary, f7_funnel, f8_round_additions, f10_rounds_filled, f12_latest_round, f13_term_clusters, g2_saturation, g3_seed_top, g11_upsert, k_current_entries, h1_keyword_top, h3_study_types, h4_reference_order, m5_verification, a21_source_text, a22_abstract_cards, j45_plain_text]
QUERIES = {f.__name__: f for f in NAMES}

_STUDY = "CASE WHEN study_type IN ('rct','meta','cohort','case_control','review','mechanism','guideline','other') THEN study_type ELSE 'other' END"
_STATUS = "CASE WHEN verification_status IN ('pending','verified','failed') THEN verification_status ELSE 'pending' END"
_TIER = f"list_position(['rct','meta','cohort','case_control','review','mechanism','guideline','other'], {_STUDY})"
_CLUSTER = "CASE WHEN length(regexp_replace(lower(coalesce(title,'')), '[^a-z0-9一-鿿]', '', 'g')) >= 6 THEN 't' || substr(sha1(regexp_replace(lower(coalesce(title,'')), '[^a-z0-9一-鿿]', '', 'g')), 1, 10) END"
_STR = "list_filter(coalesce({}, []), lambda x: x IS NOT NULL)"
_PART = "van|von|de|del|du|da|di|do|la|le|der|den|ten|ter"


def fam_sql(x: str) -> str:
    return f"lower(CASE WHEN instr({x}, ',') > 0 THEN trim(split_part({x}, ',', 1)) ELSE regexp_extract({x}, '(\\S*)\\s*$', 1) END)"


def bare_sql(x: str) -> str:
    n = fam_sql(x)
    r = f"trim(regexp_replace({n}, '^(?:(?:{_PART})\\s+)+', ''))"
    return f"CASE WHEN {r} IN ('{_PART.replace('|', chr(39) + ',' + chr(39))}') OR {r} = '' THEN {n} ELSE {r} END"


_BASE = """CASE WHEN regexp_matches(f, '^[a-z]') THEN f ELSE 'a' || f END || coalesce(CAST(CAST(year AS INTEGER) AS VARCHAR), 'na')"""
_WORDS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}_]+'))"
_JAC = "(CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END)"
_BITS = "CAST(('0x' || substr(sha1(lower(doi)), 1, 5)) AS INTEGER)"
_NEAR = f"""
n AS (SELECT lower(coalesce(doi,'')) AS doi, coalesce(title,'') AS title, {_STR.format('authors')} AS authors, year, coalesce(journal,'') AS journal, coalesce(retracted, false) AS gone, coalesce(superseded_by, '') AS successor, seq FROM entries),
u AS (SELECT * FROM (SELECT * FROM n WHERE doi <> '' QUALIFY row_number() OVER (PARTITION BY doi ORDER BY seq) = 1) WHERE NOT gone AND successor = ''),
w AS (SELECT doi, {_WORDS.format('title')} AS w, lower(trim(split_part(authors[1], ',', 1))) AS fam, CAST(year AS INTEGER) AS year,
  (starts_with(doi,'10.1101/') OR starts_with(doi,'10.21203/') OR starts_with(doi,'10.31219/') OR starts_with(doi,'10.20944/')
   OR lower(trim(journal)) IN ('biorxiv','medrxiv','research square','preprints.org','')) AS pre FROM u WHERE len(authors) > 0),
p AS (SELECT a.doi AS da, b.doi AS db, {_JAC.format(a='a.w', b='b.w')} AS s, a.pre AS pa, b.pre AS pb, coalesce(a.year,0) AS ya, coalesce(b.year,0) AS yb
  FROM w a JOIN w b ON a.fam = b.fam AND a.doi < b.doi AND (a.year IS NULL OR b.year IS NULL OR abs(a.year - b.year) <= 1) WHERE a.fam <> ''),
dir AS (SELECT *, CASE WHEN pa AND NOT pb THEN true WHEN pb AND NOT pa THEN false WHEN ya <> yb THEN ya < yb ELSE true END AS a_old FROM p WHERE s > 0.85),
pairs AS (SELECT CASE WHEN a_old THEN da ELSE db END AS old, CASE WHEN a_old THEN db ELSE da END AS new, s FROM dir)
"""
SQL = {
    "c1_normalized_entries": f"SELECT entry_id, seq, lower(coalesce(doi,'')) AS doi, coalesce(title,'') AS title, coalesce(journal,'') AS journal, array_to_string({_STR.format('authors')}, '|') AS authors, year, nullif(gap,'') AS gap, {_STUDY} AS study_type, {_STATUS} AS verification_status, coalesce(nullif(oa_status,''),'unknown') AS oa_status, coalesce(retracted,false) AS retracted, coalesce(has_fulltext_xml,false) AS has_fulltext_xml, nullif(superseded_by,'') AS superseded_by, CAST(len({_STR.format('supersedes')}) AS INTEGER) AS n_supersedes, nullif(excluded_reason,'') AS excluded_reason FROM entries",
    "c1_normalized_gaps": f"SELECT topic, gap_id, arrived_at, CASE WHEN status IN ('pending','resolved','insufficient') THEN status ELSE 'pending' END AS status, CASE WHEN trim(query) <> '' THEN query END AS query, array_to_string({_STR.format('depends_on')}, '|') AS depends_on, nullif(subgap_of,'') AS subgap_of, coalesce(created_round,0) AS created_round, array_to_string(list_sort(coalesce(map_keys(fields), [])), '|') AS field_names FROM gaps",
    "c2_grounding": f"""WITH {E_SQL}, g AS (SELECT entry_id, fetch_state AS f, CASE
  WHEN (coalesce(fetch_state.fulltext_xml,'')='succeeded' OR coalesce(has_fulltext_xml,false)) AND (coalesce(paths.pdf_text,'')<>'' OR coalesce(paths.ocr,'')<>'' OR coalesce(paths.abstract,'')<>'') THEN 'fulltext'
  WHEN coalesce(paths.pdf_text,'')<>'' THEN 'pdf_text'
  WHEN (coalesce(fetch_state.ocr,'')='succeeded' OR coalesce(paths.ocr,'')<>'') AND (coalesce(paths.ocr,'')<>'' OR coalesce(paths.abstract,'')<>'') THEN 'ocr'
  WHEN coalesce(paths.abstract,'')<>'' THEN 'abstract' ELSE 'title_only' END AS grounding FROM e)
SELECT entry_id, grounding, grounding <> 'title_only' AS grounded, CASE WHEN grounding <> 'title_only' THEN NULL
  WHEN coalesce(f.abstract,'') NOT IN ('succeeded','failed','skipped') THEN 'abstract' WHEN coalesce(f.fulltext_xml,'') NOT IN ('succeeded','failed','skipped') THEN 'fulltext'
  WHEN coalesce(f.pdf,'') NOT IN ('succeeded','failed','skipped') THEN 'pdf' WHEN coalesce(f.ocr,'') NOT IN ('succeeded','failed','skipped') THEN 'ocr' END AS next_rung FROM g""",
    "c5_publication_flags": f"""WITH {E_SQL} SELECT entry_id, CASE WHEN coalesce(retracted,false) THEN 'retracted' ELSE 'none' END AS retraction_status,
  len(list_filter(coalesce(verification.corrections,[]), lambda x: contains(lower(x),'concern'))) > 0 AS expression_of_concern,
  CASE WHEN len(list_filter(coalesce(verification.corrections,[]), lambda x: lower(x) IN ('correction','erratum','corrigendum'))) > 0 THEN 'corrected' ELSE 'none' END AS erratum_status,
  CASE WHEN regexp_matches(coalesce(journal,''), '(?i)biorxiv|medrxiv|arxiv|research\\s*square|preprint|ssrn|chemrxiv|psyarxiv|osf') THEN 'preprint' ELSE 'published' END AS preprint_status,
  {_CLUSTER} AS duplicate_cluster_id FROM e""",
    "c7_title_clusters": f"WITH {E_SQL} SELECT {_CLUSTER} AS cluster, count(*) AS entries, min(entry_id) AS first_entry FROM e GROUP BY 1 HAVING cluster IS NOT NULL AND count(*) > 1",
    "c8_citation_keys": f"""WITH {E_SQL}, b AS (SELECT *, regexp_replace(lower(trim(split_part(coalesce(authors[1],'anon'), ',', 1))), '[^a-z0-9]', '', 'g') AS f0 FROM e),
c AS (SELECT *, CASE WHEN f0 = '' THEN 'anon' ELSE f0 END AS f FROM b), k AS (SELECT *, {_BASE} AS base FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY topic, base ORDER BY seq) AS n FROM k)
SELECT entry_id, topic, base || CASE WHEN n = 1 THEN '' WHEN n <= 11 THEN substr('abcdefghij', CAST(n - 1 AS BIGINT), 1) ELSE 'x' END AS generated_key,
 CASE WHEN coalesce(doi,'') = '' THEN base ELSE base || {" || ".join(f"substr('abcdefghijklmnopqrstuvwxyz234567', (({_BITS} >> {15 - 5 * i}) & 31) + 1, 1)" for i in range(4))} END AS hashed_key FROM n""",
    "c10_references": f"""WITH {E_SQL}, a AS (SELECT *, {_STR.format('authors')} AS a FROM e), t AS (SELECT *, CASE WHEN len(a)=0 THEN 'Anon.' WHEN len(a)=1 THEN a[1] WHEN len(a)>20 THEN array_to_string(a[1:19], ', ') || ', ... ' || a[-1] ELSE array_to_string(a[1:len(a)-1], ', ') || ', & ' || a[-1] END AS au FROM a)
SELECT entry_id, au || ' (' || coalesce(CAST(CAST(year AS INTEGER) AS VARCHAR),'n.d.') || '). ' || coalesce(title,'') || CASE WHEN coalesce(journal,'')<>'' THEN '. *' || journal || '*. ' ELSE '. ' END || 'https://doi.org/' || lower(coalesce(doi,'')) AS reference,
 CASE WHEN len(a)=1 THEN trim(split_part(a[1],',',1)) WHEN len(a)=2 THEN trim(split_part(a[1],',',1)) || ' & ' || trim(split_part(a[2],',',1)) WHEN len(a)>2 THEN trim(split_part(a[1],',',1)) || ' et al.' END AS in_text FROM t""",
    "c15_families": f"WITH n AS (SELECT DISTINCT unnest(authors) AS author FROM entries) SELECT author, {fam_sql('author')} AS family, {bare_sql('author')} AS bare_family FROM n WHERE author IS NOT NULL",
    "c26_normalized_dois": f"WITH r AS (SELECT 'entries' AS origin, doi FROM entries UNION ALL SELECT 'hits', doi FROM hits) SELECT origin, {doi_sql('doi')} AS doi_key, count(*) AS records, count(DISTINCT doi) AS spellings FROM r GROUP BY 1, 2",
    "c27_warning_codes": f"WITH {E_SQL}, w AS (SELECT unnest(verification.warnings) AS w FROM e) SELECT split_part(w,'(',1) AS code, count(*) AS n FROM w WHERE w IS NOT NULL GROUP BY 1",
    "c29_gap_required_fields": "WITH g AS (SELECT topic, gap_id, arg_max(fields, arrived_at) AS fields FROM gaps GROUP BY ALL) SELECT topic, gap_id, array_to_string(list_filter(['population','intervention','comparator','outcome'], lambda x: coalesce(fields[x], '') = ''), ',') AS missing FROM g",
    "d7_relevant_titles": f"""WITH {E_SQL}, g AS (SELECT topic, gap_id, trim(coalesce(last(relevance_terms ORDER BY arrived_at, relevance_terms NULLS FIRST),'')) AS r FROM gaps GROUP BY ALL),
t AS (SELECT topic, gap_id, list_filter(list_transform(CASE WHEN contains(r, ',') THEN string_split(r, ',') ELSE regexp_split_to_array(r, '\\s+') END, lambda x: lower(trim(x))), lambda x: x <> '') AS terms FROM g)
SELECT t.topic, t.gap_id, count(*) AS entries, count(*) FILTER (len(terms) = 0 OR len(list_filter(terms, lambda x: contains(lower(coalesce(title,'')), x))) > 0) AS relevant FROM e JOIN t ON e.topic = t.topic AND e.gap = t.gap_id GROUP BY ALL""",
    "d12_doi_shapes": "SELECT source, coalesce(regexp_matches(doi, '^10\\..+/.+$'), false) AS valid, count(*) AS n FROM hits GROUP BY ALL",
    "e5_phantom_gaps": f"WITH {E_SQL} SELECT e.topic, e.gap, count(*) AS entries FROM e WHERE coalesce(gap,'') <> '' AND NOT EXISTS (SELECT 1 FROM gaps g WHERE g.topic = e.topic AND g.gap_id = e.gap) GROUP BY ALL",
    "e6_gap_evidence": f"WITH {E_SQL}, g AS (SELECT DISTINCT topic, gap_id, unnest([gap_id, subgap_of]) AS gap FROM gaps) SELECT g.topic, g.gap_id, count(DISTINCT e.entry_id) AS entries FROM g JOIN e ON e.topic = g.topic AND e.gap = g.gap GROUP BY ALL",
    "e7_near_duplicate_titles": f"WITH {_NEAR} SELECT old, new, round(s, 6) AS similarity FROM pairs",
    "k16_supersession": f"""WITH {_NEAR}, b AS (SELECT old, new AS superseded_by FROM pairs QUALIFY row_number() OVER (PARTITION BY old ORDER BY round(s, 9) DESC, new) = 1),
o AS (SELECT superseded_by AS doi, array_to_string(list_sort(list(DISTINCT old)), '|') AS supersedes FROM b GROUP BY 1)
SELECT coalesce(b.old, o.doi) AS doi, b.superseded_by, o.supersedes FROM b FULL JOIN o ON b.old = o.doi""",
    "f1_bucket_matrix": f"WITH {E_SQL}, b AS (SELECT topic, coalesce(nullif(gap,''),'<no gap>') AS gap, CASE WHEN nullif(excluded_reason,'') IS NOT NULL THEN 'excluded' ELSE {_STATUS} END AS b FROM e) SELECT topic, gap, count(*) FILTER (b='excluded') AS excluded, count(*) FILTER (b='failed') AS failed, count(*) FILTER (b='pending') AS pending, count(*) FILTER (b='verified') AS verified FROM b GROUP BY ALL",
    "f3_tier_summary": f"WITH {E_SQL}, n AS (SELECT topic, {_STUDY} AS st, min({_TIER}) AS o, count(*) AS n FROM e GROUP BY ALL) SELECT topic, string_agg(st || '=' || n, ', ' ORDER BY o) AS tiers FROM n GROUP BY 1",
    "f7_funnel": f"WITH {E_SQL}, u AS (SELECT DISTINCT topic, key FROM claims) SELECT e.topic, count(*) AS identified, count(*) FILTER ({_STATUS} <> 'failed') AS screened, count(*) FILTER (coalesce(retracted,false)) AS retracted, count(*) FILTER (nullif(excluded_reason,'') IS NOT NULL) AS excluded, count(u.key) AS included, round(100.0 * count(u.key) / count(*), 1) AS included_pct FROM e LEFT JOIN u ON u.topic = e.topic AND u.key = e.citation_key GROUP BY 1",
    "f8_round_additions": f"WITH {E_SQL} SELECT topic, CAST(added_round AS INTEGER) AS round, gap, source, count(*) AS added FROM e GROUP BY ALL",
    "f10_rounds_filled": f"WITH {E_SQL}, n AS (SELECT topic, CAST(added_round AS INTEGER) AS round, count(*) AS n FROM e WHERE added_round IS NOT NULL GROUP BY ALL), s AS (SELECT topic, unnest(range(1, max(round) + 1)) AS round FROM n GROUP BY topic) SELECT s.topic, CAST(s.round AS INTEGER) AS round, coalesce(n.n, 0) AS n FROM s LEFT JOIN n ON n.topic = s.topic AND n.round = s.round",
    "f12_latest_round": "WITH r AS (SELECT topic, CAST(rounds AS INTEGER) AS r FROM topics UNION ALL SELECT topic, CAST(added_round AS INTEGER) FROM entries UNION ALL SELECT topic, CAST(created_round AS INTEGER) FROM gaps) SELECT topic, coalesce(max(r), 0) AS latest_round FROM r GROUP BY 1",
    "f13_term_clusters": f"""WITH {E_SQL}, t AS (SELECT topic, gap, coalesce(citation_key, doi) AS key, unnest(list_distinct(regexp_extract_all(lower(coalesce(title,'')), '[a-z][a-z0-9-]{{3,}}'))) AS term FROM e),
j AS (SELECT t.*, CASE WHEN g.gap_id IS NOT NULL THEN gap END AS dg FROM t LEFT JOIN (SELECT DISTINCT topic, gap_id FROM gaps) g ON g.topic = t.topic AND g.gap_id = t.gap WHERE term NOT IN ('{"','".join(STOP)}'))
SELECT topic, term, count(DISTINCT key) AS n, coalesce(string_agg(DISTINCT dg, ',' ORDER BY dg), '') AS gaps, count(dg) = 0 AS uncovered FROM j GROUP BY 1, 2 HAVING count(DISTINCT key) >= 3""",
    "g2_saturation": f"WITH {E_SQL}, n AS (SELECT topic, CAST(added_round AS INTEGER) AS round, count(*) AS n FROM e WHERE added_round IS NOT NULL GROUP BY ALL), u AS (SELECT *, CAST(sum(n) OVER (PARTITION BY topic ORDER BY round) AS BIGINT) AS upto FROM n) SELECT topic, round, n, upto, round(n / upto, 6) AS ratio, n / upto <= 0.1 AS quiet FROM u",
    "g3_seed_top": f"WITH {E_SQL} SELECT topic, gap, entry_id, CAST(row_number() OVER (PARTITION BY topic, gap ORDER BY {_TIER}, coalesce(year,0) DESC, lower(coalesce(doi,'')), entry_id) AS INTEGER) AS rank FROM e WHERE coalesce(gap,'') <> '' QUALIFY rank <= 3",
    "g11_upsert": "SELECT entry_id, arg_min(nullif(gap,''), seq) AS gap, arg_min(added_round, seq) AS added_round, arg_min(source, seq) AS source, arg_max(title, seq) AS title, arg_max(year, seq) AS year, arg_max(doi, seq) AS doi, CASE WHEN bool_or(coalesce(verification_status = 'verified', false)) THEN 'verified' ELSE arg_max(verification_status, seq) END AS verification_status, count(*) AS versions FROM entries GROUP BY 1",
    "k_current_entries": "WITH l AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY arrived_at DESC, seq DESC) = 1) SELECT entry_id, topic, doi, title, seq FROM l WHERE NOT coalesce(deleted, false)",
    "h1_keyword_top": f"WITH {E_SQL}, s AS (SELECT topic, entry_id, doi, " + " + ".join(f"(length(lower(coalesce(title,''))) - length(replace(lower(coalesce(title,'')), '{k}', ''))) / {len(k)} + 0.5 * ((length(lower(coalesce(journal,''))) - length(replace(lower(coalesce(journal,'')), '{k}', ''))) / {len(k)})" for k in KEYWORDS) + " AS score FROM e WHERE NOT coalesce(retracted, false)) SELECT topic, entry_id, CAST(score AS DOUBLE) AS score FROM s WHERE score >= 1.0 ORDER BY score DESC, topic, doi, entry_id LIMIT 30",
    "h3_study_types": f"WITH {E_SQL} SELECT topic, {_STUDY} AS study_type, count(*) AS n, min(seq) AS first_seq FROM e GROUP BY 1, 2",
    "h4_reference_order": f"WITH {E_SQL} SELECT topic, entry_id, CAST(row_number() OVER (PARTITION BY topic ORDER BY lower(trim(split_part(coalesce(authors[1],''), ',', 1))), coalesce(year, 0), entry_id) AS INTEGER) AS place FROM e",
    "m5_verification": f"""WITH {E_SQL}, k AS (SELECT entry_id, {doi_sql('doi')} AS k, title, year, authors FROM e), hk AS (SELECT {doi_sql('doi')} AS k, title AS h_title, year AS h_year, authors AS h_authors, hit_id FROM hits),
h AS (SELECT * FROM hk WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY hit_id) = 1),
j AS (SELECT k.*, h_title, h_year, h_authors, (h_title IS NOT NULL OR h_authors IS NOT NULL) AS found FROM k LEFT JOIN h USING (k) WHERE k.k IS NOT NULL),
c AS (SELECT entry_id, [CASE WHEN NOT found THEN 'not_found' END, CASE WHEN found AND {_JAC.format(a=_WORDS.format('title'), b=_WORDS.format('h_title'))} < 0.4 THEN 'title_mismatch' END,
 CASE WHEN found AND year IS NOT NULL AND h_year IS NOT NULL AND h_year <> 0 AND year <> h_year THEN 'year_mismatch' END,
 CASE WHEN found AND len(authors) > 0 AND len(h_authors) > 0 AND {bare_sql('h_authors[1]')} <> '' AND NOT list_contains(list_transform({_STR.format('authors')}, lambda x: {bare_sql('x')}), {bare_sql('h_authors[1]')}) THEN 'first_author_mismatch' END] AS c FROM j)
SELECT entry_id, array_to_string(list_filter(c, lambda x: x IS NOT NULL), ',') AS codes FROM c""",
    "a21_source_text": "SELECT topic, lower(doi) AS doi, level, CAST(length(text) AS INTEGER) AS chars FROM sources WHERE coalesce(text,'') <> '' QUALIFY row_number() OVER (PARTITION BY topic, lower(doi) ORDER BY CASE level WHEN 'pdf_text' THEN 1 WHEN 'ocr' THEN 2 ELSE 3 END, source_id) = 1",
    "a22_abstract_cards": "WITH t AS (SELECT source_id, min(text) AS text FROM sources WHERE level = 'abstract' GROUP BY 1), b AS (SELECT *, regexp_extract(text, '(?s)^---\\n(.*?)\\n---', 1) AS fm FROM t WHERE starts_with(text, '---' || chr(10))) SELECT source_id, nullif(trim(regexp_extract(fm, '(?m)^doi:[ ]*(.*)$', 1)), '') AS doi, nullif(trim(regexp_extract(fm, '(?m)^year:[ ]*(.*)$', 1)), '') AS year, CAST(length(trim(regexp_replace(split_part(regexp_extract(text, '(?ms)^## Abstract[ ]*\\n(.*)', 1), chr(10) || '## ', 1), '\\s+', ' ', 'g'))) AS INTEGER) AS chars FROM b",
    "j45_plain_text": "SELECT DISTINCT source_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^<>]{0,200}>', ' ', 'g'), '&(?:[a-zA-Z]{2,8}|#\\d{1,6});', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM sources WHERE level = 'abstract' AND text LIKE '%<%'",
}

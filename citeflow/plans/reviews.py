"""Queries over review text and claims: citations, sections, sentences,
numbers, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeflow.functions import numbers as N
from citeflow.functions.text import loose_key
from citeflow.operators import linking, prose, ranking, store
from citeflow.plans.records import E_SQL, _entries
from citeflow.runtime import table


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "source", "text", "topic")


def _claims(s, d):
    """One row for each claim_id: the one that arrived first."""
    return store.one_each(table(s, d, "claims"), ["claim_id"], [F.col("arrived_at"), F.col("round")])


C_SQL = "c AS (SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY arrived_at, round) = 1)"
_CITE = "\\[@([\\w\\-:]+)\\]"


def i6_cited_keys(s, d):
    """Distinct keys of each document, in order of first citation."""
    o = prose.occurrences(_docs(s, d), "doc_id", "text")
    return o.groupBy("doc_id", "cited").agg(F.min("pos").alias("first"), F.count("*").alias("times"))


def e12_citation_sections(s, d):
    return prose.under_headings(_docs(s, d), "doc_id", "text").groupBy("doc_id", "section").agg(F.count("*").alias("citations"))


def g9_section_sizes(s, d):
    sizes = prose.sections(_docs(s, d), "doc_id", "text").join(_docs(s, d).select("doc_id", "source"), "doc_id")
    return ranking.upper_median(sizes, ["source"], "size")


def j26_cited_sentences(s, d):
    x = prose.cited_sentences(_docs(s, d), "doc_id", "text")
    return x.select("doc_id", "line", "nth", "cited", F.length("sentence").alias("chars"), F.concat(F.lit("c"), F.substring(F.sha1(F.concat("cited", F.lit("|"), "sentence")), 1, 8)).alias("claim_id"))


def e25_numbers_near_citations(s, d):
    x = prose.cited_sentences(_docs(s, d), "doc_id", "text")
    near = F.substring("sentence", -40, 40).rlike("[0-9]")
    return x.groupBy("doc_id").agg(F.count("*").alias("citations"), F.count_if(near).alias("after_number"))


def a14_screening_rows(s, d):
    r = prose.pipe_rows(_docs(s, d), "doc_id", "text")
    return r.groupBy("verdict", "reason").agg(F.count("*").alias("rows"), F.countDistinct("item").alias("items"))


def screening_verdicts(s, d):
    """The verdict on each item in a topic: that of its first row."""
    r = prose.pipe_rows(_docs(s, d), "doc_id", "text").join(_docs(s, d).select("doc_id", "topic"), "doc_id")
    return r.groupBy("topic", "item").agg(F.min_by("verdict", F.struct("doc_id", "line")).alias("verdict"), F.count("*").alias("rows"))


def e1_citation_status(s, d):
    """Claims by the state of what they cite."""
    e = _entries(s, d).select("topic", loose_key(F.col("citation_key")).alias("k"), "verification_status", "retracted", "entry_id").where("k IS NOT NULL")
    e = e.groupBy("topic", "k").agg(F.min_by(F.struct("verification_status", "retracted"), "entry_id").alias("e"))
    j = _claims(s, d).select("topic", "claim_id", loose_key(F.col("key")).alias("k")).join(e, ["topic", "k"], "left")
    state = F.when(F.col("k").isNull(), "no key").when(F.col("e").isNull(), "missing").when(F.coalesce("e.retracted", F.lit(False)), "retracted").when(F.col("e.verification_status") != "verified", "not verified").otherwise("verified")
    return j.groupBy("topic", state.alias("state")).agg(F.count("*").alias("claims"))


def e4_uncited(s, d):
    used = _claims(s, d).select("topic", loose_key(F.col("key")).alias("k")).where("k IS NOT NULL").distinct()
    e = _entries(s, d).select("topic", "gap", F.col("added_round").cast("int").alias("round"), "entry_id", loose_key(F.col("citation_key")).alias("k")).where("k IS NOT NULL")
    return e.join(used, ["topic", "k"], "left_anti").groupBy("topic", "gap", "round").agg(F.count("*").alias("uncited"))


def k9_keep_uncited(s, d):
    """The store with keep_uncited set on every entry that no claim cites."""
    used = _claims(s, d).select("topic", F.col("key").alias("citation_key")).distinct()
    e = _entries(s, d)
    rest = e.join(used, ["topic", "citation_key"], "left_anti").select("entry_id")
    return store.marked(e.select("entry_id", "topic", "keep_uncited"), rest, ["entry_id"], "keep_uncited", True)


def f2_citations_per_gap(s, d):
    used = _claims(s, d).select("topic", "claim_id", F.col("key").alias("citation_key"))
    e = _entries(s, d).select("topic", "citation_key", "gap", "entry_id")
    return used.join(e, ["topic", "citation_key"]).groupBy("topic", "gap").agg(F.countDistinct("claim_id").alias("claims"), F.countDistinct("entry_id").alias("entries"))


def e29_brief(s, d):
    """The first claim on each key of a topic, by round."""
    c = _claims(s, d).select("topic", loose_key(F.col("key")).alias("k"), "claim_id", "round", "sentence").where("k IS NOT NULL")
    return c.groupBy("topic", "k").agg(F.min_by("claim_id", F.struct("round", "claim_id")).alias("claim_id"), F.min("round").cast("int").alias("round"))


def verdict_merge(s, d):
    """One verdict for each key of a topic: any suspect decides, all faithful
    are faithful, the rest needs review."""
    c = _claims(s, d).select("topic", loose_key(F.col("key")).alias("k"), "verdict").where("k IS NOT NULL")
    g = c.groupBy("topic", "k").agg(F.bool_or(F.coalesce(F.col("verdict") == "suspect", F.lit(False))).alias("s"), F.bool_and(F.coalesce(F.col("verdict") == "faithful", F.lit(False))).alias("f"), F.count("*").alias("claims"))
    return g.select("topic", "k", "claims", F.when(F.col("s"), "suspect").when(F.col("f"), "faithful").otherwise("needs_review").alias("verdict"))


def verdict_counts(s, d):
    return _claims(s, d).groupBy("topic", "verdict", "risk").agg(F.count("*").alias("claims"))


def j30_claim_ids(s, d):
    c = _claims(s, d)
    text = F.trim(F.coalesce(F.when(F.col("atomic_claim") != "", F.col("atomic_claim")), F.col("sentence"), F.lit("")))
    return c.select("claim_id", F.concat(F.lit("c"), F.substring(F.sha1(F.concat(F.coalesce("key", F.lit("")), F.lit("|"), F.coalesce("sentence", F.lit("")))), 1, 8)).alias("derived_id"), F.substring(F.sha1(text), 1, 10).alias("claim_hash"))


def j1_claim_numbers(s, d):
    """Numbers of each claim's sentence."""
    return _claims(s, d).select("claim_id", N.numbers(F.regexp_replace(F.coalesce("sentence", F.lit("")), prose.CITATION, " ")).alias("found"))


def m1_number_check(s, d):
    """Numbers of each claim that the cited entry's text does not hold: claims
    joined to entries, these to the text behind their richest path."""
    c = _claims(s, d).select("topic", "claim_id", loose_key(F.col("key")).alias("k"), N.numbers(F.regexp_replace(F.coalesce("sentence", F.lit("")), prose.CITATION, " ")).alias("claimed"))
    e = _entries(s, d).select("topic", loose_key(F.col("citation_key")).alias("k"), F.coalesce("paths.pdf_text", "paths.ocr", "paths.abstract").alias("path"), "entry_id")
    e = e.where("k IS NOT NULL").groupBy("topic", "k").agg(F.min_by("path", "entry_id").alias("path"))
    t = table(s, d, "sources").where("path IS NOT NULL").groupBy("path").agg(F.min_by("text", "source_id").alias("text")).select("path", N.numbers(F.col("text")).alias("have"))
    j = c.join(e, ["topic", "k"], "left").join(t, "path", "left")
    lost = N.missing(F.col("claimed"), F.coalesce("have", F.array().cast("array<string>")))
    return j.select("claim_id", F.size("claimed").alias("numbers"), F.when(F.col("have").isNotNull(), lost).alias("missing"))


def e17_most_shared_terms(s, d):
    """For each claim the entry of its topic whose title shares most content
    terms with it, at least three."""
    c = _claims(s, d).select(F.col("claim_id").alias("lid"), F.transform(prose.content_terms(F.col("sentence")), lambda t: F.concat("topic", F.lit("|"), t)).alias("terms"))
    e = _entries(s, d).select(F.col("entry_id").alias("rid"), F.transform(prose.content_terms(F.col("title")), lambda t: F.concat("topic", F.lit("|"), t)).alias("terms"))
    return linking.most_shared(c, e, 3)


NAMES = [i6_cited_keys, e12_citation_sections, g9_section_sizes, j26_cited_sentences, e25_numbers_near_citations, a14_screening_rows, screening_verdicts, e1_citation_status, e4_uncited, k9_keep_uncited, f2_citations_per_gap, e29_brief, verdict_merge, verdict_counts, j30_claim_ids, j1_claim_numbers, m1_number_check, e17_most_shared_terms]
QUERIES = {f.__name__: f for f in NAMES}

_KEY = "nullif(regexp_replace(lower({}), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '')"
_LINES = "l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL)"
_SENT = f"""{_LINES}, x AS (SELECT doc_id, line, unnest(range(len(regexp_extract_all(t, '{_CITE}', 1)))) AS nth, unnest(regexp_extract_all(t, '{_CITE}', 1)) AS cited, regexp_split_to_array(t, '{_CITE}') AS spans FROM l WHERE contains(t, '[@')),
s AS (SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(nth AS INTEGER) AS nth, cited, trim(regexp_replace(spans[nth + 1], '^[\\s.;,]+', '')) AS sentence FROM x)"""
_BLOCKS = "b AS (SELECT doc_id, unnest(range(len(string_split(chr(10) || text, chr(10) || '## ')))) AS part, unnest(string_split(chr(10) || text, chr(10) || '## ')) AS block FROM documents WHERE text IS NOT NULL)"
_PIPE = f"{_LINES}, c AS (SELECT doc_id, line, list_transform(string_split(t, '|'), lambda x: trim(x)) AS c FROM l WHERE regexp_matches(t, '^\\s*\\d+\\s*\\|')), p AS (SELECT doc_id, line, lower(c[2]) AS verdict, c[3] AS item, c[4] AS reason FROM c WHERE len(c) >= 4)"
_TERMS = "list_distinct(list_concat(regexp_extract_all(lower(coalesce({x}, '')), '[a-z]{{4,}}'), flatten(list_transform(regexp_extract_all(lower(coalesce({x}, '')), '[一-鿿]{{2,}}'), lambda w: list_transform(range(1, length(w)), lambda i: substr(w, i, 2))))))"
SQL = {
    "i6_cited_keys": f"WITH o AS (SELECT doc_id, unnest(range(len(regexp_extract_all(text, '{_CITE}', 1)))) AS pos, unnest(regexp_extract_all(text, '{_CITE}', 1)) AS cited FROM documents) SELECT doc_id, cited, CAST(min(pos) AS INTEGER) AS first, count(*) AS times FROM o GROUP BY 1, 2",
    "e12_citation_sections": f"WITH {_BLOCKS}, o AS (SELECT doc_id, CASE WHEN part > 0 THEN nullif(regexp_extract(block, '^([^\\n]*)', 1), '') END AS section, unnest(regexp_extract_all(block, '{_CITE}', 1)) AS cited FROM b) SELECT doc_id, section, count(*) AS citations FROM o GROUP BY 1, 2",
    "g9_section_sizes": f"WITH {_BLOCKS}, s AS (SELECT doc_id, trim(regexp_extract(block, '^([^\\n]*)', 1)) AS section, part, CAST(length(regexp_replace(block, '^[^\\n]*\\n?', '')) AS INTEGER) AS size FROM b WHERE part > 0), f AS (SELECT doc_id, section, arg_min(size, part) AS size FROM s GROUP BY 1, 2), o AS (SELECT source, size, row_number() OVER (PARTITION BY source ORDER BY size) AS r, count(*) OVER (PARTITION BY source) AS n FROM f JOIN documents USING (doc_id)) SELECT source, size AS upper_median FROM o WHERE r = n // 2 + 1",
    "j26_cited_sentences": f"WITH {_SENT} SELECT doc_id, line, nth, cited, CAST(length(sentence) AS INTEGER) AS chars, 'c' || substr(sha1(cited || '|' || sentence), 1, 8) AS claim_id FROM s",
    "e25_numbers_near_citations": f"WITH {_SENT} SELECT doc_id, count(*) AS citations, count(*) FILTER (regexp_matches(right(sentence, 40), '[0-9]')) AS after_number FROM s GROUP BY 1",
    "a14_screening_rows": f"WITH {_PIPE} SELECT verdict, reason, count(*) AS rows, count(DISTINCT item) AS items FROM p GROUP BY 1, 2",
    "screening_verdicts": f"WITH {_PIPE} SELECT topic, item, arg_min(verdict, struct_pack(d := doc_id, l := line)) AS verdict, count(*) AS rows FROM p JOIN documents USING (doc_id) GROUP BY 1, 2",
    "e1_citation_status": f"WITH {C_SQL}, {E_SQL}, k AS (SELECT topic, {_KEY.format('citation_key')} AS k, verification_status, retracted FROM e WHERE {_KEY.format('citation_key')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY topic, k ORDER BY entry_id) = 1), j AS (SELECT c.topic, {_KEY.format('c.key')} AS ck, k.* EXCLUDE (topic) FROM c LEFT JOIN k ON k.topic = c.topic AND k.k = {_KEY.format('c.key')}) SELECT topic, CASE WHEN ck IS NULL THEN 'no key' WHEN k IS NULL THEN 'missing' WHEN coalesce(retracted,false) THEN 'retracted' WHEN verification_status <> 'verified' THEN 'not verified' ELSE 'verified' END AS state, count(*) AS claims FROM j GROUP BY 1, 2",
    "e4_uncited": f"WITH {C_SQL}, {E_SQL}, u AS (SELECT DISTINCT topic, {_KEY.format('key')} AS k FROM c), k AS (SELECT *, {_KEY.format('citation_key')} AS k FROM e) SELECT topic, gap, CAST(added_round AS INTEGER) AS round, count(*) AS uncited FROM k WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM u WHERE u.topic = k.topic AND u.k = k.k) GROUP BY ALL",
    "k9_keep_uncited": f"WITH {C_SQL}, {E_SQL} SELECT entry_id, topic, keep_uncited OR NOT EXISTS (SELECT 1 FROM c WHERE c.topic = e.topic AND c.key = e.citation_key) AS keep_uncited FROM e",
    "f2_citations_per_gap": f"WITH {C_SQL}, {E_SQL} SELECT e.topic, e.gap, count(DISTINCT claim_id) AS claims, count(DISTINCT entry_id) AS entries FROM c JOIN e ON e.topic = c.topic AND e.citation_key = c.key GROUP BY ALL",
    "e29_brief": f"WITH {C_SQL}, k AS (SELECT topic, {_KEY.format('key')} AS k, claim_id, round FROM c) SELECT topic, k, arg_min(claim_id, struct_pack(r := round, c := claim_id)) AS claim_id, CAST(min(round) AS INTEGER) AS round FROM k WHERE k IS NOT NULL GROUP BY 1, 2",
    "verdict_merge": f"WITH {C_SQL}, k AS (SELECT topic, {_KEY.format('key')} AS k, verdict FROM c) SELECT topic, k, count(*) AS claims, CASE WHEN bool_or(coalesce(verdict = 'suspect', false)) THEN 'suspect' WHEN bool_and(coalesce(verdict = 'faithful', false)) THEN 'faithful' ELSE 'needs_review' END AS verdict FROM k WHERE k IS NOT NULL GROUP BY 1, 2",
    "verdict_counts": f"WITH {C_SQL} SELECT topic, verdict, risk, count(*) AS claims FROM c GROUP BY ALL",
    "j30_claim_ids": f"WITH {C_SQL} SELECT claim_id, 'c' || substr(sha1(coalesce(key,'') || '|' || coalesce(sentence,'')), 1, 8) AS derived_id, substr(sha1(trim(coalesce(nullif(atomic_claim,''), sentence, ''))), 1, 10) AS claim_hash FROM c",
    "e17_most_shared_terms": f"WITH {C_SQL}, {E_SQL}, a AS (SELECT claim_id AS lid, topic, unnest({_TERMS.format(x='sentence')}) AS t FROM c), b AS (SELECT entry_id AS rid, topic, unnest({_TERMS.format(x='title')}) AS t FROM e), n AS (SELECT lid, rid, count(*) AS shared FROM a JOIN b USING (topic, t) GROUP BY 1, 2 HAVING count(*) >= 3) SELECT lid, rid, shared FROM n QUALIFY row_number() OVER (PARTITION BY lid ORDER BY shared DESC, rid) = 1",
}

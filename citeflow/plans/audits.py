"""Queries that audit a store against what is written from it: coverage of gaps,
counts by round, claims and their spans, sections, sizes, updates."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from citeflow.functions import records as R
from citeflow.functions.text import loose_key
from citeflow.operators import markup, prose, ranking, store
from citeflow.plans.records import _STR, E_SQL, STOP, _entries
from citeflow.plans.reviews import _BLOCKS, _CITE, _KEY, C_SQL, _claims, _docs
from citeflow.runtime import table

#: Words in the title of a section that states no proposition (fixed values).
OTHER_SECTIONS = ["摘要", "abstract", "方法", "method", "参考", "reference", "限定", "争议", "limitation", "实操", "建议", "recommend"]
#: Claims of a topic that an audit looks at, a parameter.
SAMPLE = 8
#: Characters of a source that stand for a span where none was found, and below
#: which an abstract is taken for a short one.
SPAN, SHORT = 400, 1500


def _gaps(s, d):
    """One row for each gap: the last to arrive that is not deleted."""
    return store.current(store.normalized_gaps(table(s, d, "gaps")), ["topic", "gap_id"], ["arrived_at"])


G_SQL = "g AS (SELECT * FROM (SELECT * FROM gaps QUALIFY row_number() OVER (PARTITION BY topic, gap_id ORDER BY arrived_at DESC) = 1) WHERE NOT coalesce(deleted, false))"
V_SQL = "v AS (SELECT * FROM e WHERE verification_status = 'verified' AND coalesce(excluded_reason, '') = '')"


def _verified(s, d):
    """Entries that are verified and not excluded."""
    return _entries(s, d).where("verification_status = 'verified' AND coalesce(excluded_reason, '') = ''")


def _used(s, d):
    return _claims(s, d).select("topic", loose_key(F.col("key")).alias("k")).where("k IS NOT NULL").distinct()


U_SQL = f"u AS (SELECT DISTINCT topic, {_KEY.format('key')} AS k FROM c WHERE {_KEY.format('key')} IS NOT NULL)"


def _level() -> Column:
    return R.grounding(F.col("fetch_state.fulltext_xml"), F.col("has_fulltext_xml"), F.col("fetch_state.ocr"), F.col("paths.abstract"), F.col("paths.pdf_text"), F.col("paths.ocr"))


_TITLE_ONLY = "(coalesce(paths.pdf_text,'') = '' AND coalesce(paths.ocr,'') = '' AND coalesce(paths.abstract,'') = '')"


def a3_store_dois(s, d):
    """The DOIs of each topic's store."""
    return store.normalized_entries(_entries(s, d)).where("doi <> ''").select("topic", "doi").distinct()


def a20_evidence_spans(s, d):
    """The spans that claims give as evidence, by number."""
    return _claims(s, d).select("claim_id", F.explode("evidence_spans").alias("number", "span")).select("claim_id", "number", F.length("span").alias("chars"), F.sha1("span").alias("span_sha1"))


def b9_compact_notes(s, d):
    """A line of each verified entry of a gap, for the notes of its round."""
    return _verified(s, d).where("gap <> ''").select("topic", "gap", "entry_id", "citation_key", "doi", "title", F.col("year").cast("int").alias("year"), R.known(F.col("study_type"), R.STUDY_TYPES, "other").alias("study_type"), _level().alias("grounding"))


def b10_notes_index(s, d):
    """Entries of each gap of a topic, and in the row without a gap those that name
    none or one that is not declared."""
    declared = _gaps(s, d).select("topic", F.col("gap_id").alias("gap"), F.lit(True).alias("known"))
    j = _entries(s, d).select("topic", "gap").join(declared, ["topic", "gap"], "left")
    return j.groupBy("topic", F.when(F.col("known"), F.col("gap")).alias("gap")).agg(F.count("*").alias("entries"))


def b14_reference_block(s, d):
    """The place of each verified entry in its topic's list of references: by
    family of the first author, year and id."""
    a = R.strings(F.col("authors"))
    e = _verified(s, d).select("topic", "entry_id", F.coalesce(R.family(F.try_element_at(a, F.lit(1))), F.lit("")).alias("family"), F.coalesce(F.col("year").cast("int"), F.lit(0)).alias("y"))
    return ranking.numbered(e, ["topic"], ["family", "y", "entry_id"], "place").select("topic", "entry_id", "place")


def b16_citation_stats(s, d):
    """Cited entries by study type."""
    e = _entries(s, d).select("topic", loose_key(F.col("citation_key")).alias("k"), R.known(F.col("study_type"), R.STUDY_TYPES, "other").alias("study_type"), "entry_id")
    return e.join(_used(s, d), ["topic", "k"], "left_semi").groupBy("study_type").agg(F.count("*").alias("entries"))


def c14_display_names(s, d):
    """Each author read as a display name: the last word is the family."""
    a = table(s, d, "entries").select(F.explode("authors").alias("author")).where("trim(author) <> ''").distinct()
    parts = F.filter(F.split("author", r"\s+"), lambda w: w != "")
    letters = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit(".")))
    return a.select("author", F.concat(F.element_at(parts, -1), F.when(F.size(letters) > 0, F.concat(F.lit(", "), F.array_join(letters, " "))).otherwise(F.lit(""))).alias("formatted"))


def c16_lint_families(s, d):
    """Last word of what stands before the comma, for each author."""
    a = table(s, d, "entries").select(F.explode("authors").alias("author")).where("author IS NOT NULL").distinct()
    return a.select("author", F.lower(F.regexp_extract(F.split_part("author", F.lit(","), F.lit(1)), r"(\S*)\s*$", 1)).alias("family"))


def c17_first_families(s, d):
    """Entries by the family of their first author as duplicates are blocked."""
    fam = F.lower(F.trim(F.split_part(F.coalesce(F.try_element_at(R.strings(F.col("authors")), F.lit(1)), F.lit("")), F.lit(","), F.lit(1))))
    return _entries(s, d).groupBy(fam.alias("family")).agg(F.count("*").alias("entries"), F.countDistinct("topic").alias("topics"))


def c28_gap_tags(s, d):
    """Descriptions of gaps with their type in front, once."""
    text = F.coalesce("description", F.lit(""))
    tagged = F.when((F.coalesce("gap_type", F.lit("")) == "") | text.startswith("["), text).otherwise(F.concat(F.lit("["), "gap_type", F.lit("] "), text))
    return _gaps(s, d).select("topic", "gap_id", tagged.alias("tagged"))


def d15_seeded_gaps(s, d):
    """Declared gaps, and whether a seed entry speaks for them."""
    seeds = _entries(s, d).where("source = 'seed' AND gap <> ''").select("topic", F.col("gap").alias("gap_id"), F.lit(True).alias("seed")).distinct()
    return _gaps(s, d).select("topic", "gap_id").join(seeds, ["topic", "gap_id"], "left").select("topic", "gap_id", F.coalesce("seed", F.lit(False)).alias("seeded"))


def _proposition(title: Column) -> Column:
    return ~F.exists(F.array(*[F.lit(m) for m in OTHER_SECTIONS]), lambda m: F.contains(F.lower(title), m))


def d18_proposition_sections(s, d):
    """Sections of the documents that state propositions, and the others."""
    t = F.trim("section")
    return prose.sections(_docs(s, d), "doc_id", "text").groupBy(_proposition(t).alias("proposition")).agg(F.count("*").alias("sections"), F.countDistinct("doc_id").alias("documents"))


def d20_citation_groups(s, d):
    """Brackets of each document that cite more than one key."""
    groups = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\[[^\[\]]*@[^\[\]]*\]"), F.lit(0))
    many = F.filter(groups, lambda g: F.size(F.split(g, "@")) > 2)
    return _docs(s, d).select("doc_id", F.size(groups).alias("brackets"), F.size(many).alias("several")).where("brackets > 0")


def e2_first_of_key(s, d):
    """The entry that each citation key of a topic stands for: the first."""
    e = _entries(s, d).where("citation_key <> ''")
    return e.groupBy("topic", "citation_key").agg(F.min_by("entry_id", "seq").alias("entry_id"), F.min_by("doi", "seq").alias("doi"))


def e20_keys_without_evidence(s, d):
    """Keys of high-risk claims for which no claim of the topic has evidence."""
    c = _claims(s, d).select("topic", loose_key(F.col("key")).alias("k"), "risk", (F.size(F.coalesce(F.map_keys("evidence_spans"), F.array().cast("array<string>"))) > 0).alias("has")).where("k IS NOT NULL")
    return c.where("risk = 'high'").select("topic", "k").distinct().join(c.where("has").select("topic", "k").distinct(), ["topic", "k"], "left_anti")


def e24_gaps_outside_propositions(s, d):
    """Gaps that documents of their topic cite, but only outside the sections
    that state propositions."""
    o = prose.under_headings(_docs(s, d), "doc_id", "text").select("doc_id", F.lower("cited").alias("k"), _proposition(F.coalesce("section", F.lit(""))).alias("in_proposition"))
    o = o.join(_docs(s, d).select("doc_id", "topic"), "doc_id")
    e = _entries(s, d).where("gap <> ''").select("topic", loose_key(F.col("citation_key")).alias("k"), "gap").where("k IS NOT NULL").distinct()
    return o.join(e, ["topic", "k"]).groupBy("topic", "gap").agg(F.count("*").alias("citations"), F.bool_or("in_proposition").alias("stated")).where("NOT stated").select("topic", "gap", "citations")


def e26_unread(s, d):
    """Entries of each topic of which only the title is known: those cited, and
    those verified for a gap that are not."""
    e = _entries(s, d).where(_level() == "title_only").select("topic", loose_key(F.col("citation_key")).alias("k"), "gap", "verification_status")
    j = e.join(_used(s, d).withColumn("cited", F.lit(True)), ["topic", "k"], "left").withColumn("cited", F.coalesce("cited", F.lit(False)))
    return j.groupBy("topic").agg(F.count_if("cited").alias("cited"), F.count_if(~F.col("cited") & (F.coalesce("verification_status", F.lit("")) == "verified") & (F.coalesce("gap", F.lit("")) != "")).alias("uncited"))


def f4_gap_verified(s, d):
    return _verified(s, d).where("gap <> ''").groupBy("topic", "gap").agg(F.count("*").alias("verified"))


def f5_gap_cited(s, d):
    e = _entries(s, d).where("gap <> ''").select("topic", loose_key(F.col("citation_key")).alias("k"), "gap", "entry_id")
    return e.join(_used(s, d), ["topic", "k"], "left_semi").groupBy("topic", "gap").agg(F.count("*").alias("cited"))


def f6_cited_ratio(s, d):
    """Share of each topic's verified entries that are cited, without those
    that are kept uncited on purpose."""
    e = _verified(s, d).where("NOT coalesce(keep_uncited, false)").select("topic", loose_key(F.col("citation_key")).alias("k"))
    j = e.join(_used(s, d).withColumn("cited", F.lit(1)), ["topic", "k"], "left")
    return j.groupBy("topic").agg(F.count("*").alias("eligible"), F.count("cited").alias("cited"), F.round(F.count("cited") / F.count("*"), 6).alias("ratio"))


def f9_new_by_gap(s, d):
    return _verified(s, d).where("added_round IS NOT NULL").groupBy("topic", F.coalesce(R.filled(F.col("gap")), F.lit("<no gap>")).alias("gap"), F.col("added_round").cast("int").alias("round")).agg(F.count("*").alias("new"))


def f11_gap_status(s, d):
    """Entries of every declared gap by what became of them."""
    e = store.normalized_entries(_entries(s, d)).select("topic", F.col("gap").alias("gap_id"), F.when(F.col("excluded_reason").isNotNull(), "excluded").otherwise(F.col("verification_status")).alias("state"))
    j = _gaps(s, d).select("topic", "gap_id", "status").join(e, ["topic", "gap_id"], "left")
    return j.groupBy("topic", "gap_id", "status").agg(F.count("state").alias("entries"), *[F.count_if(F.coalesce(F.col("state") == x, F.lit(False))).alias(x) for x in ("verified", "pending", "failed", "excluded")])


def f16_verify_stats(s, d):
    """Outcomes of verification by topic, and the exit code that they give: 2
    with failures, else 1 with what is pending."""
    e = store.normalized_entries(_entries(s, d)).groupBy("topic").agg(*[F.count_if(F.col("verification_status") == x).alias(x) for x in R.VERIFICATION])
    return e.withColumn("code", F.when(F.col("failed") > 0, 2).when(F.col("pending") > 0, 1).otherwise(0))


def f23_judged_items(s, d):
    """Distinct items that the screening rows of each topic judge; null where
    there is no such document."""
    r = prose.pipe_rows(_docs(s, d), "doc_id", "text").join(_docs(s, d).select("doc_id", "topic"), "doc_id")
    per = r.groupBy("topic").agg(F.countDistinct("item").alias("items"))
    return table(s, d, "topics").select("topic").join(per, "topic", "left")


def f24_broad_gaps(s, d):
    """Gaps for which much is verified and little is cited."""
    return f4_gap_verified(s, d).join(f5_gap_cited(s, d), ["topic", "gap"], "left").select("topic", "gap", "verified", F.coalesce("cited", F.lit(0).cast("long")).alias("cited")).where("verified >= 20 AND cited < 5")


def _units(size: Column) -> tuple[Column, Column]:
    step = F.when(size < 1 << 10, 0).when(size < 1 << 20, 1).when(size < 1 << 30, 2).when(size < 1 << 40, 3).otherwise(4)
    return F.round(size / F.pow(F.lit(1024.0), step), 1), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), step + 1)


def f26_text_sizes(s, d):
    """Bytes of text that each topic's sources hold, and as people read them."""
    t = table(s, d, "sources").groupBy("topic").agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes"), F.count("*").alias("texts"))
    size, unit = _units(F.col("bytes"))
    return t.select("topic", "bytes", "texts", size.alias("size"), unit.alias("unit"))


def h6_largest_topics(s, d):
    """The five topics of most text."""
    return f26_text_sizes(s, d).select("topic", "bytes").orderBy(F.desc("bytes"), "topic").limit(5)


def g2_walk(s, d):
    """Whether the search of each topic has come to rest: of its last rounds that
    are no addenda two in a row each brought at most a tenth of all found by then."""
    n = _entries(s, d).where("added_round IS NOT NULL").groupBy("topic", F.col("added_round").cast("int").alias("round")).agg(F.count("*").alias("n"))
    r = ranking.saturation(n, ["topic"], "round", "n")
    late = table(s, d, "topics").select("topic", F.coalesce("addendum_rounds", F.array().cast("array<int>")).alias("addenda"))
    r = r.join(late, "topic", "left").where("NOT coalesce(array_contains(addenda, round), false)")
    last = r.withColumn("back", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("round")))).where("back <= 2")
    return last.groupBy("topic").agg(F.max("round").alias("round"), (F.bool_and(F.col("ratio") <= 0.1) & (F.count("*") == 2)).alias("saturated"))


def g4_candidate_order(s, d):
    """Candidates of each topic's expansion, by overlap, then DOI."""
    e = store.normalized_entries(_entries(s, d)).where("source = 'genealogy'").select("topic", "entry_id", F.coalesce("overlap", F.lit(0)).alias("overlap"), (-F.coalesce("overlap", F.lit(0))).alias("o"), "doi")
    return ranking.numbered(e, ["topic"], ["o", "doi", "entry_id"], "place").select("topic", "entry_id", "overlap", "place")


def g6_caps(s, d):
    """How many candidates each topic may admit in its next round."""
    n = _verified(s, d).groupBy("topic").agg(F.count("*").alias("eligible"))
    g = _gaps(s, d).groupBy("topic").agg(F.count("*").alias("gaps"))
    t = table(s, d, "topics").select("topic", "rounds").join(n, "topic", "left").join(g, "topic", "left").fillna(0, ["eligible", "gaps"])
    cap = F.when(F.col("rounds") <= 2, 20).otherwise(F.greatest(F.lit(6).cast("long"), F.expr("eligible div (10 * greatest(1, gaps))")))
    return t.select("topic", cap.cast("int").alias("cap"))


def _coarse() -> Column:
    """Whether a claim is in Chinese and its span is not, or its span is coarse."""
    claim = F.coalesce(F.when(F.col("atomic_claim") != "", F.col("atomic_claim")), F.col("sentence"), F.lit(""))
    span = F.trim(F.coalesce("span", F.lit("")))
    han = r"[\x{4e00}-\x{9fff}]"
    return F.coalesce("span_source", F.lit("")).isin("abstract_fallback", "paragraph_entail") | claim.rlike(han) & ~span.isin("", "-") & ~span.rlike(han)


def j55_coarse_spans(s, d):
    return _claims(s, d).groupBy("topic", _coarse().alias("coarse")).agg(F.count("*").alias("claims"))


def g10_audit_quota(s, d):
    """The claims of each topic that an audit looks at: of SAMPLE places at most a
    quarter go to faithful claims that are neither of high risk nor of a type, the
    others to the rest of the faithful ones: high risk first, then coarse spans."""
    c = _claims(s, d).where("verdict = 'faithful'")
    judged = (F.coalesce("risk", F.lit("")) == "high") | (F.coalesce("key_type", F.lit("")) != "")
    c = c.select("topic", "claim_id", judged.alias("judged"), F.when(F.col("risk") == "high", 0).otherwise(1).alias("o1"), F.when(_coarse(), 0).otherwise(1).alias("o2"), F.coalesce("key", F.lit("")).alias("o3"), F.substring(F.coalesce("sentence", F.lit("")), 1, 40).alias("o4"))
    c = c.withColumns({"o1": F.when(F.col("judged"), F.col("o1")).otherwise(0), "o2": F.when(F.col("judged"), F.col("o2")).otherwise(0)})
    t = ranking.top(c, ["topic", "judged"], [F.col(x) for x in ("o1", "o2", "o3", "o4", "claim_id")], SAMPLE)
    quota = F.least(F.lit(SAMPLE // 4), F.max(F.when(~F.col("judged"), F.col("rank")).otherwise(0)).over(Window.partitionBy("topic")))  # over 2 x SAMPLE rows a topic
    t = t.withColumn("quota", quota)
    return t.where(F.when(F.col("judged"), F.col("rank") <= SAMPLE - F.col("quota")).otherwise(F.col("rank") <= F.col("quota"))).select("topic", "claim_id", "judged", "rank")


def i3_gap_terms(s, d):
    """Significant terms of gap descriptions and in how many gaps they are."""
    t = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("description", F.lit(""))), F.lit(r"[a-z][a-z0-9-]{3,}"), F.lit(0))), F.array(*map(F.lit, STOP)))
    return _gaps(s, d).select(F.explode(t).alias("term")).groupBy("term").agg(F.count("*").alias("gaps"))


def j22_fallback_spans(s, d):
    """The beginning of each source without a heading at its head, the span where
    no better one is found."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s*#+[^\n]*\n", "")
    return table(s, d, "sources").groupBy("source_id").agg(F.min("text").alias("text")).select("source_id", F.sha1(F.substring(F.trim(t), 1, SPAN)).alias("span_sha1"))


def j49_xml_parts(s, d):
    """What each source holds in XML: characters of the abstract, tables, figures."""
    t = table(s, d, "sources").groupBy("source_id").agg(F.min("text").alias("text"))
    return t.select("source_id", F.length(markup.abstract(F.col("text"))).alias("abstract_chars"), F.size(markup.tables(F.col("text"), None)).alias("tables"), F.size(markup.figures(F.col("text"), None)).alias("figures"))


def j58_card_authors(s, d):
    """Authors that the cards name, a semicolon between them."""
    line = F.regexp_extract(F.coalesce("text", F.lit("")), r"(?m)\A---\n(?:.*\n)*?authors: *(.*)$", 1)
    names = F.filter(F.transform(F.split(line, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return table(s, d, "sources").groupBy("source_id").agg(F.min("text").alias("text")).select("source_id", F.size(names).alias("lists")).where("lists > 0")


def k4_resolved_gaps(s, d):
    """The gaps after those that are pending and have a verified entry have been
    resolved in the round that brought the first."""
    v = _verified(s, d).where("gap <> '' AND added_round IS NOT NULL").groupBy("topic", F.col("gap").alias("gap_id")).agg(F.min("added_round").cast("int").alias("first"))
    j = _gaps(s, d).join(v, ["topic", "gap_id"], "left")
    now = (F.col("status") == "pending") & F.col("first").isNotNull()
    return j.select("topic", "gap_id", F.when(now, "resolved").otherwise(F.col("status")).alias("status"), F.when(now, F.col("first")).otherwise(F.col("resolved_round").cast("int")).alias("resolved_round"))


def k6_retracted_excluded(s, d):
    """The store after retracted entries have been excluded for that reason,
    where they had none."""
    e = _entries(s, d).select("entry_id", "topic", R.filled(F.col("excluded_reason")).alias("excluded_reason"), "retracted")
    gone = e.where("coalesce(retracted, false) AND excluded_reason IS NULL")
    return store.marked(e, gone, ["entry_id"], "excluded_reason", "retracted").select("entry_id", "topic", "excluded_reason")


def k18_fetched_levels(s, d):
    """The levels at which a text lies behind each entry's paths."""
    have = table(s, d, "sources").where("path <> '' AND trim(text) <> ''").select("path").distinct()
    levels = F.explode(F.filter(F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"paths.{x}").alias("path")) for x in ("abstract", "pdf_text", "ocr")]), lambda p: F.coalesce(p["path"], F.lit("")) != ""))
    p = _entries(s, d).select("entry_id", levels.alias("p")).select("entry_id", "p.level", "p.path").join(have, "path", "left_semi")
    return p.groupBy("entry_id").agg(F.array_join(F.array_sort(F.collect_set("level")), "|").alias("levels"))


def k22_filled_signals(s, d):
    """The h-index of each entry's journal, for entries without signals that of
    the first entry of the journal that has them."""
    e = _entries(s, d).select("entry_id", "journal", F.col("journal_signals.h_index").alias("h"), F.col("journal_signals").isNotNull().alias("own"))
    known = e.where("own AND journal <> ''").groupBy("journal").agg(F.min_by("h", "entry_id").alias("of_journal"))
    return e.join(known, "journal", "left").select("entry_id", F.when(F.col("own"), F.col("h")).otherwise(F.col("of_journal")).alias("h_index"))


def m8_abstract_choice(s, d):
    """Of each work's abstracts the one to keep: that of europepmc where it is
    not short, else the longest of europepmc and crossref, else the longest."""
    t = table(s, d, "sources").where("level = 'abstract' AND text <> '' AND doi <> ''").groupBy("source_id").agg(F.min_by(F.struct("topic", F.lower("doi").alias("doi"), "provider", F.length("text").alias("n")), "text").alias("r")).select("source_id", "r.*")
    order = F.when((F.col("provider") == "europepmc") & (F.col("n") >= SHORT), 0).when(F.coalesce("provider", F.lit("")).isin("europepmc", "crossref"), 1).otherwise(2)
    return ranking.top(t, ["topic", "doi"], [order, F.desc("n"), F.col("source_id")], 1).select("topic", "doi", "source_id", "provider")


NAMES = [a3_store_dois, a20_evidence_spans, b9_compact_notes, b10_notes_index, b14_reference_block, b16_citation_stats, c14_display_names, c16_lint_families, c17_first_families, c28_gap_tags, d15_seeded_gaps, d18_proposition_sections, d20_citation_groups, e2_first_of_key, e20_keys_without_evidence, e24_gaps_outside_propositions, e26_unread, f4_gap_verified, f5_gap_cited, f6_cited_ratio, f9_new_by_gap, f11_gap_status, f16_verify_stats, f23_judged_items, f24_broad_gaps, f26_text_sizes, h6_largest_topics, g2_walk, g4_candidate_order, g6_caps, j55_coarse_spans, g10_audit_quota, i3_gap_terms, j22_fallback_spans, j49_xml_parts, j58_card_authors, k4_resolved_gaps, k6_retracted_excluded, k18_fetched_levels, k22_filled_signals, m8_abstract_choice]
QUERIES = {f.__name__: f for f in NAMES}

_STUDY = "CASE WHEN study_type IN ('" + "','".join(R.STUDY_TYPES) + "') THEN study_type ELSE 'other' END"
_STATE = "CASE WHEN verification_status IN ('pending','verified','failed') THEN verification_status ELSE 'pending' END"
_GAP_STATE = "CASE WHEN status IN ('pending','resolved','insufficient') THEN status ELSE 'pending' END"
_K = _KEY.format("citation_key")
_OTHER = "({})".format(" OR ".join(f"contains(lower({{x}}), '{m}')" for m in OTHER_SECTIONS))
_GROUNDING = """CASE WHEN (coalesce(fetch_state.fulltext_xml,'')='succeeded' OR coalesce(has_fulltext_xml,false)) AND (coalesce(paths.pdf_text,'')<>'' OR coalesce(paths.ocr,'')<>'' OR coalesce(paths.abstract,'')<>'') THEN 'fulltext'
  WHEN coalesce(paths.pdf_text,'')<>'' THEN 'pdf_text' WHEN (coalesce(fetch_state.ocr,'')='succeeded' OR coalesce(paths.ocr,'')<>'') AND (coalesce(paths.ocr,'')<>'' OR coalesce(paths.abstract,'')<>'') THEN 'ocr'
  WHEN coalesce(paths.abstract,'')<>'' THEN 'abstract' ELSE 'title_only' END"""
_COARSE = "(coalesce(span_source,'') IN ('abstract_fallback','paragraph_entail') OR (regexp_matches(coalesce(nullif(atomic_claim,''), sentence, ''), '[一-鿿]') AND trim(coalesce(span,'')) NOT IN ('','-') AND NOT regexp_matches(coalesce(span,''), '[一-鿿]')))"
_FAM = "lower(trim(split_part(coalesce(" + _STR.format("authors") + "[1], ''), ',', 1)))"
_FAMILY = "(CASE WHEN contains({a}, ',') THEN lower(trim(split_part({a}, ',', 1))) ELSE lower(regexp_extract({a}, '(\\S*)\\s*$', 1)) END)"
_STOPPED = "','".join(STOP)
_ONE = "t AS (SELECT source_id, min(text) AS text FROM sources GROUP BY 1)"
_F4 = "f4 AS (SELECT topic, gap, count(*) AS verified FROM v WHERE gap <> '' GROUP BY ALL)"
_F5 = f"f5 AS (SELECT topic, gap, count(*) AS cited FROM (SELECT topic, gap, {_K} AS k FROM e WHERE gap <> '') JOIN u USING (topic, k) GROUP BY ALL)"
_F26 = "f26 AS (SELECT topic, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes, count(*) AS texts FROM sources GROUP BY 1)"
SQL = {
    "a3_store_dois": f"WITH {E_SQL} SELECT DISTINCT topic, lower(doi) AS doi FROM e WHERE doi <> ''",
    "a20_evidence_spans": f"WITH {C_SQL}, x AS (SELECT claim_id, unnest(map_entries(evidence_spans)) AS m FROM c) SELECT claim_id, m.key AS number, CAST(length(m.value) AS INTEGER) AS chars, sha1(m.value) AS span_sha1 FROM x",
    "b9_compact_notes": f"WITH {E_SQL}, {V_SQL} SELECT topic, gap, entry_id, citation_key, doi, title, CAST(year AS INTEGER) AS year, {_STUDY} AS study_type, {_GROUNDING} AS grounding FROM v WHERE gap <> ''",
    "b10_notes_index": f"WITH {E_SQL}, {G_SQL} SELECT e.topic, g.gap_id AS gap, count(*) AS entries FROM e LEFT JOIN g ON g.topic = e.topic AND g.gap_id = e.gap GROUP BY ALL",
    "b14_reference_block": f"WITH {E_SQL}, {V_SQL}, f AS (SELECT topic, entry_id, {_STR.format('authors')}[1] AS a, coalesce(CAST(year AS INTEGER), 0) AS y FROM v) SELECT topic, entry_id, CAST(row_number() OVER (PARTITION BY topic ORDER BY coalesce({_FAMILY.format(a='a')}, ''), y, entry_id) AS INTEGER) AS place FROM f",
    "b16_citation_stats": f"WITH {C_SQL}, {E_SQL}, {U_SQL}, k AS (SELECT topic, {_K} AS k, {_STUDY} AS study_type FROM e) SELECT study_type, count(*) AS entries FROM k JOIN u USING (topic, k) GROUP BY 1",
    "c14_display_names": "WITH n AS (SELECT DISTINCT unnest(authors) AS author FROM entries), p AS (SELECT author, list_filter(regexp_split_to_array(author, '\\s+'), lambda w: w <> '') AS p FROM n WHERE trim(author) <> '') SELECT author, p[-1] || CASE WHEN len(p) > 1 THEN ', ' || array_to_string(list_transform(p[1:-2], lambda w: upper(substr(w, 1, 1)) || '.'), ' ') ELSE '' END AS formatted FROM p",
    "c16_lint_families": "WITH n AS (SELECT DISTINCT unnest(authors) AS author FROM entries) SELECT author, lower(regexp_extract(split_part(author, ',', 1), '(\\S*)\\s*$', 1)) AS family FROM n WHERE author IS NOT NULL",
    "c17_first_families": f"WITH {E_SQL} SELECT {_FAM} AS family, count(*) AS entries, count(DISTINCT topic) AS topics FROM e GROUP BY 1",
    "c28_gap_tags": f"WITH {G_SQL} SELECT topic, gap_id, CASE WHEN coalesce(gap_type, '') = '' OR starts_with(coalesce(description, ''), '[') THEN coalesce(description, '') ELSE '[' || gap_type || '] ' || coalesce(description, '') END AS tagged FROM g",
    "d15_seeded_gaps": f"WITH {E_SQL}, {G_SQL} SELECT topic, gap_id, EXISTS (SELECT 1 FROM e WHERE e.topic = g.topic AND e.gap = g.gap_id AND e.gap <> '' AND source = 'seed') AS seeded FROM g",
    "d18_proposition_sections": f"WITH {_BLOCKS}, s AS (SELECT DISTINCT doc_id, trim(regexp_extract(block, '^([^\\n]*)', 1)) AS section FROM b WHERE part > 0) SELECT NOT {_OTHER.format(x='section')} AS proposition, count(*) AS sections, count(DISTINCT doc_id) AS documents FROM s GROUP BY 1",
    "d20_citation_groups": "WITH x AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\\[[^\\[\\]]*@[^\\[\\]]*\\]') AS g FROM documents) SELECT doc_id, CAST(len(g) AS INTEGER) AS brackets, CAST(len(list_filter(g, lambda x: len(string_split(x, '@')) > 2)) AS INTEGER) AS several FROM x WHERE len(g) > 0",
    "e2_first_of_key": f"WITH {E_SQL} SELECT topic, citation_key, arg_min(entry_id, seq) AS entry_id, arg_min_null(doi, seq) AS doi FROM e WHERE citation_key <> '' GROUP BY ALL",
    "e20_keys_without_evidence": f"WITH {C_SQL}, k AS (SELECT topic, {_KEY.format('key')} AS k, risk, len(coalesce(map_keys(evidence_spans), [])) > 0 AS has FROM c) SELECT DISTINCT topic, k FROM k WHERE k IS NOT NULL AND risk = 'high' AND NOT EXISTS (SELECT 1 FROM k x WHERE x.topic = k.topic AND x.k = k.k AND x.has)",
    "e24_gaps_outside_propositions": f"WITH {E_SQL}, {_BLOCKS}, o AS (SELECT doc_id, CASE WHEN part > 0 THEN regexp_extract(block, '^([^\\n]*)', 1) ELSE '' END AS section, lower(unnest(regexp_extract_all(block, '{_CITE}', 1))) AS k FROM b), g AS (SELECT DISTINCT topic, {_K} AS k, gap FROM e WHERE gap <> '') SELECT g.topic, g.gap, count(*) AS citations FROM o JOIN documents d USING (doc_id) JOIN g ON g.topic = d.topic AND g.k = o.k GROUP BY ALL HAVING NOT bool_or(NOT {_OTHER.format(x='section')})",
    "e26_unread": f"WITH {C_SQL}, {E_SQL}, {U_SQL}, k AS (SELECT *, {_K} AS k FROM e WHERE {_TITLE_ONLY}) SELECT k.topic, count(*) FILTER (u.k IS NOT NULL) AS cited, count(*) FILTER (u.k IS NULL AND coalesce(verification_status, '') = 'verified' AND coalesce(gap, '') <> '') AS uncited FROM k LEFT JOIN u ON u.topic = k.topic AND u.k = k.k GROUP BY 1",
    "f4_gap_verified": f"WITH {E_SQL}, {V_SQL}, {_F4} SELECT * FROM f4",
    "f5_gap_cited": f"WITH {C_SQL}, {E_SQL}, {U_SQL}, {_F5} SELECT * FROM f5",
    "f6_cited_ratio": f"WITH {C_SQL}, {E_SQL}, {U_SQL}, {V_SQL}, k AS (SELECT topic, {_K} AS k FROM v WHERE NOT coalesce(keep_uncited, false)) SELECT k.topic, count(*) AS eligible, count(u.k) AS cited, round(count(u.k) / count(*), 6) AS ratio FROM k LEFT JOIN u ON u.topic = k.topic AND u.k = k.k GROUP BY 1",
    "f9_new_by_gap": f"WITH {E_SQL}, {V_SQL} SELECT topic, coalesce(nullif(gap, ''), '<no gap>') AS gap, CAST(added_round AS INTEGER) AS round, count(*) AS new FROM v WHERE added_round IS NOT NULL GROUP BY ALL",
    "f11_gap_status": f"WITH {E_SQL}, {G_SQL}, x AS (SELECT topic, gap, CASE WHEN coalesce(excluded_reason, '') <> '' THEN 'excluded' ELSE {_STATE} END AS state FROM e WHERE gap <> '') SELECT g.topic, gap_id, {_GAP_STATE} AS status, count(state) AS entries, " + ", ".join(f"count(*) FILTER (state = '{x}') AS {x}" for x in ("verified", "pending", "failed", "excluded")) + " FROM g LEFT JOIN x ON x.topic = g.topic AND x.gap = g.gap_id GROUP BY ALL",
    "f16_verify_stats": f"WITH {E_SQL}, n AS (SELECT topic, " + ", ".join(f"count(*) FILTER ({_STATE} = '{x}') AS {x}" for x in R.VERIFICATION) + " FROM e GROUP BY 1) SELECT *, CASE WHEN failed > 0 THEN 2 WHEN pending > 0 THEN 1 ELSE 0 END AS code FROM n",
    "f23_judged_items": "WITH l AS (SELECT topic, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL), p AS (SELECT topic, list_transform(string_split(t, '|'), lambda x: trim(x)) AS c FROM l WHERE regexp_matches(t, '^\\s*\\d+\\s*\\|')), n AS (SELECT topic, count(DISTINCT c[3]) AS items FROM p WHERE len(c) >= 4 GROUP BY 1) SELECT topic, items FROM topics LEFT JOIN n USING (topic)",
    "f24_broad_gaps": f"WITH {C_SQL}, {E_SQL}, {U_SQL}, {V_SQL}, {_F4}, {_F5} SELECT topic, gap, verified, coalesce(cited, 0) AS cited FROM f4 LEFT JOIN f5 USING (topic, gap) WHERE verified >= 20 AND coalesce(cited, 0) < 5",
    "f26_text_sizes": f"WITH {_F26}, s AS (SELECT *, CASE WHEN bytes < 1024 THEN 0 WHEN bytes < 1048576 THEN 1 WHEN bytes < 1073741824 THEN 2 WHEN bytes < 1099511627776 THEN 3 ELSE 4 END AS step FROM f26) SELECT topic, bytes, texts, round(bytes / pow(1024.0, step), 1) AS size, (['B', 'KB', 'MB', 'GB', 'TB'])[step + 1] AS unit FROM s",
    "h6_largest_topics": f"WITH {_F26} SELECT topic, bytes FROM f26 ORDER BY bytes DESC, topic LIMIT 5",
    "g2_walk": f"WITH {E_SQL}, n AS (SELECT topic, CAST(added_round AS INTEGER) AS round, count(*) AS n FROM e WHERE added_round IS NOT NULL GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY topic ORDER BY round) AS upto FROM n), r AS (SELECT u.*, row_number() OVER (PARTITION BY u.topic ORDER BY round DESC) AS back FROM u LEFT JOIN topics t ON t.topic = u.topic WHERE NOT coalesce(list_contains(t.addendum_rounds, round), false)) SELECT topic, max(round) AS round, bool_and(n / upto <= 0.1) AND count(*) = 2 AS saturated FROM r WHERE back <= 2 GROUP BY 1",
    "g4_candidate_order": f"WITH {E_SQL} SELECT topic, entry_id, coalesce(overlap, 0) AS overlap, CAST(row_number() OVER (PARTITION BY topic ORDER BY coalesce(overlap, 0) DESC, lower(coalesce(doi, '')), entry_id) AS INTEGER) AS place FROM e WHERE source = 'genealogy'",
    "g6_caps": f"WITH {E_SQL}, {V_SQL}, {G_SQL}, n AS (SELECT topic, count(*) AS n FROM v GROUP BY 1), m AS (SELECT topic, count(*) AS m FROM g GROUP BY 1) SELECT topic, CAST(CASE WHEN rounds <= 2 THEN 20 ELSE greatest(6, coalesce(n, 0) // (10 * greatest(1, coalesce(m, 0)))) END AS INTEGER) AS cap FROM topics LEFT JOIN n USING (topic) LEFT JOIN m USING (topic)",
    "j55_coarse_spans": f"WITH {C_SQL} SELECT topic, {_COARSE} AS coarse, count(*) AS claims FROM c GROUP BY ALL",
    "g10_audit_quota": f"WITH {C_SQL}, f AS (SELECT topic, claim_id, (coalesce(risk, '') = 'high' OR coalesce(key_type, '') <> '') AS judged, coalesce(risk, '') = 'high' AS high, {_COARSE} AS coarse, coalesce(key, '') AS k, substr(coalesce(sentence, ''), 1, 40) AS t FROM c WHERE verdict = 'faithful'), r AS (SELECT *, row_number() OVER (PARTITION BY topic, judged ORDER BY CASE WHEN judged AND NOT high THEN 1 ELSE 0 END, CASE WHEN judged AND NOT coarse THEN 1 ELSE 0 END, k, t, claim_id) AS rank, least({SAMPLE // 4}, count(*) FILTER (NOT judged) OVER (PARTITION BY topic)) AS quota FROM f) SELECT topic, claim_id, judged, CAST(rank AS INTEGER) AS rank FROM r WHERE CASE WHEN judged THEN rank <= {SAMPLE} - quota ELSE rank <= quota END",
    "i3_gap_terms": f"WITH {G_SQL}, t AS (SELECT unnest(list_distinct(regexp_extract_all(lower(coalesce(description, '')), '[a-z][a-z0-9-]{{3,}}'))) AS term FROM g) SELECT term, count(*) AS gaps FROM t WHERE term NOT IN ('{_STOPPED}') GROUP BY 1",
    "j22_fallback_spans": f"WITH {_ONE} SELECT source_id, sha1(substr(trim(regexp_replace(coalesce(text, ''), '^\\s*#+[^\\n]*\\n', '')), 1, {SPAN})) AS span_sha1 FROM t",
    "j58_card_authors": f"WITH {_ONE}, l AS (SELECT source_id, list_filter(list_transform(string_split(regexp_extract(coalesce(text, ''), '(?m)\\A---\\n(?:.*\\n)*?authors: *(.*)$', 1), ';'), lambda x: trim(x)), lambda x: x <> '') AS n FROM t) SELECT source_id, CAST(len(n) AS INTEGER) AS lists FROM l WHERE len(n) > 0",
    "k4_resolved_gaps": f"WITH {E_SQL}, {V_SQL}, {G_SQL}, f AS (SELECT topic, gap AS gap_id, CAST(min(added_round) AS INTEGER) AS first FROM v WHERE gap <> '' AND added_round IS NOT NULL GROUP BY ALL) SELECT topic, gap_id, CASE WHEN {_GAP_STATE} = 'pending' AND first IS NOT NULL THEN 'resolved' ELSE {_GAP_STATE} END AS status, CASE WHEN {_GAP_STATE} = 'pending' AND first IS NOT NULL THEN first ELSE CAST(resolved_round AS INTEGER) END AS resolved_round FROM g LEFT JOIN f USING (topic, gap_id)",
    "k6_retracted_excluded": f"WITH {E_SQL} SELECT entry_id, topic, coalesce(nullif(excluded_reason, ''), CASE WHEN coalesce(retracted, false) THEN 'retracted' END) AS excluded_reason FROM e",
    "k18_fetched_levels": f"WITH {E_SQL}, h AS (SELECT DISTINCT path FROM sources WHERE path <> '' AND trim(text) <> ''), p AS (SELECT entry_id, 'abstract' AS level, paths.abstract AS path FROM e UNION ALL SELECT entry_id, 'pdf_text', paths.pdf_text FROM e UNION ALL SELECT entry_id, 'ocr', paths.ocr FROM e) SELECT entry_id, string_agg(level, '|' ORDER BY level) AS levels FROM p JOIN h USING (path) GROUP BY 1",
    "k22_filled_signals": f"WITH {E_SQL}, k AS (SELECT journal, journal_signals.h_index AS h FROM e WHERE journal_signals IS NOT NULL AND journal <> '' QUALIFY row_number() OVER (PARTITION BY journal ORDER BY entry_id) = 1) SELECT entry_id, CASE WHEN journal_signals IS NOT NULL THEN journal_signals.h_index ELSE k.h END AS h_index FROM e LEFT JOIN k USING (journal)",
    "m8_abstract_choice": f"WITH o AS (SELECT * FROM sources WHERE level = 'abstract' AND text <> '' AND doi <> '' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY text) = 1) SELECT topic, lower(doi) AS doi, source_id, provider FROM o QUALIFY row_number() OVER (PARTITION BY topic, lower(doi) ORDER BY CASE WHEN provider = 'europepmc' AND length(text) >= {SHORT} THEN 0 WHEN coalesce(provider, '') IN ('europepmc', 'crossref') THEN 1 ELSE 2 END, length(text) DESC, source_id) = 1",
}

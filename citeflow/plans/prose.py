"""Queries over prose: abbreviations, designs, marks, anchors, co-location."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeflow.functions import numbers as N
from citeflow.functions import records as R
from citeflow.functions.text import loose_key
from citeflow.operators import anchors, fuzzy, prose
from citeflow.plans.records import E_SQL, _entries
from citeflow.plans.reviews import _KEY, _claims, _docs
from citeflow.runtime import table

#: Words of prose that name a study design (fixed values).
DESIGNS = {
    "rct": "rct", "随机对照": "rct", "随机分组": "rct", "随机双盲": "rct", "randomized controlled": "rct", "randomised controlled": "rct", "longitudinal": "longitudinal", "纵向": "longitudinal",
    "前瞻": "cohort", "prospective": "cohort", "队列": "cohort", "cohort": "cohort", "meta-analysis": "meta", "meta分析": "meta", "荟萃": "meta",
    "横断面": "cross_sectional", "cross-sectional": "cross_sectional", "cross sectional": "cross_sectional",
}
#: Words that give a statement a direction (fixed values).
POLARITY = [
    "最高", "最低", "most", "least", "增加", "减少", "increase", "decrease", "升高", "降低", "有效", "无效", "effective", "ineffective", "改善", "恶化", "improve", "worsen",
    "正相关", "负相关", "positive correlation", "negative correlation", "最多", "最少",
]
#: The longest word decides; one of Latin letters stands alone.
_ORDER = sorted(DESIGNS, key=lambda w: (-len(w), w))
_FORM = {w: f"(^|[^a-z]){w}($|[^a-z])" if w.isascii() else w for w in _ORDER}


def j39_abbreviations(s, d):
    """Capital abbreviations of the documents and in how many they are given
    in brackets, which counts as a gloss."""
    x = _docs(s, d).where("text IS NOT NULL").select("text", F.explode(F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[A-Z]{2,}$")))).alias("abbreviation"))
    return x.groupBy("abbreviation").agg(F.count("*").alias("documents"), F.count_if(F.col("text").contains(F.concat(F.lit("("), F.col("abbreviation")))).alias("in_brackets"))


def design(text: Column) -> Column:
    """The study design that a text names; null for none."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(_FORM[w]), F.lit(DESIGNS[w])) for w in _ORDER])


def j12_designs(s, d):
    """Study designs that the documents name."""
    return _docs(s, d).select("source", design(F.col("text")).alias("design")).groupBy("source", "design").agg(F.count("*").alias("documents"))


def j14_design_conflicts(s, d):
    """Claims whose sentence names a stronger design than the entry cited has."""
    e = _entries(s, d).select("topic", loose_key(F.col("citation_key")).alias("k"), "study_type", "entry_id").where("k IS NOT NULL")
    e = e.groupBy("topic", "k").agg(F.min_by("study_type", "entry_id").alias("study_type"))
    c = _claims(s, d).select("topic", "claim_id", loose_key(F.col("key")).alias("k"), design(F.col("sentence")).alias("design"))
    conflict = (F.col("design") == "rct") & F.col("study_type").isin("cohort") | F.col("design").isin("meta", "cohort") & (F.col("study_type") == "case_control")
    return c.join(e, ["topic", "k"]).where("design IS NOT NULL").groupBy("design", "study_type").agg(F.count("*").alias("claims"), F.count_if(F.coalesce(conflict, F.lit(False))).alias("conflicts"))


def j15_polarity(s, d):
    """Claims that state a direction, that negate, by risk."""
    t = F.lower(F.coalesce("sentence", F.lit("")))
    polar = F.exists(F.array(*map(F.lit, POLARITY)), lambda w: F.contains(t, w))
    negated = t.rlike(r"\b(?:no|not|never|without)\b")
    return _claims(s, d).groupBy("risk", polar.alias("polar"), negated.alias("negated")).agg(F.count("*").alias("claims"))


def e15_nearest_marks(s, d):
    """Citations of the documents with the claim mark nearest to them."""
    return anchors.nearest_sidecars(_docs(s, d).where("text LIKE '%<!-- claim:%'"), "doc_id", "text")


def e14_prose_metadata(s, d):
    """Citations whose named family or year differs from the record's."""
    c = prose.cited_sentences(_docs(s, d), "doc_id", "text").join(_docs(s, d).select("doc_id", "topic"), "doc_id").withColumn("anchor", anchors.anchor(F.col("sentence")))
    e = _entries(s, d).where("citation_key IS NOT NULL").groupBy("topic", F.col("citation_key").alias("cited")).agg(F.min_by(F.struct(R.bare_family(F.try_element_at("authors", F.lit(1))).alias("family"), F.col("year").cast("int").alias("year")), "entry_id").alias("e"))
    j = c.join(e, ["topic", "cited"]).withColumn("differs", anchors.disagrees(F.col("anchor"), F.col("e.family"), F.col("e.year")))
    return j.select("doc_id", "line", "nth", "cited", F.array_join("differs", ",").alias("differs"))


def e27_closest_gaps(s, d):
    """For each gap that entries name and no row declares, the declared gaps of
    the topic with the most similar ids."""
    g = table(s, d, "gaps").select("topic", loose_key(F.col("gap_id")).alias("gap"))
    e = table(s, d, "entries").select("topic", loose_key(F.col("gap")).alias("gap"))
    return fuzzy.closest(e.join(g, ["topic", "gap"], "left_anti"), g, "topic", "gap").select("topic", "wanted", "declared", F.round("ratio", 6).alias("ratio"), "rank", "sure")


def g12_colocation(s, d):
    """Whether a claim's numbers stand together in the cited entry's text."""
    c = _claims(s, d).select("topic", "claim_id", loose_key(F.col("key")).alias("k"), N.numbers(F.regexp_replace(F.coalesce("sentence", F.lit("")), prose.CITATION, " ")).alias("n")).where(F.size("n") > 0)
    e = _entries(s, d).select("topic", loose_key(F.col("citation_key")).alias("k"), F.coalesce("paths.pdf_text", "paths.ocr", "paths.abstract").alias("path"), "entry_id").where("k IS NOT NULL AND path IS NOT NULL")
    e = e.groupBy("topic", "k").agg(F.min_by("path", "entry_id").alias("path"))
    t = table(s, d, "sources").where("path IS NOT NULL").groupBy("path").agg(F.min_by("text", "source_id").alias("text"))
    j = c.join(e, ["topic", "k"]).join(t, "path")
    return j.select("claim_id", F.size("n").alias("numbers"), anchors.colocated(F.col("n"), F.col("text"), 160).isNotNull().alias("together"))


NAMES = [j39_abbreviations, j12_designs, j14_design_conflicts, j15_polarity, e15_nearest_marks, e14_prose_metadata, e27_closest_gaps, g12_colocation]
QUERIES = {f.__name__: f for f in NAMES}

_C = "c AS (SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY arrived_at, round) = 1)"
_DESIGN = "CASE " + " ".join(f"WHEN regexp_matches(lower({{x}}), '{_FORM[w]}') THEN '{DESIGNS[w]}'" for w in _ORDER) + " END"
SQL = {
    "j39_abbreviations": "WITH x AS (SELECT text, unnest(list_distinct(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z]{2,}')))) AS abbreviation FROM documents) SELECT abbreviation, count(*) AS documents, count(*) FILTER (contains(text, '(' || abbreviation)) AS in_brackets FROM x GROUP BY 1",
    "j12_designs": f"SELECT source, {_DESIGN.format(x='text')} AS design, count(*) AS documents FROM documents GROUP BY 1, 2",
    "j14_design_conflicts": f"WITH {_C}, {E_SQL}, k AS (SELECT topic, {_KEY.format('citation_key')} AS k, study_type FROM e WHERE {_KEY.format('citation_key')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY topic, k ORDER BY entry_id) = 1), x AS (SELECT topic, {_KEY.format('key')} AS k, {_DESIGN.format(x='sentence')} AS design FROM c) SELECT design, study_type, count(*) AS claims, count(*) FILTER ((design = 'rct' AND study_type = 'cohort') OR (design IN ('meta', 'cohort') AND study_type = 'case_control')) AS conflicts FROM x JOIN k USING (topic, k) WHERE design IS NOT NULL GROUP BY 1, 2",
    "j15_polarity": f"WITH {_C}, t AS (SELECT risk, lower(coalesce(sentence, '')) AS t FROM c) SELECT risk, " + " OR ".join(f"contains(t, '{w}')" for w in POLARITY) + " AS polar, regexp_matches(t, '\\b(?:no|not|never|without)\\b') AS negated, count(*) AS claims FROM t GROUP BY ALL",
}

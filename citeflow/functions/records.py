"""Column expressions over bibliographic records: normal forms, flags, keys and
reference strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Enumerations of the record schema (fixed values).
STUDY_TYPES = ["rct", "meta", "cohort", "case_control", "review", "mechanism", "guideline", "other"]
VERIFICATION = ["pending", "verified", "failed"]
GAP_STATUS = ["pending", "resolved", "insufficient"]
#: Servers and prefixes that mark a preprint (fixed values).
PREPRINT_NAMES = r"(?i)biorxiv|medrxiv|arxiv|research\s*square|preprint|ssrn|chemrxiv|psyarxiv|osf"
PREPRINT_PREFIXES = ["10.1101/", "10.21203/", "10.31219/", "10.20944/"]
#: Particles before a family name that comparisons leave out (fixed values).
PARTICLES = ["van", "von", "de", "del", "du", "da", "di", "do", "la", "le", "der", "den", "ten", "ter"]
#: Forms of a correction notice that count as an erratum (fixed values).
ERRATA = ["correction", "erratum", "corrigendum"]
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"


def known(value: Column, allowed: list[str], default: str) -> Column:
    """value if it is one of allowed, else default (null too)."""
    return F.when(value.isin(allowed), value).otherwise(F.lit(default))


def filled(value: Column) -> Column:
    """Null for an empty string."""
    return F.when(value != "", value)


def strings(values: Column) -> Column:
    """A list without nulls; an empty list for null."""
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull())


def grounding(fulltext_state: Column, has_xml: Column, ocr_state: Column, abstract: Column, pdf_text: Column, ocr: Column) -> Column:
    """Richest readable level of a record: each needs a path that holds text."""
    has = lambda p: F.coalesce(p, F.lit("")) != ""
    readable = has(pdf_text) | has(ocr) | has(abstract)
    xml = (F.coalesce(fulltext_state, F.lit("")) == "succeeded") | F.coalesce(has_xml, F.lit(False))
    scanned = ((F.coalesce(ocr_state, F.lit("")) == "succeeded") | has(ocr)) & (has(ocr) | has(abstract))
    return (
        F.when(xml & readable, "fulltext").when(has(pdf_text), "pdf_text").when(scanned, "ocr").when(has(abstract), "abstract").otherwise("title_only")
    )


def next_rung(level: Column, states: dict[str, Column]) -> Column:
    """The first rung not tried yet of a record with no text; null otherwise."""
    tried = lambda s: F.coalesce(s, F.lit("")).isin("succeeded", "failed", "skipped")
    return F.when(level == "title_only", F.coalesce(*[F.when(~tried(s), F.lit(name)) for name, s in states.items()]))


def title_cluster(title: Column) -> Column:
    """Cluster id of a title: a hash of its letters and digits; null for under
    six of them."""
    norm = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9\\x{4e00}-\\x{9fff}]", "")
    return F.when(F.length(norm) >= 6, F.concat(F.lit("t"), F.substring(F.sha1(norm), 1, 10)))


def key_base(authors: Column, year: Column) -> Column:
    """Family name of the first author and the year: the stem of a citation key."""
    first = F.lower(F.trim(F.split_part(F.coalesce(F.try_element_at(authors, F.lit(1)), F.lit("anon")), F.lit(","), F.lit(1))))
    bare = F.regexp_replace(first, "[^a-z0-9]", "")
    family = F.when(bare == "", "anon").otherwise(bare)
    family = F.when(family.rlike("^[a-z]"), family).otherwise(F.concat(F.lit("a"), family))
    return F.concat(family, F.coalesce(year.cast("int").cast("string"), F.lit("na")))


def hashed_key(base: Column, doi: Column) -> Column:
    """The stem with four base-32 characters of the DOI's SHA-1, which its first
    20 bits give; the stem alone without a DOI."""
    bits = F.conv(F.substring(F.sha1(F.lower(doi)), 1, 5), 16, 10).cast("int")
    chars = [F.substring(F.lit(BASE32), F.shiftright(bits, 15 - 5 * i).bitwiseAND(31) + 1, F.lit(1)) for i in range(4)]
    return F.when(F.coalesce(doi, F.lit("")) == "", base).otherwise(F.concat(base, *chars))


def author_text(authors: Column) -> Column:
    """Authors of a reference: none, one, up to twenty, or the first nineteen
    and the last."""
    n = F.size(authors)
    return (
        F.when(n == 0, "Anon.").when(n == 1, F.try_element_at(authors, F.lit(1)))
        .when(n > 20, F.concat(F.array_join(F.slice(authors, 1, 19), ", "), F.lit(", ... "), F.try_element_at(authors, F.lit(-1))))
        .otherwise(F.concat(F.array_join(F.slice(authors, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(", & "), F.try_element_at(authors, F.lit(-1))))
    )


def apa(authors: Column, year: Column, title: Column, journal: Column, doi: Column) -> Column:
    """The reference string of a record."""
    when = F.coalesce(year.cast("int").cast("string"), F.lit("n.d."))
    place = F.when(F.coalesce(journal, F.lit("")) != "", F.concat(F.lit(". *"), journal, F.lit("*. "))).otherwise(F.lit(". "))
    return F.concat(author_text(authors), F.lit(" ("), when, F.lit("). "), F.coalesce(title, F.lit("")), place, F.lit("https://doi.org/"), doi)


def family(author: Column) -> Column:
    """Lower-case family name: what stands before a comma, else the last word."""
    return F.lower(F.when(F.instr(author, ",") > 0, F.trim(F.split_part(author, F.lit(","), F.lit(1)))).otherwise(F.regexp_extract(author, r"(\S*)\s*$", 1)))


def bare_family(author: Column) -> Column:
    """Family name without leading particles, unless nothing else is left."""
    name = family(author)
    stripped = F.trim(F.regexp_replace(name, "^(?:(?:" + "|".join(PARTICLES) + r")\s+)+", ""))
    return F.when(stripped.isin(PARTICLES) | (stripped == ""), name).otherwise(stripped)


def in_text(authors: Column) -> Column:
    """Authors as cited in text: one, two, or the first with others."""
    name = lambda i: F.trim(F.split_part(F.try_element_at(authors, F.lit(i)), F.lit(","), F.lit(1)))
    return F.when(F.size(authors) == 1, name(1)).when(F.size(authors) == 2, F.concat(name(1), F.lit(" & "), name(2))).when(F.size(authors) > 2, F.concat(name(1), F.lit(" et al.")))


def is_preprint(doi: Column, journal: Column) -> Column:
    """Preprint by DOI prefix or by the exact name of a server (an empty name
    counts as one)."""
    by_doi = F.lit(False)
    for p in PREPRINT_PREFIXES:
        by_doi = by_doi | F.coalesce(doi, F.lit("")).startswith(p)
    return by_doi | F.lower(F.trim(F.coalesce(journal, F.lit("")))).isin("biorxiv", "medrxiv", "research square", "preprints.org", "")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two lists of distinct words; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def word_set(text: Column) -> Column:
    """Distinct lower-case words of letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))

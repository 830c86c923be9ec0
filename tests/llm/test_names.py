"""Spellings of names: parsing, comparison, clustering."""

import random
from itertools import combinations

import pytest

from citeflow.llm.names import blocks, jaro_winkler, one_edit, parses, same_core, same_given, variants


@pytest.mark.parametrize(
    "name,core,given",
    [
        ("Duberivari, C. J.", "duberivari", ("c", "j")), ("C. J. Duberivari", "duberivari", ("c", "j")), ("Duberivari CJ", "duberivari", ("c", "j")),
        ("Clara J. Duberivari", "duberivari", ("clara", "j")), ("van der Berg, P.", "berg der van", ("p",)), ("Berg, P. van der", "berg der van", ("p",)),
        ("P. van der Berg", "berg der van", ("p",)), ("Iker, da Silva", "da silva", ("iker",)), ("GÖTZE, M.", "gotze", ("m",)), ("Goetze,M.", "goetze", ("m",)),
        ("Nutrition Consortium, Alpha", "alpha", ("nutrition", "consortium")), ("The Alpha Nutrition Cons.", "alpha", ("nutrition", "cons")),
    ],
)
def test_parses(name, core, given):
    assert parses(name, False)[0] == (core, given)


def test_given_family_swapped_is_read_in_both_ways():
    assert set(parses("Mirko, Jekimighan", False)) == {("mirko", ("jekimighan",)), ("jekimighan", ("mirko",))}
    assert parses("  ", False) == [] and parses("et al.", False) == [] and parses(",", False) == []


def test_cores_one_edit_apart_share_a_block():
    rng = random.Random(6)
    for _ in range(2000):
        a = "".join(rng.choice("abdeiklmnorstuv") for _ in range(rng.randrange(5, 11)))
        i, c = rng.randrange(len(a)), rng.choice("abdeiklmnorstuv")
        b = rng.choice([a[:i] + a[i + 1 :], a[:i] + c + a[i:], a[:i] + c + a[i + 1 :], a[:i] + a[i : i + 2][::-1] + a[i + 2 :]])
        assert set(blocks(a, ())) & set(blocks(b, ())), (a, b)
    assert not any(k.endswith("|") or len(k.split("|")[-1]) < 3 for k in blocks("aeiou", ()) + blocks("mila", ()) + blocks("marta", ()))


def test_similarity_from_either_end():
    from citeflow.llm.names import two_way

    assert two_way("vozorosto", "vpzorosto") > jaro_winkler("vozorosto", "vpzorosto") and two_way("kuvurkelden", "guvurkelden") == two_way("nedlekruvuk", "nedlekruvug")
    assert same_core("krarevirdt", "krarevirt") and not same_core("gaistindolberg", "glaistidolberg") and not same_core("blairtaiminnik", "blairtirinnik")


def test_one_edit_and_jaro_winkler_against_brute_force():
    def damerau(a, b):
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(2)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 7)))
        b = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 7)))
        assert one_edit(a, b) == (damerau(a, b) <= 1), (a, b)
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler("dwayne", "duane") == pytest.approx(0.84, abs=1e-2)
    assert jaro_winkler("", "a") == 0 and jaro_winkler("", "") == 1


def test_cores_one_edit_apart_share_a_block():
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for _ in range(500):
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(5, 12)))
        i, kind = rng.randrange(len(a)), rng.randrange(4)
        b = [a[:i] + a[i + 1 :], a[:i] + rng.choice(letters) + a[i:], a[:i] + rng.choice(letters) + a[i + 1 :], a[:i] + a[i : i + 2][::-1] + a[i + 2 :]][kind]
        assert set(blocks(a, ("m",))) & set(blocks(b, ("m",))), (a, b)


def test_given_parts():
    assert same_given(("misha",), ("m",)) and same_given(("trish",), ("patricia",)) and same_given(("trish",), ("p",))
    assert same_given(("clara", "j"), ("c", "j")) and same_given(("paco",), ("f", "e"))
    assert not same_given(("m",), ("c", "j")) and not same_given(("clara", "j"), ("c", "k")) and not same_given((), ("c",))
    assert same_given(("imaging", "study", "group"), ("i", "s", "g")) and same_given(("wkg", "party"), ("working", "party"))
    assert not same_given(("anna",), ("agnes",))
    assert same_core("gotze", "goetze") and same_core("bosobovari", "bosoboevaari") and same_core("masaanko", "masadanko")
    assert same_core("gevark-l", "gevark-lodon") and not same_core("abcd", "abce") and not same_core("kalmus", "palmas")


def pairs(rows):
    by = {}
    for r in rows:
        by.setdefault((r.field, r.component), []).append(r.name)
    return {frozenset(p) for v in by.values() for p in combinations(v, 2)}


def test_variants(spark):
    names = ["Duberivari, M.", "Misha Duberivari", "Duberivari, Mikhail", "Duberivri, M.", "Mikhail, Duberivari", "  Duberivari, M.", "Duberivari, C. J.", "Clara J. Duberivari", "Other, X.", "", None, "  ", "et al.", "x" * 5000]
    rows = [("authors", n, False) for n in names for _ in range(2)] + [("fam", n, True) for n in ("Sodeñdinnik", "Sodendinnik", "SODEÑDINNIK", "Talaketsis", None)]
    got = pairs(variants(spark.createDataFrame(rows, "field string, name string, family boolean")).collect())
    m, c = names[:6], names[6:8]
    assert got == {frozenset(p) for g in (m, c, ["Sodeñdinnik", "Sodendinnik", "SODEÑDINNIK"]) for p in combinations(g, 2)}


def test_separators_within_a_family_name_do_not_matter(spark):
    groups = [
        ("fam", True, ["de la Flaimarersson", "delaFlaimarersson", "dela Flaimarersson", "de la Flaimarerson"]),
        ("fam", True, ["Krandadisto-Hortop", "Krandadisto Hortop", "KrandadistoHortop", "Krandadisto Hortp"]),
        ("authors", False, ["van der Shorkaigelski, Q.", "vanderShorkaigelski, Q.", "Shorkaigelski, Q. van der", "Q. van der Shorkaigelski"]),
        ("authors", False, ["von Higailmighan, S. R.", "vonHigailmighan, S. R.", "Sanna R. von Higailmighan"]),
        ("authors", False, ["Krandadisto-Hortop, M.", "Krandadisto Hortop, M."]),
    ]
    others = [("fam", "Hortop", True), ("fam", "Flaimarersson", True), ("authors", "Hortop, M.", False), ("authors", "von Higailmighan, T.", False)]
    rows = [(field, n, family) for field, family, names in groups for n in names] + others
    got = pairs(variants(spark.createDataFrame(rows, "field string, name string, family boolean")).collect())
    assert got == {frozenset(p) for _, _, names in groups for p in combinations(names, 2)}


def test_variants_of_nothing(spark):
    assert variants(spark.createDataFrame([], "field string, name string, family boolean")).count() == 0

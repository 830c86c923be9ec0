"""Variant spellings of names typed by people.

A string is parsed into a core (family name with its particles, or the head of
an organisation's name) and given parts (names, initials, or the other words of
an organisation, which an acronym stands for). Blocks are phonetic codes of the
sorted core tokens with the first given initial; every code is also a block with
each of its symbols left out, so two cores one edit apart always share a block.
A second core, the tokens in written order without separators, makes particles
written together and double names with a blank or a hyphen alike.
Pairs within a block are compared by Jaro-Winkler similarity and a guard of one edit on the
cores, and by initials, nicknames and abbreviations on the given parts. Accepted
pairs are clustered by connected components.

All of it runs on distinct strings, then on distinct parses: a spelling used by
a third of all rows is one row. No part is collected."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.graph import components
from citeflow.runtime import cut, spread, table

#: Short forms of given names and the names that they may stand for.
NICKNAMES = {
    "al": "albert alan alfred", "alex": "alexander alexandra", "andy": "andrew", "annie": "anne", "bart": "bartholomew",
    "becky": "rebecca", "ben": "benjamin", "beppe": "giuseppe", "bert": "albert robert", "bess": "elizabeth", "beth": "elizabeth",
    "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "brad": "bradley",
    "carlo": "carlos", "cathy": "catherine", "charlie": "charles", "chris": "christopher christine christina", "chuck": "charles", "cindy": "cynthia",
    "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard",
    "dima": "dmitri dmitry", "don": "donald", "doug": "douglas", "ed": "edward edwin", "eddie": "edward", "ellie": "eleanor",
    "frank": "francis franklin", "fred": "frederick alfred", "gabe": "gabriel", "gene": "eugene", "gigi": "luigi", "gina": "regina",
    "greg": "gregory", "hank": "henry", "hans": "johannes", "harry": "harold henry", "jack": "john", "jake": "jacob",
    "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald jerome", "jill": "gillian", "jim": "james",
    "jimmy": "james", "joe": "joseph", "johnny": "john", "jon": "jonathan", "josh": "joshua", "kate": "katherine catherine",
    "kathy": "katherine kathleen", "katie": "katherine", "ken": "kenneth", "kim": "kimberly", "larry": "lawrence", "len": "leonard",
    "lenny": "leonard", "liz": "elizabeth", "lou": "louis louise", "lupe": "guadalupe", "maggie": "margaret", "manny": "manuel",
    "matt": "matthew", "max": "maximilian", "meg": "margaret", "mick": "michael", "mike": "michael", "misha": "mikhail",
    "molly": "mary", "nan": "nancy", "nate": "nathan nathaniel", "ned": "edward", "nell": "eleanor helen", "nick": "nicholas",
    "paco": "francisco", "pam": "pamela", "pancho": "francisco", "pat": "patricia patrick", "patty": "patricia", "peggy": "margaret",
    "pepe": "jose", "pete": "peter", "phil": "philip", "polly": "mary", "ray": "raymond", "rick": "richard",
    "rob": "robert", "ron": "ronald", "sally": "sarah", "sam": "samuel samantha", "sandy": "sandra alexander", "sasha": "alexander alexandra",
    "steve": "steven stephen", "sue": "susan", "ted": "edward theodore", "teri": "theresa", "terry": "terence theresa", "tess": "theresa",
    "tim": "timothy", "toby": "tobias", "tom": "thomas", "tony": "anthony antonio", "tracy": "theresa", "trish": "patricia",
    "val": "valerie", "vanya": "ivan", "vicky": "victoria", "vince": "vincent", "volodya": "vladimir", "walt": "walter",
    "wes": "wesley", "will": "william", "zach": "zachary",
}
FORMAL = {k: tuple(v.split()) for k, v in NICKNAMES.items()}
PARTICLES = {"van", "von", "der", "den", "de", "da", "la", "le", "du", "del", "della", "di", "dos", "das", "ten", "ter", "al", "el", "bin", "ibn", "zu", "zur", "af", "av"}
ORG_WORDS = ("investigators", "collaboration", "collaborative", "collaborators", "consortium", "group", "party", "network", "committee", "society", "association", "institute", "university", "initiative", "alliance", "council", "federation")
ORG_SHORT = {"grp", "wkg", "assoc", "univ", "inst", "cttee"}
#: What stands in a list of names without being one.
NO_NAMES = {"et al", "and others", "others", "anon", "anonymous", "n n", "unknown", "none", "na", "n a"}

_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "’": "'", "`": "'", "´": "'", "‘": "'", "‐": "-", "‑": "-", "–": "-"})
#: Classes of consonants that sound alike; vowels, h, w and y have none.
_SOUND = {c: k for k, s in {"1": "bp", "2": "vf", "3": "ckgqj", "4": "szx", "5": "dt", "6": "l", "7": "mn", "8": "r"}.items() for c in s}


def folded(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).lower().translate(_LETTERS))
    return "".join(c for c in text if not unicodedata.combining(c)).translate(_LETTERS)


def contracted(text: str) -> str:
    """Folded text without the vowel pairs that stand for umlauts, so that both
    spellings of them are alike."""
    return re.sub(r"aa|ae", "a", re.sub(r"oe", "o", re.sub(r"ue", "u", text)))


def _is_org(tokens: list[str]) -> bool:
    for t in tokens:
        t = folded(t).strip(".")
        if t in ORG_SHORT or len(t) >= 4 and any(w.startswith(t) for w in ORG_WORDS):
            return True
    return False


def _core(tokens: list[str]) -> str:
    """Sorted tokens, blanks and signs removed within them; a hyphen stays."""
    return " ".join(sorted(re.sub(r"[^\w-]", "", folded(t)) for t in tokens if re.sub(r"[^\w]", "", t)))


def _glued(tokens: list[str]) -> str:
    """Tokens in written order, without any separator."""
    return "".join(re.sub(r"[\W_]", "", folded(t)) for t in tokens)


def _given(tokens: list[str]) -> list[str]:
    out = []
    for t in tokens:
        out += [re.sub(r"[^\w]", "", folded(p)) for p in re.split(r"[.\-\s]+", t)]
    return [t for t in out if t]


def _initials(token: str, rest: list[str]) -> list[str] | None:
    """The letters of a token such as ``FA`` or ``J.K.``, or None."""
    bare = token.replace(".", "").replace("-", "")
    if not bare or not bare.isalpha():
        return None
    if "." in token and all(len(p) <= 1 for p in re.split(r"[.\-]", token)):
        return list(folded(bare))
    if len(bare) == 1:
        return [folded(bare)]
    if len(bare) <= 3 and bare.isupper() and any(any(c.islower() for c in r) for r in rest):
        return list(folded(bare))
    return None


def _spelled(tokens: list[str]) -> list[str]:
    out = []
    for t in tokens:
        got = _initials(t, ["x"])
        out += got if got is not None else _given([t])
    return out


def parses(name: str, family_only: bool) -> list[tuple[str, tuple[str, ...]]]:
    """(core, given parts) of each way to read a name; none for a blank one."""
    return [(_core(tokens), given) for tokens, given in _readings(name, family_only)]


def _readings(name: str, family_only: bool) -> list[tuple[list[str], tuple[str, ...]]]:
    """(tokens of the core in written order, given parts) of each way to read a
    name. Particles behind the comma come first, as they do before a family name."""
    name = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", name)).strip()
    name = re.sub(r"\s*,\s*", ", ", name)
    if not re.search(r"\w", name) or re.sub(r"\W+", " ", name.lower()).strip() in NO_NAMES:
        return []
    left, _, right = name.partition(", ")
    a, b = left.split(), right.replace(",", " ").split()
    if _is_org(a + b):
        if b:
            a = b + a
        a = [t for t in a if folded(t) != "the"]
        if len(a) > 1:
            return [(a[:1], tuple(_given(a[1:])))]
    particles = [t for t in b if folded(t) in PARTICLES]
    b = [t for t in b if folded(t) not in PARTICLES]
    if family_only:
        if not b:
            while len(a) > 1 and _initials(a[-1], a[:-1]) is not None:
                a = a[:-1]
        return [(particles + a, ())]
    if b:
        own = _spelled(b)
        swapped = [(particles + b, tuple(_spelled([t for t in a if folded(t) not in PARTICLES])))]
        if particles and right.split()[0] in particles:  # "Given, van Family"
            return [p for p in swapped if _core(p[0])]
        out = [(particles + a, tuple(own))]
        if len(b) == 1 and own and len(own[0]) > 2 and len(a) <= 2:  # perhaps "Given, Family"
            out += swapped
        return [p for p in out if _core(p[0])]
    # Without a comma: initials last, or given names first.
    tail: list[str] = []
    while len(a) > 1 and (got := _initials(a[-1], a[:-1])) is not None:
        tail, a = got + tail, a[:-1]
    if tail or len(a) == 1:
        return [(a, tuple(tail))] if _core(a) else []
    cut_at = len(a) - 1
    while cut_at > 1 and folded(a[cut_at - 1]) in PARTICLES:
        cut_at -= 1
    return [p for p in [(a[cut_at:], tuple(_spelled(a[:cut_at])))] if _core(p[0])]


def code(core: str) -> str:
    """Phonetic code of a core: the sound classes of its consonants."""
    return "".join(_SOUND.get(c, "") for c in core)


def leads(given: tuple[str, ...]) -> set[str]:
    """First letters that the first given part may have in other spellings."""
    if not given:
        return {""}
    return {f[0] for f in FORMAL.get(given[0], (given[0],))}


#: Symbols that a phonetic code needs to be a block key; too many names share less.
SYMBOLS = 3


def blocks(core: str, given: tuple[str, ...], glued: str = "") -> list[str]:
    """Block keys of a parse; glued: its core without separators. Two cores one
    edit apart share a key: their codes are equal, or equal but for one symbol.
    Where a code without a symbol would be shorter than SYMBOLS, the letters
    themselves, whole and with each one left out, serve instead."""
    out = set()
    for head, mark in ((core, ""), *([(glued, "")] if glued not in ("", core) else []), *([(core.split("-")[0], "-" + core.split("-")[1][:1])] if "-" in core else [])):
        c = code(head)
        for lead in leads(given):
            sizes = {n + i for n in (len(head), len(contracted(head))) for i in (0, 1)} if not mark else {0}
            for size in sizes:
                if len(c) >= SYMBOLS:
                    out.add(f"{lead}|{mark}|{size}|{c}")
                if len(c) > SYMBOLS:
                    out.update(f"{lead}|{mark}|{size}|{c[:i] + c[i + 1 :]}" for i in range(len(c)))
            if len(c) <= SYMBOLS:
                for letters in {head, contracted(head)}:
                    out.add(f"{lead}|{mark}|{letters}")
                    if len(letters) >= 4:
                        out.update(f"{lead}|{mark}|{letters[:i] + letters[i + 1 :]}" for i in range(len(letters)))
    return sorted(out)


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity; 1 for equal strings, 0 if one is empty."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [y for y, u in zip(b, used) if u]
    t = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def two_way(a: str, b: str) -> float:
    """Jaro-Winkler similarity from either end, the larger: a wrong letter at
    the beginning costs as much as one at the end."""
    return max(jaro_winkler(a, b), jaro_winkler(a[::-1], b[::-1]))


def one_edit(a: str, b: str) -> bool:
    """Whether at most one insertion, deletion, substitution or transposition
    of neighbours leads from a to b."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) != len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1]


def same_core(a: str, b: str, least: float = 0.9) -> bool:
    """Whether two cores are spellings of one: equal, of that Jaro-Winkler
    similarity (from either end) and not more than one edit apart, or equal with
    the second part of a double name cut to its first letter. Cores under five
    letters must be equal.

    The guard of one edit is measured: of 14,731 families, the 2,086 pairs of a
    block that are two edits apart have a similarity of 0.92 and more in 1,581
    cases, and mostly are different families; the 3,031 pairs one edit apart all
    have 0.9 and more but for short words."""
    if a == b or contracted(a) == contracted(b):
        return True
    if "-" in a and "-" in b:
        (a1, _, a2), (b1, _, b2) = a.partition("-"), b.partition("-")
        if a2 and b2 and min(len(a2), len(b2)) == 1 and a2[0] == b2[0]:
            return a1 == b1 or min(len(a1), len(b1)) >= 5 and one_edit(a1, b1)
    short, other = contracted(a), contracted(b)
    near = one_edit(a, b) and two_way(a, b) >= least or one_edit(short, other) and two_way(short, other) >= least
    return min(len(a), len(b)) >= 5 and near


def _same_word(a: str, b: str) -> bool:
    if a == b or len(a) == 1 or len(b) == 1:
        fa, fb = FORMAL.get(a, (a,)), FORMAL.get(b, (b,))
        return bool({x[0] for x in fa} & {x[0] for x in fb})
    if a.startswith(b) or b.startswith(a):
        return True
    fa, fb = FORMAL.get(a, (a,)), FORMAL.get(b, (b,))
    if any(x == y or one_edit(x, y) and len(x) > 3 or jaro_winkler(x, y) >= 0.93 for x in fa for y in fb):
        return True
    short, long = sorted((a, b), key=len)
    rest = iter(long)
    return len(short) <= 5 and short[0] == long[0] and len(long) >= len(short) + 2 and all(c in rest for c in short)  # an abbreviation


def same_given(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether given parts may be of one person: the first agree, and so do the
    others that both have. A middle part may be missing; of three and more
    parts (an organisation) none may."""
    if not a or not b:
        return not a and not b
    if len(a) != len(b) and (max(len(a), len(b)) > 2):
        return False
    return all(_same_word(x, y) for x, y in zip(a, b))


def same_family(core_a: str, core_b: str, glued_a: str, glued_b: str) -> bool:
    """Whether two parses have spellings of one core, with or without separators."""
    return same_core(core_a, core_b) or same_core(glued_a, glued_b)


def _parse_rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in it:
        out = []
        for ident, field, name, family in zip(batch["ident"], batch["field"], batch["name"], batch["family"]):
            for tokens, given in _readings(name, bool(family)):
                out.append((ident, field, bool(family), _core(tokens), _glued(tokens), " ".join(given)))
        yield pd.DataFrame(out, columns=["ident", "field", "family", "core", "glued", "given"])


def _block_rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in it:
        rows = [
            (n, f, c, contracted(c), j, contracted(j), g, blocks(c, tuple(g.split()), j))
            for n, f, c, j, g in zip(batch["node"], batch["family"], batch["core"], batch["glued"], batch["given"])
        ]
        yield pd.DataFrame(rows, columns=["node", "family", "core", "short", "glued", "glued_short", "given", "keys"])


def _accept(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in it:
        ok = [
            same_family(ca, cb, ja, jb) and (f or same_given(tuple(ga.split()), tuple(gb.split())))
            for f, ca, cb, ja, jb, ga, gb in zip(*(batch[c] for c in ("family", "core_a", "core_b", "glued_a", "glued_b", "given_a", "given_b")))
        ]
        yield batch.loc[ok, ["node_a", "node_b"]]


def variants(names: DataFrame) -> DataFrame:
    """(field, name, component) of each distinct string that has a variant.

    names: field, name and family (true for a column of family names alone).
    Null and blank names have no row; rows may repeat. Strings are kept as they
    are stored: two that differ by white space are variants. A name that can be
    read in two ways ("Given, Family") is linked in both."""
    strings = names.where("name IS NOT NULL").groupBy("field", "name").agg(F.max("family").alias("family"))
    # Numbers, not hashes, stand for strings and parses: unique, as they number the rows of checkpoints.
    strings = cut(strings).withColumn("ident", F.monotonically_increasing_id())
    read = cut(spread(strings.select("ident", "field", "name", "family")).mapInPandas(_parse_rows, "ident long, field string, family boolean, core string, glued string, given string"))
    parse = ["field", "family", "core", "glued", "given"]
    nodes = cut(read.select(parse).distinct()).withColumn("node", -1 - F.monotonically_increasing_id())
    read = read.join(nodes, parse).select("ident", "node").distinct()
    nodes = spread(nodes)
    keyed = nodes.select("node", "family", "core", "glued", "given").mapInPandas(_block_rows, "node long, family boolean, core string, short string, glued string, glued_short string, given string, keys array<string>")
    keyed = cut(keyed.select("node", "family", "core", "short", "glued", "glued_short", "given", F.explode("keys").alias("block")).withColumn("block", F.xxhash64("family", "block")))
    a, b = (keyed.select("block", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "core", "short", "glued", "glued_short", "given")], *(["family"] if x == "a" else [])) for x in "ab")
    close = F.col("core_a").contains("-")
    for c in ("core", "short", "glued", "glued_short"):
        close |= F.levenshtein(f"{c}_a", f"{c}_b", 2) >= 0
    pairs = a.join(b, "block").where((F.col("node_a") < F.col("node_b")) & close)
    pairs = pairs.groupBy("node_a", "node_b").agg(*[F.first(c).alias(c) for c in ("family", "core_a", "core_b", "glued_a", "glued_b", "given_a", "given_b")])
    linked = pairs.mapInPandas(_accept, "node_a long, node_b long")
    edges = linked.unionByName(read.select(F.col("ident").alias("node_a"), F.col("node").alias("node_b")))
    of = components(edges, "node_a", "node_b")
    return strings.join(of, strings["ident"] == of["node"]).select("field", "name", "component")


def _names(spark: SparkSession, d: str) -> DataFrame:
    authors = table(spark, d, "entries").select(F.explode("authors").alias("name")).select(F.lit("authors").alias("field"), "name", F.lit(False).alias("family"))
    families = table(spark, d, "hits").select(F.lit("first_author_family").alias("field"), F.col("first_author_family").alias("name"), F.lit(True).alias("family"))
    return authors.unionByName(families)


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each string that has a variant, the class that it belongs to and how many
    strings there are in it."""
    of = cut(variants(_names(spark, d)))
    sizes = of.groupBy("field", "component").agg(F.count("*").alias("strings"), F.min("name").alias("class"))
    return of.join(sizes, ["field", "component"]).select("field", "name", "class", "strings")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different strings for one person, organisation or family."""
    of = cut(variants(_names(spark, d)))
    a, b = of.withColumnRenamed("name", "name_a"), of.withColumnRenamed("name", "name_b")
    return a.join(b, ["field", "component"]).where("name_a < name_b").select("field", "name_a", "name_b")


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}
SQL: dict[str, str] = {}

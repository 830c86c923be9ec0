"""Noise in text from scanned pages, and its repair into running paragraphs.

Page furniture is found by layout: a line that is followed by text although the
next word would have fitted on it was not broken by the wrapping, so it is a
running header or a page number. Hyphen-like marks at line ends are joined, also
across furniture. Misread characters are found by intersecting a Levenshtein
automaton with a trie of the vocabulary, where a known confusion (``rn`` for
``m``, ``1`` for ``i``) is one edit: all vocabulary words within the distance are
candidates, ranked by context, kind of edit and frequency. A plain edit, one that
is no known confusion, is believed where the context confirms it.

The vocabulary holds every word of at least LEAST texts, whatever the number of
texts, and stays in the cluster. It is divided among tries by the beginnings and
by the ends of its words, as one edit of a word of four and more letters spares
one of them; a token is looked up in the tries of its beginning and its end, and,
with a confusion undone, of what comes out. Only the candidates, and the counts of
the pairs of words that they would stand in, are joined back to the texts."""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.runtime import cut, spread, table

#: Texts that a word of the vocabulary, and a pair of words that counts as
#: context, must be in.
LEAST, PAIRED = 4, 2
#: How many times as many texts as the misread form a word must be in to be what it
#: stands for: by the number of neighbours (0, 1, 2) that confirm it.
RATIOS = (30, 20, 5)
#: Letters of a word from which on its trie is that of three letters, else of two.
LONG = 8
#: Parts into which the tokens of each trie are divided, so that a frequent
#: beginning or end is not one task's.
SALTS = 4
#: Misread forms and what they stand for (fixed values).
CONFUSIONS = {
    "c": ("e",), "f": ("t",), "1": ("i", "l"), "5": ("s",), "cl": ("d",), "0": ("o",), "ii": ("u",), "b": ("h",), "q": ("g",), "rn": ("m",),
    "m": ("rn",), "vv": ("w",), "ﬁ": ("fi",), "ﬂ": ("fl",), "8": ("b",), "9": ("g",), "6": ("b", "g"), "|": ("l", "i"), "!": ("l", "i"), "ri": ("n",), "li": ("h",), "e": ("c",), "l": ("i",), "i": ("l",),
}
#: Of these, the ones that also occur between ordinary words: they count only in context.
FAINT = {"e", "l", "i", "ri", "li"}
HYPHENS = "-‐‑­¬"

_PAGE = re.compile(r"^(?:\[\s*\d{1,5}\s*\]|[-–—]\s*\d{1,5}\s*[-–—]|(?:p|pp|pg|page|seite|s)\.?\s*\d{1,5}(?:\s*(?:of|/|von|sur|de)\s*\d{1,5})?|\d{1,5}(?:\s*/\s*\d{1,5})?)$", re.I)
_BOTH = re.compile(r"^(?:\d{1,5}(?:\s{2,}|\s*[|·]\s*)(\S.*)|(\S.*?)(?:\s{2,}|\s*[|·]\s*)\d{1,5})$")
_BROKEN = re.compile(rf"([^\W\d_])([{HYPHENS}])$")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_ENDED = re.compile(r"[.!?:。][\"”’)]*$")
_LISTED = re.compile(r"^(?:[-*•–]|\(?\d{1,3}[.)]|[a-z]\))\s")


def sections(text: str) -> str:
    """The text of a source: the sections of a JSON object joined, anything
    else as it is."""
    if text.lstrip()[:1] == "{":
        try:
            parsed = json.loads(text)
        except ValueError:
            return text
        if isinstance(parsed, dict):
            return "\n\n".join(v for k, v in parsed.items() if isinstance(v, str) and k != "extraction_status" and v.strip())
    return text


def _form(line: str) -> str:
    """A line without digits and signs, with confusable letters made alike."""
    line = re.sub(r"rn", "m", re.sub(r"cl", "d", re.sub(r"ii", "u", re.sub(r"vv", "w", line.lower()))))
    return re.sub(r"[\W_2-4679]+", "", line.translate(str.maketrans("c10f5bql8", "eiotshgih")))


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 8:
        return False
    return sum((Counter(a) - Counter(b)).values()) + sum((Counter(b) - Counter(a)).values()) <= 2 and (a[:4] == b[:4] or a[-4:] == b[-4:])


def furniture(lines: list[str]) -> tuple[dict[int, str], bool, bool]:
    """(line numbers of furniture, header found, page number found)."""
    lengths = sorted(len(x) for x in lines if x)
    width = lengths[int(len(lengths) * 0.9)] if lengths else 0
    found: dict[int, str] = {}
    forms: Counter = Counter()
    numbered = False
    for i, x in enumerate(lines):
        if x and _PAGE.match(x):
            # A bare number counts as one only beside a break of the layout or in a row of them.
            bare = x.isdigit()
            beside = i == 0 or i == len(lines) - 1 or not lines[i - 1] or not lines[i + 1] or len(lines[i - 1]) < width - 12
            if not bare or beside or sum(y.isdigit() for y in lines) > 1:
                found[i] = "page"
                numbered = True
    for i, x in enumerate(lines[:-1]):
        if not x or i in found:
            continue
        j = i + 1
        while j < len(lines) and found.get(j) == "page":
            j += 1
        if j >= len(lines) or not lines[j]:
            continue
        letters = re.sub(r"[\W\d_]", "", x)
        unfilled = len(x) + 1 + len(lines[j].split(" ", 1)[0]) <= width - 6
        if unfilled and len(letters) >= 3 and not re.search(r"[.;:,!?]$", re.sub(r"et al\.$", "et al", x)) and not _LISTED.match(x) and not x[0].islower():
            forms[_form(x)] += 1
            found[i] = "header"
    # Headers with the page number, and other occurrences: before a blank line or at the end.
    for i, x in enumerate(lines):
        if not x or i in found:
            continue
        m = _BOTH.match(x)
        form = _form((m[1] or m[2]) if m else x)
        if forms and any(_alike(form, f) for f in forms) and (form in forms or len(x) < width - 6):
            alone = (i == 0 or not lines[i - 1]) and (i + 1 == len(lines) or not lines[i + 1])
            if not alone or forms[form] > 1 or m:
                found[i] = "header"
    for i in [i for i, k in found.items() if k == "header"]:
        if _BOTH.match(lines[i]):
            numbered = True
    return found, any(k == "header" for k in found.values()), numbered


class Trie:
    """A vocabulary with counts, searched by a Levenshtein automaton."""

    def __init__(self, words: dict[str, int]):
        self.words = words
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def within(self, token: str, distance: int, plain: bool = True) -> dict[str, tuple[int, int, bool]]:
        """Each vocabulary word within the distance: (edits, of these other than
        confusions, whether one is faint). Without ``plain``, only confusions
        are edits."""
        best: dict[str, tuple[int, int, bool]] = {}
        seen: dict[tuple, tuple[int, int, bool]] = {}
        n = len(token)
        stack = [(self.root, 0, 0, 0, False)]
        while stack:
            node, i, edits, others, faint = stack.pop()
            state = (id(node), i)
            cost = (edits, others, faint)
            if state in seen and seen[state] <= cost:
                continue
            seen[state] = cost
            if i == n and (w := node.get("")) is not None and (w not in best or cost < best[w]):
                best[w] = cost
            if i < n and (down := node.get(token[i])) is not None:
                stack.append((down, i + 1, edits, others, faint))
            if edits == distance:
                continue
            for size in (1, 2):
                for right in CONFUSIONS.get(token[i : i + size], ()) if i + size <= n else ():
                    down = node
                    for c in right:
                        down = down.get(c) if down is not None else None
                    if down is not None:
                        stack.append((down, i + size, edits + 1, others, faint or token[i : i + size] in FAINT))
            if plain:
                if i < n:
                    stack.append((node, i + 1, edits + 1, others + 1, faint))
                for c, down in node.items():
                    if c:
                        stack.append((down, i, edits + 1, others + 1, faint))
                        if i < n and c != token[i]:
                            stack.append((down, i + 1, edits + 1, others + 1, faint))
        return best


def confused(token: str) -> dict[str, tuple[bool, int]]:
    """The token with one known confusion undone, in each way: (faint?, where)."""
    out: dict[str, tuple[bool, int]] = {}
    for i in range(len(token)):
        for size in (1, 2):
            left = token[i : i + size]
            for right in CONFUSIONS.get(left, ()) if len(left) == size else ():
                new = token[:i] + right + token[i + size :]
                if new != token:
                    out[new] = min(out.get(new, (True, i)), (left in FAINT, i))
    return out


_MIXED = re.compile(r"\d.*[^\W\d_]|[^\W\d_].*\d")


def examined(low: str) -> bool:
    """Whether a token in lower case may be a misread word."""
    if low.isalpha():
        return len(low) > 2 or len(low) > 1 and ("ﬁ" in low or "ﬂ" in low)
    return bool(_MIXED.search(low)) or "ﬁ" in low or "ﬂ" in low


def searches(token: str) -> list[tuple[str, str, int, bool, bool]]:
    """(trie, form, edits so far, faint so far, whether plain edits are tried) of
    each search of a token. Without plain edits a form is looked up with one more
    confusion if it is long, else as it is. Of two confusions one is undone and
    the other looked up: the first one undone leaves the beginning as it should
    be, unless both are there, and then the end is."""
    plain = len(token) > 3 or not token.isalpha()
    out = []
    for form, edits, faint, at in [(token, 0, False, 0), *((form, 1, faint, at) for form, (faint, at) in confused(token).items())]:
        for n in {3 if n >= LONG else 2 for n in range(len(form) - 1, len(form) + 2)}:
            out.append((f"<{n}{form[:n]}", form, edits, faint, plain and not edits))
            if at <= n and (not edits or len(token) > 5):
                out.append((f">{n}{form[-n:]}", form, edits, faint, plain and not edits))
    return out


def shelves(word: str) -> list[str]:
    """The tries that hold a word of the vocabulary."""
    n = 3 if len(word) >= LONG else 2
    return [f"<{n}{word[:n]}", f">{n}{word[-n:]}"]


def looked_up(trie: "Trie", token: str, form: str, edits: int, faint: bool, plain: bool) -> dict[str, tuple[int, int, bool]]:
    """(edits, of these other than confusions, faint?) of the words of a trie
    that a form is within reach of."""
    distance = 1 if not edits else 1 if len(token) > 5 else 0
    found = trie.within(form, distance, plain)
    return {w: (edits + e, o, faint or f) for w, (e, o, f) in found.items() if edits + e}


class Repairer:
    """words: counts of words in texts; pairs: counts of pairs of neighbouring
    words, as ``a b``. candidates: of each token, (word, cost) as the cluster has
    looked them up; without it, the words are the vocabulary, in one trie."""

    def __init__(self, words: dict[str, int], pairs: dict[str, int], candidates: dict[str, list] | None = None):
        self.words, self.pairs, self.candidates = words, pairs, candidates
        self.trie = Trie({w: n for w, n in words.items() if n >= LEAST}) if candidates is None else None

    def _options(self, token: str) -> list[tuple[str, tuple[int, int, bool]]]:
        if self.candidates is not None:
            return self.candidates.get(token, [])
        found: dict[str, tuple[int, int, bool]] = {}
        for form, edits, faint, plain in dict.fromkeys(x[1:] for x in searches(token)):
            for w, c in looked_up(self.trie, token, form, edits, faint, plain).items():
                found[w] = min(found.get(w, c), c, key=_cheapest)
        return sorted(found.items())

    def read(self, token: str, before: str, after: str) -> str | None:
        """What a misread token stands for; None for one that is not misread."""
        low = token.lower()
        alone = low.isalpha()
        ligature = "ﬁ" in low or "ﬂ" in low
        if alone and not ligature and (token.isupper() or len(low) < 3 or self.candidates is not None and low not in self.candidates):
            return None
        if not examined(low):
            return None
        mixed = not alone and bool(_MIXED.search(low))
        own, best = max(1, self.words.get(low, 0)), None
        for w, (edits, others, faint) in self._options(low):
            n = self.words.get(w, 0)
            near = (self.pairs.get(f"{before} {w}", 0) >= PAIRED) + (self.pairs.get(f"{w} {after}", 0) >= PAIRED)
            if n < max(LEAST, RATIOS[near] * own):
                continue
            rank = (near, -others, -edits, not faint, n, w)
            if best is None or rank > best[0]:
                best = (rank, w, near, edits, others, faint)
        if best:
            _, w, near, edits, others, faint = best
            if others:  # a plain edit: between other words the form is a word of its own
                sure = near == 2 and own < LEAST and len(low) > 5 and edits == 1
            else:
                sure = near == 2 or near and not faint and own < LEAST or own < LEAST and not faint and len(low) >= 7 and edits == 1
            if sure or not others and (mixed or ligature):
                return w
        if ligature:
            return low.replace("ﬁ", "fi").replace("ﬂ", "fl")
        if mixed and re.fullmatch(r"[^\W\d_]{2,}[0158][^\W\d_]{2,}|[^\W\d_]{4,}[015]", low) and not token.isupper():
            return low.translate(str.maketrans("0158", "oisb"))
        return None

    def wanted(self, text: str) -> set[tuple[str, str]]:
        """Pairs of words, and words with an empty second, whose counts the
        repair of a text asks for."""
        seen: set[tuple[str, str]] = set()

        class Asked(dict):
            def __init__(self, pair: bool):
                self.pair = pair

            def get(self, key: str, default: int = 0) -> int:
                seen.add(tuple(key.split(" ", 1)) if self.pair else (key, ""))
                return 1 << 30 if self.pair or " " not in key else 0

        asked = Repairer(Asked(False), Asked(True), self.candidates)
        asked.repair(text)
        return seen

    def repair(self, text: str) -> tuple[list[str], str]:
        """(kinds of noise, repaired paragraphs) of a text."""
        lines = [x.rstrip(" \t").lstrip() for x in re.sub(r"\r\n?", "\n", sections(text)).replace("\f", "").replace("\v", "\n").split("\n")]
        found, header, page = furniture(lines)
        paragraphs: list[str] = []
        current, hyphen, pending = "", False, False  # pending: furniture since the last text

        def close():
            nonlocal current
            if current:
                paragraphs.append(current)
            current = ""

        for i, line in enumerate(lines):
            if i in found:
                pending = True
                continue
            if not line:
                # A blank line beside furniture within a sentence is no end of a paragraph.
                k = next((k for k in range(i + 1, len(lines)) if lines[k] and k not in found), None)
                goes_on = k is not None and (lines[k][0].islower() or bool(_BROKEN.search(current[-2:])))
                if not ((pending or i + 1 in found) and current and goes_on and not _ENDED.search(current[-20:])):
                    close()
                continue
            if current and pending and (e := _ENDED.search(current[-20:])) and e[0][0] != ":" and i and not lines[i - 1]:
                close()
            pending = False
            if current and _BROKEN.search(current[-2:]) and (line[0].isalpha()):
                hyphen = True
                right = re.match(r"[^\W_]+", line)
                a, b = re.search(r"[^\W_]*$", current[:-1])[0].lower(), right[0].lower() if right else ""
                whole, parts = self.words.get(a + b, 0), min(self.words.get(a, 0), self.words.get(b, 0))
                compound = (whole < LEAST) & (self.pairs.get(f"{a} {b}", 0) >= PAIRED) & (parts >= LEAST)
                current = current[:-1] + ("-" if compound else "") + line
            else:
                sep = "" if current and ord(current[-1]) > 0x2E80 and ord(line[0]) > 0x2E80 else " "
                current = current + sep + line if current else line
        close()
        glyph, out = False, []
        for p in paragraphs:
            words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(p)]
            lows = ["^", *(w.lower() for _, _, w in words), "$"]
            pieces, at = [], 0
            for k, (lo, hi, w) in enumerate(words):
                new = self.read(w, lows[k], lows[k + 2])
                if new is not None and new != w.lower():
                    glyph = True
                    new = new.upper() if w.isupper() and len(w) > 1 else new[:1].upper() + new[1:] if w[0].isupper() else new
                    pieces += [p[at:lo], new]
                    at = hi
            out.append("".join([*pieces, p[at:]]))
        heads = [lines[i] for i, k in found.items() if k == "header"]
        for x in heads:  # headers are not in the paragraphs, but are misread like them
            words = _WORD.findall(x)
            lows = ["^", *(w.lower() for w in words), "$"]
            glyph = glyph or any((r := self.read(w, lows[k], lows[k + 2])) is not None and r != w.lower() for k, w in enumerate(words))
        kinds = [k for k, on in (("hyphen", hyphen), ("glyph", glyph), ("header", header), ("page", page)) if on]
        return kinds, "\n\n".join(out)


def _cheapest(cost: tuple[int, int, bool]) -> tuple:
    return cost[1], cost[0], cost[2]


def _read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b, n, scanned): words (b empty) and pairs of neighbouring words, with
    the number of texts of the batch that have them, and of scanned ones."""
    for batch in it:
        count, scanned = Counter(), Counter()
        for text, scan in zip(batch["text"], batch["scan"]):
            words = [w.lower() for w in _WORD.findall(re.sub(rf"[{HYPHENS}]\n", "", sections(text)))]
            found = {(w, "") for w in words} | set(zip(words, words[1:]))
            if scan:  # tokens as the repair sees them, too: a hyphen at a line end apart
                scanned.update({(w.lower(), "") for w in _WORD.findall(text)} | {x for x in found if not x[1]})
            count.update(found)
        yield pd.DataFrame([(*x, count[x], scanned[x]) for x in count.keys() | scanned.keys()], columns=["a", "b", "n", "scanned"])


def lexicon(texts: DataFrame, text: str = "text", scan: Column | None = None) -> DataFrame:
    """(a, b, n, scanned) of words and pairs over all texts, summed by batches of
    them; null texts have none. scan: which texts are to be repaired."""
    rows = spread(texts.select(F.col(text).alias("text"), (F.lit(True) if scan is None else scan).alias("scan")).where("text IS NOT NULL"))
    summed = rows.mapInPandas(_read, "a string, b string, n long, scanned long")
    return cut(summed.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("scanned").alias("scanned")))


def candidates(known: DataFrame) -> DataFrame:
    """(token, found): of each token of a scanned text the words of the
    vocabulary within reach, as (word, edits, others, faint), that are in enough
    more texts than the token."""
    words = known.where("b = ''").select(F.col("a").alias("w"), "n", "scanned")
    spelled = words.where((F.col("n") >= LEAST) & ~F.col("w").rlike(r"\d"))

    def stock(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            rows = [(f"{key}|{salt}", w, w, n, 0, False, False) for w, n in zip(batch["w"], batch["n"]) for key in shelves(w) for salt in range(SALTS)]
            yield pd.DataFrame(rows, columns=_ASKED)

    def ask(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            rows = [(f"{key}|{zlib.crc32(t.encode()) % SALTS}", t, form, -max(1, n), edits, faint, plain) for t, n in zip(batch["w"], batch["n"]) if examined(t) for key, form, edits, faint, plain in searches(t)]
            yield pd.DataFrame(rows, columns=_ASKED)

    def search(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shelf, held, trie = None, {}, None  # a trie's words come before what is looked up in it
        for batch in it:
            out = []
            for key, token, form, n, edits, faint, plain in zip(*(batch[c] for c in _ASKED)):
                if key != shelf:
                    shelf, held, trie = key, {}, None
                if n > 0:
                    held[token] = n
                    continue
                if trie is None:
                    trie = Trie(held)
                for w, (e, o, f) in looked_up(trie, token, form, edits, faint, plain).items():
                    if held[w] >= RATIOS[2] * -n:
                        out.append((token, w, e, o, f))
            yield pd.DataFrame(out, columns=["token", "w", "edits", "others", "faint"])

    schema = "key string, token string, form string, n long, edits int, faint boolean, plain boolean"
    rows = spelled.mapInPandas(stock, schema).unionByName(words.where("scanned > 0").select("w", "n").mapInPandas(ask, schema))
    rows = spread(rows, "key").sortWithinPartitions("key", F.desc("n"))
    found = rows.mapInPandas(search, "token string, w string, edits int, others int, faint boolean")
    cost = F.struct("others", "edits", "faint")
    least = found.groupBy("token", "w").agg(F.min(cost).alias("c"))
    return least.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("w", "c.edits", "c.others", "c.faint"))).alias("found"))


_ASKED = ["key", "token", "form", "n", "edits", "faint", "plain"]


def repaired(texts: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """(key, kinds, repaired) of each distinct key with a text: kinds is empty
    for a clean text. Rows of one key are one text (the least one counts); null
    and empty texts have no row. known: of ``lexicon``."""
    rows = spread(texts.where(F.col(key).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("k"), F.col(text).alias("text")), "k")
    rows = rows.groupBy("k").agg(F.min("text").alias("text"))
    kind = rows.schema["k"].dataType.simpleString()

    def tokens(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            found = [(k, t) for k, text in zip(batch["k"], batch["text"]) for t in {w.lower() for form in (text, re.sub(rf"[{HYPHENS}]\s*", "", text)) for w in _WORD.findall(sections(form))} if examined(t)]
            yield pd.DataFrame(found, columns=["k", "token"])

    def options(found) -> dict[str, list]:
        return {x["token"]: [(c["w"], (c["edits"], c["others"], c["faint"])) for c in x["found"]] for x in found} if found is not None else {}

    def ask(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            out = [(k, a, b) for k, text, found in zip(batch["k"], batch["text"], batch["found"]) for a, b in Repairer({}, {}, options(found)).wanted(text)]
            yield pd.DataFrame(out, columns=["k", "a", "b"])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            out = []
            for k, text, found, counts in zip(batch["k"], batch["text"], batch["found"], batch["counts"]):
                counts = [] if counts is None else counts
                words = {x["a"]: x["n"] for x in counts if not x["b"]}
                pairs = {f"{x['a']} {x['b']}": x["n"] for x in counts if x["b"]}
                out.append((k, *Repairer(words, pairs, options(found)).repair(text)))
            yield pd.DataFrame(out, columns=["k", "kinds", "repaired"])

    suspect = rows.mapInPandas(tokens, f"k {kind}, token string").join(candidates(known), "token")
    suspect = suspect.groupBy("k").agg(F.collect_list(F.struct("token", "found")).alias("found"))
    rows = cut(rows.join(suspect, "k", "left"))
    counts = rows.mapInPandas(ask, f"k {kind}, a string, b string").join(known.select("a", "b", "n"), ["a", "b"])
    counts = counts.groupBy("k").agg(F.collect_list(F.struct("a", "b", "n")).alias("counts"))
    return spread(rows.join(counts, "k", "left"), "k").mapInPandas(run, f"k {kind}, kinds array<string>, repaired string").withColumnRenamed("k", key)


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "sources").select("source_id", "level", "text")
    scan = F.col("level").isin("pdf_text", "ocr")
    return repaired(sources.where(scan), "source_id", "text", lexicon(sources, "text", F.coalesce(scan, F.lit(False))))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Scanned sources and the kinds of noise that they hold."""
    return _scanned(spark, d).select("source_id", F.explode("kinds").alias("kind"))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The noisy sources with their repaired running paragraphs."""
    return cut(_scanned(spark, d)).where(F.size("kinds") > 0)


QUERIES = {"p4_found": p4_found, "p4_repaired": p4_repaired}
SQL: dict[str, str] = {}

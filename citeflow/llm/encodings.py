"""Text that was decoded with the wrong character encoding.

Candidates are chains of wrong decodings undone: the text (or the parts of it
that can be read so) is encoded as it was wrongly decoded and decoded as it
should have been. Each candidate and the text itself are compressed with zstd
under a dictionary of each language; description length is the smallest size
over the languages plus a cost for each step of the chain. The shortest wins; a
text that no chain shortens stays as it is. What was lost for good (replacement
characters, stray control characters within words) marks a text as damaged that
cannot be restored."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeflow.runtime import cut, spread, table

#: Encodings of one byte a character that text is wrongly read in.
SINGLE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp866", "koi8_r", "iso8859-15")
#: Encodings of several bytes, and what the bytes may have been.
MULTI = (("gb18030", "utf-8"), ("big5", "utf-8"), ("cp932", "utf-8"), ("cp949", "utf-8"), ("big5", "gb18030"), ("cp932", "gb18030"), ("cp949", "gb18030"))
#: Encodings of two bytes a character whose text may have been read in one of
#: one byte.
DOUBLE = ("gb18030", "cp932", "big5", "cp949", "euc_jp")
#: Encodings in which UTF-8 is often misread; a step through another one, or to
#: a target other than UTF-8 (whose validity proves little), costs more.
COMMON = ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251", "gb18030")
#: Longest chain; bytes that a step costs, and one that is not common.
STEPS, STEP_BYTES, RARE_BYTES = 3, 0.5, 12
#: Bytes for each distinct character outside the alphabet of all languages: it
#: is in under ALPHABET of the documents of each.
ESCAPE_BYTES, ALPHABET = 2, 0.03
#: Bytes of a dictionary, and least bytes of a phrase in it: zstd matches no less.
DICTIONARY, PHRASE = 32_768, 4
#: Characters of a text that are counted at a time.
PIECE = 1 << 16
CONTEXT = 24

_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_CJK = re.compile(r"[ᄀ-ᇿ⺀-鿿가-힯豈-﫿＀-￯]")
_CJK_RUNS = re.compile(f"{_CJK.pattern}{{2,}}")
_RUNS = re.compile(r"[^\x00-\x7f]{2,}")
_WIDE = re.compile(r"[^\x00-\x7f�]{2,}")
_ANY = re.compile(r"[^\x00-\x7f�]+")
#: Characters of which every other one may be ASCII, as second bytes are.
_PAIRS = re.compile(r"(?:[^\x00-\x7f�][@-~]?){2,}")
#: A replacement character beside a letter or digit, a C1 control, or bytes of
#: replacement characters that were themselves read wrongly.
_LOST = re.compile(r"�|[\x80-\x84\x86-\x9f]|锟斤拷|ï¿½")


class _Table(dict):
    """Characters to the byte that stands for them, as a character; ASCII stays,
    all else becomes NUL."""

    def __missing__(self, code: int) -> int:
        return code if code < 128 else 0


def _byte_table(codec: str) -> _Table:
    out = _Table()
    for b in range(128, 256):
        try:
            out.setdefault(ord(bytes([b]).decode(codec)), b)
        except UnicodeDecodeError:
            out.setdefault(b, b)  # undefined bytes pass through as controls
    return out


_TABLES = {c: _byte_table(c) for c in SINGLE}
_REPERTOIRE = {name: {chr(c) for c in t} for name, t in _TABLES.items()}
_CHARACTERS = {name: {b: chr(c) for c, b in t.items() if c != b or name == "latin-1"} for name, t in _TABLES.items()}
_PAIRED = [(wrong, right) for wrong in SINGLE for right in SINGLE if right != wrong]
#: Characters that a text misread twice may have after the first step.
_WESTERN = {chr(c) for name in ("cp1252", "mac_roman") for c in _TABLES[name]}


def undo(text: str, wrong: str, right: str = "utf-8") -> tuple[str, list[tuple[int, int, str]]]:
    """The text with every part that reads as ``right`` when encoded in
    ``wrong`` put right, and these parts as (from, to, new)."""
    parts: list[tuple[int, int, str]] = []
    if right == "utf-8" and wrong in _TABLES:
        for run in _RUNS.finditer(text):  # UTF-8 of more than a byte has no ASCII in it
            for m in _UTF8.finditer(run[0].translate(_TABLES[wrong])):
                try:
                    parts.append((run.start() + m.start(), run.start() + m.end(), m[0].encode("latin-1").decode("utf-8")))
                except UnicodeDecodeError:
                    pass
    elif wrong in _TABLES:
        for m in (_ANY if right in _TABLES else _PAIRS).finditer(text):
            for part in {m[0]: 0, m[0].rstrip("@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_`abcdefghijklmnopqrstuvwxyz{|}~"): 0}:  # ASCII at the end may be no second byte
                try:
                    new = part.translate(_TABLES[wrong]).encode("latin-1").decode(right)
                except UnicodeError:
                    continue
                if new != part and "\0" not in new and new.isprintable():
                    parts.append((m.start(), m.start() + len(part), new))
                    break
    else:
        for m in _WIDE.finditer(text):
            try:
                new = m[0].encode(wrong).decode(right)
            except UnicodeError:
                continue
            if new != m[0] and new.isprintable():
                parts.append((m.start(), m.end(), new))
    return replaced(text, parts), parts


def replaced(text: str, parts: list[tuple[int, int, str]]) -> str:
    """The text with the parts put in."""
    out, at = [], 0
    for lo, hi, new in parts:
        out += [text[at:lo], new]
        at = hi
    return "".join([*out, text[at:]])


def _script(char: str) -> str:
    """First word of a letter's Unicode name, which tells its script; empty for
    what is no letter."""
    return unicodedata.name(char, "?").split(" ", 1)[0] if unicodedata.category(char)[0] == "L" else ""


class Repairer:
    """Chooses the chain of least description length. dictionaries: bytes of a
    zstd dictionary by language; with none, plain zstd serves."""

    def __init__(self, dictionaries: dict[str, bytes], alphabet: str = "", scripts: set[str] | None = None):
        self.alphabet = {chr(i) for i in range(128)} | set(alphabet)
        self.scripts = scripts and scripts | {"", "LATIN"}
        # Of each character, the steps of one byte to one byte (as bits) that make it a letter of the alphabet.
        self.letters: dict[str, int] = {}
        for i, (wrong, right) in enumerate(_PAIRED):
            for code, byte in _TABLES[wrong].items():
                new = _CHARACTERS[right].get(byte, "")
                if new in self.alphabet and new.isalpha():
                    self.letters[chr(code)] = self.letters.get(chr(code), 0) | 1 << i
        kept = zstandard.ZstdCompressionParameters.from_level(6, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        self.by = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d) if d else None, compression_params=kept) for d in list(dictionaries.values()) or [b""]]

    def length(self, text: str) -> int:
        raw = text.encode("utf-8", "surrogatepass")
        return min(len(c.compress(raw)) for c in self.by) + ESCAPE_BYTES * len(set(text) - self.alphabet)

    def _steps(self, text: str) -> list[tuple[str, str, list[tuple[int, int, str]]]]:
        """Each way to undo one wrong decoding, by name: (name, new text, parts).
        A part that holds UTF-8 has two or more characters beyond ASCII in a row;
        one of another encoding of one or two bytes a character needs at least
        one that is not of the alphabet, as text of the alphabet alone cannot
        become more plausible. Encodings that have none of a text's characters
        are not tried."""
        runs = "".join(_RUNS.findall(text))
        chars = set(runs)
        odd = {c for c in text if c > "\x7f"} - self.alphabet - {"�"}
        if not runs and not odd:
            return []
        wide = bool(_CJK.search(runs))
        tries = [(c, "utf-8") for c in SINGLE if not chars.isdisjoint(_REPERTOIRE[c])] + [m for m in MULTI if wide]
        if odd:
            tries += self._odd_steps(text, odd)
        out, seen = [], set()
        for wrong, right in tries:
            _, parts = undo(text, wrong, right)
            parts = [p for p in parts if self._plausible(text[p[0] : p[1]], p[2], right)]
            new = replaced(text, parts)
            if parts and new not in seen:
                seen.add(new)
                out.append((f"{wrong}>{right}", new, parts))
        return out

    def _odd_steps(self, text: str, odd: set[str]) -> list[tuple[str, str]]:
        """Steps between other encodings than UTF-8 that some run with an odd
        character allows: those that turn all of it into letters of the alphabet,
        or into two and more characters of two bytes."""
        masks = 0
        for run in {r for r in _ANY.findall(text) if not odd.isdisjoint(r)}:
            mask = -1
            for c in run:
                mask &= self.letters.get(c, 0)
            masks |= mask
        out = [pair for i, pair in enumerate(_PAIRED) if masks >> i & 1]
        runs = [(r, {c for c in r if c > "\x7f"}) for r in {r for r in _PAIRS.findall(text) if len(r) > 3 and not odd.isdisjoint(r)}]
        for wrong in SINGLE:
            held = " ".join(r for r, high in runs if high <= _REPERTOIRE[wrong])
            out += [(wrong, right) for right in DOUBLE if held and any(len(new) > 1 and self._plausible(held[lo:hi], new, right) for lo, hi, new in undo(held, wrong, right)[1])]
        return out

    def _plausible(self, old: str, new: str, right: str) -> bool:
        """Whether a part may be put right so: its letters are of scripts that
        the corpus has and, where validity proves little, more of it is of the
        alphabet than before."""
        if self.scripts and any(_script(c) not in self.scripts and c not in _WESTERN for c in new):
            return False
        share = lambda t: sum(c in self.alphabet for c in t) / len(t)
        if right in _TABLES and not all(c in self.alphabet and c.isalpha() for c in new if c > "\x7f"):
            return False  # any byte is some character there: only letters of the alphabet tell
        return right == "utf-8" or share(new) > share(old)

    def _foreign(self, parts: list[tuple[int, int, str]]) -> bool:
        """Whether over a fifth of what a step brings is outside the alphabet."""
        new = [c for _, _, p in parts for c in p]
        return sum(c not in self.alphabet for c in new) > 0.2 * len(new)

    def gain(self, text: str, new: str, parts: list[tuple[int, int, str]]) -> int:
        """Bytes saved around the changed parts, before the cost of the step."""
        windows: list[list[int]] = []
        for lo, hi, _ in parts:
            if windows and lo - CONTEXT <= windows[-1][1]:
                windows[-1][1] = hi + CONTEXT
            else:
                windows.append([max(0, lo - CONTEXT), hi + CONTEXT])
        before, after, shift, k = [], [], 0, 0
        for lo, hi in windows:
            hi = min(hi, len(text))
            start = lo + shift
            while k < len(parts) and parts[k][1] <= hi:
                shift += len(parts[k][2]) - (parts[k][1] - parts[k][0])
                k += 1
            before.append(text[lo:hi])
            after.append(new[start : hi + shift])
        return self.length("\n".join(before)) - self.length("\n".join(after))

    def repair(self, text: str) -> tuple[str, str, int]:
        """(text put right, chain, bytes saved); the chain is empty for a text
        that is left unchanged."""
        best = (text, "", 0)
        front, reached = [best], {text: 0.0}
        for _ in range(STEPS):
            following: dict[str, tuple[str, str, float]] = {}
            for now, chain, saved in front:
                for name, new, parts in self._steps(now):
                    wrong, right = name.split(">")
                    usual = wrong in COMMON and right == "utf-8"
                    if not usual and self._foreign(parts):
                        continue
                    total = saved + self.gain(now, new, parts) - (STEP_BYTES if usual else RARE_BYTES)
                    # Of chains that lead to one text the shortest goes on, also where it has saved nothing yet.
                    if total > reached.get(new, -math.inf):
                        reached[new] = total
                        following[new] = (new, f"{chain} {name}".strip(), total)
            front = sorted(following.values(), key=lambda x: (-x[2], x[1]))
            if not front:
                break
            if front[0][2] > best[2]:
                best = front[0]
        return best


def dictionaries(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[dict[str, bytes], str, set[str]]:
    """A zstd dictionary of each language, the alphabet and the scripts of all,
    each counted over all rows.

    A dictionary holds the phrases that save most, by their counts in all texts
    of its language that have no replacement or control characters and nothing
    that undoes to letters of the alphabet. Languages are as labelled, in lower
    case; for the alphabet, missing labels are one language."""
    label = F.lower(F.trim(lang))
    rows = docs.select(F.coalesce(label, F.lit("")).alias("l"), F.col(text).alias("t")).where("t <> ''")
    counted = cut(spread(rows).mapInPandas(_characters, "l string, c string, n long").groupBy("l", "c").agg(F.sum("n").alias("n")))
    size = counted.where("c = ''").select("l", F.col("n").alias("docs"))
    usual = F.max(F.col("n") >= F.greatest(F.lit(2), ALPHABET * F.col("docs")))
    # No more rows than Unicode has characters, whatever the languages.
    chars = counted.where("c <> ''").join(size, "l").groupBy("c").agg(usual.alias("usual")).collect()
    alphabet = "".join(sorted(r["c"] for r in chars if r["usual"]))

    def phrases(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = set(alphabet)
        for batch in it:
            count: dict[str, Counter] = {}
            for l, t in zip(batch["l"], batch["t"]):
                if _sound(t, known):
                    _phrases(t, count.setdefault(l, Counter()))
            out = [(l, p, n) for l, of in count.items() for p, n in of.items()]
            yield pd.DataFrame(out, columns=["l", "p", "n"])

    clean = docs.select(label.alias("l"), F.col(text).alias("t")).where((F.col("l").isNotNull()) & (F.length("t") > 0) & ~F.col("t").rlike("[\\x{fffd}\\x{80}-\\x{9f}]"))
    summed = spread(clean).mapInPandas(phrases, "l string, p string, n long").groupBy("l", "p").agg(F.sum("n").alias("n")).where("n > 1")
    # A dictionary holds no more phrases than these.
    best = Window.partitionBy("l").orderBy((F.col("n") * (F.octet_length("p") - PHRASE + 1)).desc(), "p")
    kept = summed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= DICTIONARY // PHRASE)
    made = kept.groupBy("l").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "p"))), lambda x: x["p"]).alias("phrases")).orderBy("l")
    fitted = {r["l"]: _dictionary(r["phrases"]) for r in made.toLocalIterator()}
    return fitted, alphabet, {_script(r["c"]) for r in chars}


def _sound(text: str, alphabet: set[str]) -> bool:
    """Whether no part of a text undoes to letters of the alphabet, so that a
    dictionary will hold no garbled text."""
    return text.isascii() or not any(set(new) <= alphabet for c in COMMON if c in _TABLES for _, _, new in undo(text, c)[1])


def _phrases(text: str, count: Counter) -> None:
    """Counts the phrases of a text: words and pairs of words with the blank
    before them, and of scripts without blanks two to four characters in a row."""
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE]
        words = [f" {w}" for w in piece.split() if len(w) <= 40]
        count.update(w for w in words if len(w) >= PHRASE)
        count.update(map("".join, zip(words, words[1:])))
        for run in _CJK_RUNS.findall(piece):
            for n in (2, 3, 4):
                count.update(run[i : i + n] for i in range(len(run) - n + 1))


def _dictionary(phrases: list[str]) -> bytes:
    """The first phrases that fit, the best of them last, as near matches are
    the cheapest. What a better phrase holds already is left out."""
    out, held = [], ""
    size = 0
    for p in phrases:
        raw = p.encode("utf-8", "surrogatepass")
        if len(raw) < PHRASE or p in held:
            continue
        if size + len(raw) > DICTIONARY:
            break
        out.append(raw)
        held += p + "\n"
        size += len(raw)
    return b"".join(reversed(out))


def _characters(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(language, character, documents that have it) summed within a batch; the
    empty character stands for all documents. Parts that can be read as UTF-8 in
    some encoding and characters that are lost do not count, lest garbled text
    be taken for a script of its own; nor does ASCII."""
    for batch in it:
        count: Counter = Counter()
        for l, t in zip(batch["l"], batch["t"]):
            runs = " ".join(re.findall(r"[^\x00-\x7f]+", t))
            used = set(runs)
            if _RUNS.search(runs):
                codecs = [c for c in SINGLE if not used.isdisjoint(_REPERTOIRE[c])] + [c for c, right in MULTI if right == "utf-8" and _CJK.search(runs)]
                garbled = [(lo, hi) for c in codecs for lo, hi, _ in undo(runs, c)[1]]
                if garbled:
                    out = {i for lo, hi in garbled for i in range(lo, hi)}
                    used = {c for i, c in enumerate(runs) if i not in out}
            count.update((l, c) for c in used if c > "\x9f" and c != "�" and not 0xD800 <= ord(c) < 0xE000)
            count[l, ""] += 1
        yield pd.DataFrame([(l, c, n) for (l, c), n in count.items()], columns=["l", "c", "n"])


def _alphabet(samples: dict[str, list[str]]) -> set[str]:
    out = set()
    for texts in samples.values():
        seen = Counter(c for t in texts for c in set(t))
        out |= {c for c, n in seen.items() if n >= max(2, ALPHABET * len(texts))}
    return out


def fit(samples: dict[str, list[str]]) -> tuple[dict[str, bytes], str, set[str]]:
    """Dictionaries, alphabet and scripts of given texts by language, as
    ``dictionaries`` makes them of a table."""
    alphabet = _alphabet(samples)
    out = {}
    for lang, texts in samples.items():
        count: Counter = Counter()
        for t in texts:
            if _sound(t, alphabet):
                _phrases(t, count)
        ranked = sorted((p for p, n in count.items() if n > 1), key=lambda p: (-count[p] * (len(p.encode("utf-8", "surrogatepass")) - PHRASE + 1), p))
        out[lang] = _dictionary(ranked)
    scripts = {_script(c) for texts in samples.values() for t in texts for c in t}
    return out, "".join(sorted(alphabet)), scripts


def find(docs: DataFrame, key: str, text: str, fitted: tuple[dict[str, bytes], str, set[str]]) -> DataFrame:
    """(key, chain, saved, lost, repaired) of each garbled row: repaired is the
    text put right, null where no chain helps; lost tells that characters are
    gone for good. Null, empty and ASCII texts are never garbled; rows
    whose key is null are left out; a repeated key has a row for each garbled
    text. fitted: of ``dictionaries``, of bounded size, sent to the tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    kind = docs.schema[key].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = Repairer(*shared.value)
        for batch in it:
            out = []
            for k, t in zip(batch["k"], batch["t"]):
                new, chain, saved = repairer.repair(t)
                lost = bool(_LOST.search(new)) and bool(_LOST.search(t))
                if chain or lost:
                    out.append((k, chain, saved, lost, new if chain else None))
            yield pd.DataFrame(out, columns=["k", "chain", "saved", "lost", "repaired"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").rlike("[^\\x00-\\x7f]") & F.col("k").isNotNull())
    return spread(rows).mapInPandas(run, f"k {kind}, chain string, saved double, lost boolean, repaired string").withColumnRenamed("k", key)


def _found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    return find(docs, "doc_id", "text", dictionaries(docs))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents read in a wrong encoding, in whole or in part."""
    return _found(spark, d).select("doc_id").distinct()


def p9_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The garbled documents with the chain that puts them right and the text."""
    return _found(spark, d)


QUERIES = {"p9_found": p9_found, "p9_repaired": p9_repaired}
SQL: dict[str, str] = {}

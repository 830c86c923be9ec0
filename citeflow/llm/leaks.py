"""Evaluation texts leaking into training text, by suffix arrays.

The corpus is cut into shards of a bounded number of words; each task builds the
suffix array of its shard over word ids and binary-searches every suffix of every
test text in it. The neighbours of the place where a suffix would stand share the
longest prefixes with it, which gives its longest verbatim match and, as ranges of
the array, the places of all matches of each length from SEED words on.

A pair of a document and a test text leaks if the document has the whole test
text, or a passage of at least PASSAGE words of it verbatim or altered: of the
passage, KEPT are in the document in the same order and near one another, among
them at least half of the words that few other test texts have. Candidates for
altered passages are pairs that share matches of SEED words; they are aligned
word by word.

Test texts are a stated query set: they are read in blocks of bounded size and
each block is sent to all shards. In how many test texts a word occurs is counted
over all blocks, so results do not depend on how they are cut. Words that no test
text has are one id, as no match can hold them; nothing else of the corpus is left
out."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.runtime import cut, spread, table

#: Words of a shard; a single longer document is a shard of its own.
SHARD = 400_000
#: Bytes of test text in one block.
BLOCK_BYTES = 8_000_000
#: Least words of a verbatim match that counts as a place.
SEED = 3
PASSAGE, KEPT = 15, 0.75
#: Words to which suffixes are sorted, if no test text is longer.
DEPTH = 64
#: Places of matches that are held at a time; those of one test text are together.
PLACES = 2_000_000

_MARKS = re.compile(r"\[@[^\]\s]{1,80}\]|<[^<>]{1,80}>|[*_`#>|\\]+|-[ \t]*\n[ \t>]*")
_WORD = re.compile(r"\w+(?:[.,]\d+)*")


def words(text: str) -> list[str]:
    """Words in lower case, without markup, citations, layout and punctuation;
    a word broken at a line end by a hyphen is whole again."""
    return _WORD.findall(_MARKS.sub(lambda m: "" if m[0][0] == "-" or m[0][0] in "*_`" else " ", text).lower().replace("­", "").replace("​", ""))


def rarity(items: DataFrame) -> DataFrame:
    """(w, n): the words that more than one of the test texts have, and how many
    do; counted in the cluster."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            yield pd.DataFrame([(w,) for t in batch["text"] for w in set(words(t))], columns=["w"])

    return items.where("text IS NOT NULL").select("text").mapInPandas(run, "w string").groupBy("w").agg(F.count("*").alias("n")).where("n > 1")


class Tests:
    """A block of test texts as one sequence of word ids, with 0 between. few:
    texts that may have a word for it to be a text's own; common: words that more
    have, by default as counted in the block."""

    def __init__(self, items: list[tuple[int, str]], few: int | None = None, common: set[str] | None = None):
        self.ids = [i for i, _ in items]
        texts = [words(t or "") for _, t in items]
        self.vocabulary: dict[str, int] = {}
        seen: dict[int, int] = defaultdict(int)
        self.texts = []
        for t in texts:
            self.texts.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in t])
            for w in set(self.texts[-1]):
                seen[w] += 1
        few = max(2, len(items) // 50) if few is None else few
        self.own = np.zeros(len(self.vocabulary) + 1, dtype=bool)
        for w, i in self.vocabulary.items():
            self.own[i] = w not in common if common is not None else seen[i] <= few
        flat, item, at = [], [], []
        for k, t in enumerate(self.texts):
            flat += [*t, 0]
            item += [k] * (len(t) + 1)
            at += range(len(t) + 1)
        self.flat = np.array(flat + [0] * DEPTH, dtype=np.int32)
        self.item, self.at = np.array(item, dtype=np.int32), np.array(at, dtype=np.int32)


def suffix_array(seq: np.ndarray, depth: int = 0) -> np.ndarray:
    """Order of the suffixes of seq that begin with SEED words other than 0, by
    prefix doubling up to depth words (DEPTH at least), which is to be the length
    of the longest test text. A 0 ends the comparison."""
    n = len(seq)
    rank = seq.astype(np.int64)
    live = np.ones(n, dtype=bool)
    for k in range(SEED):
        live[: n - k] &= seq[k:] != 0
        live[max(0, n - k) :] = False
    width = 1
    while width < max(depth, DEPTH):
        after = np.zeros(n, dtype=np.int64)
        after[: n - width] = rank[width:]
        key = np.where(rank == 0, 0, rank * (int(rank.max()) + 1) + after) if rank.max() < 2**31 else rank
        _, rank = np.unique(key, return_inverse=True)
        rank = np.where(key == 0, 0, rank + 1)
        width *= 2
        if len(np.unique(rank[live])) == live.sum():
            break
    starts = np.flatnonzero(live)
    return starts[np.argsort(rank[starts], kind="stable")]


def _compare(seq: np.ndarray, at: np.ndarray, flat: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether the suffix of seq is less, words in common) for each pair of
    places; a 0 ends a suffix and is less than any word."""
    common, less = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=bool)
    live = np.arange(len(at))
    while len(live):
        x, y = seq[np.minimum(at[live] + common[live], len(seq) - 1)], flat[np.minimum(query[live] + common[live], len(flat) - 1)]
        on = (x == y) & (x != 0)
        less[live[~on]] = x[~on] < y[~on]
        live = live[on]
        common[live] += 1
    return less, common


def search(seq: np.ndarray, order: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffix of the tests, its longest match in words, low, high): low to high
    is the range of the suffix array whose entries begin with the suffix's first
    SEED words. Suffixes without such a match are left out. All suffixes are
    searched at once, a step of the binary search at a time; whole suffixes are
    compared, so the two entries beside the place found have the longest match."""
    flat = tests.flat
    n = len(flat) - DEPTH
    query = np.flatnonzero(np.all([flat[k : n + k] != 0 for k in range(SEED)], axis=0))
    none = np.array([], dtype=np.int64)
    if not len(order) or not len(query):
        return none, none, none, none

    def bound(less_than: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        lo, hi = np.zeros(len(query), dtype=np.int64), np.full(len(query), len(order), dtype=np.int64)
        while len(go := np.flatnonzero(lo < hi)):
            mid = (lo[go] + hi[go]) // 2
            up = less_than(order[mid], query[go])
            lo[go], hi[go] = np.where(up, mid + 1, lo[go]), np.where(up, hi[go], mid)
        return lo

    place = bound(lambda at, q: _compare(seq, at, flat, q)[0])
    longest = np.zeros(len(query), dtype=np.int64)
    for beside in (place - 1, place):
        there = (beside >= 0) & (beside < len(order))
        longest[there] = np.maximum(longest[there], _compare(seq, order[beside[there]], flat, query[there])[1])
    some = longest >= SEED
    query, place, longest = query[some], place[some], longest[some]
    head = np.stack([flat[query + k] for k in range(SEED)], axis=1)

    def first(right: bool) -> np.ndarray:  # the ends of the range, from the place found outwards
        lo, hi = (place.copy(), np.full(len(query), len(order), dtype=np.int64)) if right else (np.zeros(len(query), dtype=np.int64), place.copy())
        while len(go := np.flatnonzero(lo < hi)):
            mid = (lo[go] + hi[go]) // 2
            same = np.all(np.stack([seq[order[mid] + k] for k in range(SEED)], axis=1) == head[go], axis=1)
            up = same if right else ~same
            lo[go], hi[go] = np.where(up, mid + 1, lo[go]), np.where(up, hi[go], mid)
        return lo

    return query, longest, first(False), first(True)


def aligned(doc: list[int], test: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Longest common subsequence: for each word of the test text, whether it is
    kept, and at which word of the document. Among equal ones, kept words lie
    as close together as the first choice from the end allows."""
    a, b = np.array(test, dtype=np.int32), np.array(doc, dtype=np.int32)
    n, m = len(a), len(b)
    best = np.zeros((n + 1, m + 1), dtype=np.int32)
    for i in range(1, n + 1):
        step = np.where(b == a[i - 1], best[i - 1, :-1] + 1, best[i - 1, 1:])
        best[i, 1:] = np.maximum.accumulate(np.maximum(step, best[i - 1, 1:]))
    place = np.full(n, -1, dtype=np.int64)
    i, j = n, m
    while i and j:
        if a[i - 1] == b[j - 1] and best[i, j] == best[i - 1, j - 1] + 1:
            place[i - 1] = j - 1
            i, j = i - 1, j - 1
        elif best[i - 1, j] >= best[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return place >= 0, place


def passage(kept: np.ndarray, place: np.ndarray, own: np.ndarray) -> bool:
    """Whether some run of PASSAGE or more words of the test text, or all of a
    shorter one, is kept."""
    n = len(kept)
    if n < PASSAGE:
        at = place[kept]
        return bool(len(at) >= KEPT * n and (kept & own).sum() >= max(2, 0.5 * own.sum()) and at[-1] - at[0] <= 1.5 * n + 6)
    total, mine, mine_kept = (np.concatenate([[0], np.cumsum(x)]) for x in (kept, own, kept & own))
    first = np.where(kept, place, 1 << 40)
    for size in range(PASSAGE, min(n, 2 * PASSAGE) + 1):
        lo, hi = np.arange(n - size + 1), np.arange(size, n + 1)
        good = (total[hi] - total[lo] >= KEPT * size) & kept[lo] & kept[hi - 1]
        own_all, own_kept = mine[hi] - mine[lo], mine_kept[hi] - mine_kept[lo]
        good &= (own_kept >= 2) & (own_kept >= 0.5 * own_all)
        good &= place[hi - 1] - first[lo] <= 1.5 * size + 6
        if good.any():
            return True
    return False


def _shard(keys: list, seqs: list[list[int]], tests: Tests) -> list[tuple]:
    """(doc, test, longest verbatim match in words, its places in the document
    and in the test text, leaked?) of a shard."""
    lengths = np.array([len(s) + 1 for s in seqs])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    seq = np.zeros(int(ends[-1]) + DEPTH, dtype=np.int32)
    for at, s in zip(starts, seqs):
        seq[at : at + len(s)] = s
    order = suffix_array(seq, max(map(len, tests.texts), default=0))
    query, longest, low, high = search(seq, order, tests)
    out = []
    counts = high - low
    of = tests.item[query]
    lo = 0
    while lo < len(query):  # whole test texts at a time
        hi = int(np.searchsorted(np.cumsum(counts[lo:]), PLACES, side="right")) + lo
        hi = int(np.searchsorted(of, of[max(lo, hi - 1)], side="right"))
        out += _places(keys, seqs, tests, seq, order, starts, ends, query[lo:hi], low[lo:hi], counts[lo:hi])
        lo = hi
    return out


def _places(keys: list, seqs: list[list[int]], tests: Tests, seq: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, query: np.ndarray, low: np.ndarray, counts: np.ndarray) -> list[tuple]:
    rep = np.repeat(np.arange(len(query)), counts)
    pos = order[np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
    q = query[rep]
    length = _compare(seq, pos, tests.flat, q)[1]
    doc = np.searchsorted(ends, pos, side="right")
    item, at = tests.item[q], tests.at[q]
    group = defaultdict(list)
    for d, k, p, a, n in zip(doc.tolist(), item.tolist(), (pos - starts[doc]).tolist(), at.tolist(), length.tolist()):
        group[d, k].append((p, a, n))
    out = []
    for (d, k), found in group.items():
        test = tests.texts[k]
        longest, in_doc, in_test = max(((n, p, a) for p, a, n in found), key=lambda x: (x[0], -x[1], -x[2]))
        covered: set[int] = set()
        for _, a, n in found:
            covered.update(range(a, a + n))
        mine = {test[a] for a in covered if tests.own[test[a]]}
        hit = longest >= min(PASSAGE, len(test))
        if not hit and len(covered) >= min(6, KEPT * len(test)) and len(mine) >= 2:
            # The places where the test text would begin; each stretch of the document is aligned once.
            spans: list[list[int]] = []
            for p, a, _ in sorted(found):
                lo, hi = max(0, p - int(1.4 * a) - 10), min(len(seqs[d]), p + int(1.4 * (len(test) - a)) + 10)
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
            own = tests.own[np.array(test)]
            for lo, hi in spans:
                for cut_lo in range(lo, hi, 4096):  # a merged stretch is aligned by overlapping pieces
                    part = seqs[d][cut_lo : min(hi, cut_lo + 4096 + 2 * len(test))]
                    kept, place = aligned(part, test)
                    if passage(kept, place, own):
                        hit = True
                        break
                    if cut_lo + 4096 + 2 * len(test) >= hi:
                        break
                if hit:
                    break
        if hit or longest >= 5:
            out.append((keys[d], tests.ids[k], longest, in_doc, in_test, hit))
    return out


_OUT = ["doc_id", "item_id", "longest", "doc_word", "item_word", "leaked"]


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, longest, doc_word, item_word, leaked): pairs that share a
    verbatim match of at least five words or a leaked passage; how many words the
    longest match has, and at which word of each text it begins (from 0; the first
    of several).

    docs: doc_id, text; items: item_id, text. Null and empty texts match
    nothing, nor do rows whose id is null. Keys may repeat; each row counts by
    itself and results are distinct. Other columns may have any name. A test
    text of under PASSAGE words leaks as a whole, one of under SEED words never:
    a phrase of a few words is no case."""
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).head()[0]
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    spark, out = docs.sparkSession, None
    few = max(2, items.where("text IS NOT NULL").count() // 50)
    # Words that so many texts have: at most 50 times as many as a text has on average.
    common = {r["w"] for r in rarity(items).where(F.col("n") > few).collect()}
    held = spread(docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text"))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text")
        rows = [tuple(r) for r in part.distinct().collect()]  # a bounded block of the query set
        shared = spark.sparkContext.broadcast(Tests(rows, few, common))

        def run(it: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            tests, keys, seqs, size = shared.value, [], [], 0
            get = tests.vocabulary.get
            for batch in it:
                found = []
                for key, text in zip(batch["doc_id"], batch["text"]):
                    seq = [get(w, 0) for w in words(text)]
                    keys.append(key)
                    seqs.append(seq)
                    size += len(seq)
                    if size >= SHARD:
                        found += _shard(keys, seqs, tests)
                        keys, seqs, size = [], [], 0
                if found:
                    yield pd.DataFrame(found, columns=_OUT)
            if seqs:
                yield pd.DataFrame(_shard(keys, seqs, tests), columns=_OUT)

        got = held.mapInPandas(run, f"doc_id {kind}, item_id {item_kind}, longest int, doc_word int, item_word int, leaked boolean")
        out = got if out is None else out.unionByName(got)
    return out.distinct()


def without_leaks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the documents that hold a leaked passage."""
    return docs.join(found.where("leaked").select("doc_id").distinct(), "doc_id", "left_anti")


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return matches(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the test items that they leak."""
    return _matches(spark, d).where("leaked").select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """For each leaked item: documents that hold it, and its longest verbatim
    match in words."""
    return _matches(spark, d).where("leaked").groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("longest").alias("longest_words"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the documents that remain when affected ones are removed."""
    return without_leaks(table(spark, d, "documents").select("doc_id"), cut(_matches(spark, d))).select("doc_id")


QUERIES = {"p8_found": p8_found, "p8_items": p8_items, "p8_clean": p8_clean}
SQL: dict[str, str] = {}
